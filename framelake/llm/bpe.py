"""Token ids by a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

_IRREGULAR = re.compile(r"\s\s|\A\s|\s\Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space as the vocabulary's pattern has it, in runs too long for its regular expression.
_LONG = re.compile(r"(?<![\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The ids of `tokenizers` for a byte-level BPE file, as little-endian unsigned 32-bit bytes.

    Texts are encoded with the same vocabulary as ranks, which is several times as fast; a text that holds a
    special token's string goes to `tokenizers` itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.by_ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ordinary(self, text: str) -> list[int]:
        """The ids, special tokens' strings taken as text.

        A run of white space is a pre-token, but for its last character if something follows. Very long runs go to
        `tokenizers` by themselves; what stands before and after is encoded as it would be in place.
        """
        if len(text) < 10_000 or not _LONG.search(text):
            return self.by_ranks(text)
        ids, at = [], 0
        for run in _LONG.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.by_ranks(text[at : run.start()])
            ids += self.whole.encode(text[run.start() : end], add_special_tokens=False).ids
            at = end
        return ids + self.by_ranks(text[at:])

    def parts(self, text: str) -> list[str]:
        """The text cut at the single spaces between two characters that aren't white space; the pattern of this
        vocabulary never continues a pre-token over one. Each part but the first goes with the space before it."""
        return _CUT.split(text) if _IRREGULAR.search(text) else text.split(" ")

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ordinary(text), "<u4").tobytes()


@cache
def encoder(tokenizer: str, ranks: str) -> Encoder:
    """One for each worker process."""
    return Encoder(tokenizer, ranks)

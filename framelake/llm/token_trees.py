"""Token counts that follow edits.

Every document keeps a segment tree over its pre-token segments: a text is cut at single spaces between
characters that aren't white space, where the vocabulary's pre-tokens always end, and LEAF consecutive parts are
a leaf with its number of characters and of tokens; inner nodes hold the sums of their children. An edit finds
its first and last leaf by descending over character sums. The text of those leaves and of one leaf on each side
(the boundary context) is encoded anew, once for all edits whose leaves meet, put in the place of the first, and the
sums above are updated. The rest of the document isn't encoded again. A region that edits have made large is dealt out as
new leaves. Trees are stored with their documents, and edits are applied to what is stored.

Edits are (first, end, replacement) in code points of the original text. They are taken in order of their
place; one that reaches beyond the text ends with it, one that overlaps an earlier one is left out.

Defined cases: a null or empty text has no tokens and a tree of one empty leaf; edits may fill it. Null edits
are none. The string of a special token is ordinary text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm._shared import cut
from framelake.llm.bpe import Encoder, encoder, vocabulary

LEAF, LARGE = 16, 64
EDITS = "array<struct<first: int, end: int, replacement: string>>"
#: What a redaction replaces: mail addresses, secrets in assignments, addresses and long numbers, licence lines.
REDACTIONS = (
    (re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<email>"),
    (re.compile(r"\b(?:password|passwd|secret|token|api_?key)\s*[=:]\s*\S+", re.IGNORECASE), "<secret>"),
    (re.compile(r"\b(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,}"), "<secret>"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<address>"),
    (re.compile(r"\+?\d[\d ()-]{7,}\d"), "<number>"),
    (re.compile(r"^Licensed under [^\n]*\n?", re.MULTILINE), ""),
)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that take personal data, secrets and licence lines out; at one place the first pattern counts."""
    found = sorted((m.start(), k, m.end(), new) for k, (pattern, new) in enumerate(REDACTIONS) for m in pattern.finditer(text))
    out: list[tuple[int, int, str]] = []
    for first, _, end, new in found:
        if not out or first >= out[-1][1]:
            out.append((first, end, new))
    return out


class TokenTree:
    """Sums of characters and tokens over leaves, in heap order: node k has the children 2k and 2k + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, text: str, encode: Encoder, parts_per_leaf: int = LEAF) -> TokenTree:
        return cls.over(*_leaves(text, encode, parts_per_leaf))

    @classmethod
    def over(cls, chars: np.ndarray, tokens: list[int] | np.ndarray) -> TokenTree:
        """The sums over these leaves."""
        size = 1 << max(len(chars) - 1, 0).bit_length()
        sums = []
        for leaves in (chars, tokens):
            tree = np.zeros(2 * size, np.int32)
            tree[size : size + len(leaves)] = leaves
            level = size
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
                level //= 2
            sums.append(tree)
        return cls(*sums)

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and where it starts; beyond the text the last that isn't empty."""
        node, before, at = 1, 0, min(at, max(int(self.chars[1]) - 1, 0))
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        chars, tokens = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def around(self, first: int, end: int) -> tuple[int, int]:
        """The leaves that an edit touches, and one with text on each side."""
        low, high = self.leaf_at(first)[0], self.leaf_at(max(end - 1, first))[0]
        low, high = low - 1, high + 1
        while low > 0 and not self.chars[self.size + low]:
            low -= 1
        while high < self.size - 1 and not self.chars[self.size + high]:
            high += 1
        return max(low, 0), min(high, self.size - 1)


def _leaves(text: str, encode: Encoder, parts_per_leaf: int) -> tuple[np.ndarray, list[int]]:
    """Characters and tokens of the leaves of a text."""
    lengths = np.array([len(p) + 1 for p in encode.parts(text)], np.int32)
    lengths[0] -= 1
    sizes, at, counts = np.add.reduceat(lengths, np.arange(0, len(lengths), parts_per_leaf)), 0, []
    for n in sizes.tolist():
        counts.append(len(encode.ordinary(text[at : at + n])))
        at += n
    return sizes, counts


def apply_edits(tree: TokenTree, text: str, edits: list[tuple[int, int, str]], encode: Encoder) -> tuple[TokenTree, str, int, int]:
    """The new tree and text, the number of edits made, and of parts encoded anew.

    Edits whose leaves (context included) meet are one region, encoded once, so the work grows with what the edits touch.
    """
    taken, reach = [], 0
    for first, end, new in sorted(edits, key=lambda x: x[:2]):
        first, end = max(first, 0), min(max(end, first, 0), len(text))
        if first >= reach and first <= len(text):
            taken.append((first, max(end, first), new or ""))
            reach = max(end, first)
    if not taken:
        return tree, text, 0, 0
    regions: list[tuple[int, int, list[tuple[int, int, str]]]] = []
    for e in taken:
        low, high = tree.around(*e[:2])
        if regions and low <= regions[-1][1]:
            low, before, some = regions.pop()
            some.append(e)
            regions.append((low, max(before, high), some))
        else:
            regions.append((low, high, [e]))
    bounds = np.concatenate([[0], np.cumsum(tree.chars[tree.size :], dtype=np.int64)])
    out, at, touched, dealt = [], 0, 0, {}
    for low, high, some in regions:
        start, stop = int(bounds[low]), int(bounds[high + 1])
        pieces, here = [], start
        for first, end, new in some:
            pieces += [text[here:first], new]
            here = end
        region = "".join([*pieces, text[here:stop]])
        n = len(encode.parts(region))
        touched += n
        out += [text[at:start], region]
        at = stop
        if n > LARGE * LEAF:
            dealt[low] = (high, *_leaves(region, encode, LEAF))
            continue
        count = len(encode.ordinary(region))
        for leaf in range(low + 1, high + 1):
            if tree.chars[tree.size + leaf]:
                tree.set(leaf, 0, 0)
        tree.set(low, len(region), count)
    if dealt:  # large regions become leaves of the usual size; other leaves keep their sums
        sums: list[list[np.ndarray]] = [[], []]
        leaf = 0
        for low, (high, sizes, counts) in sorted(dealt.items()):
            for column, old, new in zip(sums, (tree.chars, tree.tokens), (sizes, counts), strict=True):
                column += [old[tree.size + leaf : tree.size + low], np.asarray(new, np.int32)]
            leaf = high + 1
        for column, old in zip(sums, (tree.chars, tree.tokens), strict=True):
            column.append(old[tree.size + leaf :])
        chars, tokens = map(np.concatenate, sums)
        used = chars > 0
        tree = TokenTree.over(chars[used], tokens[used])
    return tree, "".join([*out, text[at:]]), len(taken), touched


def with_redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns to keep, edits (redactions) for every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    schema = T.StructType([*rows.schema.fields, T.StructField("edits", T.DataType.fromDDL(EDITS))])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [[{"first": a, "end": b, "replacement": c} for a, b, c in redactions(x.as_py() or "")] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def build_trees(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """docs: doc_id, text, edits. Adds chars and tokens, the document's tree in heap order."""
    files = (tokenizer or vocabulary("byte_bpe_50k.json"), ranks or vocabulary("byte_bpe_50k.tiktoken"))
    rows = docs.select("doc_id", "text", "edits")
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*rows.schema.fields, T.StructField("chars", ints, False), T.StructField("tokens", ints, False)])

    def run(batches):
        encode = encoder(*files)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                trees = [TokenTree.build(x.as_py() or "", encode) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists([t.chars for t in trees]), _lists([t.tokens for t in trees])], names=schema.names)

    return rows.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def update_trees(trees: DataFrame, with_trees: bool = True, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """trees: build_trees(). doc_id, n_tokens_before, n_edits, n_parts_encoded, n_tokens; and the new text and tree, to be stored."""
    files = (tokenizer or vocabulary("byte_bpe_50k.json"), ranks or vocabulary("byte_bpe_50k.tiktoken"))
    ints = T.ArrayType(T.IntegerType(), False)
    fields = [trees.schema["doc_id"], *(T.StructField(n, T.LongType(), False) for n in ("n_tokens_before", "n_edits", "n_parts_encoded", "n_tokens"))]
    schema = T.StructType(fields + [T.StructField("text", T.StringType(), False), T.StructField("chars", ints, False), T.StructField("tokens", ints, False)] * with_trees)
    rows = trees.select("doc_id", "text", "edits", "chars", "tokens")

    def run(batches):
        encode = encoder(*files)
        for batch in batches:
            counts, texts, new = [[], [], [], []], [], []
            for text, edits, chars, tokens in zip(*batch.columns[1:], strict=True):
                text, edits = text.as_py() or "", [(e["first"], e["end"], e["replacement"]) for e in edits.as_py() or ()]
                tree = TokenTree(*(x.values.to_numpy(zero_copy_only=False).copy() for x in (chars, tokens)))
                before = int(tree.tokens[1])
                tree, text, n, touched = apply_edits(tree, text, edits, encode) if edits else (tree, text, 0, 0)
                for column, value in zip(counts, (before, n, touched, int(tree.tokens[1])), strict=True):
                    column.append(value)
                if with_trees:
                    texts.append(text)
                    new.append(tree)
            more = [pa.array(texts, pa.string()), _lists([t.chars for t in new]), _lists([t.tokens for t in new])] if with_trees and new else []
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *more], names=schema.names)

    return rows.mapInArrow(run, schema)


def count_redacted(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens_before, n_edits, n_parts_encoded, n_tokens of every row of docs after its redactions: trees are stored first, then updated."""
    none = F.lit(None).cast(EDITS).alias("edits")
    stored = cut(build_trees(docs.select("doc_id", "text", none)).drop("edits"), "token-trees")
    edits = with_redactions(stored, keep=("chars", "tokens"))
    return update_trees(edits, with_trees=False)

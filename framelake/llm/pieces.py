"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A vocabulary is a list of pieces with log scores. The trie (Aoe's double array: one base and one check entry per
node) is built once on the driver and has the vocabulary's size. A text gets a dummy prefix, its spaces become
markers, and the segmentation with the largest sum of scores is taken; a character that no piece covers costs
the least score less 10 and is encoded as bytes. Of equal sums that which is found first stays (earliest start
of the last piece, as in SentencePiece).

No piece of such vocabularies holds a marker after another character (this is checked), so the best
segmentation of a text is that of its words, each with the markers before it, and equal words are encoded once
(a bounded memory per worker).

A vocabulary file that holds merge ranks and not log probabilities gets Zipf scores, -log(rank).

Defined cases: a null or empty text has no ids and decodes to an empty text. A marker character in a text
decodes to a space, as in SentencePiece. Bytes that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
PENALTY, WORDS, LONGEST = 10.0, 300_000, 48
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    #: Ids that the trie holds, and the id of each byte.
    normal: list[int]
    bytes: list[int]
    unknown: int = 0

    @classmethod
    def load(cls, path: str, zipf: bool | None = None) -> Vocabulary:
        """From a .model file. zipf: None chooses by whether the scores are ranks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        pieces, scores = [sp.id_to_piece(i) for i in every], [sp.get_score(i) for i in every]
        normal = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if zipf is None:
            zipf = sum(scores[i] == int(scores[i]) for i in normal) > len(normal) // 2
        if zipf:
            for rank, i in enumerate(normal, 1):
                scores[i] = -log(rank + 1)
        by = {int(pieces[i][3:5], 16): i for i in every if sp.is_byte(i)}
        return cls(pieces, scores, normal, [by.get(b, sp.unk_id()) for b in range(256)], sp.unk_id())


@dataclass
class Trie:
    """node t is a child of s by byte c if t = base[s] + c + 1 and check[t] = s; value[t] is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, v in keys.items():
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    values.append(-1)
                at = children[at][c]
            values[at] = v
        size = 2 * len(children) + 512
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], value[0], todo, free, wide = 0, values[0], deque([(0, 0)]), 257, 257
        while todo:
            node, slot = todo.popleft()
            codes = sorted(children[node])
            if not codes:
                continue
            while check[free] >= 0:
                free += 1
            first = free if len(codes) == 1 else max(free, wide)  # single children fill the gaps
            b = max(first - codes[0] - 1, 0)
            while any(check[b + c + 1] >= 0 for c in codes):
                b += 1
                if b + 514 > len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
            base[slot] = b
            if len(codes) > 1 and b + codes[0] + 1 - first > 64:
                wide = b + codes[0] + 1
            if b + 514 > len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
            for c in codes:
                check[b + c + 1], value[b + c + 1] = slot, values[children[node][c]]
                todo.append((children[node][c], b + c + 1))
        return cls(np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32))


class Codec(dict):
    """Encoding and decoding with one vocabulary; a memory of words already encoded."""

    def __init__(self, vocabulary: Vocabulary, trie: Trie | None = None):
        super().__init__()
        self.vocabulary, v = vocabulary, vocabulary
        if any(MARK in v.pieces[i].lstrip(MARK) for i in v.normal):
            raise ValueError("a piece has a marker after another character")
        self.trie = trie or Trie.build({v.pieces[i].encode(): i for i in v.normal})
        self.base, self.check, self.value = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()
        self.unknown = min((v.scores[i] for i in v.normal), default=0.0) - PENALTY
        self.arrays = (self.trie.base.astype(np.int64), self.trie.check, self.trie.value, np.array(v.scores), self.unknown)
        self.is_byte = {b: k for k, b in enumerate(v.bytes) if b != v.unknown}
        self.texts = [p.replace(MARK, " ") for p in v.pieces]

    def best(self, word: str) -> list[int]:
        """The ids of the best segmentation."""
        data, base, check, value, scores = word.encode(), self.base, self.check, self.value, self.vocabulary.scores
        n, size = len(data), len(self.check)
        total, back = [None] * (n + 1), [(0, -1)] * (n + 1)
        total[0] = 0.0
        for at in range(n):
            here = total[at]
            if here is None:
                continue
            width = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            node, alone = 0, False
            for end in range(at, n):
                t = base[node] + data[end] + 1
                if t >= size or check[t] != node:
                    break
                node = t
                if (piece := value[t]) >= 0:
                    alone |= end + 1 - at == width
                    if (s := here + scores[piece]) > (total[end + 1] if total[end + 1] is not None else float("-inf")):
                        total[end + 1], back[end + 1] = s, (at, piece)
            if not alone and (s := here + self.unknown) > (total[at + width] if total[at + width] is not None else float("-inf")):
                total[at + width], back[at + width] = s, (at, -1)
        out, at = [], n
        while at:
            first, piece = back[at]
            out.extend([piece] if piece >= 0 else [self.vocabulary.bytes[c] for c in reversed(data[first:at])])
            at = first
        return out[::-1]

    def best_many(self, words: list[str]) -> list[bytes]:
        """best() of many words at once, as little-endian unsigned 32-bit bytes: the same steps for all words at a time."""
        if not words:
            return []
        base, check, value, scores, unknown = self.arrays
        data = [w.encode() for w in words]
        size = np.array([len(d) for d in data])
        wide = int(size.max())
        chars = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in data), np.uint8).reshape(-1, wide)
        total = np.full((len(data), wide + 5), -np.inf)
        start, piece = np.zeros((len(data), wide + 5), np.int32), np.full((len(data), wide + 5), -1, np.int32)
        total[:, 0] = 0
        for at in range(wide):
            rows = np.flatnonzero((size > at) & (total[:, at] > -np.inf))
            if not len(rows):
                continue
            lead = chars[rows, at]
            width = 1 + (lead >= 192) + (lead >= 224) + (lead >= 240)
            here, alone = total[rows, at], np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for end in range(at, wide):
                t = base[node] + chars[rows[live], end] + 1
                on = (check[t] == node) & (size[rows[live]] > end)
                live, node = live[on], t[on]
                if not len(live):
                    break
                ids = value[node]
                some = np.flatnonzero(ids >= 0)
                if not len(some):
                    continue
                who, got = live[some], ids[some]
                alone[who[width[who] == end + 1 - at]] = True
                sums = here[who] + scores[got]
                better = sums > total[rows[who], end + 1]
                who, at_rows = who[better], rows[who[better]]
                total[at_rows, end + 1], start[at_rows, end + 1], piece[at_rows, end + 1] = sums[better], at, got[better]
            other = np.flatnonzero(~alone)
            if len(other):
                at_rows, to = rows[other], at + width[other]
                better = here[other] + unknown > total[at_rows, to]
                at_rows, to = at_rows[better], to[better]
                total[at_rows, to], start[at_rows, to], piece[at_rows, to] = here[other][better] + unknown, at, -1
        out, many = np.zeros((len(data), wide), "<u4"), np.zeros(len(data), np.int64)
        at, odd = size.copy(), np.zeros(len(data), bool)
        rows = np.arange(len(data))
        while len(rows):
            got = piece[rows, at[rows]]
            odd[rows] |= got < 0
            many[rows] += 1
            out[rows, wide - many[rows]] = np.maximum(got, 0)
            at[rows] = start[rows, at[rows]]
            rows = rows[at[rows] > 0]
        flat = out.tobytes()
        found = [flat[4 * (k * wide + wide - n) : 4 * (k + 1) * wide] for k, n in enumerate(many.tolist())]
        for k in np.flatnonzero(odd):
            found[k] = np.array(self.best(words[k]), "<u4").tobytes()
        return found

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known, those of about equal length together."""
        new = sorted((w for w in words if w not in self and len(w) <= LONGEST), key=len)
        if len(self) + len(new) > WORDS:
            self.clear()
            new = sorted((w for w in words if len(w) <= LONGEST), key=len)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.update(zip(some, self.best_many(some), strict=True))

    def __missing__(self, word: str) -> bytes:
        return np.array(self.best(word), "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn({w for words in cut for w in words})
        return [b"".join([self[w] for w in words]) for words in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        texts, numbers = self.texts, np.frombuffer(ids, "<u4").tolist()
        if self.is_byte.keys().isdisjoint(numbers):
            text = "".join([texts[i] for i in numbers])
        else:
            text = b"".join([bytes((self.is_byte[i],)) if i in self.is_byte else texts[i].encode() for i in numbers]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec for a broadcast vocabulary and trie."""
    if shared.value[2] not in _codecs:
        _codecs.clear()
        _codecs[shared.value[2]] = Codec(*shared.value[:2])
    return _codecs[shared.value[2]]


def _share(df: DataFrame, vocabulary: Vocabulary):
    codec = Codec(vocabulary)
    return df.sparkSession.sparkContext.broadcast((vocabulary, codec.trie, zlib.crc32("\n".join(vocabulary.pieces).encode() + np.array(vocabulary.scores).tobytes())))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids (array of int) for every row of docs; text as it was."""
    rows, shared = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), _share(docs, vocabulary)
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = codec.encode_many([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(data)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _lists(data: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) // 4 for x in data)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), np.int32)))


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded: doc_id, text, ids. Adds n_ids, n_byte_ids, ids_crc32, log_score and decoded; ids are dropped."""
    shared = _share(encoded, vocabulary)
    more = [("n_ids", T.LongType()), ("n_byte_ids", T.LongType()), ("ids_crc32", T.LongType()), ("log_score", T.DoubleType()), ("decoded", T.StringType())]
    schema = T.StructType([encoded.schema["doc_id"], encoded.schema["text"], *(T.StructField(n, t, False) for n, t in more)])

    def run(batches):
        codec = _codec(shared)
        scores, is_byte = np.array(codec.vocabulary.scores), np.zeros(len(codec.vocabulary.pieces), bool)
        is_byte[list(codec.is_byte)] = True
        for batch in batches:
            columns = [[], [], [], [], []]
            for x in batch.column(2):
                ids = x.values.to_numpy(zero_copy_only=False).astype("<u4")
                data = ids.tobytes()
                for column, value in zip(columns, (len(ids), int(is_byte[ids].sum()), zlib.crc32(data), float(scores[ids].sum()), codec.decode(data)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True))], names=schema.names)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (unsigned, little-endian 32-bit ids), log_score, and whether decoding gives the text back."""
    back = decode_documents(encode_documents(docs, vocabulary), vocabulary)
    return back.select("doc_id", "n_ids", "n_byte_ids", "ids_crc32", "log_score", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))

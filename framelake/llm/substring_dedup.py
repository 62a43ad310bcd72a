"""Removal of passages that earlier documents hold, with compressed FM-indexes per shard.

A window is `width` consecutive words. A word is removed if a window that covers it also starts in a document
with a smaller doc_id. Windows reach their shard by their minimizer, the least hash among the word groups in the
window, so equal windows always meet:

1. Every row gives its distinct minimizers with their windows and runs, written once. Those of one row only can't belong
   to a repeated window; they are counted with partial aggregation and dropped by a join that AQE may split.
2. Runs of windows with the same minimizer become segments (the words of the run). Minimizers that stand for more words
   than a quarter of a shard, be it by many rows or by rows that repeat a template, give a segment for each window,
   dealt out by the window's own hash. Equal segments of a batch are one, with references to the rows that hold it: a piece is
   what a batch has for one shard. The number of shards follows from all these words, so a shard's are bounded.
3. Each shard becomes an FM-index, written once and removed when all pieces have passed it: the suffixes of its
   distinct segments are sorted by `width` words, their Burrows-Wheeler transform is stored as a wavelet matrix of
   packed bits, with the lengths that neighbours share and the least document of each repeated window. Intervals
   are widened by packed bits for each length, with the nearest words of them that hold any.
4. The pieces are streamed against their shard's index. Backward search computes matching statistics from the
   right: a match grows by one word to the left; where it can't, it's shortened on the right to the interval that
   encloses it, and goes on. Places whose match has `width` words are reported with the interval's least document.
5. Reports and references meet by piece, never by content, so the many holders of a segment don't meet in a task.
   Each row drops the intervals that are reported for a smaller document.

Hash collisions can only bring windows together that needn't meet: windows are compared by their words.

Defined cases: null and empty texts have no words. Rows with a null doc_id stay whole and count for nobody.
Rows that repeat a doc_id are the same document: none of them covers the others; equal texts get equal results.
A text of any length is worked on in slices; what is held at once for a row are 16 bytes a word.
"""

from __future__ import annotations

import hashlib
import io
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm._shared import Scratch

WIDTH, GROUP = 13, 5
#: Words of a shard (before equal segments become one); words of a minimizer beyond which its windows are dealt out one by one; windows of a segment, bytes worked on at once, segments of a piece's batch, tasks over all shards (beyond that, a task takes its shards one after another).
SHARD, HOT, RUN, BYTES, PIECES_HELD, TASKS = 250_000, 60_000, 64, 1 << 20, 100_000, 20_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones((2, 1), np.uint64)


def _power_tables(n: int) -> np.ndarray:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    global _powers
    while _powers.shape[1] < n:
        size = _powers.shape[1]
        step = np.array([[pow(int(_BASE), size, 1 << 64)], [pow(int(_BASE), -size, 1 << 64)]], np.uint64)
        _powers = np.concatenate([_powers, _powers * step], axis=1)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(data: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """Where parts of about `most` bytes begin, and the parts; cut between words."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        if end < len(data):
            found = _WORD.match(data, end)
            end = found.end() if found else end
        yield at, data[at:end]
        at = end


class Words:
    """The words of some texts: where each starts and ends in `data`, its text and its hash."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, part in _slices(self.data, 2 * BYTES):
            raw = np.frombuffer(part, np.uint8)
            solid = ~_SPACE[raw]
            edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
            start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            powers = _power_tables(len(raw) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[0, : len(raw)], dtype=np.uint64)])
            hashes.append(_mix((sums[end] - sums[start]) * powers[1, start]))
            starts.append(start + at)
            ends.append(end + at)
        self.starts, self.ends, self.hash = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.of = np.searchsorted(first, self.starts, side="right") - 1

    def windows(self, width: int, group: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows start (within one text), and their minimizers (48 bits)."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n - group + 1, np.uint64)
        for k in range(group):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : k + len(h)]
        h, span, have = _mix(h), width - group + 1, 1
        while have < span:
            step = min(have, span - have)
            h = np.minimum(h[:-step], h[step:])
            have += step
        at = np.flatnonzero(self.of[: n - width + 1] == self.of[width - 1 :])
        return at, h[at] >> np.uint64(16)


def _chunks(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of about BYTES together, and the index of the first. Of a batch, no more than that is held at once."""
    first, some, size = 0, [], 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BYTES:
            yield first, some
            first, some, size = k, [], 0
        some.append(t)
        size += len(t) + 1
    if some:
        yield first, some


def _utf8(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


def _runs(of: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices at which runs of neighbouring windows of one text with one minimizer begin and end, of RUN windows at most."""
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
    first = np.flatnonzero(new)
    age = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
    first = np.flatnonzero(age % RUN == 0)
    return first, np.append(first[1:], len(at))


def minimizers(rows: DataFrame, width: int, group: int) -> DataFrame:
    """rows: row, text. h, row, windows, runs for the distinct minimizers of each row."""

    def run(batches):
        for batch in batches:
            for k, texts in _chunks(_utf8(batch.column(1))):
                words = Words(texts)
                at, least = words.windows(width, group)
                if not len(at):
                    continue
                first, end = _runs(words.of, at, least)
                owner, h = words.of[at[first]], least[first]
                order = np.lexsort((h, owner))
                owner, h, size = owner[order], h[order], (end - first)[order]
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
                windows, runs = np.add.reduceat(size, new), np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column(0).take(pa.array(owner[new] + k)), pa.array(windows), pa.array(runs)], names=["h", "row", "windows", "runs"])

    return rows.mapInArrow(run, "h long, row long, windows long, runs long")


def _pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the text as a compressed binary column of the same name: what a shuffle writes shrinks to two thirds."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text_col else f for f in docs.schema.fields])
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            columns = batch.columns
            columns[place] = pa.array((_pack(x.as_py()) if x.is_valid else None for x in columns[place].cast(pa.binary())), pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _unpack(column: Iterable[pa.Scalar]) -> Iterator[bytes | None]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(x.as_py()) if x.is_valid else None for x in column)


class _Pieces:
    """The segments of a batch, equal ones once, with their shards and the rows that hold them."""

    def __init__(self, shards: int):
        self.shards, self.known, self.keys = shards, {}, array("Q")
        self.of, self.doc, self.row, self.start = array("i"), array("q"), array("q"), array("i")

    def add(self, text: bytes, key: int, doc: int, row: int, start: int) -> None:
        """key: what the segment's shard depends on."""
        of = self.known.setdefault(text, len(self.known))
        if of == len(self.keys):
            self.keys.append(key)
        self.of.append(of)
        self.doc.append(doc)
        self.row.append(row)
        self.start.append(start)

    def batch(self) -> pa.RecordBatch:
        """A row for each shard: words (segments joined by line ends, compressed), least and most (documents of each segment), and of, doc, row, start of the references."""
        of, doc, row, start = (np.frombuffer(x, x.typecode) for x in (self.of, self.doc, self.row, self.start))
        low, high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, of, doc)
        np.maximum.at(high, of, doc)
        shard = (_mix(np.frombuffer(self.keys, np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
        size = np.diff(np.append(first, len(order)))
        place = np.empty(len(order), np.int32)  # of a segment in its piece
        place[order] = np.arange(len(order)) - np.repeat(first, size)
        texts = list(self.known)
        words = [_pack(b"\n".join([texts[k] for k in order[a : a + n].tolist()])) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
        ref = np.argsort(shard[of], kind="stable")
        held = np.diff(np.searchsorted(shard[of][ref], np.append(shard[order][first], self.shards)))
        lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(x))
        columns = [pa.array(shard[order][first]), pa.array(words, pa.binary()), lists(low[order], size), lists(high[order], size),
                   lists(place[of][ref], held), lists(doc[ref], held), lists(row[ref], held), lists(start[ref], held)]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "words", "least", "most", "of", "doc", "row", "start"])


PIECES = "shard long, words binary, least array<bigint>, most array<bigint>, of array<int>, doc array<bigint>, row array<bigint>, start array<int>"


def pieces(rows: DataFrame, width: int, group: int, shards: int) -> DataFrame:
    """rows: doc, row, text (packed), hits (array of h, hot; null: every window). PIECES: what each batch of rows has for each shard."""

    def run(batches):
        for batch in batches:
            hits, found = batch.column(3), _Pieces(shards)
            ids, row = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys, hot = (hits.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            bounds, chosen = hits.offsets.to_numpy(), hits.is_valid().to_numpy(zero_copy_only=False)
            for k, texts in _chunks(x or b"" for x in _unpack(batch.column(2))):
                words = Words(texts)
                at, least = words.windows(width, group)
                if not len(at):
                    continue
                spread = np.zeros(len(at), bool)
                mine = ~chosen[words.of[at] + k]
                here = slice(bounds[k], bounds[k + len(texts)])
                if here.start < here.stop:
                    # A pair of row and minimizer is one number; two that fall together only bring a segment too many.
                    owner = np.repeat(np.arange(len(texts)), np.diff(bounds[k : k + len(texts) + 1])).astype(np.uint64)
                    pair = _mix(keys[here].view(np.uint64) ^ _mix(owner))
                    order = np.argsort(pair)
                    pair, is_hot = pair[order], hot[here][order]
                    want = _mix(least ^ _mix(words.of[at].astype(np.uint64)))
                    place = np.minimum(np.searchsorted(pair, want), len(pair) - 1)
                    same = pair[place] == want
                    spread, mine = same & is_hot[place], mine | same
                at, least, spread = at[mine], least[mine], spread[mine]
                if not len(at):
                    continue
                first, end = _runs(words.of, at, least)
                data, starts, ends, of = words.data, words.starts.tolist(), words.ends.tolist(), words.of[at].tolist()
                base = np.searchsorted(words.of, np.arange(len(texts))).tolist()
                for a, b in zip(first.tolist(), end.tolist(), strict=True):
                    s, who, split = int(at[a]), of[a], bool(spread[a])
                    for x, n in [(s + j, 1) for j in range(b - a)] if split else [(s, b - a)]:
                        text = b" ".join(data[starts[x] : ends[x + n + width - 2]].split())
                        found.add(text, _own_key(text) if split else int(least[a]), ids[who + k], row[who + k], x - base[who])
                if len(found.known) > PIECES_HELD:
                    yield found.batch()
                    found = _Pieces(shards)
            if found.known:
                yield found.batch()

    return rows.mapInArrow(run, PIECES)


def _own_key(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank of a symbol in a sequence, from packed bits and counts per 64 of them."""

    def __init__(self, bits: np.ndarray, zeros: np.ndarray):
        """bits: a row of 64-bit words for each level, the highest bit of the symbols first. zeros: of each level."""
        self.bits, self.zeros = bits, zeros
        self.counts = np.zeros((bits.shape[0], bits.shape[1] + 1), np.int64)
        np.cumsum(np.bitwise_count(bits), axis=1, out=self.counts[:, 1:])

    @classmethod
    def of(cls, symbols: np.ndarray, levels: int) -> WaveletMatrix:
        bits, zeros = np.zeros((levels, len(symbols) // 64 + 1), np.uint64), np.zeros(levels, np.int64)
        for k, level in enumerate(reversed(range(levels))):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            some = np.packbits(bit, bitorder="little")
            bits[k].view(np.uint8)[: len(some)] = some
            zeros[k] = len(symbols) - int(bit.sum())
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        return cls(bits, zeros)

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place; counted from where the symbol's part of the last level starts."""
        levels = len(self.zeros)
        for k, level in enumerate(reversed(range(levels))):
            word = places >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & _BELOW[places & 63])
            places = np.where((symbols >> level) & 1, self.zeros[k] + ones, places - ones)
        return places


class Edges:
    """Where neighbouring suffixes share less than d symbols, as packed bits for each d; the nearest such places on either side."""

    def __init__(self, shared: np.ndarray, width: int):
        """shared: of each place and the one before; 0 at both ends, which are edges of every length."""
        n = len(shared)
        edge = np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), -1, shared).astype(np.int8)
        self.bits = np.zeros((width + 1, n // 64 + 1), np.uint64)
        for d in range(1, width + 1):
            some = np.packbits(edge < d, bitorder="little")
            self.bits[d].view(np.uint8)[: len(some)] = some
        place, any_ = np.arange(self.bits.shape[1], dtype=np.int32), self.bits != 0
        last = np.maximum.accumulate(np.where(any_, place, -1), axis=1)
        self.before = np.concatenate([np.full((width + 1, 1), -1, np.int32), last[:, :-1]], axis=1)
        following = np.minimum.accumulate(np.where(any_, place, len(place))[:, ::-1], axis=1)[:, ::-1]
        self.after = np.concatenate([following[:, 1:], np.full((width + 1, 1), len(place), np.int32)], axis=1)
        self.counts = np.append(0, np.cumsum(np.bitwise_count(self.bits[width]), dtype=np.int64))
        self.width = width

    def left(self, d: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The last edge of length d (1 or more) at or before place."""
        word = place >> 6
        x = self.bits[d, word] & (_BELOW[place & 63] | (np.uint64(1) << (place & 63).astype(np.uint64)))
        none = np.flatnonzero(x == 0)
        word[none] = self.before[d[none], word[none]]
        x[none] = self.bits[d[none], word[none]]
        for k in (1, 2, 4, 8, 16, 32):  # all bits up to the highest
            x = x | (x >> np.uint64(k))
        return word * 64 + np.bitwise_count(x) - 1

    def right(self, d: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first edge of length d (1 or more) at or behind place."""
        word = place >> 6
        x = self.bits[d, word] & ~_BELOW[place & 63]
        none = np.flatnonzero(x == 0)
        word[none] = self.after[d[none], word[none]]
        x[none] = self.bits[d[none], word[none]]
        return word * 64 + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Edges of the full width before place."""
        return self.counts[place >> 6] + np.bitwise_count(self.bits[self.width, place >> 6] & _BELOW[place & 63])


class FMIndex:
    """Backward search over texts of numbers above 0 and matching statistics up to `width`, with the least owner of each window's places."""

    def __init__(self, tree: WaveletMatrix, first: np.ndarray, shared: np.ndarray, least: np.ndarray, width: int):
        """first: where the suffixes that begin with a symbol begin. shared: how many symbols a suffix has in common with the one before, up to `width`; 0 at both ends. least: of the blocks that share `width`."""
        self.tree, self.first, self.shared, self.least, self.width, self.n = tree, first, shared, least, width, len(shared) - 1
        symbols = np.arange(len(first) - 1)
        # rank() counts from the place to which the start of the sequence is mapped.
        self.shift = first[:-1] - tree.rank(symbols, np.zeros(len(symbols), np.int64))
        self.edges = Edges(shared, width)

    @classmethod
    def build(cls, text: np.ndarray, owners: np.ndarray, width: int) -> FMIndex:
        """text: 0 ends each part. owners: of each place."""
        n, rank, have = len(text), text.astype(np.int64), 1
        order = np.argsort(rank)
        pad = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])
        while have < width:  # prefix doubling
            step = min(have, width - have)
            pair = rank * (int(rank.max()) + 1) + pad(rank, step)
            order = np.argsort(pair)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(False, pair[order][1:] != pair[order][:-1]))
            have += step
        shared, equal, padded = np.zeros(n + 1, np.int8), np.ones(n - 1, bool), np.append(text, np.zeros(width, text.dtype))
        for k in range(width):
            equal &= padded[order[1:] + k] == padded[order[:-1] + k]
            shared[1:n] += equal
        levels = max(int(text.max()).bit_length(), 1)
        first = np.append(0, np.cumsum(np.bincount(text, minlength=int(text.max()) + 1)))
        least = np.minimum.reduceat(owners[order], np.append(0, np.flatnonzero(shared[1:n] < width) + 1))
        return cls(WaveletMatrix.of(text[order - 1], levels), first, shared, least, width)

    def dump(self, words: Iterable[bytes]) -> bytes:
        """The index and the words that its symbols 1, 2, ... stand for."""
        out = io.BytesIO()
        np.savez(out, words=np.frombuffer(b"\n".join(words), np.uint8), bits=self.tree.bits, zeros=self.tree.zeros, first=self.first, shared=self.shared, least=self.least, width=self.width)
        return _pack(out.getvalue())

    @classmethod
    def load(cls, data: bytes) -> tuple[dict[bytes, int], FMIndex]:
        import zstandard

        x = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)))
        numbers = {w: k for k, w in enumerate(x["words"].tobytes().split(b"\n"), 1)}
        return numbers, cls(WaveletMatrix(x["bits"], x["zeros"]), x["first"], x["shared"], x["least"], int(x["width"]))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        n, both = len(symbol), np.concatenate([symbol, symbol])
        moved = self.shift[both] + self.tree.rank(both, np.concatenate([low, high]))
        return moved[:n], moved[n:]

    def enclosing(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first `length` symbols of the patterns with these intervals."""
        some, length = length > 0, np.maximum(length, 1)
        return np.where(some, self.edges.left(length, low), 0), np.where(some, self.edges.right(length, high), self.n)

    def matching_statistics(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the parts of text from begin to end: symbols (up to `width`) from there on that the index holds in a row, and where the interval of this match starts.

        Numbers that no symbol of the index has are 0. All parts advance together, from right to left.
        """
        length, start = np.zeros(len(text), np.int8), np.zeros(len(text), np.int64)
        order = np.argsort(begin - end, kind="stable")
        end, size = end[order], (end - begin)[order]
        low, high, have = np.zeros(len(end), np.int64), np.full(len(end), self.n), np.zeros(len(end), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t))  # parts with more than t symbols come first
            at = end[:k] - 1 - t
            symbol = text[at]
            todo = np.flatnonzero(have[:k] == self.width)
            low[todo], high[todo] = self.enclosing(low[todo], high[todo], np.full(len(todo), self.width - 1))
            have[todo] = self.width - 1
            gone = np.flatnonzero(symbol == 0)
            low[gone], high[gone], have[gone] = 0, self.n, 0
            todo = np.flatnonzero(symbol)
            while len(todo):
                a, b = self.step(symbol[todo], low[todo], high[todo])
                grown = a < b
                done = todo[grown]
                low[done], high[done] = a[grown], b[grown]
                have[done] += 1
                todo = todo[~grown]
                todo = todo[have[todo] > 0]
                less = np.maximum(self.shared[low[todo]], self.shared[high[todo]]).astype(np.int64)
                low[todo], high[todo] = self.enclosing(low[todo], high[todo], less)
                have[todo] = less
            length[at], start[at] = have[:k], low[:k]
        return length, start

    def least_owner(self, start: np.ndarray) -> np.ndarray:
        """Of matches of `width` symbols, by where their intervals start."""
        return self.least[self.edges.rank(start)]


def _numbered(parts: Iterable[bytes], number) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of parts, a 0 after each part, and where the parts end."""
    numbered, ends = array("i"), array("q")
    for part in parts:
        numbered.extend(map(number, part.split()))
        ends.append(len(numbered))
        numbered.append(0)
    return np.frombuffer(numbered, np.int32), np.frombuffer(ends, np.int64)


def build_index(found: DataFrame, width: int, shards: int) -> DataFrame:
    """found: pieces(). shard, index: the FM-index over the distinct segments of each shard."""

    def report(shard: int, merged: dict[bytes, int]):
        numbers: dict[bytes, int] = defaultdict(lambda: len(numbers) + 1)
        text, ends = _numbered(merged, numbers.__getitem__)
        owners = np.repeat(np.fromiter(merged.values(), np.int64, len(merged)), np.diff(ends, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([FMIndex.build(text, owners, width).dump(numbers)], pa.binary())], names=["shard", "index"])

    def run(batches):
        now, merged = None, {}
        for batch in batches:
            for shard, words, least in zip(batch.column(0).to_pylist(), _unpack(batch.column(1)), batch.column(2), strict=True):
                if shard != now:
                    if merged:
                        yield report(now, merged)
                    now, merged = shard, {}
                for text, doc in zip(words.split(b"\n"), least.values.to_pylist(), strict=True):
                    merged[text] = min(merged.get(text, doc), doc)
        if merged:
            yield report(now, merged)

    return found.select("shard", "words", "least").repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, index binary")


def streamed(found: DataFrame, index: DataFrame, width: int, shards: int) -> DataFrame:
    """found: pieces() with a column piece; index: build_index(). piece, of, sizes, docs: for segments in which some row may lose a window, the least document of each window (or the largest number)."""
    never = np.iinfo(np.int64).max

    def answer(numbers: dict[bytes, int], fm: FMIndex, asked: list[tuple[int, list[bytes], np.ndarray]]):
        """A row for each piece (number, segments, largest document of each) that has such segments. All are matched together, equal ones once."""
        places: dict[bytes, int] = {}
        of = [np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words)) for _, words, _ in asked]
        get = numbers.get
        text, ends = _numbered(places, lambda w: get(w, 0))
        begin = np.append(0, ends[:-1] + 1)
        length, start = fm.matching_statistics(text, begin, ends)
        docs, whole = np.full(len(text), never), np.flatnonzero(length == width)
        docs[whole] = fm.least_owner(start[whole])
        least, windows = np.minimum.reduceat(docs, begin), ends - begin - width + 1
        out = [[], [], [], []]
        for (piece, _, most), mine in zip(asked, of, strict=True):
            loses = np.flatnonzero(least[mine] < most)
            if len(loses):
                n, first = windows[mine[loses]], begin[mine[loses]]
                at = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
                for column, x in zip(out, (piece, loses.astype(np.int32), n.astype(np.int32), docs[at]), strict=True):
                    column.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), *(pa.array(x, pa.list_(t)) for x, t in zip(out[1:], (pa.int32(), pa.int32(), pa.int64()), strict=True))], names=["piece", "of", "sizes", "docs"])

    def run(batches):
        now, index, asked, size = None, (), [], 0
        for batch in batches:
            for shard, data, piece, words, most in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), _unpack(batch.column(4)), batch.column(5), strict=True):
                if data.is_valid or size > 8 * BYTES:
                    if asked:
                        yield from answer(*index, asked)
                    asked, size = [], 0
                if data.is_valid:
                    now, index = shard, FMIndex.load(data.as_py())
                elif shard == now:  # else a shard that the index doesn't have
                    asked.append((piece, words.split(b"\n"), most.values.to_numpy()))
                    size += len(words)
        if asked:
            yield from answer(*index, asked)

    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    stored = index.select("shard", F.lit(0).alias("kind"), "index", nothing("long", "piece"), nothing("binary", "words"), nothing("array<bigint>", "most"))
    asked = found.select("shard", F.lit(1).alias("kind"), nothing("binary", "index"), "piece", "words", "most")
    # A shard's index comes first in its partition, then all pieces stream by.
    return stored.union(asked).repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "piece long, of array<int>, sizes array<int>, docs array<bigint>")


def reports(found: DataFrame, answers: DataFrame, width: int) -> DataFrame:
    """found: pieces() with a column piece; answers: streamed(). doc_id, row, first, end: words of a row that an earlier document holds."""

    def run(batches):
        for batch in batches:
            for named, sizes, docs, of, doc, row, start in zip(*(batch.column(k) for k in range(1, 8)), strict=True):
                named, sizes, docs, of, doc, row, start = (x.values.to_numpy() for x in (named, sizes, docs, of, doc, row, start))
                place = np.minimum(np.searchsorted(named, of), len(named) - 1)
                mine = np.flatnonzero(named[place] == of)
                n = sizes[place[mine]].astype(np.int64)
                who = np.repeat(mine, n)
                offset = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                lost = np.flatnonzero(docs[np.repeat((np.cumsum(sizes) - sizes)[place[mine]], n) + offset] < doc[who])
                if not len(lost):
                    continue
                who, offset = who[lost], offset[lost]
                new = np.append(True, (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1))
                last = np.append(np.flatnonzero(new)[1:], len(who)) - 1
                first, end = start[who[new]] + offset[new], start[who[last]] + offset[last] + width
                yield pa.RecordBatch.from_arrays([pa.array(doc[who[new]]), pa.array(row[who[new]]), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "row", "first", "end"])

    both = answers.select("piece", F.col("of").alias("named"), "sizes", "docs").join(found.select("piece", "of", "doc", "row", "start"), "piece")
    return both.select("piece", "named", "sizes", "docs", "of", "doc", "row", "start").mapInArrow(run, "doc_id long, row long, first int, end int")


def shared_minimizers(least: DataFrame, width: int, hot: int) -> DataFrame:
    """least: minimizers(). row, hits (h and whether it stands for more than `hot` words) of the minimizers of two rows or more, words that the row's segments get."""
    words = lambda windows, runs: F.col(windows) + (width - 1) * F.col(runs)
    sums = least.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("windows").alias("all_windows"), F.sum("runs").alias("all_runs"))
    shared = sums.where("n > 1").select("h", (words("all_windows", "all_runs") > hot).alias("hot"))
    own = F.when(F.col("hot"), width * F.col("windows")).otherwise(words("windows", "runs"))
    return least.join(shared, "h").groupBy("row").agg(F.collect_list(F.struct("h", "hot")).alias("hits"), F.sum(own).alias("words"))


def covered_words(docs: DataFrame, width: int = WIDTH, group: int = GROUP, hot: int = HOT, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of id and text), intervals: the words of a row (first, end) that windows cover which an earlier document holds."""
    doc = F.col(id_col).cast("long")
    rows = docs.where(doc.isNotNull()).select(doc.alias("doc"), F.xxhash64(doc, text_col).alias("row"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "substrings")
    least = scratch.cut(minimizers(rows.select("row", "text"), width, group), "minimizers")
    hits = scratch.cut(shared_minimizers(least, width, hot), "hits")
    scratch.drop("minimizers")
    shards = -(-(hits.agg(F.sum("words")).first()[0] or 1) // shard)
    chosen = packed(rows, "text").join(hits, "row").select("doc", "row", "text", "hits")
    found = scratch.cut(pieces(chosen, width, group, shards).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    scratch.drop("hits")
    index = scratch.cut(build_index(found, width, shards), "index")
    answers = scratch.cut(streamed(found, index, width, shards), "answers")
    scratch.drop("index")
    intervals = reports(found, answers, width).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("intervals"))
    out = scratch.cut(intervals, "intervals")
    scratch.drop("pieces", "answers")
    return out


def _without(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Words, words removed, the words kept joined by one space, and the text without what is removed."""
    words = text.split()
    if not len(first):
        return len(words), 0, b" ".join(words), text
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, end, -1)
    keep = np.cumsum(change[:-1]) == 0
    starts = [m.start() for m in _WORD.finditer(text)]
    head = text[: starts[0]] if keep[0] else b""
    left = head + b"".join(text[a:b] for a, b, k in zip(starts, [*starts[1:], len(text)], keep.tolist(), strict=True) if k)
    return len(words), int(len(words) - keep.sum()), b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k), left


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of docs, the text without what earlier documents hold, and __n_words, __n_removed, __kept_sha256."""
    covered = covered_words(docs, width, id_col=id_col, text_col=text_col, **options)
    keyed = packed(docs.withColumn("__row", F.xxhash64(F.col(id_col).cast("long"), text_col)), text_col)
    spans = covered.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__hash"), F.col("intervals.first").alias("__first"), F.col("intervals.end").alias("__end"))
    joined = keyed.join(spans, (F.col("__row") == F.col("__hash")) & (F.col(id_col) == F.col("__doc")), "left").select(*docs.columns, "__first", "__end")
    fields = [T.StructField(n, t, False) for n, t in (("__n_words", T.LongType()), ("__n_removed", T.LongType()), ("__kept_sha256", T.StringType()))]
    schema, place = T.StructType([*docs.schema.fields, *fields]), docs.columns.index(text_col)
    numbers = lambda x: x.values.to_numpy().astype(np.int64) if x.is_valid else np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            n, gone, digests, texts = [], [], [], []
            for text, first, end in zip(_unpack(batch.column(place)), *batch.columns[-2:], strict=True):
                a, b, kept, left = _without(text or b"", numbers(first), numbers(end))
                n.append(a)
                gone.append(b)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(None if text is None else left.decode())
            columns = batch.columns[:-2]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)


def matches(docs: DataFrame, known: DataFrame, width: int = WIDTH, group: int = GROUP, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, first, end: the words of docs (streamed) that documents of `known` (indexed) with smaller ids hold in windows."""
    doc = F.col(id_col).cast("long")
    scratch = Scratch(docs.sparkSession, "matches")
    every = F.lit(None).cast("array<struct<h: bigint, hot: boolean>>")
    rows = lambda x: x.where(doc.isNotNull()).select(doc.alias("doc"), F.xxhash64(doc, text_col).alias("row"), F.col(text_col).alias("text"))
    shards = -(-max(known.agg(F.sum(F.size(F.split(text_col, " ")))).first()[0] or 1, 1) // shard)
    index = scratch.cut(build_index(pieces(packed(rows(known), "text").withColumn("hits", every), width, group, shards), width, shards), "index")
    found = scratch.cut(pieces(packed(rows(docs), "text").withColumn("hits", every), width, group, shards).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    return reports(found, scratch.cut(streamed(found, index, width, shards), "answers"), width)


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    return without_repeats(docs.select("doc_id", "text")).select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept_sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the text that is left and its number of characters; rows that lose nothing are as they were."""
    out = without_repeats(docs)
    changed = F.col("__n_removed") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)

"""A factorisation machine that scores texts for quality (Rendle, "Factorization Machines", 2010).

Inputs of a score: hashed words of the whole text (logarithmic counts, scaled to length one), statistics of
its structure, and the table's n_chars. The pairwise part is computed in linear time,
sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2. The model is fitted on at most `sample` labelled
rows, those with the smallest hash of their doc_id, and has a fixed size, so it can go to every executor.
Scores are calibrated (Platt, "Probabilistic Outputs for Support Vector Machines", 1999): two machines, each fitted on
half of the labelled rows, score the other half, and the logistic curve that fits these scores best is laid over the scores of
the machine fitted on all. Otherwise few examples of one kind give scores too near to the middle.

Defined cases: null and empty texts get the score of their (empty) inputs. A null n_chars counts as 0. Rows of
labels with a null or another value than 0 and 1 are ignored; a doc_id labelled twice counts as 0 if one label
is 0, a labelled doc_id that repeats is learnt from once (the row with the smallest hash). Without labels of both kinds
every score is the share of label 1 (0.5 without any); with fewer than two of a kind scores aren't calibrated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._shared import small_batches

SAMPLE, DIMENSIONS, RANK, THRESHOLD = 12_000, 1 << 13, 8, 0.3
#: Structure statistics, after the hashed words.
STATS = 15
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS, _STOPS = bytes(range(65, 91)), b"0123456789", b".,;:!?"


@lru_cache(200_000)
def _slot(word: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word, 7) % DIMENSIONS


def inputs(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's inputs."""
    data = (text or "").encode()
    words = data.split()
    n, counts = len(words), Counter(words)
    slots = np.fromiter(map(_slot, counts), np.int32, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(counts):
        values *= 1 / np.sqrt(values @ values)
    slots, back = np.unique(slots, return_inverse=True)  # words that share a slot are one input
    values = np.bincount(back, values, len(slots)).astype(np.float32)
    solid = max(1, len(data) - data.count(b" ") - data.count(b"\n"))
    share = lambda some: (len(data) - len(data.translate(None, some))) / solid
    lines = [x for x in data.split(b"\n") if x.split()]
    most = max(counts.values(), default=0)
    pairs = len(set(zip(words, words[1:], strict=False)))
    again = sum(map(bytes.__eq__, words, words[1:]))  # words equal to the one before
    chars = 0 if n_chars is None or n_chars != n_chars else max(0, n_chars)
    stats = (1, log1p(n) / 10, log1p(chars) / 12, min(solid / max(n, 1), 30) / 10, share(_SYMBOLS), share(_UPPER), share(_DIGITS), share(_STOPS), 2 * share(b"!"), 2 * share(b"|"),
             len(counts) / max(n, 1), most / max(n, 1), pairs / max(n - 1, 1), again / max(n - 1, 1), len(set(lines)) / max(len(lines), 1))
    return np.concatenate([slots, np.arange(DIMENSIONS, DIMENSIONS + STATS, dtype=np.int32)]), np.concatenate([values, np.array(stats, np.float32)])


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at]
        return float(self.bias + self.linear[at] @ x + 0.5 * (((x @ v) ** 2).sum() - ((x * x) @ (v * v)).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(_logistic(self.slope * self.margin(at, x) + self.shift))


def _machine(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 10, rate: float = 0.08, decay: float = 1e-5, batch: int = 64, seed: int = 1) -> Model:
    """Logistic loss, AdaGrad over small batches."""
    rng = np.random.default_rng(seed)
    size = DIMENSIONS + STATS
    linear, factors = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32)
    positive = sum(y for _, _, y in rows)
    if not rows or positive in (0, len(rows)):
        p = min(max(positive / len(rows) if rows else 0.5, 1e-3), 1 - 1e-3)
        return Model(float(np.log(p / (1 - p))), linear, factors * 0)
    bias, seen_b = float(np.log(positive / (len(rows) - positive))), 1e-6
    seen_l, seen_f = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), batch):
            some = [rows[i] for i in order[first : first + batch]]
            at, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            starts = np.cumsum([0, *(len(r[0]) for r in some)])[:-1]
            owner = np.repeat(np.arange(len(some)), [len(r[0]) for r in some])
            v = factors[at]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = bias + np.add.reduceat(linear[at] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
            error = (_logistic(z) - np.array([r[2] for r in some])).astype(np.float32) / len(some)
            step = (error[owner] * x)[:, None]
            used, back = np.unique(at, return_inverse=True)
            grad_l = np.bincount(back, step[:, 0], len(used)).astype(np.float32) + decay * linear[used]
            each = step * (total[owner] - vx)
            grad_f = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + decay * factors[used]
            seen_l[used] += grad_l**2
            seen_f[used] += grad_f**2
            seen_b += float(error.sum()) ** 2
            linear[used] -= rate * grad_l / np.sqrt(seen_l[used])
            factors[used] -= rate * grad_f / np.sqrt(seen_f[used])
            bias -= rate * float(error.sum()) / seen_b**0.5
    return Model(bias, linear, factors)


def _curve(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (z, y), by Newton's method on Platt's smoothed targets."""
    z, ones = np.clip(z, -30, 30), y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    both, at = np.stack([z, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = _logistic(at @ both)
        step = np.linalg.solve((both * (p * (1 - p))) @ both.T + 1e-3 * np.eye(2), both @ (target - p))
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The machine of all rows, its scores calibrated on those that machines of one half give the other."""
    model, y = _machine(rows), np.array([r[2] for r in rows], np.int64)
    if min(y.sum(), len(y) - y.sum()) < 2:
        return model
    dealt = np.empty(len(y), np.int64)
    dealt[np.argsort(y, kind="stable")] = np.arange(len(y)) % 2  # each kind is in both halves
    z = np.empty(len(y))
    for half in (0, 1):
        other = _machine([r for r, k in zip(rows, dealt, strict=True) if k != half])
        for i in np.flatnonzero(dealt == half):
            z[i] = other.margin(*rows[i][:2])
    slope, shift = _curve(z, y)
    return Model(model.bias, model.linear, model.factors, slope, shift) if slope > 0 else model


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the rows, by their id; never learnt from. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text, n_chars. labels: doc_id, quality. Learns from rows that aren't held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("at binary, x binary")
    def packed(text: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        got = [inputs(t, c) for t, c in zip(text, n_chars, strict=True)]
        return pd.DataFrame({"at": [a.tobytes() for a, _ in got], "x": [x.astype(np.float32).tobytes() for _, x in got]}, columns=["at", "x"])

    # A doc_id that repeats is one example, so at most `sample` rows of at most DIMENSIONS + STATS values come to the driver.
    once = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text", "n_chars"), "text", "n_chars", "y")).alias("r")).select("doc_id", "r.text", "r.n_chars", "r.y")
    found = once.select("doc_id", "y", packed("text", F.col("n_chars").cast("double")).alias("p")).select("doc_id", "y", "p.at", "p.x").collect()
    found.sort(key=lambda r: (r["doc_id"], r["at"], r["x"]))
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), r["y"]) for r in found])


def score(docs: DataFrame, model: Model) -> Column:
    """The score of a row of docs (0 to 1)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = shared.value
        for text, n_chars in batches:
            yield pd.Series([m.score(*inputs(t, c)) for t, c in zip(text, n_chars, strict=True)], dtype="float64")

    return scored(docs["text"], docs["n_chars"].cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels, sample)
    return docs.select("doc_id", held_out().alias("held_out"), score(docs, model).alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents predicted 1, with their columns."""
    model = train(docs, labels, sample)
    return docs.where(score(docs, model) >= THRESHOLD)

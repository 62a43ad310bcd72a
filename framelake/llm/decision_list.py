"""Learned quality rules: a decision list over text statistics, by sequential covering.

Statistics are Spark expressions over the whole text. The learner grows one rule at a time for the rare class
(quality 0) on two thirds of the labelled rows, taking the threshold condition with the best FOIL gain, prunes
its last conditions on the other third, removes what the rule covers and goes on (as in Cohen, "Fast Effective
Rule Induction", 1995). It never sees rows: labelled statistics are binned at quantiles and counted by cell with
Spark, and each step reads the counts per statistic and bin. The verdict is an ordered when(...).when(...)
expression that Spark compiles; no Python runs on the executors.

Defined cases: a null text has no words. Statistics of a text without words are 0. Labels that are null or not
0 or 1 are ignored, and labels of unknown documents too. Without labels of both kinds there are no rules and
only the base rules decide. Rows that repeat a doc_id are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._shared import SPACE, Scratch, cut, text_or_empty

#: Statistics that rules may test.
TESTED = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")
BINS, RULES, CONDITIONS = 32, 8, 3
#: A rule must be right this often on the rows kept for pruning; documents outside all rules are kept.
PRECISION = 0.9


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the base rules, and the shares that rules test; a row per document."""
    words = F.filter(F.split("t", f"{SPACE}+"), lambda w: w != "")
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).withColumn("w", words)
    docs = docs.withColumn("n_words", F.size("w").cast("long"))
    only = lambda chars: F.length(F.regexp_replace("t", f"[^{chars}]+", "")).cast("long")
    # The words at which 3-word windows that occur more than once begin, in order.
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    docs = docs.select(
        "doc_id", "n_words", windows.alias("s"), lines.alias("lines"),
        F.length(F.regexp_replace("t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"), only("A-Z").alias("n_upper"), only("!?").alias("n_marks"),
    )
    again = F.filter("s", lambda x, k: (x["h"] == F.get("s", k + 1)["h"]) | (x["h"] == F.get("s", F.when(k > 0, k - 1))["h"]))
    docs = docs.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    docs = docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    return docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "word_chars").alias("mark_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """stat > value, or stat <= value."""

    stat: str
    above: bool
    value: float
    bin: int

    def column(self) -> Column:
        return F.col(self.stat) > self.value if self.above else F.col(self.stat) <= self.value

    def on_bins(self) -> Column:
        return F.col(f"b_{self.stat}") > self.bin if self.above else F.col(f"b_{self.stat}") <= self.bin

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


class DecisionList:
    """Ordered rules; the first that holds rejects, else the document is kept."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def verdict(self) -> Column:
        """True for documents to keep."""
        if not self.rules:
            return F.lit(True)
        chain = F
        for rule in self.rules:
            chain = chain.when(_all([c.column() for c in rule]), F.lit(False))
        return chain.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "".join(f"reject if {' and '.join(map(str, rule))}\n" for rule in self.rules) + "else keep"


def _counts(cells: DataFrame, where: Column) -> dict[str, dict[int, tuple[int, int]]]:
    """Rejected and kept rows by statistic and bin."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"b_{s}").alias("bin")) for s in TESTED])).alias("c")
    rows = cells.where(where).select(each, "bad", "good").groupBy("c.stat", "c.bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    out: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in TESTED}
    for r in rows:
        out[r["stat"]][r["bin"]] = (r["bad"], r["good"])
    return out


def _best(counts: dict[str, dict[int, tuple[int, int]]], edges: dict[str, list[float]]) -> tuple[float, Condition | None]:
    """The condition with the largest FOIL gain; the first of equals."""
    best: tuple[float, Condition | None] = (0.0, None)
    for stat in TESTED:
        p0, n0 = (sum(x[i] for x in counts[stat].values()) for i in (0, 1))
        if not p0 or not n0:
            continue
        p = n = 0
        for k, value in enumerate(edges[stat]):
            a, b = counts[stat].get(k, (0, 0))
            p, n = p + a, n + b
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                if pp and pp + nn < p0 + n0:
                    gain = pp * (log2(pp / (pp + nn)) - log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = gain, Condition(stat, above, value, k)
    return best


def learn(labelled: DataFrame, bins: int = BINS, rules: int = RULES, conditions: int = CONDITIONS, precision: float = PRECISION) -> DecisionList:
    """labelled: doc_id, quality and the tested statistics, written before."""
    quantiles = [k / bins for k in range(bins + 1)]
    found = labelled.agg(*[F.percentile_approx(s, quantiles, 10_000).alias(s) for s in TESTED]).first()
    if found[TESTED[0]] is None:
        return DecisionList([])
    known = {s: sorted({float(x) for x in found[s]}) for s in TESTED}
    edges = {s: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for s, v in known.items()}
    binned = [sum((F.when(F.col(s) > v, 1).otherwise(0) for v in edges[s]), F.lit(0)).alias(f"b_{s}") for s in TESTED]
    grow = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow")
    keys = [f"b_{s}" for s in TESTED]
    scratch = Scratch(labelled.sparkSession, "rules")
    cells = scratch.cut(labelled.select(*binned, grow, "quality").groupBy(*keys, "grow").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good")), "cells")
    left, out = F.lit(True), []
    while len(out) < rules:
        rule: list[Condition] = []
        while len(rule) < conditions:
            gain, best = _best(_counts(cells, left & F.col("grow") & _all([c.on_bins() for c in rule])), edges)
            if best is None or gain <= 0:
                break
            rule.append(best)
        if not rule:
            break
        prefixes = [_all([c.on_bins() for c in rule[: k + 1]]) for k in range(len(rule))]
        sums = [f for k, p in enumerate(prefixes) for f in (F.sum(F.when(p, F.col("bad"))).alias(f"p{k}"), F.sum(F.when(p, F.col("good"))).alias(f"n{k}"))]
        held = cells.where(left & ~F.col("grow")).agg(*sums).first()
        worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k in range(len(rule)) for p, n in [(held[f"p{k}"] or 0, held[f"n{k}"] or 0)]]
        kept = -max(worth)[1] + 1
        p, n = held[f"p{kept - 1}"] or 0, held[f"n{kept - 1}"] or 0
        if p < precision * (p + n) or not p:
            break
        out.append(tuple(rule[:kept]))
        left = left & ~prefixes[kept - 1]
    scratch.drop("cells")
    return DecisionList(out)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, the tested shares, base_failed and kept for every row of docs."""
    stats = cut(statistics(docs), "statistics")
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    scratch = Scratch(docs.sparkSession, "labelled")
    found = learn(scratch.cut(stats.where(~base_failed()).join(known, "doc_id"), "rows"))
    scratch.drop("rows")
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & found.verdict())

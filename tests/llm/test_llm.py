"""The corpus operators against brute force, round trips and held-out labels, and their defined cases."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import bpe, components, decision_list, exact_dedup, html_text, packing, pieces, quality_fm, queries, simhash, substring_dedup, token_trees, warc
from framelake.llm._shared import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Clashing and extra columns, nulls, empty and long texts, repeats.
EXTRA = ", n long, digest string, h long, fp long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", 2, 3) for i, t in rows], DOCS + EXTRA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 97} v{i % 89}" for i in range(30_000))
    base = " ".join(f"tok{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, base), (7, base), (8, base + " end"), (9, "x  y\r\nz"), (9, "x  y\r\nz"), (None, base), (None, None)]
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


# 1


def block(*parts):
    return "<html><head><title>t</title><style>p{}</style></head><body>" + "".join(parts) + "</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain, text.", "plain, text."),
        (block("<nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head</h1><p>One,  two.<br>three &amp; four.</p><p>five <b>s</b>ix</article><aside>side</aside><footer>&copy; x</footer>"), "Head One, two. three & four. five six"),
        (block("<header>site</header><main><p>Long enough text, with marks.</p><ul><li>a<li>b</ul><form>f<input></form><script>if (a<b) '</p>'</script></main>"), "Long enough text, with marks. a b"),
        (block("<div id=content><p>Text one, here.</p><section class='comments'><p>First!</p></section><p>Text two, here.</p></div><div class='cookie-notice'>We use, cookies, all of them, always.</div>"), "Text one, here. Text two, here."),
        ("<body><article><p>open <i>tags", "open tags"), ("<p>cut <a href='x", "cut"), ("<!-- c --><p>a</p><!-- open", "a"), ("<p title=\"a>b\">q</p>", "q"), ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_articles_of_pages(spark, data):
    pages = spark.read.parquet(f"{data}/sf0.001/pages.parquet")
    got = {r.page_id: r for r in queries.op1_html_text(spark, f"{data}/sf0.001").collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", r.html, re.S)[1]
        want = " ".join(html_text.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|br|h1)\b[^>]*>", " ", inner))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_pages_odd(spark):
    rows = spark.createDataFrame([(1, None, None, 3), (1, None, None, 3), (None, "u", "<p>x</p>", 4)], "page_id long, url string, html string, text long")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract_pages(rows).collect()) == [("1", "", 0), ("1", "", 0), ("None", "x", 1)]
    assert html_text.extract_pages(rows.limit(0)).count() == 0


# 2


def counts(text):
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = collections.Counter(windows), set()
    for i, g in enumerate(windows):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, odd, texts):
    got = {r.doc_id: tuple(r)[1:6] for r in decision_list.statistics(docs).collect()}
    assert got == {i: counts(t) for i, t in texts}
    for r in decision_list.statistics(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert tuple(r)[1:6] == counts(r.text or "")


def test_rules_are_learnt(spark, data):
    sf = f"{data}/sf0.01"
    out = queries.op2_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_rules_conjunction(spark):
    """Only both conditions together tell the classes apart."""
    rng = random.Random(1)
    rows = [(i, *(float(rng.random()) for _ in decision_list.TESTED)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{s} double" for s in decision_list.TESTED)).withColumn("quality", F.when((F.col("symbol_share") > 0.7) & (F.col("repeat_share") > 0.6), 0).otherwise(1)).cache()
    found = decision_list.learn(df)
    wrong = df.where(found.verdict() != (F.col("quality") == 1)).count()
    assert wrong < 30 and any(len(r) > 1 for r in found.rules) and "symbol_share" in str(found)


def test_rules_without_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = decision_list.quality_rules(odd, none)
    assert out.count() == odd.count() and all(r.kept == (not r.base_failed) for r in out.collect())


# 3


def kept_by_brute_force(rows, width=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if i is not None and first.get(g, i) >= i:
                first[g] = i
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_substrings(docs, texts):
    got = sorted((tuple(r) for r in substring_dedup.removed_words(docs).collect()), key=str)
    assert got == kept_by_brute_force(texts)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("options", [{"hot": 2}, {"shard": 255}, {"hot": 500, "shard": 2000}, {"group": 3}, {"width": 5, "group": 2}])
def test_substring_options(docs, texts, options):
    out = substring_dedup.without_repeats(docs.select("doc_id", "text"), **options)
    got = sorted((tuple(r) for r in out.select("doc_id", "__n_words", "__n_removed", "__kept_sha256").collect()), key=str)
    assert got == kept_by_brute_force(texts, options.get("width", 13))


def test_substrings_odd(odd, empty):
    got = sorted((tuple(r) for r in substring_dedup.removed_words(odd).collect()), key=str)
    assert got == kept_by_brute_force([(r.doc_id, r.text) for r in odd.collect()])
    assert substring_dedup.removed_words(empty).count() == 0
    left = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).collect()}
    assert left[8].text == "end" or left[8].text.split() == ["end"]
    assert left[7].text.strip() == "" and left[7].n_chars == len(left[7].text) and left[9].text == "x  y\r\nz" and left[1].text is None
    assert substring_dedup.remove_repeats(odd).columns == odd.columns


def test_fm_index_counts():
    rng = random.Random(5)
    parts = [[rng.randint(1, 3) for _ in range(rng.randint(4, 30))] for _ in range(20)]
    text = np.array([x for p in parts for x in (*p, 0)])
    owner = np.array([k for k, p in enumerate(parts) for _ in range(len(p) + 1)])
    index = substring_dedup.FMIndex.build(text, owner, 4)
    for _ in range(100):
        pattern = [rng.randint(1, 3) for _ in range(4)]
        low, high = (np.array([x]) for x in (index.first[pattern[-1]], index.first[pattern[-1] + 1]))
        for c in reversed(pattern[:-1]):
            low, high = index.step(np.array([c]), low, high)
        found = [k for k, p in enumerate(parts) for i in range(len(p) - 3) if p[i : i + 4] == pattern]
        assert int(high[0] - low[0]) == len(found)
        if found:
            assert index.least_owner(low)[0] == min(found)


@pytest.mark.parametrize(("symbols", "width"), [(2, 2), (2, 13), (3, 5), (6, 4), (40, 5)])
def test_matching_statistics(symbols, width):
    """Of streamed parts against a stored index, with words that the index doesn't have."""
    rng = random.Random(symbols * width)
    for _ in range(25):
        parts = [[rng.randint(1, symbols) for _ in range(rng.randint(width, 30))] for _ in range(rng.randint(1, 12))]
        text = np.array([x for p in parts for x in (*p, 0)], np.int32)
        owner = np.array([k * 7 % 11 for k, p in enumerate(parts) for _ in range(len(p) + 1)])
        _, index = substring_dedup.FMIndex.load(substring_dedup.FMIndex.build(text, owner, width).dump([b"x"] * symbols))
        asked = [[rng.randint(0, max(text)) for _ in range(rng.randint(0, 40))] for _ in range(5)]
        asked.append(parts[0] + [0] + parts[-1] * 2)
        ends = np.cumsum([len(q) + 1 for q in asked]) - 1
        begin = np.append(0, ends[:-1] + 1)
        length, start = index.matching_statistics(np.array([x for q in asked for x in (*q, 0)], np.int32), begin, ends)
        for q, b in zip(asked, begin.tolist(), strict=True):
            for i in range(len(q)):
                held = lambda n, q=q, i=i: [k * 7 % 11 for k, p in enumerate(parts) if any(p[j : j + n] == q[i : i + n] for j in range(len(p) - n + 1))]
                want = max((n for n in range(1, width + 1) if i + n <= len(q) and held(n)), default=0)
                assert length[b + i] == want
                if want == width:
                    assert index.least_owner(start[b + i : b + i + 1])[0] == min(held(width))


def test_shards_are_bounded(spark):
    """Rows of one template share their minimizers window after window: their windows are dealt out, and no shard is much larger than asked for."""
    rows = [(k, " ".join(f"level info service gateway request r{(i + k) % 400} s{i % 7} t1 u1" for i in range(555))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    keyed = docs.select("doc_id", F.col("doc_id").alias("row"), "text")
    least = substring_dedup.minimizers(keyed.select("row", "text"), 13, 5).cache()
    hits = substring_dedup.shared_minimizers(least, 13, 60_000)
    shard = 100_000
    shards = -(-hits.agg(F.sum("words")).first()[0] // shard)
    chosen = substring_dedup.packed(keyed.withColumnRenamed("doc_id", "doc"), "text").join(hits, "row").select("doc", "row", "text", "hits")
    found = substring_dedup.pieces(chosen, 13, 5, shards)
    unpacked = found.select("shard", "words").collect()
    held, unpack = collections.Counter(), substring_dedup._unpack
    import pyarrow as pa

    for r, words in zip(unpacked, unpack(pa.array([bytes(r["words"]) for r in unpacked], pa.binary())), strict=True):
        held[r["shard"]] += len(words.split())
    assert least.groupBy("h").agg(F.sum("windows").alias("n")).agg(F.max("n")).first()[0] * 13 > 5 * shard
    assert max(held.values()) < 2 * shard
    some = docs.where("doc_id < 12")
    got = sorted((tuple(r) for r in substring_dedup.without_repeats(some, hot=2_000, shard=20_000).select("doc_id", "__n_words", "__n_removed", "__kept_sha256").collect()), key=str)
    assert got == kept_by_brute_force(rows[:12])


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_edges(n):
    rng = np.random.default_rng(n)
    shared = rng.choice([0, 1, 2, 3, 4, 4, 4, 4, 4, 4, 4], n + 1) if n < 1000 else np.full(n + 1, 4)
    shared[[0, -1]] = 0
    edges, edge = substring_dedup.Edges(shared, 4), np.where(np.isin(np.arange(n + 1), (0, n)), -1, shared)
    place = np.arange(n + 1)
    for d in range(1, 5):
        at = np.flatnonzero(edge < d)
        assert (edges.left(np.full(n + 1, d), place) == at[np.searchsorted(at, place, side="right") - 1]).all()
        assert (edges.right(np.full(n + 1, d), place) == at[np.searchsorted(at, place)]).all()
    assert (edges.rank(place) == np.searchsorted(np.flatnonzero(edge < 4), place)).all()


def test_stream_against_an_index(spark, texts):
    """Other documents than those of the index; of a longer text only the words that it holds."""
    known = [(i, t) for i, t in texts if i % 2 == 0]
    asked = [(i + 1_000_000, t) for i, t in texts if i % 3 == 0] + [(-1, texts[0][1])]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in substring_dedup.matches(frame(asked), frame(known), shard=500).collect():
        got.setdefault(r.doc_id, set()).update(range(r.first, r.end))
    windows = {tuple(w[k : k + 13]) for _, t in known for w in [t.encode().split()] for k in range(len(w) - 12)}
    for i, t in asked:
        w = t.encode().split()
        want = {x for k in range(len(w) - 12) if i > 0 and tuple(w[k : k + 13]) in windows for x in range(k, k + 13)}
        assert got.get(i, set()) == want


def test_words_of_long_texts(monkeypatch):
    """Slices give the same words and hashes as the whole."""
    texts = [b"a bc " * 5000, b"x" * 40_000 + b" y", b" " * 30_000, b"", b"z\tq"]
    whole = substring_dedup.Words(texts)
    monkeypatch.setattr(substring_dedup, "BYTES", 500)
    sliced = substring_dedup.Words(texts)
    assert [whole.data[a:b] for a, b in zip(whole.starts, whole.ends, strict=True)] == b" ".join(texts).split()
    for name in ("starts", "ends", "hash", "of"):
        assert (getattr(whole, name) == getattr(sliced, name)).all()


def test_ids_that_repeat_with_other_texts(spark):
    base = " ".join(f"w{k}" for k in range(20))
    rows = [(1, base), (1, base + " more"), (2, "x y " + base), (2, "other"), (None, base)]
    got = sorted((tuple(r) for r in substring_dedup.removed_words(make(spark, rows)).collect()), key=str)
    assert got == kept_by_brute_force(rows)


# 4


def test_exact_odd(odd, empty):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()), key=str)
    blank = [(1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (None, 3, 4, False)]
    same = [(6, 6, 3, True), (7, 6, 3, False), (None, 6, 3, False)]
    assert got == sorted([*blank, *same, (4, 4, 1, True), (5, 5, 1, True), (8, 8, 1, True), (9, 9, 2, True), (9, 9, 2, True)], key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 4, 5, 6, 8, 9]


IDS = [(0, "same text here"), (1, "same text here"), (1, "only this row says this"), (2, "a b c d"), (2, "zz yy xx ww"), (2, "a b c d"), (None, "same  text here!"), (None, "of no id"), (None, "of no id"), (None, "a b c d")]


def test_rows_of_equal_ids_are_told_apart(spark):
    """Both stages go by row: a text without a copy stays, whatever its doc_id."""
    want = {(0, "same text here"), (1, "only this row says this"), (2, "a b c d"), (2, "zz yy xx ww"), (None, "same  text here!"), (None, "of no id")}
    for stage in (exact_dedup.keep_first, simhash.keep_one):
        kept = [(r.doc_id, r.text) for r in stage(make(spark, IDS)).collect()]
        assert len(kept) == len(want) and set(kept) == want, stage


@pytest.mark.parametrize(("batches", "hot"), [(1, 1000), (2, 1000), (5, 3), (3, 10**9)])
def test_batches_give_the_same_rows(spark, docs, texts, monkeypatch, batches, hot):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot)
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups["".join(WORD.findall(t))].append((-len(t), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, batches=batches).collect())) == want


def test_plan_of_append(spark):
    """The anti-join sorts and merges, and reads the index by buckets: only the batch is shuffled."""
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "index"), 4).attach()
    index.append(exact_dedup.leaders(exact_dedup.digests(make(spark, [(1, "a"), (2, "b")]))), 0, 0)
    batch = exact_dedup.leaders(exact_dedup.digests(make(spark, [(3, "a"), (4, "c")])))
    held = spark.table(index.name).where("new").select("digest").hint("merge")
    plan = batch.join(held, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    known = plan[plan.index("SortMergeJoin") :].split("FileScan")[0]
    assert "Bucketed: true" in plan and known.count("Exchange hashpartitioning") <= 1
    for _ in range(2):  # the second time is a retry
        index.append(batch, 1, 0)
    assert sorted((r.keep_id, r.group_size) for r in index.read().collect()) == [(1, 2), (2, 1), (4, 1)]
    index.detach()


def test_index_is_kept(spark):
    path = shared_path(spark, "index")
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(make(spark, [(1, "a b"), (2, "c")]), first)
    later = exact_dedup.DigestIndex(spark, path, 4).attach()
    out = exact_dedup.exact_dedup(make(spark, [(0, "ab "), (3, "d"), (4, "d")]), later).collect()
    assert sorted((r.doc_id, r.keep_id) for r in out) == [(0, 1), (3, 3), (4, 3)]
    assert later.read().count() == 3
    plan = spark.sql(f"SELECT * FROM {later.name}")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or spark.sql(f"DESCRIBE EXTENDED {later.name}").where("col_name = 'Num Buckets'").first()["data_type"] == "4"


# 5


def test_classifier(spark, data):
    sf = f"{data}/sf0.01"
    out = queries.op5_quality_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted for r in held if r.quality == 1]) > 0.95


def test_classifier_odd(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (8, 7), (4, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        out = quality_fm.quality_scores(odd, some).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality_fm.quality_scores(empty, labels).count() == 0
    assert quality_fm.keep_good(odd, labels).columns == odd.columns


def test_inputs_are_bounded():
    at, x = quality_fm.inputs(" ".join(f"w{k}" for k in range(60_000)), 5)
    assert len(at) == len(set(at.tolist())) == len(x) <= quality_fm.DIMENSIONS + quality_fm.STATS


def test_repeated_ids_are_one_example(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_fm, "fit", lambda rows: seen.append(len(rows)))
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    quality_fm.train(make(spark, [(k % 100, f"a b {k}") for k in range(500)]), labels, sample=30)
    assert seen == [30]


def test_pairs_in_linear_time():
    rng = np.random.default_rng(2)
    m = quality_fm.Model(0.3, rng.normal(size=20), rng.normal(size=(20, 3)))
    at, x = np.array([1, 4, 7]), np.array([0.5, -1.0, 2.0])
    z = m.bias + m.linear[at] @ x + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.score(at, x) == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_bad_texts_are_rejected(spark, data):
    sf = f"{data}/sf0.01"
    out = queries.op5_quality_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality = 0").collect()
    assert out and np.mean([r.predicted for r in out]) <= 0.1


def test_scores_are_calibrated():
    """Few examples: the curve follows the shares, whatever the machine's margins are."""
    rng = np.random.default_rng(4)
    y = (rng.random(4000) < 0.7).astype(int)
    z = rng.normal(0, 1, 4000) + 2 * y - 1  # log odds 2 z + log(7 / 3)
    slope, shift = quality_fm._curve(z, y)
    assert slope == pytest.approx(2, abs=0.2) and shift == pytest.approx(np.log(7 / 3), abs=0.2)
    rows = [(np.array([0, k % 7 + 1], np.int32), np.array([1, 1], np.float32), int(k % 7 < 4)) for k in range(60)]
    model = quality_fm.fit(rows)
    assert model.slope > 0 and all((model.score(a, x) >= 0.3) == t for a, x, t in rows)
    for some in ([], rows[:1], [r for r in rows if r[2]], [*[r for r in rows if r[2]], rows[4]]):
        one = quality_fm.fit(some)
        assert (one.slope, one.shift) == (1.0, 0.0) and 0 < one.score(*rows[0][:2]) < 1


# 6 and 7


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("byte_bpe_50k.tiktoken"))


ODD = ["", " ", "\n", "  a  b\n\n c ", "a b   c", "x" * 3000 + " y", "a \n b", "don't 'll  I'm 123 45\x1c 6", "é è\x85 ü 中文 🙂", "a <|endoftext|> b"]


def test_ids_are_those_of_the_library(encoder, texts):
    for t in [*ODD, *(t for _, t in texts[:60])]:
        assert np.frombuffer(encoder(t), "<u4").tolist() == encoder.whole.encode(t, add_special_tokens=False).ids


def test_trees_follow_edits(encoder, texts):
    rng = random.Random(3)
    for t in [*ODD[:-1], *(t for _, t in texts[:80])]:
        tree = token_trees.TokenTree.build(t, encoder)
        assert (tree.chars[1], tree.tokens[1]) == (len(t), len(encoder.ordinary(t)))
        edits = [(x := rng.randint(0, len(t)), x + rng.choice([0, 1, 2, 30, 500]), rng.choice(["", " ", "  ", "zz q", "\n", " a b c ", "x" * 40])) for _ in range(rng.randint(1, 6))]
        _, after, _, _ = token_trees.apply_edits(token_trees.TokenTree(tree.chars.copy(), tree.tokens.copy()), t, edits, encoder)
        new, text, n, touched = token_trees.apply_edits(tree, t, edits, encoder)
        assert text == after and new.tokens[1] == len(encoder.ordinary(text)) and new.chars[1] == len(text) and 1 <= n <= len(edits)


LONG = [" " * 1_500_000, "a" + " " * 1_500_000 + "b c", "x y" + "\n \t" * 200_000, "a" * 1_000_000, "ab" + "\u3000" * 20_000 + "\x1c" * 3 + " z", ("word" + " " * 10_050) * 5 + "!", " " * 9_999 + "q"]


def test_long_runs(spark, encoder):
    """Ids are those of the library, and both operators get through."""
    for t in LONG:
        assert encoder.ordinary(t) == encoder.whole.encode(t, add_special_tokens=False).ids
    df = make(spark, list(enumerate(LONG)))
    want = {i: len(encoder.ordinary(t)) for i, t in enumerate(LONG)}
    assert {r.doc_id: r.n_tokens_before for r in token_trees.count_redacted(df).collect()} == want
    assert {r.doc_id: r.doc_tokens for r in packing.pack_documents(df).collect()} == {i: n + 1 for i, n in want.items()}


def test_many_edits_in_linear_time(encoder):
    text = "mail a@b.cc now " * 20_000
    edits = token_trees.redactions(text)
    began = time.perf_counter()
    tree, after, n, _ = token_trees.apply_edits(token_trees.TokenTree.build(text, encoder), text, edits, encoder)
    assert n == len(edits) == 20_000 and after == text.replace("a@b.cc", "<email>")
    assert tree.tokens[1] == len(encoder.ordinary(after)) and tree.chars[1] == len(after)
    assert token_trees.redactions("x" * 1_000_000) == [] and token_trees.redactions("1" * 1_000_000) == [(0, 1_000_000, "<number>")]
    assert time.perf_counter() - began < 20


def test_few_edits_touch_little(encoder):
    text = "some plain words to count here. " * 3000
    tree = token_trees.TokenTree.build(text, encoder)
    new, after, n, parts = token_trees.apply_edits(tree, text, [(5, 10, "x"), (50_000, 50_000, " y"), (50_010, 50_020, "")], encoder)
    assert n == 3 and parts < 200 and new.tokens[1] == len(encoder.ordinary(after))


def test_counts_after_redaction(spark, docs, texts, odd, empty, encoder):
    got = {r.doc_id: r for r in token_trees.count_redacted(docs).collect()}
    for i, t in texts:
        after = t
        for a, b, new in reversed(token_trees.redactions(t)):
            after = after[:a] + new + after[b:]
        r = got[i]
        assert (r.n_tokens_before, r.n_edits, r.n_tokens) == (len(encoder.ordinary(t)), len(token_trees.redactions(t)), len(encoder.ordinary(after)))
    assert sum(r.n_edits for r in got.values()) > 0
    assert token_trees.count_redacted(odd).count() == odd.count() and token_trees.count_redacted(empty).count() == 0
    trees = token_trees.update_trees(token_trees.build_trees(odd.withColumn("edits", F.expr(f"CAST(NULL AS {token_trees.EDITS})"))))
    assert all(r.tokens[1] == r.n_tokens == r.n_tokens_before for r in trees.collect())


def check_packing(rows, encoder, size=1024):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for got in by_sequence.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= size
    return by_doc, by_sequence


def test_packing(docs, texts, encoder):
    rows = packing.pack_documents(docs).collect()
    by_doc, by_sequence = check_packing(rows, encoder)
    for i, t in texts:
        ids, at = encoder(t) + bytes(4), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)
    total = sum(r.length for r in rows)
    padding = sum(1024 - n for n in (sum(x for _, x in s) for s in by_sequence.values()) if n & (n - 1))
    assert padding < 0.05 * total


def test_packing_parts(docs, monkeypatch, encoder):
    monkeypatch.setattr(packing, "PART", 7)
    rows = packing.pack_documents(docs, size=64, with_ids=True).collect()
    check_packing(rows, encoder, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)


def test_packing_odd(odd, empty, encoder):
    rows = packing.pack_documents(odd).collect()
    check_packing(rows, encoder)
    assert len({r.doc_id for r in rows}) == len({r.doc_id for r in odd.collect()}) and packing.pack_documents(empty).count() == 0


def test_patterns_hold_the_histogram():
    rng = random.Random(4)
    for _ in range(30):
        size = rng.choice([16, 100, 1024])
        counts = collections.Counter(rng.randint(1, size) for _ in range(rng.randint(0, 500)))
        patterns, seen = packing.pack_histogram(counts, size), collections.Counter()
        for p, n in patterns:
            assert sum(p) <= size and n > 0
            for x in p:
                seen[x] += n
        assert seen == counts


# 8


def test_warc(spark, data):
    pages = spark.read.parquet(f"{data}/sf0.001/pages.parquet")
    more = [(None, None, "x"), (100_000, "a b", None), (100_001, None, ""), (100_002, "u", "é" * 100_000), (100_003, "u", "é" * 100_000), (100_003, "u", "é" * 100_000), (100_004, "u", "\r\n\r\nWARC/1.1\r\n0\r\n\r\n")]
    df = pages.unionByName(spark.createDataFrame(more, pages.schema)).withColumn("digest", F.lit(1))
    rows = df.collect()
    best = {}
    for r in rows:
        h = (r.html or "").encode()
        best[h] = max(best.get(h, -1), -1 if r.page_id is None else r.page_id)
    want = []
    for r in rows:
        h = (r.html or "").encode()
        first = None if best[h] < 0 else best[h]
        want.append((r.page_id, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first == r.page_id else "revisit", None if first == r.page_id else first))
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == sorted(want, key=str)
    path = shared_path(spark, "warc")
    warc.write_warc(df, path, segment=500, chunk=77, per_file=11)
    back = {r.page_id: r.payload for r in warc.read_warc(spark, path).collect() if r.record_type == "response"}
    assert all(bytes(back[r.page_id]) == (r.html or "").encode() for r in rows if r.page_id in back)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_most_pages_are_segmented(spark, data):
    """The query's archives hold continuation records; bytes of a file are bounded, and only segments are grouped."""
    path = shared_path(spark, "warc")
    pages = spark.read.parquet(f"{data}/sf0.01/pages.parquet")
    warc.write_warc(pages, path)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    kinds = collections.Counter(fields["warc-type"] for f in files for fields, _ in warc.parse(f.content))
    assert kinds["continuation"] > 10 and kinds["response"] + kinds["revisit"] == pages.count()
    monster = spark.createDataFrame([(1, "u", "z" * 40_000_000), (2, "u", "q")], pages.schema)
    rows = warc.round_trip(monster).orderBy("page_id").collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in rows] == [(1, 40_000_000, "response"), (2, 1, "response")]
    warc.write_warc(monster, path + "-big")
    assert max(len(gzip.decompress(r.content)) for r in spark.read.format("binaryFile").load(path + "-big").select("content").collect()) < 20 << 20


def test_revisits_name_records(spark, data, tmp_path):
    """Each WARC-Refers-To is the id of a response with the same digest; a dangling one is an error."""
    path, pages = shared_path(spark, "warc"), spark.read.parquet(f"{data}/sf0.001/pages.parquet")
    copies = [(7_000 + k, "u", "copied") for k in range(5)] + [(7_004, "v", "copied"), (None, None, "nobody"), (None, None, "nobody")]
    warc.write_warc(pages.unionByName(spark.createDataFrame(copies, pages.schema)), path)
    found = [fields for f in spark.read.format("binaryFile").load(path).select("content").collect() for fields, _ in warc.parse(f.content)]
    names = [f["warc-record-id"] for f in found]
    assert len(names) == len(set(names))
    held = {f["warc-record-id"]: f["warc-payload-digest"] for f in found if f["warc-type"] == "response"}
    revisits = [f for f in found if f["warc-type"] == "revisit"]
    assert len(revisits) >= 4 and all(held[f["warc-refers-to"]] == f["warc-payload-digest"] for f in revisits)
    out = [*warc.records(1, "u", b"x", warc.digest(b"x"), None, "d", 300, 100), *warc.records(2, "u", b"x", warc.digest(b"x"), "urn:page:9:0", "d", 300, 100)]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in out))
    with pytest.raises(Exception, match="no response of the same digest"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    assert [tuple(r)[3:] for r in warc.round_trip(df, min_revisit=3).orderBy("page_id").collect()] == [("response", None), ("response", None), ("revisit", 4), ("response", None)]


def test_broken_segments_are_errors(spark, tmp_path):
    out = list(warc.records(1, "u", b"x" * 1000, warc.digest(b"x" * 1000), None, "d", 300, 100))
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in out[:2] + out[3:]))
    with pytest.raises(Exception, match="missing, repeated"):
        warc.read_warc(spark, str(tmp_path)).collect()


# 9


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Vocabulary.load(bpe.vocabulary("piece_bpe_32k.model")))


def test_viterbi_is_best(codec):
    """Against a plain search over all pieces of a word."""
    scores = {codec.vocabulary.pieces[i]: codec.vocabulary.scores[i] for i in codec.vocabulary.normal}
    for word in ["▁thereathing", "▁é中x", "▁", "▁▁a", "▁naïve-🙂\nq", "a", "▁tion" * 5]:
        best = [0.0] + [-1e18] * len(word)
        for end in range(1, len(word) + 1):
            for at in range(max(0, end - 20), end):
                s = scores.get(word[at:end], codec.unknown if end - at == 1 else None)
                if s is not None:
                    best[end] = max(best[end], best[at] + s)
        ids = codec.best(word)
        assert np.frombuffer(codec.best_many([word])[0], "<u4").tolist() == ids
        by_bytes = codec.is_byte.keys() & set(ids)
        if not by_bytes:
            assert sum(codec.vocabulary.scores[i] for i in ids) == pytest.approx(best[-1])


def test_same_as_the_library(codec, texts):
    """The library's own unigram segmentation with these scores; only equal sums may differ."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(bpe.vocabulary("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p, s in zip(model.pieces, codec.vocabulary.scores, strict=True):
        p.score = s
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    total = lambda ids: sum(codec.vocabulary.scores[i] for i in ids)
    for t in [*ODD, *(t for _, t in texts[:60])]:
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        want = library.encode(t)
        assert ids == want or total(ids) == pytest.approx(total(want))
        assert codec.decode(codec.encode(t)) == t


def test_pieces_round_trip(spark, data, docs, odd, empty, codec):
    out = queries.op9_pieces(spark, f"{data}/sf0.001").collect()
    assert len(out) == docs.count() and all(r.round_trip and r.n_ids > 0 for r in out)
    assert pieces.round_trip(odd, codec.vocabulary).where("round_trip").count() == odd.count()
    assert pieces.round_trip(empty, codec.vocabulary).count() == 0
    assert codec.decode(np.array([codec.vocabulary.bytes[0xFF]], "<u4").tobytes()) == "�"


# 10


def fingerprint(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = WORD.findall(w)
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, linked):
    least = {n: n for n in nodes}
    change = True
    while change:
        change = False
        for a, b in linked:
            m = min(least[a], least[b])
            change |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_fingerprints_and_components(docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    fps = {i: fingerprint(t) for i, t in texts}
    ids = sorted(fps)
    least = reach(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == {i: (f"{fps[i]:016x}", least[i]) for i in ids}


@pytest.mark.parametrize(("bucket", "segments"), [(512, 8), (3, 8), (1, 16), (512, 4)])
def test_links_are_exact(spark, bucket, segments):
    """Planted neighbours, in pairs and beyond the size of a key's group."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:
        for _ in range(4):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.7) * (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    found = {r.node: r.component for r in components.connected_components(simhash.links(df, segments=segments, bucket=bucket)).collect()}
    least = reach(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {n: found.get(n, n) for n in least} == least


def test_simhash_odd(odd, empty):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(odd).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (3, zero, 1), (None, zero, 1)} <= got
    assert len(got) == odd.distinct().count() and simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {2, 3, 7}.isdisjoint({r.doc_id for r in kept.collect()})


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


# The queries and the pipeline


def test_oracle_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, f"{data}/sf0.001")
        want = con.sql(sql)
        assert sorted(map(tuple, df.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline(spark, data, encoder):
    import corpus_pipeline

    sf = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text or "" for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        rows = [(r.doc_id, r.text) for r in out.collect()]
        now = {i: t or "" for i, t in rows}
        assert now.keys() <= before.keys() and len(now) == len(rows)
        if name == "substring_dedup":
            kept = {i: (n, d) for i, _, n, d in kept_by_brute_force(before.items())}
            assert all(kept[i][1] == hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for i, t in now.items())
        else:
            assert all(before[i] == t for i, t in now.items())
        docs, before = spark.createDataFrame(out.collect(), out.schema), now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in last) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole)
    check_packing(whole, encoder)


def test_pipeline_stages_odd(spark, data, odd, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"{data}/sf0.001").count() == 0, name
        assert stage(spark, odd, f"{data}/sf0.001").count() > 0, name

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decision_list, exact_dedup, hard_negatives, html_text, packing, pieces, prefix_trie, quality_fm, simhash, substring_dedup, token_trees, topk_search, warc
from framelake.llm._shared import table
from framelake.llm.bpe import vocabulary


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op2's rules are made of."""
    return decision_list.statistics(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", decision_list.base_failed().alias("base_failed"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_words(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trees.count_redacted(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(vocabulary("piece_bpe_32k.model")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_quality_rules": op2_quality_rules,
    "quality_base_statistics": quality_base_statistics,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_fm": op5_quality_fm,
    "op6_token_trees": op6_token_trees,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_pieces": op9_pieces,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_top_k": op13_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "quality_base_statistics": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
        w AS (SELECT k, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS word FROM (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a FROM d)),
        g AS (SELECT *, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
        r AS (SELECT k, i FROM g WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, word, second, third) > 1),
        n AS (SELECT k, count(DISTINCT i + j) AS n FROM r, range(3) t(j) GROUP BY k),
        c AS (SELECT k, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY k),
        l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
        u AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
        s AS (
            SELECT d.doc_id, coalesce(c.n, 0) AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(u.n, 0) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words
            FROM d LEFT JOIN c USING (k) LEFT JOIN u USING (k) LEFT JOIN n USING (k))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
    """,
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) for x in embedding] AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
        QUALIFY row_number() OVER w <= 3
    """,
    "op12_prefix_trie": r"""
        WITH RECURSIVE crc AS (
            SELECT conv_id AS c, conv_id::VARCHAR AS s, 4294967295::BIGINT AS x, 0 AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
            UNION ALL
            SELECT c, s, xor(t >> 1, CASE WHEN t % 2 = 1 THEN 3988292384 ELSE 0 END), n + 1
            FROM (SELECT c, s, n, CASE WHEN n % 8 = 0 THEN xor(x, ascii(s[n // 8 + 1])) ELSE x END AS t FROM crc WHERE n < 8 * length(s))),
        convs AS (SELECT c, c - c % 20 AS base, xor(x, 4294967295) % 4 AS h FROM crc WHERE n = 8 * length(s)),
        turns AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
            FROM conversations WHERE conv_id IS NOT NULL),
        whole AS (
            SELECT v.c, 0 AS source, t.p, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.p <= v.h
            UNION ALL SELECT v.c, 1, t.p, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.p > v.h),
        prefixes AS (
            SELECT c, row_number() OVER w AS depth, string_agg(md5(role) || md5(text), ',') OVER w AS key, len(regexp_extract_all(text, '[^ 	-
]+')) AS words
            FROM whole WINDOW w AS (PARTITION BY c ORDER BY source, p ROWS UNBOUNDED PRECEDING)
            UNION ALL SELECT c, 0, '', 0 FROM convs),
        sized AS (SELECT *, max(depth) OVER (PARTITION BY c) AS size, lag(key) OVER (PARTITION BY c ORDER BY depth) AS above FROM prefixes),
        nodes AS (
            SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(words) AS words, max(size) = depth AS leaf,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = depth), '')) AS ends_sha256
            FROM sized GROUP BY key, depth),
        below AS (SELECT DISTINCT a.key, b.key AS under FROM sized a JOIN sized b ON a.c = b.c AND a.depth <= b.depth),
        sums AS (
            SELECT b.key, count(*) FILTER (WHERE n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
            FROM below b JOIN nodes n ON n.key = b.under GROUP BY b.key),
        kids AS (SELECT above AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN nodes u ON n.depth > 0 AND u.key = n.above LEFT JOIN kids k ON k.key = n.key
    """,
    "op13_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10
    """,
}

"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, fm_dedup, langid, license_scan, media, packing, partenum, quality, suffix_dedup, token_counts
from tidemark.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.digests(fm_dedup.dedup(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.label(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op9_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's interleaved sequence, one row an item."""
    items = media.interleave(table(spark, sf_dir, "pages"))
    return items.select("page_id", F.explode("items").alias("x")).select("page_id", "x.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say: word windows and shingle sets. The others tokenize, train, or look at bytes."""
    windows = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
    k AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50),
    s AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM k),
    m AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s),
    h AS (SELECT s.doc_id, s.k FROM s JOIN m ON s.s = m.s WHERE m.least < s.doc_id),
    c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(k, k + 50)) AS p FROM h)),
    p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    r AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p WHERE c.p IS NULL GROUP BY p.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    links = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(lower)} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0))),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS (SELECT i.a, i.b FROM i JOIN n AS x ON i.a = x.doc_id JOIN n AS y ON i.b = y.doc_id WHERE 100 * i.i >= 80 * (x.n + y.n - i.i)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    t AS (SELECT doc_id, doc_id AS x FROM d UNION SELECT t.doc_id, u.b FROM t JOIN u ON t.x = u.a),
    c AS (SELECT doc_id, min(x) AS component_id FROM t GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id"""
    return {"op2_substring_dedup": windows, "op4_jaccard_join": links}

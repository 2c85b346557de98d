"""From raw documents to packed training sequences, in five stages, each by one operator of tidemark.llm.

Every stage takes all rows that the one before kept, and all but the last return the columns of documents, whatever these
are called. A null text or one without a word fails the quality rules. Rows without doc_id are documents like others. Of rows
alike in doc_id and text, and of each group of near duplicates, one stays, see partenum.keep_one(); rows that share a doc_id
but not their text are different documents. A text that loses every word in substring dedup stays, empty, and packs as its
end-of-text id. Very long texts go through whole. Tables without rows give none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fm_dedup, langid, packing, partenum, quality
from tidemark.llm.common import checkpoint_folder, table

#: Score below which a text is taken for no language.
MIN_SCORE = 0.25


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    return docs.where(quality.kept(F.col("text"), quality.train(docs, table(spark, sf_dir, "labels"))))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; all of them where no document has a lang to learn from."""
    profiles = langid.learn(docs) if "lang" in docs.columns else {}
    if not profiles:
        return docs
    found = langid.predicted(F.col("text"), profiles)
    return docs.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= MIN_SCORE))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates."""
    return partenum.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller document has too; n_chars, where there is one, follows the text."""
    found = fm_dedup.clean(docs)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns]) if "n_chars" in docs.columns else found


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.best_fit(docs, cached=packing.CACHED)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: No SQL: the stages train models, tokenize, and search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the checkpoint folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{name}")
    return docs

"""Language identification by rank-order profiles (operator 10).

A profile is the list of a language's most frequent letter n-grams of one to three characters, words padded with a space,
most frequent first. A document gets such a list of its own from its whole text; its distance to a language is the sum of
how far out of place each of its n-grams is in that language's list, with the list's length for one that isn't there. The
nearest language is the prediction; the score is 1 less the distance as a share of the greatest possible one.

Profiles are learnt from a sample of at most ``SAMPLE`` labelled documents a language, those with the lowest hash of
doc_id; held-out documents are never among them. Only texts count in a prediction.

Null text, or one without a letter: ``und``, score 0. Without labelled documents every prediction is ``und``. Ties between
languages go to the first by name, ties between n-grams to the lesser code. A null doc_id isn't held out. Very long texts
count whole. One row a row of input, repeated rows alike; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tidemark.llm.common import batch, bounded_batches, cache_of, map_arrow

#: Labelled documents a language at most; n-grams of a language's profile; n-grams of a document's profile.
SAMPLE, PROFILE, OWN = 500, 400, 300
#: Parts of a language that are ranked alone before the whole is, so that no task gets all rows of a language.
SALTS = 64
UNKNOWN = "und"
BITS, SPACE = 21, 1
_alpha: list[np.ndarray] = []


def alpha() -> np.ndarray:
    """By code point: itself where it is a letter, else SPACE."""
    if not _alpha:
        table = np.full(0x110000, SPACE, np.int64)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                table[c] = c
        _alpha.append(table)
    return _alpha[0]


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    x = alpha()[points]
    letter = x != SPACE
    if not letter.any():
        return np.empty(0, np.int64)
    x = np.concatenate([[SPACE], x[letter | np.concatenate([[False], letter[:-1]])], [SPACE]])
    if x[-2] == SPACE:
        x = x[:-1]
    two = x[:-1] << BITS | x[1:]
    three = two[:-1] << BITS | x[2:]
    return np.concatenate([x[x != SPACE], two, three])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, ties in their own order."""
    if not len(codes):
        return codes
    codes.sort()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(starts, len(codes)))
    return codes[starts[(-counts).argsort(kind="stable")[:most]]]


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def least(rows: DataFrame, key: str, order: list, salt: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each key in an order: of each of its SALTS parts first, then of what these leave."""
    first = rows.withColumn("salt_", F.pmod(salt, F.lit(SALTS))).withColumn("k", F.row_number().over(Window.partitionBy(key, "salt_").orderBy(*order))).where(F.col("k") <= most)
    return first.drop("salt_", "k").withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("k") <= most)


def learn(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, from (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.xxhash64("doc_id")
    # The limit of each language's hash comes from ids alone and is pre-aggregated; texts are then only filtered.
    near = least(rows.select("lang", h.alias("h")), "lang", ["h"], F.xxhash64("h"), sample)
    last = {r.lang: r.h for r in near.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not last:
        return {}
    chosen = rows.where(F.create_map(*[F.lit(x) for kv in sorted(last.items()) for x in kv])[F.col("lang")] >= h)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(text))
        for lang, codes in found.items():
            values, counts = np.unique(np.concatenate(codes), return_counts=True)
            yield batch(("lang", "code", "n"), ([lang] * len(values), values, counts), (pa.string(), pa.int64(), pa.int64()))

    counted = map_arrow(chosen.select("text", "lang"), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = least(counted, "lang", [F.desc("n"), "code"], F.xxhash64("code"), size)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "k").collect():
        profiles.setdefault(r.lang, []).append(r.code)
    return profiles


class Profiles:
    """All profiles as one table of ranks."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.languages = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.rank[k, self.codes.searchsorted(np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def predict(self, text: str | None, own: int = OWN) -> tuple[str, float]:
        codes = ranked(grams(text), own) if text else ()
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        at = self.codes.searchsorted(codes)
        there = self.codes[np.minimum(at, len(self.codes) - 1)] == codes
        rank = self.rank[:, np.where(there, at, len(self.codes))]
        far = np.where(rank >= 0, np.abs(rank - np.arange(len(codes))), self.size).sum(axis=1)
        k = int(far.argmin())
        return self.languages[k], float(max(0.0, 1 - far[k] / (self.size * len(codes))))


def predicted(text: Column, profiles: dict[str, list[int]], size: int = PROFILE) -> Column:
    """struct<lang_pred, score> of a text; only the text goes to Python, whatever else its row has."""
    bounded_batches(SparkSession.active())
    fields = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(t: pa.Array) -> pa.Array:
        cache_of(__name__)
        p = Profiles(profiles, size)
        return pa.array([dict(zip(("lang_pred", "score"), p.predict(x), strict=True)) for k in range(0, len(t), 64) for x in t.slice(k, 64).to_pylist()], fields)

    return predict(text.cast("string"))


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, then the columns of ``docs`` named in ``keep`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(profiles, size)
        for b in batches:
            got = [p.predict(x) for x in b.column(2).to_pylist()]
            yield batch(["doc_id", "held_out", "lang_pred", "score", *keep], [b.column(0), b.column(1), [x for x, _ in got], [y for _, y in got], *b.columns[3:]], [pa.int64(), pa.bool_(), pa.string(), pa.float64(), *(c.type for c in b.columns[3:])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep])
    fields = [StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return map_arrow(rows, run, StructType([*fields, *[docs.schema[c] for c in keep]]))

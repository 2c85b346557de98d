"""Heatmaps, tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_ROWS = 1000


def bucket_cells(rows: DataFrame, by: list[str], buckets: list[tuple[int, str, Column]]) -> DataFrame:
    """(by, ts_ms, pk, bucket_index, value): a row a bucket that a sample has."""
    cells = F.array(*[F.struct(F.lit(i).alias("bucket_index"), c.alias("value")) for i, _, c in buckets])
    return rows.select(*by, "ts_ms", "pk", F.explode(cells).alias("x")).select(*by, "ts_ms", "pk", "x.*").where(F.col("value").isNotNull())


def heatmap(cells: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by, bucket_index, ts, value): sums of buckets by clock-aligned windows; partial sums come before the shuffle."""
    ts = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(max(1, width)))
    return cells.groupBy(*by, "bucket_index", ts.alias("ts")).agg(F.sum("value").alias("value"))


def tabular(rows: DataFrame, by: list[str], fields: list[tuple[str, Column]], limit: int, newest: bool) -> DataFrame:
    """(time, by, fields): the oldest rows with a selected field, or the newest; in time order either way."""
    picked = rows.select(F.col("ts_ms").alias("time"), F.col("pk").alias("pk_"), *[F.coalesce(F.col(b), F.lit("")).alias(b) for b in by], *[c.alias(n) for n, c in fields])
    some = F.lit(False)
    for n, _ in fields:
        some = some | F.col(f"`{n}`").isNotNull()
    order = [F.desc("time"), F.desc("pk_")] if newest else [F.asc("time"), F.asc("pk_")]
    return picked.where(some).orderBy(*order).limit(limit).orderBy("time", "pk_").drop("pk_")

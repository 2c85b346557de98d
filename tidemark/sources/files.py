"""Log files as ordered lines: archives and binary files are left out and reported, gzip and bzip2 are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of archives (fixed values).
ARCHIVES = (".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.zst", ".tar.xz", ".zip")
HEAD = 65_536


def listing(spark: SparkSession, *paths: str) -> list[str]:
    """Files of paths, folders and globs, each once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, None] = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for status in fs.globStatus(path) or []:
            if status.isFile():
                found[status.getPath().toString()] = None
                continue
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                found[files.next().getPath().toString()] = None
    return sorted(found)


def lines(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """((stream, ord, line), (path, reason)): lines of readable files in their order, and the files that are left out."""
    files = listing(spark, *paths)
    kept = [f for f in files if not f.lower().endswith(ARCHIVES)]
    skipped = [(f, "archive") for f in files if f.lower().endswith(ARCHIVES)]
    if not kept:
        empty = spark.createDataFrame([], "stream string, ord struct<block:bigint,n:bigint>, line string")
        return empty, spark.createDataFrame(skipped, "path string, reason string")
    # Only a line feed ends a line, with one carriage return before it or none.
    text = spark.read.option("lineSep", "\n").text(kept).select(F.col("_metadata.file_path").alias("stream"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("ord"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    # Heads are enough to tell a binary file: the first block's first lines.
    binary = text.where((F.col("ord.block") == 0) & F.contains(F.substring("line", 1, HEAD), F.lit("\0"))).select(F.col("stream").alias("path")).distinct()
    left_out = spark.createDataFrame(skipped, "path string, reason string").unionByName(binary.select("path", F.lit("binary").alias("reason")))
    return text.join(binary, text["stream"] == binary["path"], "left_anti"), left_out

"""Checkpoints in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Written once to the folder in spark.checkpoint.dir; a temporary one only on a local master without it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def folder(spark) -> str:
    """The checkpoint folder itself, for tables that outlive a query."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    return sc.getCheckpointDir()

"""Written stages that cut lineage between rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation


def counted_stage(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """`stage(df)` with aggregates over its rows, taken while they are written."""
    seen = Observation()
    out = stage(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return out, seen.get


def stage(df: DataFrame) -> DataFrame:
    """`df`, written to the folder that all executors share, and read back."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loamgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Streams of measurements: hourly medians with a watermark, and hysteresis with state for each key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Where rows without a time or id stand; rows given out at once.
LAST, GIVEN = 2**63 - 1, 10_000


def events(spark: SparkSession, path: str) -> DataFrame:
    """The table of events as a stream; its files are found under the folder by name, so that both a file and a folder serve."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """key, hour, n, total, least, most of each hour; rows later than the watermark are dropped."""
    rows = stream.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    return rows.groupBy("key", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most")).select("key", F.col("w.start").alias("hour"), "n", "total", "least", "most")


def hysteresis(stream: DataFrame, centre: float, half: float) -> DataFrame:
    """key, event_id, state, smooth: the band's side is kept for each key from batch to batch.

    Rows are taken in order of time and id within a batch; a null value clears the state.
    """
    lower, upper = max(0.0, centre - half), centre + half

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side = state.get[0] if state.exists else None
        # A key's rows are held as three numbers each, rows without a time or id last.
        held = []
        for batch in batches:
            at, i = batch["ts"].to_numpy("datetime64[ns]").view(np.int64), batch["event_id"]
            held.append((np.where(batch["ts"].isna(), LAST, at), i.astype("Int64").fillna(LAST).to_numpy(np.int64), batch["value"].to_numpy(np.float64, na_value=np.nan)))
        ts, ids, values = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((ids, ts))
        for a in range(0, len(order), GIVEN):
            own = order[a : a + GIVEN]
            out = []
            for i, value in zip(ids[own].tolist(), values[own].tolist()):
                if math.isnan(value):
                    side = None
                    continue
                if value > upper:
                    side = "H"
                elif value <= lower:
                    side = "L"
                elif side is None:
                    side = "H" if value > centre else "L"
                out.append((key[0], None if i == LAST else i, side, max(value, upper) if side == "H" else min(value, lower)))
            yield pd.DataFrame(out, columns=["key", "event_id", "state", "smooth"])
        state.update((side,))

    rows = stream.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, event_id long, state string, smooth double", "side string", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream gives from what is there now, through a file sink with its own checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def updated(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The last row of each key that a stream in update mode gives from what is there now.

    Each batch is written to a folder of its own, anew if it is repeated; nothing comes to the driver, and the
    stream's watermark lets go of state.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = stream.schema.add("batch", "long")
    rows = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")

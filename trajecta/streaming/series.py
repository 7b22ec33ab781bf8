"""The grid, gap-separated episodes and running stages over event streams. Watermarks bound state; late rows beyond them go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def events(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(ddl).parquet(folder)


def binned(stream: DataFrame, key: str = "id", ts: str = "ts", value: str = "value", hours: int = 6, late: str = "2 days") -> DataFrame:
    """(key, start, stop, top, n): largest value of each fixed bin, given out when the watermark passes it."""
    w = F.window(ts, f"{hours} hours")
    g = stream.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.max(value).alias("top"), F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "top", "n")


def gap_episodes(stream: DataFrame, key: str = "id", ts: str = "ts", gap: str = "48 hours", late: str = "2 days") -> DataFrame:
    """(key, start, stop, n): runs of rows less than the gap apart."""
    g = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("stop"))
    return g.select(key, "start", "stop", "n")


def pair_means(stream: DataFrame, key: str = "id", ts: str = "ts", value: str = "value", max_hours: int = 24) -> DataFrame:
    """(id, ts, value): each value averaged with the next of its key if that is near, given out when the next has come. State: one row a key."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts")
        out = []
        for t, v in zip(rows["ts"], rows["value"]):
            at = int(t.value // 1000) if hasattr(t, "value") else int(t)
            if held is not None:
                before, old = held
                near = 0 <= at - before <= max_hours * 3_600_000_000
                out.append((k[0], pd.Timestamp(before + (at - before) // 2 if near else before, unit="us"), (old + v) / 2 if near else old))
            held = (at, float(v))
        if held is not None:
            state.update(held)
        yield pd.DataFrame(out, columns=["id", "ts", "value"])

    narrow = stream.select(F.col(key).alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return narrow.groupBy("id").applyInPandasWithState(run, "id long, ts timestamp, value double", "ts long, value double", "append", GroupStateTimeout.NoTimeout)

"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """A folder of tables that belong to one job. Tables are read back with a fresh, short lineage. options: of the Parquet writer."""

    def __init__(self, spark: SparkSession, name: str, **options: str):
        self.spark, self.options = spark, options
        self.path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.places: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        place = f"{self.path}/{self.n}"
        df.write.options(**self.options).parquet(place)
        back = self.spark.read.schema(df.schema).parquet(place)
        self.places.append((back, place))
        return back

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of what is finished, which it does when the driver's objects for it are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for place in [p for df, p in self.places if any(df is t for t in tables)]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.places = [(df, p) for df, p in self.places if not any(df is t for t in tables)]


def plain(name: str) -> Column:
    """The column of this very name, dots included."""
    return F.col(f"`{name}`")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests on one machine) a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


#: Bits of a filter for each key, and its most words of 64 bits: 16 MB on the driver and each executor. Where there are more keys than
#: that serves, the filter only selects less; what it passes is joined exactly in any case.
BITS_A_KEY, MOST_WORDS = 24, 1 << 21


def key_filter(keys: DataFrame, key: str, most: int = MOST_WORDS) -> np.ndarray:
    """Bits of the 64-bit keys: `passes` is true for all of them and for few others. At most `most` rows come to the driver."""
    n = max(1, keys.count() * BITS_A_KEY // 64)
    size = min(most, 1 << (n - 1).bit_length())
    bit = F.shiftrightunsigned(F.col(key), 40).bitwiseAND(F.lit(63)).cast("int")
    rows = (
        keys.where(F.col(key).isNotNull())
        .select(F.col(key).bitwiseAND(F.lit(size - 1)).alias("at"), bit.alias("b"))
        .groupBy("at")
        .agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(size, dtype=np.int64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.astype(np.int64, copy=False).view(np.uint64)
    return ((bits[(k & np.uint64(len(bits) - 1)).astype(np.int64)] >> ((k >> np.uint64(40)) & np.uint64(63))) & np.uint64(1)).astype(bool)

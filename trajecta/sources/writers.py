"""Sinks: Parquet first; text forms for tools that read them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "overwrite", *by: str) -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def ragged_rows(df: DataFrame, id_: str = "id", values: str = "values", form: str = "%f", sep: str = ",") -> DataFrame:
    """One text column of rows id,v0,v1,...; an empty array gives the id alone."""
    cells = F.transform(F.col(values), lambda x: F.format_string(form, x.cast("bigint") if form.endswith("d") else x.cast("double")))
    return df.select(F.concat_ws(sep, F.col(id_).cast("string"), cells).alias("value"))


def ragged(df: DataFrame, path: str, id_: str = "id", values: str = "values", form: str = "%f", sep: str = ",", append: bool = False, parts: int = 8) -> None:
    """Rows in the order of their ids, within and across files."""
    ragged_rows(df.repartitionByRange(parts, id_).sortWithinPartitions(id_), id_, values, form, sep).write.mode("append" if append else "overwrite").text(path)


def edges(df: DataFrame, path: str) -> None:
    df.select("id1", "id2", "d").write.mode("overwrite").parquet(path)


def alignment_rows(df: DataFrame) -> DataFrame:
    """Text of stored alignments, as readers.alignments takes them."""
    line = lambda i, p: F.concat_ws(",", F.col(i).cast("string"), F.transform(F.col(p), lambda x: x.cast("string")))
    return df.select(F.concat_ws("\n", line("id1", "path1"), line("id2", "path2"), F.lit("")).alias("value"))


def table(df: DataFrame, path: str, label: str = "label") -> None:
    """A long summary table as one CSV with a header: it has a few hundred rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def formatted(count: Column, share: Column) -> Column:
    """n (p%) as text."""
    return F.format_string("%d (%.2f%%)", count.cast("bigint"), share * 100)


def clustered_alignments(df: DataFrame, path: str, parts: int = 64) -> None:
    """Alignments (id1 < id2, ...) in ranges of (id1, id2), with a table of each range's least and largest pair (see `readers.clustered_alignments`)."""
    dealt = df.repartitionByRange(parts, "id1", "id2").sortWithinPartitions("id1", "id2").withColumn("part", F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    pair = F.struct("id1", "id2")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    written.groupBy("part").agg(F.min(pair).alias("least"), F.max(pair).alias("most")).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


class ColumnGroups:
    """A wide table of one row a key, kept as groups of columns that are each made once for the inputs they depend on.

    A group's folder is named by a digest of its version and of the contents of its inputs (their columns, number of rows and two sums of row
    hashes, whatever the rows' order and partitions), so a group whose inputs haven't changed is read, and any other is made anew beside it. A write that
    broke off has left no mark of success and is written over, so a run can be repeated as often as it takes.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.groups: dict[str, str] = {}

    def _there(self, place: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @staticmethod
    def digest(inputs: Sequence[DataFrame], version: str = "") -> str:
        """Of the inputs' contents; one pass over each."""
        told = [version]
        for df in inputs:
            row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
            n, x, s = df.select(row.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
            told.append(f"{df.schema.simpleString()}:{n}:{x}:{s}")
        return hashlib.sha256("|".join(told).encode()).hexdigest()[:32]

    def group(self, name: str, make: Callable[[], DataFrame], *inputs: DataFrame, version: str = "") -> DataFrame:
        """The group's columns, made by `make` unless they are there for these inputs. Rows that share a key are an error."""
        place = f"{self.path}/{name}/{self.digest(inputs, version)}"
        if not self._there(place):
            made = make()
            made.repartition(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(place)
            twice = self.spark.read.parquet(place).groupBy(self.key).count().where("count > 1")
            if not twice.isEmpty():
                raise ValueError(f"group {name} has rows that share a {self.key}")
        self.groups[name] = place
        return self.spark.read.parquet(place)

    def table(self, ids: DataFrame) -> DataFrame:
        """One row for each id with the columns of all groups so far; a column that an earlier group has too is named group_column."""
        out = ids.select(self.key)
        for name, place in self.groups.items():
            part = self.spark.read.parquet(place)
            renamed = [F.col(f"`{c}`").alias(c if c == self.key or c not in out.columns else f"{name}_{c}") for c in part.columns]
            out = out.join(part.select(*renamed), self.key, "left")
        return out

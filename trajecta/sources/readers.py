"""Scans. Files have no order in Spark, so file order is made explicit where a rule needs it."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.operators.joins import first_rows
from trajecta.sources import schemas


def csv(spark: SparkSession, path: str, ddl: str, sep: str = ",", place: bool = False) -> DataFrame:
    """A CSV file with a header and known columns. place: adds the row's position (file, then offset in it)."""
    df = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False).schema(ddl).csv(path)
    return df.withColumn("place", F.monotonically_increasing_id()) if place else df


def ragged(spark: SparkSession, path: str, sep: str = ",", skip_header: bool = False, ids: DataFrame | None = None, columns: Sequence[int] | None = None, kind: str = "double") -> DataFrame:
    """(id, values) of rows id,v0,v1,... of any length; an id alone has an empty array. ids keeps only those; columns picks positions."""
    parts = F.split("value", F.lit(f"\\{sep}" if sep in "^|.$*+?()[]{}\\" else sep))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    rest = F.filter(rest, lambda x: F.trim(x) != "")
    if columns is not None:
        rest = F.array(*(F.get(rest, F.lit(i)) for i in columns))
    df = spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("bigint").alias("id"), F.transform(rest, lambda x: F.trim(x).try_cast(kind)).alias("values"))
    if skip_header:
        df = df.where("id is not null")  # a header's first cell is no number
    return df.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else df


def missing_ids(ids: DataFrame, found: DataFrame) -> DataFrame:
    return ids.select("id").join(found, "id", "left_anti")


def registry(spark: SparkSession, events: str, mapping: str, event_ddl: str, mapping_ddl: str, key: str, date: str, sep: str = "^") -> DataFrame:
    """(id, date) of a registry by its own key: the first mapping of a key counts, unmatched rows go."""
    e = csv(spark, events, event_ddl, sep)
    m = first_rows(csv(spark, mapping, mapping_ddl, ",", place=True), key, "place").drop("place")
    return e.join(m, key).select(m.columns[1] if m.columns[0] == key else m.columns[0], date)


def code_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(name, code) of lines `name: code, a.b - a.d, ...`: a range counts up its last digits, keeping their number."""
    t = spark.read.text(path).where(F.contains("value", F.lit(":")))
    t = t.select(F.trim(F.split_part("value", F.lit(":"), F.lit(1))).alias("name"), F.explode(F.split(F.split_part("value", F.lit(":"), F.lit(2)), ",")).alias("part"))
    t = t.withColumn("part", F.trim("part")).where("part <> ''")
    low, high = F.trim(F.split_part("part", F.lit("-"), F.lit(1))), F.trim(F.split_part("part", F.lit("-"), F.lit(2)))
    digits = lambda c: F.regexp_extract(c, r"(\d+)$", 1)
    stem = F.regexp_extract(low, r"^(.*?)(\d+)$", 1)
    count = F.sequence(digits(low).try_cast("int"), F.greatest(digits(high).try_cast("int"), digits(low).try_cast("int")))
    spread = F.transform(count, lambda i: F.concat(stem, F.lpad(i.cast("string"), F.length(digits(low)), F.lit("0"))))
    return t.select("name", F.explode(F.when(F.contains("part", F.lit("-")), spread).otherwise(F.array("part"))).alias("code"))


def names(spark: SparkSession, path: str) -> list[str]:
    """A list of feature names, one a line."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def weights(spark: SparkSession, path: str) -> list[float]:
    """The second column of a small CSV file with a header or without, in file order."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    out = []
    for r in rows:
        try:
            out.append(float(r[0].split(",")[1]))
        except (IndexError, ValueError):
            continue
    return out


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Distances (id1, id2, d), Parquet or rows id1,id2,d."""
    return spark.read.schema(schemas.EDGES).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schemas.EDGES).csv(path)


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(id1, id2, path1, path2) of stored alignments: groups of three lines, two sequences with their ids first and a blank one."""
    t = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    line = lambda i: F.split(F.split_part(F.ltrim("value"), F.lit("\n"), F.lit(i)), ",")
    seq = lambda i: F.transform(F.filter(F.slice(line(i), 2, 1_000_000), lambda x: F.trim(x) != ""), lambda x: x.try_cast("double"))
    return t.select(F.get(line(1), F.lit(0)).try_cast("bigint").alias("id1"), F.get(line(2), F.lit(0)).try_cast("bigint").alias("id2"), seq(1).alias("path1"), seq(2).alias("path2"))


def labelled_items(dictionary: DataFrame, part: str) -> DataFrame:
    """Item numbers whose label contains a text, whatever its case."""
    return dictionary.where(F.lower("LABEL").contains(part.lower())).select("ITEMID")


def critical_care(labs: DataFrame, dictionary: DataFrame, stays: DataFrame, admissions: DataFrame, part: str = "creatinine") -> DataFrame:
    """(id, ts, value, icu): one lab's values with whether they lie in an intensive-care stay of the same admission."""
    wanted = labs.join(F.broadcast(labelled_items(dictionary, part)), "ITEMID")  # a dictionary of some hundred labels
    v = wanted.join(admissions.select("HADM_ID"), "HADM_ID").select("HADM_ID", F.col("SUBJECT_ID").alias("id"), F.try_to_timestamp("CHARTTIME").alias("ts"), F.col("VALUENUM").alias("value"))
    s = stays.select("HADM_ID", F.try_to_timestamp("INTIME").alias("a"), F.try_to_timestamp("OUTTIME").alias("b"))
    inside = F.max(F.coalesce(F.col("ts").between(F.col("a"), F.col("b")), F.lit(False)))
    return v.join(s, "HADM_ID", "left").groupBy("id", "HADM_ID", "ts", "value").agg(inside.alias("icu")).drop("HADM_ID")


@dataclass(frozen=True)
class Config:
    """Scalars of a study."""

    base_path: str = "."
    analysis_days: int = 14
    hours: int = 6
    injury_days: int = 3
    window: int = 2
    max_gap_hours: int = 24
    cohort: str = "a"
    version: str = "v1"
    period: str = "icu"
    weights_file: str | None = None
    verbose: bool = False

    @staticmethod
    def read(text: str, strict: bool = False) -> Config:
        """Of a JSON object; `NAMES` are the names that other studies' files have. A name that is neither is passed over with a warning, or if `strict` an error."""
        given = {NAMES.get(k, k): v for k, v in json.loads(text).items()}
        unknown = sorted(set(given) - set(Config.__dataclass_fields__))
        if unknown and strict:
            raise ValueError(f"no such settings: {unknown}")
        if unknown:
            warnings.warn(f"no such settings: {unknown}", stacklevel=2)
        return Config(**{k: v for k, v in given.items() if k not in unknown})


#: Fixed names of study files and the settings they are.
NAMES = {"basePath": "base_path", "cohortName": "cohort", "analyze": "period", "analysisDays": "analysis_days", "timeResolutionHrs": "hours", "verbose": "verbose", "transition_cost_file": "weights_file", "akiDayLim": "injury_days"}


def as_times(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as timestamps."""
    from trajecta.functions.times import parse_timestamp

    return df.withColumns({c: parse_timestamp(F.col(c)) for c in columns})


def unpivoted_treatments(raw: DataFrame, id_: str = "STUDY_PATIENT_ID") -> DataFrame:
    """(id, kind, start, stop, place) of a table with a pair of columns for each kind of dialysis."""
    from trajecta.functions.times import parse_timestamp

    def one(kind: str) -> Column:
        a, b = (schemas.resolved([c for c in raw.columns if c.lower().startswith(kind.lower() + "_")], e) for e in ("start", "stop"))
        return F.struct(F.lit(kind).alias("kind"), parse_timestamp(F.col(a)).alias("start"), parse_timestamp(F.col(b)).alias("stop"))

    kinds = [k for k in ("HD", "CRRT", "PD") if any(c.upper().startswith(k + "_START") for c in raw.columns)]
    marked = raw if "place" in raw.columns else raw.withColumn("place", F.monotonically_increasing_id())
    return marked.select(F.col(id_).alias("id"), "place", F.explode(F.array(*map(one, kinds))).alias("e")).select("id", "place", "e.*").where("start is not null")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(report, line, tokens) of the lines of text files that aren't blank; line from 0, tokens between white space. A file is one row of its reader, so it must be a report's size."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("report"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    tokens = F.array_remove(F.split("text", r"\s+"), "")
    return whole.select("report", "line", tokens.alias("tokens")).where("size(tokens) > 0")


def reclassification_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, statistic, value, low, high, p) of text reports of reclassification: nri_categorical, nri_continuous, nri_events, nri_nonevents, idi, auc_before and auc_after.

    A line is known by its first words and its numbers by their places; the bounds of non-events stand in reverse. The first line of an area is
    that of the model before, the second that of the one after, and so with the lines of their intervals. Lines of no statistic are passed over.
    """
    lines = _lines(spark, path)
    t = lambda i: F.get("tokens", F.lit(i))
    last = lambda i: F.get("tokens", F.size("tokens") - i)
    row = lambda name, *numbers: F.struct(F.lit(name).alias("statistic"), *(x.try_cast("double").alias(n) for n, x in zip(("value", "low", "high", "p"), numbers)))
    null = F.lit(None).cast("string")
    full = lambda name: row(name, t(3), t(5), t(7), t(11))
    bound = lambda i: F.get(F.regexp_extract_all(t(2), F.lit(r"([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), F.lit(i))
    found = F.when(t(0) == "NRI(Categorical)", full("nri_categorical")).when(t(0) == "NRI(Continuous)", full("nri_continuous"))
    found = found.when((t(0) == "NRI") & (t(2) == "events"), row("nri_events", t(4), last(2), last(1), null)).when((t(0) == "NRI") & (t(2) == "non-events"), row("nri_nonevents", t(4), last(1), last(2), null))
    found = found.when((t(0) == "IDI") & (t(1) != "SE"), full("idi")).when(t(0) == "Area", row("auc", last(1), null, null, null)).when(t(0) == "95%", row("auc_ends", null, bound(0), bound(1), null))
    rows = lines.withColumn("f", found).where("f is not null").select("report", "line", "f.*")
    order = F.row_number().over(W.partitionBy("report", "statistic").orderBy("line"))  # a report has few lines
    named = rows.withColumn("n", order).withColumn("statistic", F.when(F.col("statistic").isin("auc", "auc_ends"), F.when(F.col("n") == 1, "auc_before").otherwise("auc_after")).otherwise(F.col("statistic")))
    return named.groupBy("report", "statistic").agg(*(F.max(c).alias(c) for c in ("value", "low", "high", "p")))


def coefficient_reports(spark: SparkSession, path: str, features: int, header: int = 12) -> DataFrame:
    """(report, place, name, coefficient, low, high) of the `features` lines after the first `header` of text summaries of fitted models, blank ones included."""
    lines = _lines(spark, path).where((F.col("line") >= header) & (F.col("line") < header + features))
    number = lambda c, n: c.try_cast("double").alias(n)
    last = lambda i: F.get("tokens", F.size("tokens") - i)
    return lines.select("report", (F.col("line") - header).alias("place"), F.get("tokens", F.lit(0)).alias("name"), number(F.get("tokens", F.lit(1)), "coefficient"), number(last(2), "low"), number(last(1), "high"))


def clustered_alignments(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The stored alignments (`writers.clustered_alignments`) of the pairs `wanted` (id1, id2 in either order), read from the ranges that can hold them.

    The ranges' bounds are a table of one row a range; those that a wanted pair lies in are partition values of the read, so the other
    ranges' files are never opened.
    """
    pairs = wanted.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()
    bounds = spark.read.parquet(f"{path}/bounds")
    key = F.struct("id1", "id2")
    met = pairs.join(F.broadcast(bounds), (key >= F.col("least")) & (key <= F.col("most")))  # one row a range
    parts = [r[0] for r in met.select("part").distinct().collect()]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin(parts))
    return rows.join(pairs, ["id1", "id2"], "left_semi").drop("part")

"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every 8 consecutive 6-word hashes the least is a fingerprint, so a shared span of 13 words always shares one, at the same place of the span.
Fingerprints of documents and benchmark items are joined; each meeting is extended over the words of both, which are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.llm.scratch import Scratch, plain

#: Words end at these ASCII characters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window; words of a hashed gram; grams of which one is kept. WINDOW = GRAM + KEPT_OF - 1.
WINDOW, GRAM, KEPT_OF = 13, 6, 8


def folded(text: Column) -> Column:
    """A-Z as a-z, all else unchanged; null as empty."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.coalesce(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(""))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(folded(text), BREAKS), "")


def _joined(a: str, b: str, shift: int, made: str) -> Column:
    """made(x, y) for each x of array a and the y of array b that is `shift` places on."""
    n = f"greatest(least(size({a}), size({b}) - {shift}), 0)"
    return F.expr(f"zip_with(slice({a}, 1, {n}), slice({b}, {shift + 1}, {n}), (x, y) -> {made})")


def _hashes(frame: DataFrame) -> DataFrame:
    """Adds h (of each word), g2, g4 and g6 (of each run of as many words) to a frame with ws."""
    frame = frame.withColumn("h", F.expr("transform(ws, x -> xxhash64(x))"))
    frame = frame.withColumn("g2", _joined("h", "h", 1, "xxhash64(x, y)"))
    frame = frame.withColumn("g4", _joined("g2", "g2", 2, "xxhash64(x, y)"))
    return frame.withColumn("g6", _joined("g4", "g2", 4, "xxhash64(x, y)"))


def _least(frame: DataFrame) -> DataFrame:
    """Adds m8: the least of each 8 consecutive values of g6."""
    for k in (1, 2, 4):
        source = "g6" if k == 1 else f"m{k}"
        frame = frame.withColumn(f"m{2 * k}", _joined(source, source, k, "least(x, y)"))
    return frame


# Arrays that are made in long chains of expressions are unfolded by explode_outer: for explode, Spark tests their size first and so makes them again.


def _prints(frame: DataFrame) -> DataFrame:
    """Adds f: (g, at) of each place whose 6-word hash is the least of some 8 consecutive ones that it is among."""
    least = " or ".join(f"get(m8, i - {k}) = g" for k in range(KEPT_OF))
    return frame.withColumn("f", F.expr(f"filter(transform(g6, (g, i) -> if({least}, struct(g, i as at), null)), x -> x is not null)"))


def _whole(frame: DataFrame, length: int) -> DataFrame:
    """Adds w: a hash of each run of `length` words."""
    frame = frame.withColumn("w", F.expr(f"transform(h, x -> xxhash64(x, {length}))"))
    for k in range(1, length):
        frame = frame.withColumn("w", _joined("w", "h", k, f"xxhash64(x, y, {k})"))
    return frame


def row_key(doc_id: Column, text: Column) -> Column:
    """What rows of one doc_id and text share."""
    return F.xxhash64(doc_id, text)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _extended(met: DataFrame) -> DataFrame:
    """Adds the runs of equal words (start, len) that are long enough to `met` (ws, item words iw, shift: place in the document less place in the item).

    The two texts are laid over each other by the shift and compared word by word from end to end, so a meeting is extended as far as it goes.
    Only the words that lie over each other are taken out of the document, never more than the item has, in the join that brings both sides
    together: a text of which every place meets an item is not copied for each of them.
    """
    lo = "greatest(shift, 0)"
    n = f"least(size(ws) - {lo}, size(iw) - {lo} + shift)"
    met = met.withColumn("eq", F.expr(f"zip_with(slice(ws, {lo} + 1, {n}), slice(iw, {lo} - shift + 1, {n}), (x, y) -> x = y)"))
    met = met.withColumn("ends", F.expr("concat(array(-1), filter(transform(eq, (x, i) -> if(x, null, i)), x -> x is not null), array(size(eq)))"))
    met = met.withColumn("runs", F.expr(f"transform(slice(ends, 1, size(ends) - 1), (e, i) -> struct(e + 1 + {lo} as start, ends[i + 1] - e - 1 as len))"))
    return met.withColumn("runs", F.expr(f"filter(runs, r -> r.len >= least({WINDOW}, size(iw)))")).drop("eq", "ends")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, items) of every document; items: the sorted ids, as strings, of items with a window in it.

    Words are runs of digits, letters and all non-ASCII characters, with A-Z as a-z. A window is 13 consecutive words
    of an item, or all words of an item of fewer; every document word inside an occurrence of a window is hit.
    Null, empty and wordless texts have no words and no hits; wordless items have no window; repeated rows each keep a
    row with the same figures; items that share an id count once; the words of an item without an id are hit, but it isn't
    listed. Lengths of items under 13 words (12 at most) are the only values that come to the driver. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnow")
    rows = docs.select(plain(doc_id).alias("id"), plain(text).alias("t")).withColumn("rid", row_key(F.col("id"), F.col("t")))
    items = benchmark.select(plain(item_id).cast("string").alias("item"), word_list(plain(item_text)).alias("iw")).where("size(iw) > 0").distinct()
    items = scratch.table(items.withColumn("iid", F.xxhash64("item", "iw")))
    short = sorted(r[0] for r in items.where(f"size(iw) < {WINDOW}").select(F.size("iw")).distinct().collect())
    # hashes and least hashes as tables before they are used many times in one expression
    of_items = scratch.table(_least(_hashes(items.select("iid", F.col("iw").alias("ws")))).select("iid", "ws", "h", "g6", "m8"))
    prints = _prints(of_items.where(f"size(ws) >= {WINDOW}")).select("iid", F.explode_outer("f").alias("f")).where("f is not null").select("iid", "f.g", F.col("f.at").alias("item_at"))
    for n in short:
        prints = prints.union(_whole(of_items.where(f"size(ws) = {n}"), n).select("iid", F.explode_outer("w").alias("g"), F.lit(0).alias("item_at")))
    prints = scratch.table(prints)

    # the distinct fingerprints of each document
    found = _least(_hashes(rows.select("id", "rid", word_list(F.col("t")).alias("ws"))))
    for n in short:
        found = _whole(found, n).withColumn(f"s{n}", F.array_distinct("w")).drop("w")
    every = scratch.table(found.select("id", "rid", F.size("ws").cast("long").alias("n_words"), F.concat(F.array_distinct("m8"), *(F.col(f"s{n}") for n in short)).alias("gs")))
    meeting = every.select("rid", F.explode("gs").alias("g")).join(prints.select("g").distinct(), "g", "left_semi").select("rid").distinct()
    meeting = scratch.table(meeting)

    # their places in the documents that have one of an item's, and the words from there on both sides
    few = rows.join(meeting, "rid", "left_semi").select("rid", word_list(F.col("t")).alias("ws")).dropDuplicates(["rid"])
    few = scratch.table(_least(_hashes(few)).select("rid", "ws", "h", "g6", "m8"))
    places = _prints(few).select("rid", F.explode_outer("f").alias("f")).where("f is not null").select("rid", "f.g", F.col("f.at").alias("at"))
    for n in short:
        places = places.union(_whole(few, n).select("rid", F.posexplode_outer("w").alias("at", "g")).where("g is not null").select("rid", "g", "at"))
    shifts = scratch.table(places.join(prints, "g").select("rid", "iid", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    met = shifts.join(items, "iid").join(few.select("rid", "ws"), "rid")
    hits = scratch.table(_extended(met).select("rid", "item", F.explode_outer("runs").alias("run")).where("run is not null").select("rid", "item", "run.start", "run.len"))
    # words of runs that overlap count once: each run adds what lies behind the ends of those that start before it
    runs = hits.select("rid", "start", (F.col("start") + F.col("len")).alias("end")).groupBy("rid", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(W.partitionBy("rid").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))), F.lit(0))
    covered = runs.withColumn("added", added).groupBy("rid").agg(F.sum("added").cast("long").alias("n_hit"))
    which = hits.where("item is not null").select("rid", "item").distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    covered, which = scratch.table(covered), scratch.table(which)
    out = every.drop("gs").join(covered, "rid", "left").join(which, "rid", "left")
    return out.select(F.col("id").alias(doc_id), F.col("rid").alias("row_key"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

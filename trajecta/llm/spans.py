"""Substring deduplication over sliding runs of sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.arrowtext import FOLD, SPACED, blocks, mix, words
from trajecta.llm.scratch import Scratch, key_filter, passes, plain

#: Runs have so many sentences and words at least; a sentence of so many words is one by itself.
SENTENCES, WORDS, LONG = 2, 20, 50
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord("."), ord("!"), ord("?")]] = True


@dataclass
class Runs:
    """Sentences of a block of texts (text, byte range), and runs in order of their first sentence: the shortest that starts at each sentence,
    where closed also the shortest that ends at each, and every long sentence. Two texts with a run in common have all such runs inside it
    in common, and these cover it: one that starts at its first sentence, and one that ends at each sentence after that."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # number of the text's first sentence
    run: np.ndarray  # first sentence of each run
    last: np.ndarray  # its last sentence
    hash: np.ndarray


def runs(raw: np.ndarray, at: np.ndarray, sentences: int, least_words: int, closed: bool) -> Runs:
    """A sentence is words up to one that ends in . ! or ?, or that a line or the text ends after. Case (A-Z) and white space don't count."""
    w = words(raw, at, SPACED, FOLD)
    none = np.zeros(0, dtype=np.int64)
    if not len(w.start):
        return Runs(none, none, none, none, none, none, np.zeros(0, np.uint64))
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    closes = _STOPS[raw[w.end - 1]]
    closes[:-1] |= (w.text[1:] != w.text[:-1]) | (lines[w.start[1:]] > lines[w.end[:-1]])
    closes[-1] = True
    last_word = np.flatnonzero(closes)
    first_word = np.concatenate([[0], last_word[:-1] + 1])
    n_words = last_word - first_word + 1
    place = np.arange(len(w.start)) - np.repeat(first_word, n_words)
    value = mix(np.add.reduceat(mix(w.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first_word))
    text = w.text[first_word]
    n = len(text)
    after = np.searchsorted(text, text, "right")  # one past the text's last sentence
    first = np.searchsorted(text, text, "left")
    total = np.concatenate([[0], np.cumsum(n_words)])
    last = np.maximum(np.arange(n) + sentences - 1, np.searchsorted(total, total[:-1] + least_words, "left") - 1)
    number = np.arange(n)
    opens = np.minimum(number - sentences + 1, np.searchsorted(total, total[1:] - least_words, "right") - 1)  # of the shortest run that ends here
    fits, ends = last < after, opens >= first
    ends &= ~(fits[opens] & (last[opens] == number))
    alone = (n_words >= LONG) & ~(fits & (last == number)) & ~(ends & (opens == number))
    if not closed:
        ends, alone = np.zeros((2, n), dtype=bool)
    run = np.concatenate([number[fits], opens[ends], number[alone]])
    last = np.concatenate([last[fits], number[ends], number[alone]])
    order = np.lexsort((last, run))
    run, last = run[order], last[order]
    # the hash of a run: its sentences' hashes as digits, by prefix sums
    base = 0xD1342543DE82EF95
    step = np.full(n + 1, base, dtype=np.uint64)
    step[0] = 1
    power = np.cumprod(step)
    step[1:] = np.uint64(pow(base, -1, 1 << 64))
    inverse = np.cumprod(step)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:n])])
    hashed = mix((sums[last + 1] - sums[run]) * inverse[run] + (last - run).astype(np.uint64))
    return Runs(text, w.start[first_word], w.end[last_word], first, run, last, hashed)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), sentences: int = SENTENCES, least_words: int = WORDS, closed: bool = False) -> DataFrame:
    """The columns `keep` of every document with text less the sentences of repeated runs, n_sentences, n_removed and n_removed_words.

    A run is at least `sentences` consecutive sentences and `least_words` words; the shortest that starts at each sentence counts.
    Where `closed`, runs of any length count, and single sentences of LONG words. Of equal runs anywhere in the table,
    the first (by doc_id, then place in the text) stays; sentences that any other covers are cut out, with the white
    space after them. A text without such runs is returned as it is. Null texts stay null, with no sentences; a null
    doc_id comes before all others; rows that repeat a doc_id and a text are first together and so don't cut each other,
    and rows that share only a doc_id are told apart by their runs' hashes: they are cut by other documents, and by
    each other where a run stands at different places. A kept column with the name of a result gives way to it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spans")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in blocks(batch.column(1)):
                r = runs(raw, at, sentences, least_words, closed)
                ids = batch.column(0).slice(a, b - a).take(pa.array(r.text[r.run]))
                yield pa.RecordBatch.from_arrays([ids, pa.array((r.run - r.first[r.run]).astype(np.int32)), pa.array(r.hash.view(np.int64))], names=["id", "i", "h"])

    rows = docs.select(plain(doc_id).alias("id"), plain(text).alias("t"))
    all_runs = scratch.table(rows.mapInArrow(found, rows.select("id").schema.add("i", "integer").add("h", "long")))
    repeated = scratch.table(all_runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    bits = spark.sparkContext.broadcast(key_filter(repeated, "h"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(2).to_numpy(zero_copy_only=False))))

    met = scratch.table(all_runs.mapInArrow(picked, all_runs.schema))
    scratch.drop(all_runs, repeated)
    # the first place of each run, as a table, so that the join is of two dealt tables, of which Spark splits hot keys
    first = met.groupBy("h").agg(F.min(F.struct("id", "i")).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = scratch.table(met.join(scratch.table(first.select("h", "first")), "h"))
    cut = met.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("i") == F.col("first.i"))))
    by_doc = cut.select("id", "i", "h").distinct().groupBy(F.col("id").alias("__id")).agg(F.collect_list("i").alias("__i"), F.collect_list("h").alias("__h"))

    kept_names = [c for c in keep if c not in (text, "n_sentences", "n_removed", "n_removed_words")]
    numbered = [f"k{i}" for i in range(len(kept_names))]
    source = docs.select(*(plain(c).alias(k) for c, k in zip(kept_names, numbered)), plain(doc_id).alias("__doc"), plain(text).alias("__text"))
    source = source.join(by_doc, F.col("__doc").eqNullSafe(F.col("__id")), "left").drop("__doc", "__id")
    fields = docs.select(*map(plain, kept_names)).schema.add(text, "string").add("n_sentences", "long").add("n_removed", "long").add("n_removed_words", "long")
    names, n_kept = fields.names, len(kept_names)

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n_kept)
            places, hashes = batch.column(n_kept + 1), batch.column(n_kept + 2)
            out: list[str | None] = []
            counts, removed, removed_words = [], [], []
            for a, b, raw, at in blocks(texts):
                r = runs(raw, at, sentences, least_words, closed)
                bounds = np.searchsorted(r.text, np.arange(b - a + 1))
                for j in range(b - a):
                    lo, hi = bounds[j], bounds[j + 1]
                    counts.append(int(hi - lo))
                    listed = places[a + j].as_py() if places[a + j].is_valid else None
                    if not listed:
                        out.append(texts[a + j].as_py())
                        removed.append(0)
                        removed_words.append(0)
                        continue
                    asked = set(zip(listed, hashes[a + j].as_py()))
                    own = slice(*np.searchsorted(r.run, (lo, hi)))
                    met = np.array([k in asked for k in zip((r.run[own] - lo).tolist(), r.hash[own].view(np.int64).tolist())], dtype=bool)
                    edge = np.zeros(hi - lo + 1, dtype=np.int64)
                    np.add.at(edge, r.run[own][met] - lo, 1)
                    np.add.at(edge, r.last[own][met] + 1 - lo, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    stay, begin, upto = [], at[j], at[j + 1]
                    starts = np.append(r.start[lo:hi], upto)
                    pos = begin
                    for s in np.flatnonzero(gone):
                        stay.append(raw[pos : starts[s]])
                        pos = starts[s + 1]
                    stay.append(raw[pos:upto])
                    out.append(np.concatenate(stay).tobytes().decode("utf-8"))
                    removed.append(int(gone.sum()))
                    removed_words.append(int(sum(len(raw[r.start[lo + s] : r.end[lo + s]].tobytes().split()) for s in np.flatnonzero(gone))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_kept)), pa.array(out, pa.string()), *(pa.array(x, pa.int64()) for x in (counts, removed, removed_words))], names=names)

    return source.select(*numbered, "__text", "__i", "__h").mapInArrow(less, fields)

"""Spelling variants of the words of a corpus, by range searches in k-d trees over letter counts.

A word is a point: how often it has each letter. One letter replaced takes one from a coordinate and adds one to another; one inserted
adds one. So the words near a word lie at an L1 distance of one or two, and in a k-d tree a search crosses a split upwards at most once and
downwards at most once (not at all towards longer words). There is a tree for each word length. Its upper splits, the most even ones over all
words of the length, deal words and searches to cells, which are Spark's groups; the lower ones are made within a cell. What a
search finds is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.arrowtext import buffers
from trajecta.llm.scratch import Scratch, plain

#: Words of a cell, about; words under which a box is searched as it is; rows of a cell that are searched in one group, at most.
CELL, LEAF, MOST = 16_384, 48, 131_072
#: Letters: a to z, and U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Upper splits of a tree, at most: a cell's number has a bit for each.
DEEPEST = 48
DATA, REPLACE, INSERT, OWN = range(4)


def spelled(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words one after the other, number of letters of each)."""
    raw, at = buffers(column)
    letter = raw != 0xC3  # the first byte of each letter beyond ASCII; the second tells which
    before = np.concatenate([[0], np.cumsum(letter)])
    code = raw[letter].astype(np.int64)
    return np.where(code < 0x80, code - 97, code - 0x80 + 26), before[at[1:]] - before[at[:-1]]


def letter_counts(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(words, LETTERS)."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.bincount(owner * LETTERS + letters, minlength=len(size) * LETTERS).reshape(-1, LETTERS).astype(np.uint8 if size.max(initial=0) < 256 else np.int32)


def variants(docs: DataFrame, doc_id: str, text: str, least_length: int, altered: int | None) -> DataFrame:
    """(word, n): runs of letters of the texts, of which one in `altered` loses a letter, with their numbers of occurrences."""
    runs = F.explode(F.regexp_extract_all(plain(text), F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})"), F.lit(1)))
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.coalesce(plain(doc_id).cast("string"), F.lit("")).alias("id"), runs.alias("run")).select("id", low.alias("word"))
    if altered:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        words = words.select("word", h.alias("h")).select(F.expr(f"if(h % {altered} = 0, concat(substring(word, 1, int(h % length(word))), substring(word, int(h % length(word)) + 2)), word)").alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def upper_splits(words: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """For each length of more than CELL words the splits (letter, least count on the upper side) of its tree, the most even first.

    What comes to the driver is a few hundred rows for each such length, so for each CELL words at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, size = spelled(batch.column(0))
            counts = letter_counts(letters, size)
            for m in np.unique(size):
                some = counts[size == m]
                reached = np.stack([(some >= t).sum(axis=0) for t in range(1, min(int(m), 8) + 1)], axis=1)
                letter, t = np.nonzero(reached)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(letter) + 1, m)), pa.array(np.append(letter, -1)), pa.array(np.append(t + 1, 0)), pa.array(np.append(reached[letter, t], len(some)))], names=["size", "letter", "t", "n"])

    sums = words.select("word").mapInArrow(run, "size long, letter long, t long, n long").groupBy("size", "letter", "t").agg(F.sum("n").alias("n"))
    large = sums.where((F.col("letter") == -1) & (F.col("n") > CELL)).select("size", F.col("n").alias("words"))
    out: dict[int, list[tuple[int, int]]] = {}
    for m, rows in _by_size(sums.join(large, "size").where("letter >= 0 and n * 20 > words and n * 20 < words * 19").collect()):
        rows.sort(key=lambda r: (abs(2 * r["n"] - r["words"]), r["letter"], r["t"]))
        depth = min(DEEPEST, int(np.ceil(np.log2(rows[0]["words"] / CELL))))
        out[m] = [(r["letter"], r["t"]) for r in rows[:depth]]
    return out


def _by_size(rows: list) -> list[tuple[int, list]]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["size"], []).append(r)
    return sorted(by.items())


def cells_of(counts: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(counts), dtype=np.int64)
    for i, (letter, t) in enumerate(splits):
        out |= (counts[:, letter] >= t).astype(np.int64) << i
    return out


def crossings(counts: np.ndarray, splits: list[tuple[int, int]], downwards: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, cell) of the cells that a search reaches besides the word's own: across one split upwards, one downwards, or both."""
    own = cells_of(counts, splits)
    ups = [(np.int64(1) << i, np.flatnonzero(counts[:, letter].astype(np.int64) == t - 1)) for i, (letter, t) in enumerate(splits)]
    downs = [(np.int64(1) << i, counts[:, letter].astype(np.int64) == t) for i, (letter, t) in enumerate(splits)]
    for bit, rows in ups:
        yield rows, own[rows] | bit
        if downwards:
            for other, tight in downs:
                both = rows[tight[rows]]
                yield both, (own[both] | bit) & ~other
    if downwards:
        for other, tight in downs:
            rows = np.flatnonzero(tight)
            yield rows, own[rows] & ~other


def _dealt(words: DataFrame, splits: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(size, cell, side, word, n): each word in its cell, and where it is searched for: words of its length in cells of higher numbers than its own (the others search for it), and words one letter longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, size = spelled(batch.column(0))
            counts = letter_counts(letters, size)
            for m in np.unique(size):
                at = np.flatnonzero(size == m)
                here, longer = splits.get(int(m), []), splits.get(int(m) + 1, [])
                own, above = cells_of(counts[at], here), cells_of(counts[at], longer)
                every = np.arange(len(at))
                found = [(m, DATA, every, own), (m + 1, INSERT, every, above)]
                found += [(m, REPLACE, rows[cell > own[rows]], cell[cell > own[rows]]) for rows, cell in crossings(counts[at], here, True)]
                found += [(m + 1, INSERT, rows, cell) for rows, cell in crossings(counts[at], longer, False)]
                for length, side, rows, cell in found:
                    if len(rows):
                        picked = batch.take(pa.array(at[rows]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), length)), pa.array(cell), pa.array(np.full(len(rows), side, dtype=np.int32)), *picked.columns], names=["size", "cell", "side", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "size long, cell long, side int, word string, n long")


def _replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(words of a, words of b): which differ in one letter of the same place."""
    apart = np.zeros((len(a), len(b)), dtype=np.uint8 if a.shape[1] < 256 else np.int32)
    for i in range(a.shape[1]):
        apart += a[:, i][:, None] != b[:, i][None, :]
    return apart == 1


def _inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(words of a, words of b, one letter longer): which differ in one letter that b has more."""
    n = a.shape[1]
    common = np.zeros((len(a), len(b)), dtype=np.int32)
    for places, step in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        still = np.ones(common.shape, dtype=bool)
        for i in places:
            still &= a[:, i][:, None] == b[:, i + step][None, :]
            common += still
    return common >= n


def search(data: np.ndarray, asked: np.ndarray, counts: np.ndarray, counts_asked: np.ndarray, downs: np.ndarray, verify) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked, data) numbers of the rows that `verify(asked, data)` confirms, of those in reach of each other: one letter more, and `downs` (0 or 1 for each asked) fewer."""
    boxes = [(data, asked, np.ones(len(asked), dtype=np.int8), downs[asked])]
    while boxes:
        d, q, up, down = boxes.pop()
        if not len(d) or not len(q):
            continue
        split = None
        if len(d) > LEAF:
            c = counts[d]
            share = np.stack([(c >= t).sum(axis=0) for t in (1, 2, 3)])
            t, letter = np.unravel_index(np.abs(2 * share - len(d)).argmin(), share.shape)
            split = (letter, t + 1) if 0 < share[t, letter] < len(d) else None
        if split is None:
            for i in range(0, len(d), LEAF * 16):  # anagrams, or words with a letter more often than three times
                confirmed = verify(q, d[i : i + LEAF * 16])
                x, y = np.nonzero(confirmed)
                if len(x):
                    yield q[x], d[i + y]
            continue
        letter, t = split
        high = c[:, letter] >= t
        own = counts_asked[q, letter].astype(np.int64)
        above, to_above, to_below = own >= t, (own == t - 1) & (up > 0), (own == t) & (down > 0)
        for side, mine, crossed, spent in ((high, above, to_above, (1, 0)), (~high, ~above, to_below, (0, 1))):
            go = mine | crossed
            boxes.append((d[side], q[go], up[go] - spent[0] * crossed[go].astype(np.int8), down[go] - spent[1] * crossed[go].astype(np.int8)))


def _near(cells: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of each pair of near words."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        size, side = key[0].as_py(), rows["side"].to_numpy()
        order = np.argsort(side == INSERT, kind="stable")  # words of one length, then those that are a letter shorter
        rows, side, same = rows.take(pa.array(order)), side[order], int((side != INSERT).sum())
        letters, n_letters = spelled(rows["word"])
        counts = letter_counts(letters, n_letters)
        long = letters[: same * size].reshape(same, size).astype(np.uint8)
        short = letters[same * size :].reshape(len(side) - same, size - 1).astype(np.uint8)
        data = np.flatnonzero(side == DATA)
        downs = (side != INSERT).astype(np.int8)
        own = np.flatnonzero(side == OWN)
        words = rows["word"].to_numpy()

        def once(q: np.ndarray, d: np.ndarray) -> np.ndarray:
            if len(own):
                return _replaced(long[q], long[d]) & (words[q][:, None] < words[d][None, :])
            return _replaced(long[q], long[d]) & (q[:, None] < d[None, :])

        found = [(np.zeros(0, dtype=np.int64),) * 2]
        found += search(data, own if len(own) else data, counts, counts, downs, once)
        found += search(data, np.flatnonzero(side == REPLACE), counts, counts, downs, lambda q, d: _replaced(long[q], long[d]))
        found += search(data, np.flatnonzero(side == INSERT), counts, counts, downs, lambda q, d: _inserted(short[q - same], long[d]))
        a, b = (np.concatenate(x) for x in zip(*found))
        one, two = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        return pa.table({"word": rows["word"].take(one), "near": rows["word"].take(two), "near_n": rows["n"].take(two)})

    return cells.groupBy("size", "cell", "d", "q").applyInArrow(run, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_n: int = 2, times: int = 10, altered: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts.

    Words are the distinct maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z, of at least `least_length` letters that
    occur at least `least_n` times. Where `altered` is given, a run whose crc32 (with the document's id before it; a null id is
    an empty text) it divides first loses one letter, as the check of the operator wants it. Two words are near if one letter replaced, put in or
    left out makes one of the other. form: the near word of most occurrences, of equals the first by code points, if it has `times` those of
    the word; root: the last word along the forms, which ends as they occur ever more often. Null and empty texts have no words; rows that repeat
    a document count again; an empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("forms may only lead to words that occur more often")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(variants(docs, doc_id, text, least_length, altered).where(F.col("n") >= least_n))
    dealt = _dealt(words, upper_splits(words))

    # cells of more rows than MOST are searched in blocks of their words and of the words that search them
    held = dealt.groupBy("size", "cell").agg(F.count_if(F.col("side") == DATA).alias("n_data"), F.count("*").alias("n_rows"))
    crowded = held.where(F.col("n_rows") > MOST).select("size", "cell", *(F.ceil(F.col(c) / MOST).cast("int").alias(k) for c, k in (("n_data", "kd"), ("n_rows", "kq"))))
    cells = dealt.join(F.broadcast(crowded), ["size", "cell"], "left")  # one row for each MOST rows, at most
    h = F.xxhash64("word")
    as_data = F.transform(F.sequence(F.lit(0), F.col("kq") - 1), lambda q: F.struct(F.col("side").alias("side"), F.pmod(h, "kd").cast("int").alias("d"), q.alias("q")))
    as_query = F.transform(F.sequence(F.lit(0), F.col("kd") - 1), lambda d: F.struct(F.when(F.col("side") == DATA, OWN).otherwise(F.col("side")).alias("side"), d.alias("d"), F.pmod(h, "kq").cast("int").alias("q")))
    alone = F.array(F.struct("side", F.lit(0).alias("d"), F.lit(0).alias("q")))
    places = F.when(F.col("kd").isNull(), alone).when(F.col("side") == DATA, F.concat(as_data, as_query)).otherwise(as_query)
    near = _near(cells.withColumn("p", F.explode(places)).select("size", "cell", "p.*", "word", "n"))

    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    of = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = (-F.col("best.n")) >= times * F.col("n")
    found = scratch.table(words.join(of, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n")))

    # roots: each round doubles the number of forms followed; every form has `times` the occurrences, so few rounds are needed
    roots = scratch.table(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = scratch.table(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(roots)
        roots = ahead
        if ahead.where("moved").isEmpty():
            break
    return found.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

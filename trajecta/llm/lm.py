"""Hierarchical Pitman-Yor language model: counts over the whole corpus, seating by Gibbs, scores of whole texts.

Every word, and the start of a text, is a context with a restaurant of its own; every word, and the end of a text, is a dish of each.
All restaurants share one parent over the words. A pair of words met once has one table, so it needs no seat: how many
such pairs a context or a dish has follows from its count and its other pairs. Pairs met more often, their seats, contexts and
dishes are Spark tables of `lmtables`, dealt by words and by pairs. A word that is met once, and in no text that isn't learned, has
one table everywhere, so all of these have the same terms and need no row.

The other words are numbered, those of most tokens first, so a pair is one number. Numbers, and so all draws, depend on the texts
alone. Nothing is broadcast but where the numbers of each part of the words start; chunks of texts, parts of the pairs and
parts of the words ask and tell each other, each distinct word or pair once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm import lmtables
from trajecta.llm.arrowtext import blocks, mix, words
from trajecta.llm.lmtables import ROW, each, gathered, met, thick
from trajecta.llm.scratch import Scratch, plain

#: Shares of all tokens from which `Lookup` may take words and pairs: at most 1,000,000 and 2,000,000 of them. `score` looks up none.
KNOWN, FREQUENT = 1e-6, 5e-7
#: Discount and strength of the context restaurants and of their parent.
INNER, PARENT = (0.7, 2.0), (0.5, 2.0)
#: Sweeps before the first sample, samples averaged, parts of the rows that take turns in a sweep, rounds of sweeps.
BURN, SAMPLES, MOVES, ROUNDS = 1, 3, 2, 2
#: Hashes of the end of a text and, for `Lookup`, of what is before its first token.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
SIGN = np.int64(-(2**63))
#: Tokens of a chunk of texts; a longer text is a chunk of its own.
GATHERED = 2_000_000
#: Tokens for each part that words and pairs are dealt to; the pairs of a part are seated together.
PART = 2_000_000
#: What `score` gives besides the columns kept.
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, text index, hash) of the tokens of blocks of texts, each text's end last."""
    for a, b, raw, at in blocks(column):
        w = words(raw, at)
        ends = np.cumsum(w.counts())
        yield a, b, np.insert(w.text, ends, np.arange(b - a)), np.insert(w.hash, ends, np.full(b - a, END))


class Places:
    """Where values stand among sorted, mixed 64-bit keys: by a table of the first key of each range of their top bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self._range(keys), np.arange((1 << bits) + 1)).astype(np.int32)
        self.keys = np.append(keys, 0)

    def _range(self, value: np.ndarray) -> np.ndarray:
        return ((value.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the value is there)."""
        of = self._range(value)
        at, end = self.first[of], self.first[of + 1]
        found = (self.keys[at] == value) & (at < end)
        left = np.flatnonzero(~found & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.keys[at[left]] == value[left]
            found[left] = hit
            left = left[~hit & (at[left] + 1 < end[left])]
        return at, found


class Lookup:
    """Known words: their ranks by count, from 1, and counts. Rank 0 is the start of a text."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        rank = np.lexsort((h, -c))
        self.count = np.concatenate([[0], c[rank]])
        order = np.argsort(h[rank])
        self.places, self.rank = Places(h[rank][order]), np.append(order + 1, 0)
        self.names = np.concatenate([START.view(np.int64)[None], h[rank]]) | SIGN

    def code(self, value: np.ndarray) -> np.ndarray:
        v = value.view(np.int64)
        at, found = self.places.find(v)
        return np.where(found, self.rank[at], v | SIGN)

    def name(self, code: np.ndarray) -> np.ndarray:
        """The code that a word would have if it weren't known."""
        return np.where(code >= 0, self.names[np.maximum(code, 0)], code)

    def pair(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A key of each pair, whether its words are known or not."""
        return mix(mix(self.name(u).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + self.name(w).view(np.uint64)).view(np.int64)


def _before(text: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The context of each token: the word before, 0 for the first."""
    out = np.zeros(len(code), dtype=np.int64)
    out[1:] = np.where(text[1:] == text[:-1], code[:-1], 0)
    return out


def _grouped(*columns: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, places of the first of equal rows in it), with the texts `of` (numbers under 2^20) in order.

    Rows are sorted by one hash; where two hashes meet, equal rows may come as two groups, which all users sum up again.
    """
    h = mix(columns[0].view(np.uint64))
    for c in columns[1:]:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + c.view(np.uint64))
    if of is not None:
        h = (of.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
        columns = (of, *columns)
    order = np.argsort(h)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def _dealt(part: np.ndarray, n_parts: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part that has rows: its number and the bytes of its rows' columns, so that a shuffle moves few large rows."""
    order = np.argsort(part.astype(np.uint16) if n_parts <= 1 << 16 else part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n_parts + 1))
    some = np.flatnonzero(np.diff(bounds))
    at = np.append(bounds[some], bounds[-1])
    blobs = [pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x[order]))]) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *blobs], names=["part", *columns])


def _opened(part: pa.Table, name: str, kind: type) -> np.ndarray:
    """The column of all rows of a part of `_dealt`."""
    return np.concatenate([np.zeros(0, dtype=kind), *(np.frombuffer(x.as_buffer(), dtype=kind) for x in part[name] if x.is_valid)])


def _packed(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether both words of a pair are known, and those pairs as one number each, in half the bytes."""
    both = (u >= 0) & (w >= 0)
    return both, u[both] << np.int64(32) | w[both]


def _unpacked(uw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return uw >> np.int64(32), uw & np.int64(0xFFFFFFFF)


def _part_of(k: np.ndarray, n_parts: int) -> np.ndarray:
    return ((k.view(np.uint64) >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)


def _pairs(docs: DataFrame, lookup, n_parts: int) -> DataFrame:
    """(u, w, c, k) of `docs` (learn, text), a row a pair (`score` has them as blocks): pairs that were learned twice or more, c times, or once and stand in a text that wasn't learned from. k: `Lookup.pair`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            u, w, c = (np.concatenate(x) for x in zip(*held))
            order, first = _grouped(u, w)
            at = order[first]
            n, every = np.add.reduceat(c[order].astype(np.int64), first), np.diff(np.append(first, len(u)))
            u, w = u[at], w[at]
            part, n, asked = _part_of(lookup.value.pair(u, w), n_parts), n.astype(np.int32), every > n
            both, uw = _packed(u, w)
            for some, columns in ((both, {"uw": uw}), (~both, {"u": u[~both], "w": w[~both]})):
                dealt = _dealt(part[some], n_parts, **columns, c=n[some], asked=asked[some])
                none = pa.nulls(dealt.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([dealt["part"], *(dealt[x] if x in columns else none for x in ("uw", "u", "w")), dealt["c"], dealt["asked"]], names=["part", "uw", "u", "w", "c", "asked"])

        for batch in batches:
            learn = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, text, value in _tokens(batch.column(1)):
                code = lookup.value.code(value)
                held.append((_before(text, code), code, learn[a:b][text]))
                size += len(value)
                if size >= GATHERED:
                    yield from summed()
                    held, size = [], 0
        if held:
            yield from summed()

    def merged(key: tuple, part: pa.Table) -> pa.Table:
        packed = pa.compute.is_valid(part["uw"])
        near, far = part.filter(packed), part.filter(pa.compute.invert(packed))
        (u, w), more = _unpacked(_opened(near, "uw", np.int64)), [_opened(far, name, np.int64) for name in ("u", "w")]
        u, w = np.concatenate([u, more[0]]), np.concatenate([w, more[1]])
        c, asked = (np.concatenate([_opened(x, name, kind) for x in (near, far)]) for name, kind in (("c", np.int32), ("asked", bool)))
        k = lookup.value.pair(u, w)
        order = np.argsort(k)
        u, w, k = u[order], w[order], k[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        other = np.zeros(len(k), dtype=bool)
        other[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        if (other & ~new).any():  # two pairs of one key
            again = np.lexsort((w, u))
            order, u, w, k = order[again], u[again], w[again], k[again]
            new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        c, asked = np.add.reduceat(c[order].astype(np.int64), first), np.logical_or.reduceat(asked[order], first)
        stay = (c > 1) | ((c == 1) & asked)
        at = first[stay]
        return pa.table({"u": u[at], "w": w[at], "c": c[stay], "k": k[at]})

    return docs.mapInArrow(run, "part int, uw binary, u binary, w binary, c binary, asked binary").groupBy("part").applyInArrow(merged, "u long, w long, c long, k long")


def _seated(rows: DataFrame, opened: float, served: float, base: float, n_parts: int, burn: int, samples: int, seed: int) -> DataFrame:
    """(u, w, c, k, tables) of `rows` (u, w, c, k, t, a, s, o), dealt by the pair to groups that are seated apart from each other.

    A row is a pair of words with its customers c, its tables t so far and its restaurant's weight a of a new table; s are the tables
    of the word in all restaurants so far, o those in the parent. A group takes the tables of the word's other rows as they are.
    """

    def run(key: tuple, part: pa.Table) -> pa.Table:
        u, w, c, k, t, a, s, o = (part[x].to_numpy() for x in ("u", "w", "c", "k", "t", "a", "s", "o"))
        _, first, dish = np.unique(w, return_index=True, return_inverse=True)
        elsewhere = s[first] - np.bincount(dish, t, minlength=len(first))
        seats = gibbs(c, dish, a, base, INNER, (*PARENT, opened, served), burn, samples, MOVES, seed, elsewhere, o[first], t, k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * samples), pa.array(seats.ravel()))
        return pa.table({"u": u, "w": w, "c": c, "k": k, "tables": lists})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(n_parts)))
    return dealt.repartition(n_parts, "part").groupBy("part").applyInArrow(run, "u long, w long, c long, k long, tables array<long>")


def _over(dishes: DataFrame, lookup, n: int, base: float, opened: float, seed: int) -> DataFrame:
    """`dishes` (w, ..., served: tables below, n of them) with `over`, drawn tables in the parent: by numbers that depend on the word alone."""
    fields = T.StructType([*dishes.schema.fields, T.StructField("over", T.ArrayType(T.LongType()))])
    at_w, at_served = dishes.columns.index("w"), dishes.columns.index("served")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = lookup.value.name(batch.column(at_w).to_numpy(zero_copy_only=False)).view(np.uint64)
            served = batch.column(at_served).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            out = np.zeros(served.shape, dtype=np.int64)
            for i in range(n):
                draw = np.stack([mix(w * np.uint64(0xD1342543DE82EF95) + np.uint64(1000 * seed + 10 * i + j + 1)) for j in (0, 1)]) / 2.0**64
                out[:, i] = parent_tables(served[:, i], base, PARENT, opened, draw)
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=fields.names)

    return dishes.mapInArrow(run, fields)


def _attached(rows: DataFrame, by: str, table: DataFrame, key: str) -> DataFrame:
    """`rows` with the columns of `table` (one row a word): known words by broadcast, the others, none of which is frequent, by a join."""
    renamed = table.withColumnRenamed(key, by) if key != by else table
    known = rows.where(F.col(by) >= 0).join(F.broadcast(renamed.where(F.col(by) >= 0)), by, "left")
    return known.unionByName(rows.where(F.col(by) < 0).join(renamed.where(F.col(by) < 0), by, "left"))


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of `docs` with n_tokens, n_known, train_tokens, base_score and score, learned from the rows where `learn` holds.

    Tokens are the words of the whole text (A-Z as a-z, ended by ASCII white space) and one end; null and empty texts
    have the end alone. base_score adds log10((c + 1) / (N + V + 1)); score is the model's log10 probability, averaged
    over the samples as probabilities. Rows that repeat an id and a text get equal scores; a null id is an id like others. With no row
    to learn from, the model is uniform over one unknown word. A kept column with the name of a result gives way to it.
    The result doesn't depend on the number of executors or partitions. `perplexity` gives the figure by token.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm", **lmtables.STORED)
    names = [c for c in keep if c not in RESULTS]
    source = docs.select(*(plain(c).alias(f"k{i}") for i, c in enumerate(names)), F.xxhash64(plain(doc_id), plain(text)).alias("__key"), F.coalesce(learn, F.lit(False)).alias("__learn"), plain(text).alias("__text"))

    # words get numbers, and chunks of texts the numbers of their words
    chunked = scratch.table(lmtables.chunks(source.select("__key", "__learn", "__text"), _tokens, GATHERED))
    n_tokens, n_starts = chunked.where("kind = 2").agg(F.coalesce(F.sum("to"), F.lit(0)), F.coalesce(F.sum("at"), F.lit(0))).first()
    n_parts = n_tokens // PART + 1
    asked = chunked.where("kind = 1").mapInArrow(each(partial(lmtables.by_hash, n_parts=n_parts)), ROW)
    vocab = scratch.table(gathered(asked, lmtables.vocabulary))
    sizes, classes = np.zeros(3, dtype=np.int64), np.zeros((n_parts, 64), dtype=np.int64)
    for _, _, at, data in vocab.where("kind = 1").collect():
        sizes += thick(data[0])
        classes[at] = thick(data[1])
    total, n_types, n_once = (int(x) for x in sizes)
    down = classes[:, ::-1].T.ravel()  # the words of most times first
    starts = (1 + np.cumsum(down) - down).reshape(64, n_parts).T[:, ::-1]
    by = lmtables.Numbers(max(1, int(classes.sum()).bit_length()), n_parts)
    numbers = met(asked, vocab.where("kind = 0"), partial(lmtables.named, starts=starts))
    texts = scratch.table(met(chunked.where("kind = 0"), numbers, partial(lmtables.numbered, norm=float(np.log10(total + n_types + 1)))))
    scratch.drop(chunked)
    scratch.tidy()

    # pairs, and words with what their pairs that are met once come to
    pairs = scratch.table(gathered(texts.mapInArrow(each(partial(lmtables.paired, by=by)), ROW), lmtables.merged))
    scratch.tidy()
    base, opened = 1.0 / (n_types + 1), float(n_types + 1)
    served = float(pairs.where("kind = 2").agg(F.coalesce(F.sum("to"), F.lit(0))).first()[0])
    counts = vocab.where("kind = 0").mapInArrow(each(partial(lmtables.counted, by=by, starts=starts)), ROW)
    seats, routes = pairs.where("kind = 0"), pairs.where("kind = 1")
    reseated = partial(lmtables.reseated, by=by, base=base, parent=PARENT)
    told = seats.mapInArrow(each(partial(lmtables.told, by=by, start=True)), ROW)
    state = scratch.table(met(counts, told, partial(reseated, opened=opened, seed=1, samples=1, n_starts=n_starts)))
    scratch.drop(vocab)
    scratch.tidy()

    all_served, all_opened = [0] * SAMPLES, [1] * SAMPLES
    for turn in range(1, ROUNDS + 1):
        samples = SAMPLES if turn == ROUNDS else 1
        sat = partial(lmtables.sat_down, by=by, base=base, inner=INNER, over=(*PARENT, opened, served), burn=BURN, samples=samples, moves=MOVES, seed=100 * turn)
        held, seats = (seats, state), scratch.table(met(seats, state.where("kind = 1"), sat))
        told = seats.mapInArrow(each(partial(lmtables.told, by=by, start=False)), ROW)
        state = scratch.table(met(state.where("kind = 0"), told, partial(reseated, opened=opened, seed=turn + 1, samples=samples)))
        scratch.drop(*held)
        scratch.tidy()
        totals = np.zeros((2, samples), dtype=np.int64) + n_once
        for row in state.where("kind = 2").select("data").collect():
            totals += [thick(x) for x in row["data"]]
        all_served, all_opened = totals.tolist()
        opened, served = max(float(sum(all_opened)) / samples, 1.0), max(float(sum(all_served)) / samples, 1.0)

    # chunks are told of their pairs and words
    of_pairs = met(seats, routes, partial(lmtables.pairs_answered, samples=SAMPLES))
    of_words = met(state.where("kind = 0"), texts.mapInArrow(each(partial(lmtables.words_asked, by=by)), ROW), lmtables.words_answered)
    answers = of_pairs.union(of_words)
    result = partial(lmtables.scored, by=by, inner=INNER, parent=PARENT, served=all_served, opened=all_opened, base=base)

    def finished(key: tuple, chunk: pa.Table, told: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("__key", *(f"__{c}" for c in sums)), result(lmtables.rows_of(chunk)[0], lmtables.rows_of(told)))))

    sums = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    found = texts.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(finished, "__key long, " + ", ".join(f"__{c} {kind}" for c, kind in sums.items()))
    found = scratch.table(found.groupBy("__key").agg(*(F.max(f"__{c}").alias(f"__{c}") for c in sums)))  # equal rows have equal sums
    scratch.drop(texts, pairs, seats, state)
    scratch.tidy()
    out = source.drop("__text", "__learn").join(found, "__key")
    of = lambda c: F.col(f"__{c}").alias(c)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), of("n_tokens"), of("n_known"), F.lit(total).cast("long").alias("train_tokens"), of("base_score"), of("score"))


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)

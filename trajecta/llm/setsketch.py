"""Near duplicates by SetSketch: registers banded for candidates, judged jointly by likelihood, confirmed on the full sets.

A register holds the least of exponentially distributed hashes of a set's features, as the number of its exponentially spaced step
(the base to the power -k), cut to 0..TOP + 1. Registers of a union are the larger ones of its parts. Two sets of similarity J agree in
a register with a chance of about J, and which side has the larger one tells the rest, so both counts together give J.

Before two sets are laid side by side, the parities of how many of their features fall in each of some bins are compared: sets
differ in at least as many features as their parities in bins, so what this rules out cannot link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm.arrowtext import blocks, mix, words
from trajecta.llm.graph import components
from trajecta.llm.partenum import SKETCH, _digests, _similar, _sketches, _texts, shingles
from trajecta.llm.scratch import Scratch, key_filter, passes, plain

#: Bands, and registers of a band: sets of similarity 0.85 share no band with a chance of (1 - 0.85^5)^40 = 7e-11.
BANDS, DEPTH = 40, 5
#: Base of the steps, rate of the hashes, and the highest step that is told apart (a set of 10^7 features has its registers near 19,000).
BASE, RATE, TOP = 1.001, 20.0, 65_533
#: Standard deviations of the estimate by which a pair may fall short of the similarity and still be confirmed on its sets.
SPARE = 6.0
#: Classes of a crowd that meet in one group, about; bands that a task holds before it sums them up; rows it gives on at a time.
BLOCK, HELD, GIVEN = 256, 1 << 20, 1 << 16

_N = BANDS * DEPTH
_SEEDS = np.random.default_rng(12).integers(0, 2**64, (2, _N), dtype=np.uint64)


def registers(text: np.ndarray, value: np.ndarray, n_texts: int) -> np.ndarray:
    """(texts, registers) of sets given as features sorted by text; 0 for an empty set."""
    out = np.zeros((n_texts, _N), dtype=np.uint16)
    if len(text):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        least = np.empty((len(first), _N), dtype=np.uint64)
        for j in range(_N):
            least[:, j] = np.minimum.reduceat((value + _SEEDS[0, j]) * (_SEEDS[1, j] | np.uint64(1)), first)
        h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64).clip(max=1 - 2.0**-53) / RATE
        out[text[first]] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1)
    return out


def _above(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that a register of one set is above the other's, where x is the share of the union (as n + n') that only it has; and its slope."""
    inner = 1 - x * (BASE - 1) / BASE
    return -np.log(inner) / np.log(BASE), (BASE - 1) / BASE / inner / np.log(BASE)


def at_least(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float | np.ndarray) -> np.ndarray:
    """Whether the likeliest similarity of the pairs reaches `similarity`, given how many registers of a are above and below those of b.

    The likelihood has one peak, so its slope at `similarity` tells. False where the sizes alone rule it out.
    """
    u = size_a / (size_a + size_b)
    v = 1 - u
    x, y = u - v * similarity, v - u * similarity
    fits = (x > -1e-12) & (y > -1e-12)
    (p, dp), (q, dq) = _above(np.maximum(x, 1e-12)), _above(np.maximum(y, 1e-12))
    equal = _N - above - below
    return fits & (equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12) >= above * v * dp / p + below * u * dq / q)


def similarity(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The likeliest similarity of the pairs."""
    low, high = np.zeros(len(above)), np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
    for _ in range(40):
        middle = (low + high) / 2
        up = at_least(above, below, size_a, size_b, middle)
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return low


def _described(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, key, registers, parity) of each text's set; registers and parity are null in rows whose set a row of the same block has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in blocks(batch.column(1)):
                text, value = shingles(words(raw, at), size)
                n, key = np.bincount(text, minlength=b - a), _digests(text, value, b - a)
                new = np.zeros(b - a, dtype=bool)
                new[np.unique(key, return_index=True)[1]] = True
                new &= n > 0
                number, mine = np.cumsum(new) - 1, new[text]
                few, own = int(new.sum()), (number[text[mine]], value[mine])
                listed = pa.array([r.tobytes() for r in registers(*own, few)], pa.binary())
                parity = _sketches(*own, few, 0)[0]
                at = pa.array(number, mask=~new)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(key.view(np.int64)), listed.take(at), parity.take(at)], names=["id", "n", "key", "registers", "parity"])

    return rows.mapInArrow(run, rows.select("id").schema.add("n", "long").add("key", "long").add("registers", "binary").add("parity", T.ArrayType(T.LongType())))


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, _N)


class Parities:
    """Parities of the rows of a column, which have 64 bins a number and powers of two of numbers, at least SKETCH bins."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.size = np.asarray(pc.list_value_length(column)).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        start = np.cumsum(self.size) - self.size
        self.place = np.zeros(len(self.size), dtype=np.int64)
        self.whole: dict[tuple[int, int], np.ndarray] = {}
        for k in np.unique(self.size):
            rows = np.flatnonzero(self.size == k)
            self.place[rows] = np.arange(len(rows))
            self.whole[k, k] = flat[start[rows][:, None] + np.arange(k)]

    def folded(self, rows: np.ndarray, size: int, to: int) -> np.ndarray:
        """Parities of rows that have `size` numbers, in `to` of them: two bins that become one have the parity of their sum."""
        if (size, to) not in self.whole:
            s = self.whole[size, size]
            while s.shape[1] > to:
                half = s.shape[1] // 2
                s = s[:, :half] ^ s[:, half:]
            self.whole[size, to] = s
        return self.whole[size, to][self.place[rows]]

    def differing(self, a: np.ndarray, other: Parities, b: np.ndarray) -> np.ndarray:
        """In how many bins row a[i] here and row b[i] there differ."""
        out = np.zeros(len(a), dtype=np.int64)
        for m in np.unique(self.size[a]):
            for n in np.unique(other.size[b]):
                both = np.flatnonzero((self.size[a] == m) & (other.size[b] == n))
                to = min(m, n)
                for i in range(0, len(both), GIVEN // SKETCH + 1):
                    k = both[i : i + GIVEN // SKETCH + 1]
                    out[k] = np.bitwise_count(self.folded(a[k], m, to) ^ other.folded(b[k], n, to)).sum(axis=1)
        return out


def _bands(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key, signature) of the bands of (key, registers) rows."""
    r = _unpacked(batch.column(1)).astype(np.uint64).reshape(-1, BANDS, DEPTH)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), r.shape[:2])
    for j in range(DEPTH):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + r[:, :, j])
    return np.repeat(batch.column(0).to_numpy(), BANDS), h.ravel().view(np.int64)


def _shared(classes: DataFrame) -> DataFrame:
    """(sig, a, b, n): the least and the largest class of each signature that n > 1 classes have. Tasks sum up what they hold before it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> Iterator[pa.RecordBatch]:
            key, sig = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((key, sig))
            key, sig = key[order], sig[order]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            end = np.append(first[1:], len(sig))
            for i in range(0, len(first), GIVEN):
                f, e = first[i : i + GIVEN], end[i : i + GIVEN]
                yield pa.RecordBatch.from_arrays([pa.array(sig[f]), pa.array(key[f]), pa.array(key[e - 1], mask=e - f == 1), pa.array((e - f).astype(np.int64))], names=["sig", "a", "b", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, HELD // BANDS):
                held.append(_bands(batch.slice(i, HELD // BANDS)))
                if sum(len(x) for x, _ in held) >= HELD:
                    yield from summed()
                    held = []
        if held:
            yield from summed()

    dealt = classes.select("key", "registers").mapInArrow(run, "sig long, a long, b long, n long").repartition("sig")  # b is null for one class
    return dealt.groupBy("sig").agg(F.min("a").alias("a"), F.greatest(F.max("a"), F.max("b")).alias("b"), F.sum("n").alias("n")).where("a <> b")


def _signed(classes: DataFrame, bits) -> DataFrame:
    """(key, sig) of the bands that pass the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, sig = _bands(batch)
            use = passes(bits.value, sig)
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(sig[use])], names=["key", "sig"])

    return classes.select("key", "registers").mapInArrow(run, "key long, sig long")


def _likely(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, percent: int, least: float) -> np.ndarray:
    """Pairs whose sizes allow a link and whose likeliest similarity is `least` or more."""
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & at_least(above, below, n_a, n_b, least)


def _close(n_a: np.ndarray, n_b: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that differ in so few bins that they may link: linking sets differ in at most (100 - p) / (100 + p) (a + b) features."""
    return (100 + percent) * differing <= (100 - percent) * (n_a + n_b)


def _apart(cells: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs (a, b) of different roots that may link, in the cells (sig, kind, x, y) of rows (key, n, registers, parity, root, side).

    In a cell of two sides, side 0 meets side 1; in a cell of one, each row meets the others. A pair that shares several bands is given in
    the cell of the first.
    """

    def run(cell: pa.Table) -> pa.Table:
        key, n, root, side = (cell[c].to_numpy() for c in ("key", "n", "root", "side"))
        r, parity = _unpacked(cell["registers"]), Parities(cell["parity"])
        deep = r.reshape(len(r), BANDS, DEPTH)
        signatures = _bands(pa.RecordBatch.from_arrays([pa.array(key[:1]), cell["registers"].chunk(0).slice(0, 1)], names=["key", "registers"]))[1]
        here = int(np.flatnonzero(signatures == cell["sig"][0].as_py())[0])
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if side.any() else one
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        for i in one:
            j = two[(root[two] != root[i]) & ((two > i) | (side[two] == 1))]
            j = j[_likely(n[i], n[j], (r[i] > r[j]).sum(axis=1), (r[i] < r[j]).sum(axis=1), percent, least)]
            if len(j):
                j = j[(deep[j] == deep[i]).all(axis=2).argmax(axis=1) == here]
                found.append((np.full(len(j), i), j))
        a, b = (np.concatenate(x) for x in zip(*found))
        may = _close(n[a], n[b], parity.differing(a, parity, b), percent)
        a, b = key[a[may]], key[b[may]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cells.groupBy("sig", "kind", "x", "y").applyInArrow(run, "a long, b long")


def _met_likely(pairs: DataFrame, classes: DataFrame, percent: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are likely and may link."""
    one, two = (classes.select(F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "registers", "parity"))) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = batch.column(2).to_numpy(), batch.column(5).to_numpy()
                a, b = _unpacked(batch.column(3)), _unpacked(batch.column(6))
                likely = np.flatnonzero(_likely(n_a, n_b, (a > b).sum(axis=1), (a < b).sum(axis=1), percent, least))
                differing = Parities(batch.column(4)).differing(likely, Parities(batch.column(7)), likely)
                yield batch.select([0, 1]).take(pa.array(likely[_close(n_a[likely], n_b[likely], differing, percent)]))

    return pairs.join(one, "a").join(two, "b").select("a", "b", *(f"{c}_{x}" for x in "ab" for c in ("n", "registers", "parity"))).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_key, component_id, kept) of every document.

    Words end at ASCII white space and A-Z count as a-z. Two documents link when 100 |A & B| >= percent |A | B| for
    their sets of distinct `size`-word runs (a shorter text is one run). component_id is the least doc_id reachable and `kept` holds
    where it is the row's own. Null, empty and wordless texts have 0 shingles, link with nothing and are kept. A null doc_id is a
    document of its own kind that is never anyone's component_id unless all members' are null (then `kept` holds).
    Rows that repeat a doc_id stay apart as rows. An empty table gives an empty result.

    Equal sets are one class. Classes that share a band are candidates: first each with the central class of the band, then, of a band
    whose classes are still in several components, those of different components, in blocks of bounded size. Of the candidates the
    likely ones, by registers and sizes, are confirmed on their full sets, but for those that parities rule out. Links are found up to the chance that a pair
    shares no band (7e-11 at 0.85, 2e-7 at 0.8) or is estimated SPARE deviations too low; none is dropped, capped or left unconfirmed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "setsketch")
    j = percent / 100
    least = max(0.0, j - SPARE * (j * (1 - j) / _N) ** 0.5)
    rows = docs.select(plain(doc_id).alias("id"), plain(text).alias("text"))
    described = scratch.table(_described(rows, size))
    members = scratch.table(described.select("id", "n", "key"))
    classes = scratch.table(described.where("registers is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "registers", "parity"))))
    scratch.drop(described)

    # classes of one band: pairs, and crowds around the class that meets most others
    shared = scratch.table(_shared(classes))
    crowded = shared.where("n > 2").select("sig", F.col("n").alias("crowd"))
    bits = spark.sparkContext.broadcast(key_filter(crowded, "sig"))
    signed = scratch.table(_signed(classes, bits).join(crowded, "sig"))
    weight = signed.groupBy("key").agg(F.sum("crowd").alias("weight"))
    in_crowds = scratch.table(signed.select("sig", "key").join(weight, "key"))
    scratch.drop(signed)
    centers = in_crowds.groupBy("sig").agg(F.max_by("key", F.struct("weight", "key")).alias("center"))
    stars = in_crowds.join(centers, "sig").where("key <> center").select(F.least("center", "key").alias("a"), F.greatest("center", "key").alias("b"))
    met = shared.where("n = 2").select("a", "b").union(stars).distinct()
    tried = scratch.table(_met_likely(met, classes, percent, least))
    scratch.drop(shared)
    scratch.tidy()
    texts = scratch.table(_texts(rows, tried, members, size))
    edges = scratch.table(_similar(tried, texts, size, percent))
    scratch.drop(texts)
    roots = scratch.table(components(edges, scratch))

    # crowds in several components: its largest part (side 0) meets the others (side 1), and these meet each other
    at = in_crowds.join(roots.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", F.coalesce("root", "key").alias("root"))
    parts = at.groupBy("sig", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("sig").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("n_main < n_all")
    several = mixed.select("sig", "main", *(F.ceil(F.expr(n) / BLOCK).cast("int").alias(k) for n, k in (("n_main", "k0"), ("n_all - n_main", "k1"))))
    at = at.join(several, "sig").withColumn("side", F.when(F.col("root") == F.col("main"), 0).otherwise(1))
    at = at.withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("side") == 0, F.col("k0")).otherwise(F.col("k1"))).cast("int"))

    def cell(kind: int, x, y, side=None):
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), (F.lit(side) if side is not None else F.col("side")).cast("int").alias("side"))

    def numbered(k: str, f):
        return F.transform(F.sequence(F.lit(0), F.col(k) - 1), f)

    block = F.col("block")
    here = numbered("k1", lambda i: cell(0, block, i))
    there = F.concat(numbered("k0", lambda i: cell(0, i, block)), numbered("k1", lambda i: cell(1, F.least(block, i), F.greatest(block, i), 0)))
    # rows of two blocks of the others: the lower block is side 0, so rows of one block don't meet there again
    there = F.transform(there, lambda c: F.when((c["kind"] == 1) & (c["x"] < c["y"]) & (c["y"] == block), c.withField("side", F.lit(1))).otherwise(c))
    cells = at.withColumn("c", F.explode(F.when(F.col("side") == 0, here).otherwise(there))).select("sig", "key", "root", "c.*").join(classes, "key")
    rest = scratch.table(_apart(cells, percent, least).distinct().join(tried, ["a", "b"], "left_anti"))
    scratch.drop(in_crowds)
    if not rest.isEmpty():
        more = scratch.table(_similar(rest, scratch.table(_texts(rows, rest, members, size)), size, percent))
        roots = components(edges.union(more), scratch)
    labelled = scratch.table(members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    first = scratch.table(labelled.where("n > 0").groupBy("root").agg(F.min("id").alias("least")))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return labelled.join(first, "root", "left").select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

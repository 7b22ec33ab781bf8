"""Exact n-gram Jaccard join with PartEnum signatures, reported as classes and components.

Sets of equal or neighbouring size bands whose Jaccard similarity reaches the threshold differ in at most k features.
The feature domain is split into n1 parts and each part into n2; two sets that differ in at most k features agree,
in some part, on some n2 - k2 of its n2 pieces, so the hashes of all such selections always share one value.
From a similarity of 0.9 on, n2 = 3 and k2 = 1; below, one part with k2 = k and n2 = k + 4 for sets of small k, else n2 = 2 and k2 = 1 with spare pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm.arrowtext import BLOCK_BYTES, Words, blocks, mix, windows, words
from trajecta.llm.graph import components
from trajecta.llm.scratch import Scratch, key_filter, passes, plain

#: Features from which on a selection is not thin.
FULL = 4


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """First set size of each size band; sets of similarity percent/100 are in one band or in neighbours."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, dtype=np.int64)


def distance(band: np.ndarray, percent: int) -> np.ndarray:
    """Features in which two linking sets can differ, of which one is in the band and the other in it or the one below."""
    largest = bands(percent)[band + 1] - 1
    # two sets of sizes a, b with this similarity differ in at most (100 - p) / (100 + p) (a + b) features
    return ((100 - percent) * 2 * largest) // (100 + percent)


def schemes(k: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]:
    """(which sets, n2, k2, n1 of each, spare of each): ways of dividing the domain for the distances k. k = 0 has none: only equal sets link.

    Two linking sets agree on at least `spare` parts' selections; where a selection is one of two pieces, on `spare` pieces.
    """
    one = np.ones(len(k), dtype=np.int64)
    if percent >= 90:
        yield k > 0, 3, 1, k // 2 + 1, one
        return
    for few in range(1, 6):
        yield k == few, few + 4, few, one, one
    n1 = (k + 5 + k // 8) // 2
    yield k > 5, 2, 1, n1, 2 * n1 - k


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct run of `size` words, sorted by both; a shorter text's whole sequence is its one run."""
    _, text, value = windows(w, size)
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        at = np.searchsorted(w.text, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            has = n[short] > j
            extra[has] = mix(extra[has] * np.uint64(0xFF51AFD7ED558CCD) + w.hash[at[has] + j])
        text, value = np.concatenate([text, short]), np.concatenate([value, mix(extra + np.uint64(1))])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def signatures(text: np.ndarray, value: np.ndarray, n_texts: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) for the sorted features of a block's sets: in the set's band and, to meet the larger sets, in the next.

    A selection of few features says little, so a set leaves out those of less than `least` features, where `least` (at
    most FULL) is such that fewer of its parts have one than its spare parts: of any linking pair, the set with the
    larger `least` still has a part that agrees, and the other set has that selection too, as it has the same features.
    """
    sizes = np.bincount(text, minlength=n_texts)
    hashed, mixed = mix(value + np.uint64(0x632BE59BD9B4E019)), mix(value ^ np.uint64(0xA24BAED4963EE407))
    owners, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for step in (0, 1):
        band = np.searchsorted(bands(percent), np.maximum(sizes, 1), "right") - 1 + step
        for which, n2, k2, n1, spare in schemes(distance(band, percent), percent):
            who = np.flatnonzero(which & (sizes > 0))
            if not len(who):
                continue
            n1 = n1[who]
            cells = n1 * n2
            base = np.zeros(n_texts, dtype=np.int64)
            base[who] = np.cumsum(cells) - cells
            wide = np.ones(n_texts, dtype=np.uint64)
            wide[who] = cells.astype(np.uint64)
            mine = which[text]
            t = text[mine]
            cell = (hashed[mine] % wide[t]).astype(np.int64) + base[t]
            total = int(cells.sum())
            count = np.bincount(cell, minlength=total)
            sums = np.zeros(total, dtype=np.uint64)
            order = np.argsort(cell, kind="stable")
            c, v = cell[order], mixed[mine][order]
            firsts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            sums[c[firsts]] = np.add.reduceat(v, firsts)
            owner = np.repeat(who, n1)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(n1) - n1, n1)
            first = base[owner] + part * n2
            picks = n2 - k2
            fewest = count if picks == 1 else np.sort(count.reshape(-1, n2), axis=1)[:, :picks].sum(axis=1)
            of = np.repeat(owner, n2) if picks == 1 else owner
            least = np.zeros(n_texts, dtype=np.int64)
            for m in range(1, FULL + 1):
                least[np.bincount(of, fewest < m, minlength=n_texts) < np.where(which, spare, 1)] = m
            tag = mix((band[owner].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64))
            for j, picked in enumerate(combinations(range(n2), picks)):
                h, n = tag + np.uint64(j), np.zeros(len(owner), dtype=np.int64)
                for q in picked:
                    h = mix(h * np.uint64(0x9FB21C651E98DF25) + sums[first + q])
                    n += count[first + q]
                some = n >= least[owner]
                owners.append(owner[some])
                found.append(h[some])
    return np.concatenate(owners), np.concatenate(found)


def _digests(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A key of each text's set; 0 for an empty one."""
    sizes = np.bincount(text, minlength=n)
    out = np.zeros((2, n), dtype=np.uint64)
    if len(text):
        firsts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        out[0, text[firsts]] = np.add.reduceat(mix(value + np.uint64(0x1D8E4E27C47D124F)), firsts)
        out[1, text[firsts]] = np.bitwise_xor.reduceat(mix(value + np.uint64(0xEB44ACCAB455D165)), firsts)
    key = mix(out[0] + mix(out[1] ^ sizes.astype(np.uint64)))
    key[sizes == 0] = 0
    return key


#: Classes of a crowd that meet in one group, about.
BLOCK = 256
#: Bits of a sketch from a similarity of 0.9 on. Below, a set of n features has the power of two from 2 n on, at least this.
SKETCH = 512


def _sketches(text: np.ndarray, value: np.ndarray, n: int, percent: int) -> tuple[pa.Array, pa.Array]:
    """The parity of how many features fall in each bin, and that folded to SKETCH bins. Sets differ in at least as many features as their sketches in bits."""
    sizes = np.bincount(text, minlength=n)
    bits = np.full(n, SKETCH, dtype=np.int64)
    if percent < 90:
        bits = np.maximum(bits, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 2))).astype(np.int64))
    start = np.cumsum(bits) - bits
    bins = (mix(value + np.uint64(0x27D4EB2F165667C5)) & (bits[text] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(start[text] + bins, minlength=int(bits.sum())) & 1).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(bits // 64)]).astype(np.int32)
    whole = np.packbits(odd).view(np.int64)
    few = SKETCH // 64
    folded = np.bitwise_xor.reduceat(whole.reshape(-1, few), offsets[:-1] // few, axis=0) if n else np.zeros((0, few), dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * few), pa.array(folded.ravel()))


def _near(percent: int) -> str:
    """SQL test of rows (na, sa, fa, nb, sb, fb) that holds for every pair that links: its sets differ in at most (100 - p) / (100 + p) (a + b) features.

    A longer sketch is folded to the length of the other: bins that become one have the parity of their sum.
    """
    within = f"<= {100 - percent} * (na + nb)"
    short = " + ".join(f"bit_count(get(fa, {i}) ^ get(fb, {i}))" for i in range(SKETCH // 64))
    test = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * ({short}) {within}"
    if percent >= 90:
        return test
    half = "size({s}) div 2"
    fold = "case when size({s}) > size({o}) then zip_with(slice({s}, 1, " + half + "), slice({s}, " + half + " + 1, " + half + "), (x, y) -> x ^ y) else {s} end"
    a, b = fold.format(s="sa", o="sb"), fold.format(s="sb", o="sa")
    apart = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0L, (t, x) -> t + x)"
    return f"{test} and (size(sa) <= {SKETCH // 64} or {100 + percent} * ({apart}) {within})"


def _described(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, key, sketch, folded) of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in blocks(batch.column(1)):
                text, value = shingles(words(raw, at), size)
                n = np.bincount(text, minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(_digests(text, value, b - a).view(np.int64)), *_sketches(text, value, b - a, percent)], names=["id", "n", "key", "sketch", "folded"])

    longs = T.ArrayType(T.LongType())
    return docs.mapInArrow(run, docs.select("id").schema.add("n", "long").add("key", "long").add("sketch", longs).add("folded", longs))


#: Signatures that a task holds before it sums them up, and rows that it gives on at a time.
HELD, GIVEN = 1 << 20, 1 << 16


def _classes(column: pa.Array, size: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, signature) of the distinct sets of each block of texts."""
    for a, b, raw, at in blocks(column, BLOCK_BYTES // 4):
        text, value = shingles(words(raw, at), size)
        key = _digests(text, value, b - a)
        _, first = np.unique(key, return_index=True)
        if len(first) < b - a:
            number = np.full(b - a, -1)
            number[np.sort(first)] = np.arange(len(first))
            key, mine = key[np.sort(first)], number[text] >= 0
            text, value = number[text[mine]], value[mine]
        owner, sig = signatures(text, value, len(key), percent)
        yield key[owner].view(np.int64), sig


def _shared(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, a, b, n): the least and the largest class of each signature that two classes have, and how often it came.

    Tasks sum up what they hold before it is dealt by signature; signatures are made anew where they are needed
    again, as they would be most of the job's disk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def summed() -> Iterator[pa.RecordBatch]:
            key, sig = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((key, sig))
            key, sig = key[order], sig[order].view(np.int64)
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            key, sig = key[new], sig[new]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            last = np.append(first[1:], len(sig))
            for i in range(0, len(first), GIVEN):
                f, e = first[i : i + GIVEN], last[i : i + GIVEN]
                yield pa.RecordBatch.from_arrays([pa.array(sig[f]), pa.array(key[f]), pa.array(key[e - 1], mask=e - f == 1), pa.array((e - f).astype(np.int32))], names=["sig", "a", "b", "n"])

        for batch in batches:
            for key, sig in _classes(batch.column(0), size, percent):
                held.append((key, sig))
                n_held += len(sig)
                if n_held >= HELD:
                    yield from summed()
                    held, n_held = [], 0
        if n_held:
            yield from summed()

    dealt = docs.select("text").mapInArrow(run, "sig long, a long, b long, n int").repartition("sig")  # b is null for one class
    return dealt.groupBy("sig").agg(F.min("a").alias("a"), F.greatest(F.max("a"), F.max("b")).alias("b"), F.sum("n").alias("n")).where("a <> b")


def _signed(docs: DataFrame, size: int, percent: int, bits) -> DataFrame:
    """(key, sig) of each text's signatures that pass the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, sig in _classes(batch.column(0), size, percent):
                use = np.flatnonzero(passes(bits.value, sig))
                for i in range(0, len(use), GIVEN):
                    some = use[i : i + GIVEN]
                    yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(sig[some].view(np.int64))], names=["key", "sig"])

    return docs.select("text").mapInArrow(run, "key long, sig long")


def _similar(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys whose sets reach the threshold, counted on the whole texts of one member each."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for a, b, raw, at in blocks(column):
            text, value = shingles(words(raw, at), size)
            cut = np.searchsorted(text, np.arange(b - a + 1))
            for i in range(b - a):
                yield value[cut[i] : cut[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, class_key, component_id) of every document.

    Words end at ASCII white space and A-Z count as a-z. Two documents link when 100 |A & B| >= percent |A | B| for
    their sets of distinct `size`-word runs (a shorter text is one run). component_id is the least doc_id reachable.
    Null, empty and wordless texts have 0 shingles, link with nothing and are their own component; a null doc_id
    is a document of its own kind that is never anyone's component_id unless all members' are null. Rows that repeat
    a doc_id stay apart as rows; a component they share has the same component_id.

    Equal sets are one class, so copies never meet as pairs. A class meets, through each shared signature, only the
    central class of that signature; pairs of classes that are already connected are not compared. What is left between
    unconnected classes of one signature is then compared in full, so no link is lost and none is capped. Parity sketches
    of the sets rule out most pairs that cannot link before they are emitted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(plain(doc_id).alias("id"), plain(text).alias("text"))
    described = scratch.table(_described(rows, size, percent))
    members = described.select("id", "n", "key")
    # signatures that two classes or more share
    shared = scratch.table(_shared(rows, size, percent))
    pairs = shared.select("a", "b")
    crowded = shared.where("n > 2").select("sig", F.col("n").alias("crowd"))
    bits = spark.sparkContext.broadcast(key_filter(crowded, "sig"))

    signed = scratch.table(_signed(rows, size, percent, bits).distinct().join(crowded, "sig"))
    # the center of a crowd is the class that meets most others: links of a group of near copies mostly go through it
    weight = signed.groupBy("key").agg(F.sum("crowd").alias("weight"))
    in_crowds = scratch.table(signed.select("sig", "key").join(weight, "key"))
    scratch.drop(signed)
    scratch.tidy()
    heaviest = in_crowds.groupBy("sig").agg(F.max("weight").alias("weight"))
    centers = in_crowds.join(heaviest, ["sig", "weight"]).groupBy("sig").agg(F.min("key").alias("center"))
    stars = in_crowds.join(centers, "sig").where("key <> center").select(F.least("center", "key").alias("a"), F.greatest("center", "key").alias("b"))
    sketches = scratch.table(described.where("n > 0").select("key", "n", "sketch", "folded").dropDuplicates(["key"]))
    one, two = (sketches.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("folded").alias(f"f{x}")) for x in "ab")
    met = pairs.union(stars).distinct()
    tried = scratch.table(met.join(one, "a").join(two, "b").where(_near(percent)).select("a", "b"))
    scratch.drop(shared)
    texts = scratch.table(_texts(rows, tried, members, size))
    edges = scratch.table(_similar(tried, texts, size, percent))
    scratch.drop(texts)
    roots = scratch.table(components(edges, scratch))

    # what is left: classes of one signature in different components, met in a grid of blocks of each crowd
    at = in_crowds.join(roots.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", F.coalesce("root", "key").alias("root"))
    mixed = at.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y").select("sig", F.expr(f"cast((n - 1) div {BLOCK} + 1 as int)").alias("blocks"))
    at = at.join(mixed, "sig").join(sketches, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    at = scratch.table(at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("blocks", "other"))
    one, two = (at.select("sig", "x", "y", F.col("key").alias(k), F.col("root").alias(f"r{k}"), F.col("block").alias(f"b{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"), F.col("folded").alias(f"f{k}")) for k in "ab")
    rest = one.join(two, ["sig", "x", "y"]).where("a < b and ra <> rb and (x = y or ba <> bb) and " + _near(percent)).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    rest = scratch.table(rest)
    scratch.drop(at, in_crowds)
    scratch.tidy()
    if not rest.isEmpty():
        more = scratch.table(_similar(rest, scratch.table(_texts(rows, rest, members, size)), size, percent))
        roots = components(edges.union(more), scratch)
    labelled = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    labelled = scratch.table(labelled)
    least = scratch.table(labelled.where("n > 0").groupBy("root").agg(F.min("id").alias("least")))
    return labelled.join(least, "root", "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id")
    )


def _texts(rows: DataFrame, pairs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(key, text): one text of each class that is in a pair."""
    spark = rows.sparkSession
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    chosen = members.groupBy("key").agg(F.min("id").alias("id")).join(keys, "key").withColumn("h", F.xxhash64("id"))
    bits = spark.sparkContext.broadcast(key_filter(chosen, "h"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(passes(bits.value, batch.column(2).to_numpy(zero_copy_only=False))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in picked(batches):
            for a, b, raw, at in blocks(batch.column(1)):
                key = _digests(*shingles(words(raw, at), size), b - a).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(key)], names=["id", "text", "key"])

    few = rows.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(keyed, "id " + rows.schema["id"].dataType.simpleString() + ", text string, key long")
    chosen = chosen.select("key", F.col("id").alias("of"))
    return few.join(chosen, "key").where(F.col("id").eqNullSafe(F.col("of"))).select("key", "text").dropDuplicates(["key"])

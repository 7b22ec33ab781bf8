import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pytest
from corpus import documents

from trajecta.llm import lm, lmtables
from trajecta.llm.scratch import Scratch


def written(spark):
    """Bytes that the shuffles of the session have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    time.sleep(1)
    spark.range(10).repartition(2).count()  # its end brings the figures up to date
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_shuffles_of_scores_are_small(spark, monkeypatch):
    """Under 2 bytes for a byte of text, where most pairs stand in few texts and what is looked up has the share of tokens that it has in a corpus of 100 million."""
    monkeypatch.setattr(lm, "KNOWN", 3e-4)
    monkeypatch.setattr(lm, "FREQUENT", 1.5e-4)
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9))) for _ in range(20000)]
    share = [1 / (i + 3) for i in range(len(vocabulary))]
    docs = spark.createDataFrame([(i, " ".join(r.choices(vocabulary, share, k=400))) for i in range(1000)], "doc_id long, text string").repartition(2, "doc_id").localCheckpoint()
    size = sum(len(t) for _, t in docs.collect())
    before = written(spark)
    assert lm.score(docs, lm.remainder(docs["doc_id"], 7) != 2).count() == 1000
    assert 0 < written(spark) - before < 2 * size


def test_numbers_as_bytes():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        for most in (1, 256, 2**20, 2**62):
            x = r.integers(0, most, n)
            assert np.array_equal(lmtables.thick(lmtables.thin(x)), x)
            assert np.array_equal(lmtables.risen(lmtables.rising(np.sort(x))), np.sort(x))
    h = np.sort(r.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert np.array_equal(lmtables.risen(lmtables.rising(h)).view(np.uint64), h)


def test_order_of_numbers_that_share_their_high_bits():
    r = np.random.default_rng(4)
    for x in (r.integers(0, 2**62, 5000), r.integers(0, 50, 5000), np.repeat(2**61 + r.integers(0, 9, 40), 70), np.zeros(0, np.int64), r.integers(0, 2**64 - 1, 5000, dtype=np.uint64)):
        order = lmtables.order_of(x)
        assert np.array_equal(x[order], np.sort(x)) and np.array_equal(np.sort(order), np.arange(len(x)))


def test_pairs_have_numbers_of_their_own():
    r = np.random.default_rng(5)
    for bits in (1, 7, 22, 31):
        by = lmtables.Numbers(bits, 5)
        u, w = (r.integers(0, 2**bits, 3000) for _ in range(2))
        pair = by.pair(u, w)
        back = by.words(pair)
        assert np.array_equal(back[0], u) and np.array_equal(back[1], w) and pair.min() >= 0 and pair.max() < 2 ** (2 * bits)
        assert sum(s.stop - s.start for _, s in by.sliced(np.sort(pair))) == len(pair)
    with pytest.raises(ValueError):
        lmtables.Numbers(32, 5)


def test_chunks_and_parts_ask_and_tell_each_other(spark, monkeypatch):
    """Many chunks change no score; many parts no count, and scores as another seed does."""
    df = spark.createDataFrame(documents(), "doc_id long, text string").repartition(2, "doc_id").localCheckpoint()
    learn = lm.remainder(df["doc_id"], 7) != 2
    one = {r["doc_id"]: r for r in lm.score(df, learn).collect()}
    for size, part in ((700, lm.PART), (700, 900)):
        monkeypatch.setattr(lm, "GATHERED", size)
        monkeypatch.setattr(lm, "PART", part)
        two = {r["doc_id"]: r for r in lm.score(df, learn).collect()}
        assert one.keys() == two.keys()
        for i, r in one.items():
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (two[i]["n_tokens"], two[i]["n_known"], two[i]["train_tokens"])
            assert abs(r["base_score"] - two[i]["base_score"]) < 1e-6
            assert abs(r["score"] - two[i]["score"]) < (1e-9 if part > 900 else 0.05 * r["n_tokens"] + 0.1), (i, r, two[i])


def test_bytes_of_a_token(monkeypatch):
    """What a task takes for each token of its chunk or part, at its peak."""
    r = np.random.default_rng(9)
    size = 400_000
    words = np.minimum(r.pareto(0.6, size), 50_000).astype(int)
    lines = np.array([f"w{i}" for i in range(50_001)])[words].reshape(-1, 1000)
    texts = pa.record_batch([pa.array(range(len(lines)), pa.int64()), pa.array([i % 7 != 2 for i in range(len(lines))]), pa.array([" ".join(x) for x in lines])], names=["key", "learn", "text"])
    taken = {}

    def traced(f, *args, **more):
        tracemalloc.start()
        try:
            found = list(f(*args, **more))
            taken[f.__name__] = tracemalloc.get_traced_memory()[1] / size
        finally:
            tracemalloc.stop()
        return found

    class Texts:
        def mapInArrow(self, run, schema):
            def chunked(batches):
                return run(batches)

            return chunked

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(lmtables, "TaskContext", Context)
    tokens = list(lm._tokens(texts.column(2)))  # whose own blocks count apart
    text, asked, _ = (row for batch in traced(lmtables.chunks(Texts(), lambda _: tokens, 2 * size), iter([texts])) for row in lmtables.rows_of(batch))
    n_words = lmtables.risen(asked[3][0]).size
    norm = float(np.log10(size + n_words + 1))
    vocab = list(lmtables.vocabulary(0, list(lmtables.by_hash(asked, 1))))
    classes = lmtables.thick(vocab[1][3][1])[None]
    starts = (1 + np.cumsum(classes[:, ::-1]) - classes[:, ::-1])[:, ::-1]
    by = lmtables.Numbers(int(classes.sum()).bit_length(), 1)
    told = list(lmtables.named(0, list(lmtables.by_hash(asked, 1)), vocab[:1], starts))
    (chunk,) = traced(lmtables.numbered, 0, [text], told, norm)
    pairs = traced(lmtables.merged, 0, traced(lmtables.paired, chunk, by))
    seats, routes = ([r for r in pairs if r[0] == k] for k in (0, 1))
    base, opened = 1 / (n_words + 1), n_words + 1.0
    first = list(lmtables.reseated(0, list(lmtables.counted(vocab[0], by, starts)), list(lmtables.told(seats[0], by, True)), by, base, lm.PARENT, opened, 1, 1, n_starts=len(lines)))
    seats = list(lmtables.sat_down(0, seats, [r for r in first if r[0] == 1], by, base, lm.INNER, (*lm.PARENT, opened, opened), 1, 3, 2, 100))
    state = list(lmtables.reseated(0, first[:1], list(lmtables.told(seats[0], by, False)), by, base, lm.PARENT, opened, 2, 3))
    answers = [*lmtables.pairs_answered(0, seats, routes, 3), *lmtables.words_answered(0, state[:1], traced(lmtables.words_asked, chunk, by))]
    served, opened = (lmtables.thick(x).tolist() for x in state[-1][3])
    *_, sizes, _, _, score = traced(lmtables.scored, chunk, answers, by, lm.INNER, lm.PARENT, served, opened, base)
    assert sizes.sum() == size + len(lines) and (score < -sizes).all() and (score > -9 * sizes).all()
    assert {k: round(x) for k, x in taken.items() if x > 56} == {}, taken


def test_stored_blocks_need_no_buffers_outside_the_heap(spark):
    """Snappy's codec keeps two of the size of a page, here of all rows, for each reader and writer."""
    rows = [(0, i, i, [bytes([i]) * 3, np.random.default_rng(i).bytes(300_000)]) for i in range(8)]
    scratch = Scratch(spark, "stored", **lmtables.STORED)
    back = scratch.table(spark.createDataFrame(rows, lmtables.ROW).coalesce(1))
    assert sorted((r["kind"], r["to"], r["at"], [bytes(x) for x in r["data"]]) for r in back.collect()) == rows
    (file,) = pa.dataset.dataset(scratch.places[0][1].removeprefix("file://")).get_fragments()
    assert {file.metadata.row_group(0).column(i).compression for i in range(4)} == {"ZSTD"}

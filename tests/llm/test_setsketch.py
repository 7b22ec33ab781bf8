"""SetSketch registers, their estimate, and the components they lead to, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from corpus import documents, prose
from test_joins import components

from trajecta.llm import setsketch

DOCS = documents()


def found(spark, docs, **more):
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **more).collect()
    assert len(got) == len(docs) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


@pytest.mark.parametrize("percent,size", [(85, 3), (80, 5)])
def test_components(spark, percent, size):
    assert found(spark, DOCS, percent=percent, size=size) == components(DOCS, percent, size)


@pytest.mark.parametrize("block", [256, 16])
def test_a_crowd_in_several_components(spark, monkeypatch, block):
    """Near copies of which many are too far from the center and from each other, so blocks of the crowd meet."""
    monkeypatch.setattr(setsketch, "BLOCK", block)
    r = random.Random(9)
    base = prose(r, 150).split(" ")
    docs = []
    for i in range(250):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(len(w))] = "x%d" % r.randrange(1000)
        docs.append((i, " ".join(w)))
    want = components(docs, 85)
    assert 10 < len({c for _, c in want.values()}) < 200
    assert found(spark, docs, percent=85, size=3) == want


def test_a_set_of_any_size(spark):
    """One word more or less at the threshold: 17 of 20 runs shared link, 16 of 20 don't."""
    words = [f"w{i}" for i in range(2000)]
    docs = []
    for k, (shared, each) in enumerate([(17, 3), (16, 4), (850, 150), (849, 152), (1, 0), (2, 0)]):
        for j, tail in enumerate(("y", "z")):
            left = each // 2 if j else each - each // 2
            docs.append((10 * k + j, " ".join([f"{k}{w}" for w in words[: shared + 2]] + [f"{k}{tail}{i}" for i in range(left)])))
    assert found(spark, docs, percent=85, size=3) == components(docs, 85)


def test_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, None), (3, "q r s t u"), (4, ""), (5, " \n "), (6, "q")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, kept int, `a.b` string")
    got = sorted(tuple(r) for r in setsketch.near_duplicates(df, size=3, percent=85).drop("class_key").fillna(-1, ["doc_id", "component_id"]).collect())
    assert got == sorted([(1, 2, 1, True)] * 2 + [(-1, 2, 1, False), (-1, 0, -1, True), (2, 0, 2, True), (3, 3, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True)])
    assert setsketch.near_duplicates(df.limit(0)).count() == 0


def sets(r, sizes):
    """Registers of sets of random features: (features of each set) by ranges of one list."""
    value = r.integers(0, 2**64, max(b for _, b in sizes), dtype=np.uint64)
    text = np.concatenate([np.full(b - a, i) for i, (a, b) in enumerate(sizes)])
    return setsketch.registers(text, np.concatenate([value[a:b] for a, b in sizes]), len(sizes))


def test_registers_merge_and_estimate():
    r = np.random.default_rng(3)
    errors = []
    for n, m, common in ((1000, 1000, 850), (1000, 900, 880), (300, 300, 100), (40, 38, 36), (5, 5, 5)):
        for _ in range(20):
            a, b, both = sets(r, [(0, n), (n - common, n - common + m), (0, n - common + m)])
            assert (np.maximum(a, b) == both).all()
            got = setsketch.similarity(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([n]), np.array([m]))[0]
            errors.append((got - common / (n + m - common)) * 200**0.5)
    assert abs(np.mean(errors)) < 0.1 and np.std(errors) < 0.5 and np.max(np.abs(errors)) < 2


def test_bands_meet_as_often_as_they_should():
    """Of pairs of similarity 0.6 the share that meets in a band is that of independent registers."""
    r = np.random.default_rng(5)
    met = 0
    for _ in range(300):
        a, b = sets(r, [(0, 400), (100, 500)]).reshape(2, setsketch.BANDS, setsketch.DEPTH)
        met += (a == b).all(axis=1).sum()
    assert abs(met / (300 * setsketch.BANDS) - 0.6**5) < 0.015


def test_parities_bound_the_difference():
    """Of sets of any sizes, so that longer parities are folded."""
    r = np.random.default_rng(8)
    sizes = [(0, n) for n in (3, 200, 255, 257, 300, 1000)] + [(5, 260), (40, 310), (900, 3000)]
    value = r.integers(0, 2**64, 3000, dtype=np.uint64)
    text = np.concatenate([np.full(b - a, i) for i, (a, b) in enumerate(sizes)])
    column = setsketch._sketches(text, np.concatenate([value[a:b] for a, b in sizes]), len(sizes), 0)[0]
    p = setsketch.Parities(column)
    assert len(set(p.size)) > 2
    a, b = (x.ravel() for x in np.indices((len(sizes),) * 2))
    got = p.differing(a, p, b)
    for i, j, k in zip(a, b, got):
        apart = len(set(range(*sizes[i])) ^ set(range(*sizes[j])))
        assert k <= apart and (k >= 0.7 * apart or apart > 100)

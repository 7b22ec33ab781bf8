"""Hard negatives against plain integer arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from trajecta.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, negative_id string, `a.b` int"


def mined(rows, n_positives=5, n_negatives=3, low=50, high=95):
    v = {(i, lab, tuple(math.floor(256 * x) for x in e)) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for a in v:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b) for b in v if b != a)
        for s, i, _ in [x for x in scored if x[2][1] == a[1]][:n_positives]:
            fits = [(j, t) for t, j, b in scored if b[1] != a[1] and low * -s <= 100 * -t <= high * -s]
            out += [(a[0], i, k, j, -s, -t) for k, (j, t) in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, e and [x if x is None else float(x) for x in e], lab, "x", 1) for i, e, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, negatives.F.col("vec_id") % 50 == 0, **more).collect())


def vectors(seed, n, d=6, labels=3, step=0.25):
    r = random.Random(seed)
    return [(i, [r.randrange(-6, 7) * step for _ in range(d)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("blocks", [(16_384, 8_192), (2, 37)])
def test_by_hand_with_ties(spark, monkeypatch, blocks):
    """Coarse components make many equal scores; small blocks make many of them meet."""
    monkeypatch.setattr(negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(negatives, "CANDIDATES", blocks[1])
    rows = vectors(3, 400)
    assert got(spark, rows) == mined(rows)
    assert got(spark, rows, n_positives=2, n_negatives=1, percents=(0, 100)) == mined(rows, 2, 1, 0, 100)


def test_odd_rows(spark):
    rows = vectors(4, 120)
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (250, [1.0, None, 0, 0, 0, 0], 1), (300, [float("nan")] + [0.0] * 5, 1), (350, [float("inf")] * 6, 2), (400, [1.0] * 6, None)]
    rows += [(450, [], 0), (451, [2.0], 0), (500, [1.0] * 9, 1), rows[50], rows[50], rows[7]]
    assert got(spark, rows) == mined(rows)
    assert got(spark, []) == [] and got(spark, [(1, [1.0], 1)]) == [] and got(spark, [(50, [1.0], 1)]) == []


def test_one_vector_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    rows = vectors(5, 300) + [(i, [1.0, 0.5, 0, 0, 0, 0], 2) for i in range(300, 450)]
    assert got(spark, rows) == mined(rows)


@pytest.mark.parametrize("top", [3, 300, 60_000, 2**24, 2**28])
def test_packed_products_are_exact(top):
    """Over ranges that leave two fields and more, one field of a double, and one of a 64-bit integer."""
    r = np.random.default_rng(top)
    a, c = r.integers(-top, top + 1, (7, 33)), r.integers(-top // 2, top + 1, (10, 33))
    a[0] = c[0] = top
    packed = negatives.Packed(c, -top, top)
    assert packed.fields == {3: 4, 300: 2}.get(top, 1)
    assert (packed.scores(a) == a @ c.T).all()


def test_what_doesnt_fit_is_an_error(spark):
    with pytest.raises(ValueError):
        negatives.Packed(np.zeros((1, 64), dtype=np.int64), -(2**31), 2**31)
    with pytest.raises(Exception, match="32 bits"):
        got(spark, [(50, [1e9], 1), (51, [1.0], 1)])

"""Spelling variants against all pairs of words."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpus import FOLD

from trajecta.llm import queries, spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def counted(docs, least_length=7, least_n=2, altered=31):
    n = Counter()
    for i, t in docs:
        for run in RUNS.findall(t or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if altered and h % altered == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}


def grouped(n, times=10):
    """By the words that leave the same rest when the letter of one place is taken away."""
    near = defaultdict(set)
    rests = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rests[w[:i] + "*" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for same in rests.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df, **more):
    rows = spelling.spelling_variants(df, **more).select(*COLUMNS).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def corpus(seed, n_docs, n_words, alphabet="abcdeéñ", lengths=(6, 11)):
    """Few letters, so that many words are near each other; some words are frequent, some run through several forms."""
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(*lengths))) for _ in range(n_words)]
    weight = [1 / (k + 1) for k in range(n_words)]
    return [(i, " ".join(w.capitalize() if r.random() < 0.2 else w for w in r.choices(base, weight, k=200))) for i in range(n_docs)]


@pytest.mark.parametrize("cell,most", [(16_384, 131_072), (40, 131_072), (60, 50)])
def test_all_words(spark, monkeypatch, cell, most):
    """With one cell for each length, with many, and with cells that are searched in blocks."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "MOST", most)
    docs = corpus(1, 300, 2500, "abcé")
    want = grouped(counted(docs))
    assert len(want) > 1000 and any(f for _, f, *_ in want) and max(w[4] for w in want) > 5
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), altered=31) == want


def test_chains_of_forms(spark):
    words = [("straightens", 1), ("straighten", 10), ("straightem", 100), ("straightam", 1000), ("straightbm", 10_000), ("unrelated", 3)]
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)]
    got = {r[0]: r for r in found(spark.createDataFrame(docs, "doc_id long, text string"), least_n=1)}
    assert {w: r[2] for w, r in got.items()} == {w: "unrelated" if w == "unrelated" else "straightbm" for w, _ in words}
    assert got["straightens"][1:] == ("straighten", "straightbm", 1, 1, 10)


def test_anagrams_and_long_words(spark, monkeypatch):
    """More words of one point than a box holds, and letters more often than the splits ask for."""
    r = random.Random(2)
    letters = list("aaaabbbccd")
    some = {"".join(r.sample(letters, 10)) for _ in range(400)} | {"z" * k for k in (7, 8, 9, 300, 301, 70_000)} | {"z" * 299 + "y"}
    docs = [(1, " ".join(sorted(some))), (2, " ".join(sorted(some)))]
    for cell in (16_384, 50):
        monkeypatch.setattr(spelling, "CELL", cell)
        assert found(spark.createDataFrame(docs, "doc_id long, text string")) == grouped(counted(docs, altered=None))


def test_odd_rows(spark):
    rows = [(1, "Straßen STRASSEN"), (1, "Straßen STRASSEN"), (None, "éèêëàâä éèêëàâä ÉÈÊËÀÂÄ"), (None, None), (2, ""), (3, "short x1y2"), (4, "naıve naïveté naïvetê×÷ naïvetê×÷ naïveté")]
    df = spark.createDataFrame([(*r, "w", 1, "d") for r in rows], "doc_id long, text string, word string, n int, `a.b` string")
    assert found(df, altered=31) == grouped(counted(rows))
    assert found(df, altered=3, least_n=1) == grouped(counted(rows, least_n=1, altered=3))
    assert found(df.limit(0)) == set()
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, times=1)


def test_letters():
    letters, size = spelling.spelled(pa.array(["abz", "", "éa", "ÀÿZ".replace("Z", "z")]))
    assert list(size) == [3, 0, 2, 3] and list(letters) == [0, 1, 25, 26 + 0xE9 - 0xC0, 0, 26, 89, 25]
    assert (spelling.letter_counts(letters, size).sum(axis=1) == size).all()


def test_a_search_finds_all_in_reach():
    r = np.random.default_rng(1)
    points = r.integers(0, 4, (600, spelling.LETTERS)).astype(np.uint8) * (np.arange(spelling.LETTERS) < 4)
    every = np.arange(600)
    downs = (every % 2).astype(np.int8)
    seen = {(a, b) for x, y in spelling.search(every, every, points, points, downs, lambda q, d: np.ones((len(q), len(d)), dtype=bool)) for a, b in zip(x, y)}
    for a in every:
        apart = points.astype(int) - points[a].astype(int)
        near = np.flatnonzero((np.maximum(apart, 0).sum(axis=1) <= 1) & (np.maximum(-apart, 0).sum(axis=1) <= downs[a]))
        assert all((a, b) in seen for b in near)
    assert len(seen) < 600 * 600 / 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_the_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.op13_spelling_variants(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()}
    assert got == grouped(counted(docs)) and len(got) > 100

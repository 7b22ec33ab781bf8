"""The registered queries themselves on the smallest tables: against SQL, the library, or brute force."""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus import FOLD, SPACED
from test_joins import cut_all
from test_models import judged_by_rules

from trajecta.llm import arrowtext, quality, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.sql("select doc_id, text from documents").fetchall())


def rows(spark, name, key="doc_id"):
    got = queries.QUERIES[name](spark, FOLDER).collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, db, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = db.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_op1_counts_as_the_library(spark, texts):
    for i, r in rows(spark, "op1_token_counts").items():
        n = len(LIBRARY.encode(texts[i] or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[i] or "").encode()), n, n > 4096)


def test_op2_ranks_as_a_plain_gradient_over_all_pairs(spark, db, texts):
    got = rows(spark, "op2_quality_classifier")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    labels = {i: q for i, q in db.sql("select doc_id, quality from labels where quality is not null").fetchall() if i in texts}
    ids = list(texts)
    raw, at = arrowtext.buffers(arrowtext.pa.array([texts[i] for i in ids], arrowtext.pa.string()))
    x = quality._measured(raw, at)
    learn = [k for k, i in enumerate(ids) if i in labels and not got[i]["held_out"]]
    z = (x - x[learn].mean(axis=0)) / np.maximum(x[learn].std(axis=0), 1e-9)
    good, bad = ([k for k in learn if labels[ids[k]] == y] for y in (1, 0))
    d = (z[good][:, None] - z[bad][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        w += 0.5 * ((d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(axis=0) - 1e-3 * w)
    order = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(order(z @ w), order([got[i]["score"] for i in ids]))[0, 1] > 0.9
    held = [i for i in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.9


def test_op4_encodes_as_the_library(spark, texts):
    for i, r in rows(spark, "op4_sentencepiece").items():
        ids = LIBRARY.encode(texts[i] or "") + [LIBRARY.eos_id()]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_op5_cuts_as_brute_force(spark, texts):
    got = rows(spark, "op5_substring_dedup")
    assert {i: r["n_removed"] for i, r in got.items()} == cut_all(sorted(texts.items()))
    assert all(r["text"] == texts[i] for i, r in got.items() if not r["n_removed"])


def test_op7_gives_a_row_a_page(spark, db):
    got = rows(spark, "op7_html_extraction", "page_id")
    assert {i: r["url"] for i, r in got.items()} == dict(db.sql("select page_id, url from pages").fetchall())
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"].replace("< ", "") for r in got.values())


def test_op9_by_the_given_rules(spark, db):
    pages = dict(db.sql("select page_id, url from pages").fetchall())
    for i, r in rows(spark, "op9_url_filters", "page_id").items():
        host, path, rule, verdict = judged_by_rules(pages[i])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict if rule or not r["mined"] else "block")


def test_op10_counts_and_scores(spark, texts):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*SPACED.findall((t or "").translate(FOLD)), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    total = sum(c.values())
    got = rows(spark, "op10_lm_scoring")
    for i, r in got.items():
        ws = tokens[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ws), sum(c[w] > 0 for w in ws), total)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws)) < 1e-6
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])

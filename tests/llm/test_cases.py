"""Null ids, repeated rows, clashing and dotted names, very long and empty texts, ties and empty tables, through each operator."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from corpus import prose

import corpus_pipeline
from trajecta.llm import lm, pages, partenum, pieces, quality, rules, spans, urls, winnow

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
R = random.Random(21)
LONG = prose(R, 260_000)  # over 1 MB
ROWS = [(1, "Some words. And more words here."), (1, "Some words. And more words here."), (None, "no id"), (None, None), (2, ""), (3, None), (4, "a"), (5, "  \n\t ")]
COLUMNS = "doc_id long, text string, lang string, score double, `a.b` string, n_chars int, n_words string, kept string, k0 string, __text string, n_tokens string, h string, u string"


def table(spark, more=()):
    return spark.createDataFrame([(i, t, "en", 0.5, "dot", 77, "w", "k", "k0", "t", "n", "h", "u") for i, t in [*ROWS, *more]], COLUMNS)


EXTRA = ("doc_id", "a.b", "n_chars", "n_words", "kept", "k0", "__text", "n_tokens", "h", "u", "score")
LABELS = "doc_id long, quality int"
RUNS = {
    "count_tokens": lambda d, s: pieces.count_tokens(d, PATH),
    "ranked": lambda d, s: quality.ranked(d, s.createDataFrame([(1, 1), (4, 0), (None, 1)], LABELS), quality.F.lit(True), keep=EXTRA),
    "encode_decode": lambda d, s: pieces.encode_decode(d, PATH, keep=EXTRA, digests=True),
    "repeated_spans": lambda d, s: spans.repeated_spans(d, keep=EXTRA, closed=True),
    "quality_rules": lambda d, s: rules.quality_rules(d, keep=EXTRA),
    "score": lambda d, s: lm.score(d, lm.remainder(lm.F.col("doc_id"), 7) != 2, keep=EXTRA),
    "contamination": lambda d, s: winnow.contamination(d, s.createDataFrame([(1, "some words and more"), (None, "no id")], "item_id long, text string")),
    "jaccard": lambda d, s: partenum.jaccard_components(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, name):
    got = RUNS[name](table(spark), spark)
    rows = got.collect()
    assert len(rows) == len(ROWS) and len(set(got.columns)) == len(got.columns)
    ones = [r for r in rows if r["doc_id"] == 1]
    assert len(ones) == 2 and ones[0] == ones[1]
    assert sum(r["doc_id"] is None for r in rows) == 2
    if "a.b" in got.columns:
        assert {(r["a.b"], r["k0"]) for r in rows} == {("dot", "k0")}
    if name == "quality_rules":
        assert {r["n_chars"] for r in rows} == {77} and all(r["kept"] is False for r in rows)
    if name == "contamination":  # the item without an id is hit but not listed
        assert [(r["n_hit"], list(r["items"])) for r in rows if r["n_words"] == 2] == [(2, [])]
        assert [(r["n_hit"], list(r["items"])) for r in ones] == [(4, ["1"])] * 2
    assert RUNS[name](table(spark).limit(0), spark).count() == 0


def test_texts_beyond_a_block(spark):
    df = table(spark, [(9, LONG), (10, LONG + " end")])
    ids = LIBRARY.encode(LONG)
    assert {r["doc_id"]: r["n_tokens"] for r in pieces.count_tokens(df, PATH).collect()}[9] == len(ids)
    got = {r["doc_id"]: r for r in pieces.encode_decode(df, PATH).collect()}
    assert list(got[9]["ids"]) == [*ids, LIBRARY.eos_id()] and got[9]["decoded"] == LIBRARY.decode(ids)
    linked = {r["doc_id"]: r["component_id"] for r in partenum.jaccard_components(df).collect()}
    assert linked[10] == 9
    cut = {r["doc_id"]: r for r in spans.repeated_spans(df, closed=True).collect()}
    assert cut[9]["text"] == LONG and len(cut[10]["text"]) < 1000
    item = " ".join(LONG.split()[1000:1040])
    hit = {r["doc_id"]: r for r in winnow.contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hit[9]["n_hit"] >= 38 and list(hit[10]["items"]) == ["1"]


def test_equal_scores_stand_together(spark):
    """Documents of one text have one score, on whichever side of the threshold."""
    docs = spark.createDataFrame([(i, "same words in every row") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)], LABELS)
    got = quality.ranked(docs, labels, quality.F.lit(True)).collect()
    assert len({(r["score"], r["predicted"]) for r in got}) == 1


def test_odd_pages(spark):
    page = "<html><body><article><p>One two.</p></article></body></html>"
    data = [(1, "http://a.org/x", page), (1, "http://a.org/x", page), (None, None, page), (2, None, None), (3, "", "")]
    df = spark.createDataFrame([(*r, "t", 5, "k") for r in data], "page_id long, url string, html string, text string, n_chars int, `a.b` string")
    got = pages.main_text(df, keep=("page_id", "url", "text", "a.b")).collect()
    assert len(got) == 5 and sorted(r["text"] for r in got) == ["", "", "One two.", "One two.", "One two."] and {r["a.b"] for r in got} == {"k"}
    judged = urls.judged(df, spark.createDataFrame([(1, True), (None, True)], "page_id long, block boolean"), [("block", "org/")]).collect()
    assert len(judged) == 5 and sorted(r["verdict"] for r in judged) == ["allow"] * 3 + ["block"] * 2


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    d = f"{tmp_path}/sf"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0

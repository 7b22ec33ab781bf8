from __future__ import annotations

import random

import public_tokenizers
import sentencepiece
from corpus import prose, word
from test_joins import components, cut, hits

import corpus_pipeline

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def corpus():
    r = random.Random(12)
    items = [(k, prose(r, 40)) for k in range(3)]
    passage = prose(r, 70) + "end. "
    docs, labels = [], []
    for i in range(120):
        bad = i % 6 == 0
        t = " ".join(word(r).upper() + "!!" for _ in range(60)) if bad else prose(r, r.randrange(40, 150))
        if not bad and i % 10 == 1:
            t += passage + prose(r, 20)
        if not bad and i % 10 == 3:
            t += items[i % 3][1] + prose(r, 5)
        docs.append((i, t))
        if i % 3 != 2:
            labels.append((i, int(not bad), 0))
    for i in range(120, 160):
        w = docs[r.choice([2, 4, 5, 7, 8])][1].split(" ")
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = word(r)
        docs.append((i, " ".join(w)))
    return docs, labels, items


def test_each_stage_and_the_run(spark, tmp_path):
    docs, labels, items = corpus()
    d = f"{tmp_path}/sf"
    rows = [(i, t, "en", "s", len(t), 1.5, "k") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    held = dict(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, d).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == columns
        before = sorted(held.items())
        if k == 0:
            held = {i: t for i, t in before if "!!" not in t}
        elif k == 1:
            found = components(before, 80, 5)
            held = {i: t for i, t in before if found[i][1] == i}
        elif k == 2:
            held = {i: x[0] for i, x in cut(before, closed=True).items()}
        else:
            held = {i: held[i] for i, n, hit, _ in hits(before, items) if not (hit and 20 * hit >= n)}
        got = now.collect()
        assert {r["doc_id"]: r["text"] for r in got} == held
        assert all(r["n_chars"] == len(r["text"]) and r["score"] == 1.5 and r["n_removed"] == "k" for r in got)
    final = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert final == {i: LIBRARY.encode(t) + [LIBRARY.eos_id()] for i, t in held.items()}
    assert len(held) < 110

from __future__ import annotations

import random

import pytest
from corpus import FOLD, PLAIN, SPACED, documents, prose

from trajecta.llm import partenum, spans, winnow

DOCS = documents()


def components(docs, percent=90, size=3):
    sets = {}
    for i, t in docs:
        w = SPACED.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_components(spark, percent):
    got = partenum.jaccard_components(spark.createDataFrame(DOCS, "doc_id long, text string"), percent=percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(DOCS, percent)


def test_a_large_near_group(spark):
    r = random.Random(9)
    base = prose(r, 150).split(" ")
    docs = []
    for i in range(250):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = "x%d" % r.randrange(1000)
        docs.append((i, " ".join(w)))
    got = partenum.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(docs)


def test_jaccard_odd_rows(spark):
    empty = partenum.jaccard_components(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, None), (3, "q r s t u")]
    got = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] == 2 and r["doc_id"]) == [(1, 1), (1, 1)]
    assert [r["component_id"] for r in got if r["n_shingles"] == 2 and r["doc_id"] is None] == [1]


def hits(docs, items):
    found = {}
    for item, t in items:
        w = PLAIN.findall((t or "").translate(FOLD))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault((n, tuple(w[k : k + n])), set()).add(str(item))
    out = []
    for i, t in docs:
        w = PLAIN.findall((t or "").translate(FOLD))
        hit, which = set(), set()
        for n in {k[0] for k in found}:
            for k in range(len(w) - n + 1):
                got = found.get((n, tuple(w[k : k + n])))
                if got:
                    which |= got
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(which)))
    return out


def test_contamination(spark):
    r = random.Random(4)
    items = [(k, prose(r, n)) for k, n in enumerate([40, 13, 14, 12, 5, 1, 30, 30])] + [(90, None), (91, ""), (92, "...")]
    items.append((93, items[0][1]))
    docs = list(DOCS)
    for k, (_, t) in enumerate(items[:8]):
        docs.append((500 + k, prose(r, 30) + t.upper() + " " + prose(r, 20)))
        docs.append((600 + k, prose(r, 9) + " ".join(t.split(" ")[3:20]) + " " + prose(r, 9)))
    docs += [docs[-1], (None, items[0][1])]
    got = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()), key=key) == sorted(hits(docs, items), key=key)


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c")]), ([(1, "a b c")], []), ([], [])])
def test_contamination_of_empty_tables(spark, docs, items):
    got = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r["n_words"], r["n_hit"]) for r in got.collect()] == [(3, 0)] * len(docs)


def cut(docs, sentences=2, least=20, closed=False, long=50):
    """Texts less repeated runs: the shortest that start at each sentence, or where closed all runs and single long sentences."""
    first, parsed = {}, []
    for d, t in sorted(docs):
        t = t or ""
        words = [(m.start(), m.end(), m.group().translate(FOLD)) for m in SPACED.finditer(t)]
        split, now = [], []
        for k, (_, b, w) in enumerate(words):
            now.append(k)
            if w[-1] in ".!?" or k + 1 == len(words) or "\n" in t[b : words[k + 1][0]]:
                split.append(now)
                now = []
        found = []
        for i in range(len(split)):
            n = 0
            for j in range(i, len(split)):
                n += len(split[j])
                if closed and n >= (long if i == j else least):
                    found.append((i, j, tuple(tuple(words[k][2] for k in s) for s in split[i : j + 1])))
                elif not closed and n >= least and j - i + 1 >= sentences:
                    found.append((i, j, tuple(tuple(words[k][2] for k in s) for s in split[i : j + 1])))
                    break
        for i, _, h in found:
            first.setdefault(h, (d, i))
        parsed.append((d, t, words, split, found))
    out = {}
    for d, t, words, split, found in parsed:
        gone = {s for i, j, h in found if first[h] != (d, i) for s in range(i, j + 1)}
        starts = [words[s[0]][0] for s in split] + [len(t)]
        text, pos = "", 0
        for s in sorted(gone):
            text += t[pos : starts[s]]
            pos = starts[s + 1]
        out[d] = (text + t[pos:], len(split), len(gone))
    return out


def test_repeated_spans(spark):
    got = spans.repeated_spans(spark.createDataFrame(DOCS, "doc_id long, text string"))
    expected = cut(DOCS)
    rows = got.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r["text"] or "", r["n_sentences"], r["n_removed"]) == expected[r["doc_id"]]
    assert next(r for r in rows if r["doc_id"] == dict((t, i) for i, t in DOCS)[None])["text"] is None
    assert sum(r["n_removed"] > 0 for r in rows) >= 9


def cut_all(docs, least=20, long=50):
    """Sentences gone when all runs of two sentences and 20 words, whatever their length, and all single sentences of 50 words count."""
    first, parsed = {}, []
    for d, t in sorted(docs):
        words = SPACED.findall(t.translate(FOLD))
        split, now = [], []
        for w in words:
            now.append(w)
            if w[-1] in ".!?":
                split.append(tuple(now))
                now = []
        split += [tuple(now)] if now else []
        found = [(i, j, tuple(split[i : j + 1])) for i in range(len(split)) for j in range(i, len(split)) if sum(map(len, split[i : j + 1])) >= (long if i == j else least)]
        for i, _, h in found:
            first.setdefault(h, (d, i))
        parsed.append((d, found))
    return {d: len({s for i, j, h in found if first[h] != (d, i) for s in range(i, j + 1)}) for d, found in parsed}


def test_spans_cover_all_runs(spark):
    r = random.Random(3)
    sentence = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + ". "
    pool = [sentence(r.choice([1, 3, 5, 8, 12, 18, 25, 49, 50, 60])) for _ in range(60)]
    docs = [(1, "".join(pool[:20])), (2, sentence(30) + "".join(pool[2:9]) + sentence(9)), (3, sentence(4) + sentence(50) + sentence(3))]
    long = sentence(55)
    docs += [(4, sentence(5) + long + sentence(5)), (5, sentence(6) + long + sentence(6))]
    for i in range(6, 60):
        a = r.randrange(50)
        docs.append((i, sentence(r.randrange(1, 30)) + "".join(pool[a : a + r.randrange(1, 9)]) + sentence(r.randrange(1, 30)) + pool[r.randrange(60)]))
    got = {x["doc_id"]: x["n_removed"] for x in spans.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), closed=True).collect()}
    assert got == cut_all(docs)
    old = {x["doc_id"]: x["n_removed"] for x in spans.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), closed=False).collect()}
    assert sum(got.values()) > sum(old.values()) and got[5] == 1


def test_spans_keep_columns_and_repeats(spark):
    t = "One two three four five six seven. Eight nine ten eleven twelve thirteen. More words here to reach twenty of them. "
    df = spark.createDataFrame([(1, t, "a", 5), (1, t, "a", 5), (2, t, "b", 6), (None, None, "c", 7)], "doc_id long, text string, i string, h int")
    got = spans.repeated_spans(df, keep=("doc_id", "text", "i", "h"))
    assert got.columns == ["doc_id", "i", "h", "text", "n_sentences", "n_removed", "n_removed_words"]
    assert sorted((r["i"], r["n_removed"]) for r in got.collect()) == [("a", 0), ("a", 0), ("b", 3), ("c", 0)]
    assert spans.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_of_one_word(spark):
    """Every place of the text meets every place of the item; and a text of two words in turn, which meets at every second one."""
    docs = spark.createDataFrame([(1, "a " * 20_000), (2, "a b " * 5_000 + "c"), (3, "a " * 12)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a " * 60), (8, "b a " * 10)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in winnow.contamination(docs, items).collect()}
    assert got == {1: (20_000, 20_000, ["7"]), 2: (10_001, 10_000, ["8"]), 3: (12, 0, [])}

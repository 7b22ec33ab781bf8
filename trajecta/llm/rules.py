"""Quality rules: base counts, and Jensen-Shannon distance to language references. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.scratch import Scratch, plain

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Character classes; letters in lower case and all that is left are the last class.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "point": r"[.,;:?]", "shout": "!"}
#: Common words of each language that has a reference for them.
COMMON = {
    "en": "the of and to in is that for it as with was on be at by",
    "de": "der die das und in zu den von ist mit im auf für nicht sich des",
    "fr": "de la le les et en un une du des que qui dans pour sur au",
    "es": "de la que el en y a los del se las por un para con no",
}
#: Fewest documents behind a language's reference.
MIN_DOCS = 30
#: Fewest characters for a verdict by characters, fewest words for one by common words, and the largest distances that pass.
MIN_CHARS, MIN_WORDS = 200, 150
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.24


def js_distance(p: str, q: str) -> Column:
    """Square root of the Jensen-Shannon divergence in bits (0 to 1) of two count arrays; null if one has no counts."""
    total = lambda a: f"aggregate({a}, 0D, (s, x) -> s + x)"
    half = f"""aggregate(zip_with({p}, {q}, (x, y) -> struct(x / nullif({total(p)}, 0D) as a, y / nullif({total(q)}, 0D) as b)), 0D, (s, e) -> s
        + if(e.a > 0, e.a * log2(2 * e.a / (e.a + e.b)), 0D) + if(e.b > 0, e.b * log2(2 * e.b / (e.a + e.b)), 0D))"""
    return F.expr(f"if({total(p)} > 0 and {total(q)} > 0, sqrt(greatest({half} / 2, 0D)), null)")


def measured(docs: DataFrame, keep: list[str], text: str, lang: str) -> DataFrame:
    """Base counts and histograms of each whole text; the columns `keep` are k0, k1, ..."""
    f = docs.select(*(plain(c).alias(f"k{i}") for i, c in enumerate(keep)), plain(lang).alias("__lang"), F.coalesce(plain(text), F.lit("")).alias("__t"))
    f = f.withColumn("ws", F.array_remove(F.split("__t", SPACES), ""))
    f = f.withColumn("n_words", F.size("ws").cast("long")).withColumn("word_chars", F.expr("aggregate(ws, 0L, (s, x) -> s + char_length(x))"))
    f = f.withColumn("n_symbols", F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"))
    f = f.withColumn("lines", F.expr(r"filter(split(__t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    f = f.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # runs of three words: sort by hash, take the places of those that stand beside an equal one, add up what they cover
    f = f.withColumn("g", F.expr("transform(ws, x -> xxhash64(x))"))
    f = f.withColumn("g", F.expr("transform(slice(g, 1, greatest(size(g) - 2, 0)), (x, i) -> struct(xxhash64(x, get(g, i + 1), get(g, i + 2)) as h, i as i))"))
    f = f.withColumn("g", F.sort_array("g"))
    f = f.withColumn("g", F.expr("filter(transform(g, (e, j) -> if(e.h = get(g, j - 1).h or e.h = get(g, j + 1).h, e.i, null)), x -> x is not null)"))
    f = f.withColumn("g", F.sort_array("g"))
    f = f.withColumn("n_repeat_words", F.expr("aggregate(transform(g, (x, j) -> coalesce(least(3, get(g, j + 1) - x), 3)), 0L, (s, x) -> s + x)")).drop("g")
    f = f.withColumn("n_chars", F.char_length("__t"))
    for name, pattern in CLASSES.items():
        f = f.withColumn(name, F.regexp_count("__t", F.lit(pattern)))
    counted = [F.col("n_symbols"), F.col("n_chars") - F.col("word_chars"), *(F.col(c) for c in CLASSES)]
    rest = F.greatest(F.col("n_chars") - reduce(lambda a, b: a + b, counted), F.lit(0))
    f = f.withColumn("chars", F.array(*(c.cast("double") for c in [*counted, rest]))).drop(*CLASSES)
    every = sorted({w for words in COMMON.values() for w in words.split()})
    f = f.withColumn("ws", F.filter(F.transform("ws", F.lower), lambda x: x.isin(every)))
    tally = F.lit(None).cast("array<double>")
    for name, words in COMMON.items():
        lists = F.transform(F.array(*map(F.lit, words.split())), lambda w: F.size(F.filter("ws", lambda x: x == w)).cast("double"))
        tally = F.when(F.col("__lang") == name, lists).otherwise(tally)
    f = f.withColumn("common", tally)
    f = f.withColumn("common", F.expr("concat(common, array(cast(n_words as double) - aggregate(common, 0D, (s, x) -> s + x)))"))
    return f.drop("ws", "__t")


def quality_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns `keep` with base counts, base_failed, the distances to the language's references, and kept.

    References are the sums of the character classes and common words of all documents of a language in the table that
    pass the base; a language with fewer than MIN_DOCS of them has none. A document fails if its character distance exceeds MAX_CHAR_DISTANCE or its word distance MAX_WORD_DISTANCE; under
    MIN_CHARS characters or MIN_WORDS words, or without a reference, the guard holds and that distance is no ground.
    Null and empty texts have no words and so fail the base; a null language is a language of its own; each row has
    its own result, so repeated rows have equal ones; a kept column with the name of a result gives way to it. The one shuffle is of sums by language.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = tuple(c for c in keep if c not in {*counts, "base_failed", "kept", "char_distance", "word_distance"})
    f = scratch.table(measured(docs, list(keep), text, lang))
    sizes = {"chars": len(CLASSES) + 3, "common": max(len(w.split()) for w in COMMON.values()) + 1}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    reference = f.where(~failed).groupBy("__lang").agg(*sums, F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS).select(F.col("__lang").alias("of"), *(F.array(*(F.coalesce(f"{c}{i}", F.lit(0.0)) for i in range(n))).alias(f"all_{c}") for c, n in sizes.items()))
    f = f.join(reference, F.col("__lang").eqNullSafe(F.col("of")), "left")
    f = f.withColumn("char_distance", js_distance("chars", "all_chars")).withColumn("word_distance", js_distance("common", "all_common"))
    odd = ((F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return f.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *counts, failed.alias("base_failed"), (~failed & ~F.coalesce(odd, F.lit(False))).alias("kept"), "char_distance", "word_distance")

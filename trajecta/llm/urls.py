"""URL filters: given rules first, then association rules mined by FP-growth. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.scratch import Scratch, plain
from trajecta.llm.winnow import folded

#: Least share of the labelled rows that have a rule's tokens and its outcome; least share of those with the tokens that have the outcome.
SUPPORT, CONFIDENCE = 0.005, 0.8
#: Least number of labelled rows behind a rule, in small tables.
ROWS = 8
#: About so many labelled rows are mined, drawn by hash where there are more.
LABELLED = 50_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BLOCKED = "=block"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z as a-z; empty for null and where there is no ://."""
    return folded(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host suffixes, words of the host, path segments (digits as 0), file ending, keys of the query, fragment."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -i, i), ".")))
    suffixes = F.filter(suffixes, lambda x: x != "host:")
    words = F.transform(F.filter(F.split(host(url), r"[.\-_0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x))
    segments = F.filter(F.split(folded(path(url)), "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    keys = F.transform(query, lambda x: F.concat(F.lit("key:"), x))
    return F.array_distinct(F.concat(suffixes, words, segments, keys))


def ruled(rules: Sequence[tuple[str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest rule (action, host/path) whose host is the url's or above it and whose path begins the url's; nulls if none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, begins = text.partition("/")
        fits = ((host_ == of) | host_.endswith("." + of)) & path_.startswith(slash + begins)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def _apart(labelled: DataFrame, pages: DataFrame) -> DataFrame:
    """`labelled` (r, tokens, block) with one token of those that occur in the very same rows: the one that most `pages` (tokens) have, the least in order among equals.

    Tokens that always come together would otherwise make 2^n sets of n of them, all of the same rows.
    """
    tall = labelled.select("r", F.explode("tokens").alias("token"))
    frequency = pages.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("pages"))
    where = tall.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("r")).alias("x"), F.bit_xor(F.xxhash64("r", F.lit(1))).alias("y"))
    first = where.join(frequency, "token").groupBy("n", "x", "y").agg(F.min_by("token", F.struct(-F.col("pages"), F.col("token"))).alias("token"))
    few = tall.join(first.select("token"), "token").groupBy("r").agg(F.collect_set("token").alias("tokens"))
    return labelled.drop("tokens").join(few, "r")


def mined(labelled: DataFrame, pages: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, key, confidence): token sets that imply a block, without those that contain a smaller one.

    labelled: (tokens, block); pages: (tokens) of all pages. Empty tables and tables of one kind of label give no rules. Of tokens
    that occur in the same labelled rows one stands for all.
    """
    scratch = Scratch(labelled.sparkSession, "urls")
    labelled = scratch.table(labelled.where("size(tokens) > 0 and block is not null").withColumn("r", F.monotonically_increasing_id()))
    support = min(1.0, max(support, ROWS / max(labelled.count(), 1)))
    labelled = scratch.table(_apart(labelled, pages))
    items = labelled.select(F.when(F.col("block"), F.array_append("tokens", BLOCKED)).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCKED))).select(F.array_sort("antecedent").alias("tokens"), "confidence")
    rules = scratch.table(rules.withColumn("rule_id", F.xxhash64("tokens")))
    smaller = rules.select(F.col("tokens").alias("few"), F.element_at("tokens", 1).alias("token"))
    larger = rules.select("rule_id", "tokens", F.explode("tokens").alias("token"))
    redundant = larger.join(smaller, "token").where("size(few) < size(tokens) and size(array_except(few, tokens)) = 0").select("rule_id").distinct()
    kept = rules.join(redundant, "rule_id", "left_anti")
    counts = labelled.select(F.explode("tokens").alias("key")).groupBy("key").count()
    rarest = kept.select("rule_id", F.explode("tokens").alias("key")).join(counts, "key").groupBy("rule_id").agg(F.min_by("key", F.struct("count", "key")).alias("key"))
    return scratch.table(kept.join(rarest, "rule_id"))


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url", labelled: int = LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every page.

    labels: (page_id, block boolean). A given rule that fits decides; else a page is blocked if it has all tokens of a
    mined rule (`mined` lists them), found by an inverted index from each rule's rarest token, and allowed otherwise.
    Null urls and urls without :// have an empty host and path, no rule and no tokens but those of a query; null labels
    are not mined; repeated rows have equal results; with no labels everything without a rule is allowed.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "judged")
    f = pages.select(plain(page_id).alias("id"), plain(url).alias("u"))
    f = scratch.table(f.select("id", "u", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"), tokens(F.col("u")).alias("tokens")))
    known = labels.select(plain(page_id).alias("id"), "block").where("block is not null")
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(1_000_003 * min(1.0, labelled / max(n, 1))))
    learned = scratch.table(f.select("id", "tokens").join(known, "id").select("tokens", "block"))
    index = mined(learned, f.select("tokens"))
    asked = f.where("size(tokens) > 0").select("tokens").distinct().withColumn("set", F.xxhash64("tokens"))
    asked = asked.select("set", "tokens", F.explode("tokens").alias("key"))
    met = asked.join(index.select("key", "rule_id", F.col("tokens").alias("needs")), "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    met = scratch.table(met.groupBy("set").agg(F.sort_array(F.collect_set("rule_id")).alias("mined")))
    f = f.withColumn("set", F.xxhash64("tokens")).join(met, "set", "left")
    rule, action = ruled(rules, F.col("host"), F.col("path"))
    verdict = F.coalesce(action, F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return f.select(F.col("id").alias(page_id), "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.coalesce("mined", F.array().cast("array<bigint>")).alias("mined"))

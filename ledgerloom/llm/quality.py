"""Quality rules: base counts of a text, and a length-normalised log-likelihood ratio of hashed n-grams.

Texts are cut into runs of letters, digits and underscores and runs of other signs, lowered; unigrams and bigrams of
them are hashed into ``BUCKETS``. The trusted multinomial is estimated on labelled documents of quality 1 that are not
toxic, at most ``TRUSTED`` of them chosen by hash; the raw one on all documents. A document is kept if it passes the
base rules and the mean of ``log p_trusted - log p_raw`` over its n-grams is at least ``THRESHOLD``. Nothing is drawn
at random, so a document's verdict is the same wherever it stands.

Only DataFrame functions run. Null or empty text: no words, base rules failed, ratio 0. A repeated doc_id in the labels
is trusted if any of its rows is. Without trusted documents the ratio is 0. Repeated rows: a row each. Empty table: no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.operators.select import with_once

#: Hash buckets, trusted documents at most, added count of a bucket, least mean ratio, words that count as repeated.
BUCKETS, TRUSTED, SMOOTHING, THRESHOLD, WINDOW = 8192, 16_384, 1.0, -0.35, 8
#: Base rules: least number of words, most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 20, 30

SPACE = r"[\x20\x09-\x0D]+"
PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def base_counts(docs: DataFrame, *carried: str) -> DataFrame:
    """``carried``, text, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row.

    Hashes of all windows are sorted with their places; equal neighbours mark places. In order of place a marked window
    adds the words that the marked one before it does not cover. Most texts repeat no window and are not sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(*carried, "text", F.array_remove(F.split(text, SPACE), "").alias("w"), lines.alias("l"))
    rows = rows.select(
        *carried, "text", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    counts = rows.columns[:-1]
    for width in (1, 2, 4):  # hashes of one word, then of two, four and eight
        left = F.greatest(F.size("h") - width, F.lit(0))
        pairs = F.zip_with(F.slice("h", F.lit(1), left), F.slice("h", F.lit(width + 1), left), lambda x, y: F.xxhash64(x, y))
        rows = rows.select(*counts, pairs.alias("h"))
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed)).drop("h")
    twice = "(k > 0 and s[k - 1].h = e.h) or (k < size(s) - 1 and s[k + 1].h = e.h)"
    repeated = F.expr(
        f"aggregate(sort_array(filter(transform(s, (e, k) -> if({twice}, e.i, null)), i -> i is not null)), "
        f"named_struct('last', -{WINDOW}, 'n', 0L), "
        f"(acc, i) -> named_struct('last', i, 'n', acc.n + least({WINDOW}, i - acc.last)), acc -> acc.n)"
    )
    # a filter on the counts must not be pushed below and compute them anew for every element
    return with_once(rows, "n_repeat_words", F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(repeated)).drop("s")


def pieces(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``p``, the pieces of the text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(PIECES), F.lit(0))
    return docs.select(*columns, found.alias("p"))


def grams(value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For every piece ``join`` of ``value`` of its unigram's and its bigram's bucket; the last piece is paired with the end."""

    def bucket(*parts: Column) -> Column:
        return value(F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int"))

    following = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    return F.zip_with("p", following, lambda x, y: join(bucket(x), bucket(x, y)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """At most ``TRUSTED`` ids of good labelled documents: the smallest of each hash bucket."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id"))
    bucket = F.pmod(F.xxhash64("trusted_id"), F.lit(TRUSTED))
    return good.groupBy(bucket.alias("bucket")).agg(F.min("trusted_id").alias("trusted_id")).select("trusted_id")


def fit(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Log ratio of every bucket; the driver gets one row per bucket."""
    # at most TRUSTED ids, so the broadcast has a bound
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(trusted_ids(labels)), F.col("doc_id") == F.col("trusted_id"), "left"
    ).withColumn("good", F.col("trusted_id").isNotNull().cast("int"))
    buckets = pieces(marked, "good").select("good", F.flatten(grams(lambda b: b, F.array)).alias("b"))
    # explode would bring a filter on the array's size, which is pushed down and cuts every text again
    counted = buckets.select("good", F.explode_outer("b").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("raw"), F.sum("good").alias("good")
    )
    rows = counted.collect()  # at most BUCKETS rows, and one of empty texts
    raw, good = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for row in (r for r in rows if r["bucket"] is not None):
        raw[row["bucket"]] += row["raw"]
        good[row["bucket"]] += row["good"]
    if sum(good) == SMOOTHING * BUCKETS:
        return [0.0] * BUCKETS
    all_good, all_raw = sum(good), sum(raw)
    return [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw)]


def scored(docs: DataFrame, ratios: list[float], *columns: str) -> DataFrame:
    """``columns`` and ``ratio``, the mean log ratio of a text's n-grams."""
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    each = grams(lambda b: F.get(weights, b), lambda one, two: one + two)
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
    ratio = F.when(F.size("p") > 0, total / (2 * F.size("p"))).otherwise(0.0)
    return with_once(pieces(docs, *columns), "ratio", ratio).drop("p")


def judge(docs: DataFrame, ratios: list[float], *carried: str) -> DataFrame:
    """``carried`` columns (doc_id if none), base counts, ``base_failed``, ``ratio`` and ``kept`` of every row."""
    carried = carried or ("doc_id",)
    counted = base_counts(docs.withColumn("text", F.col("text").cast("string")).select(*carried, "text"), *carried)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored(counted, ratios, *(c for c in counted.columns if c != "text")).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.round("ratio", 9) >= THRESHOLD)
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    whole = docs.select(F.struct("*").alias("whole"), "text")
    return judge(whole, fit(docs, labels), "whole").where("kept").select("whole.*")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"
    )


QUERIES: dict[str, tuple[Callable, str | None]] = {"op2_quality": (op2_quality, None)}

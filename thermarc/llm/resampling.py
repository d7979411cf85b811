"""Importance resampling towards a target distribution of hashed words and word pairs.

A document's features are its words and its pairs of neighbouring words, each hashed to one of BUCKETS buckets by higher-order functions: no
row is multiplied for scoring. A bucket's gain is the logarithm of its share in the target over its share in the documents; a
document's weight is the mean gain of its features. Of the documents that are long enough, those with the highest weights plus Gumbel
noise, drawn from their ids, are a sample without replacement in proportion to the exponential of their weights.

Only bucket totals are shuffled, BUCKETS rows a task, and ids with scores for the ranks. The gains are one array of BUCKETS numbers, a literal in the plan.

Defined results: null and empty texts, and those without words, have no features and weight 0. Null ids draw their noise from the empty id, and are smaller
than any other id in ties. Repeated rows are counted and drawn one by one. Texts are taken whole, whatever their length. Of an empty target all totals are 0. An
empty table gives an empty result. Other columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.cluster import stored
from thermarc.llm.ordering import running
from thermarc.llm.text import whole_text

BUCKETS = 10000
#: Gains and noise are thousandths of natural logarithms.
SCALE = 1000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def feature_words(text: Column) -> Column:
    """Runs of digits, letters and other characters than ASCII, A-Z in lower case."""
    parts = F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def buckets(words: Column) -> Column:
    """The bucket of each word and of each pair of neighbours, repeats too."""
    n = F.size(words)
    left, right = F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.concat(F.transform(words, bucket), F.zip_with(left, right, lambda a, b: bucket(F.concat(a, F.lit(" "), b))))


def bucketed(rows: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The kept columns, n_words and the array of buckets."""
    words = rows.select(*keep, feature_words(whole_text(text)).alias("_words"))
    return words.select(*[c for c in words.columns if c != "_words"], F.size("_words").alias("n_words"), buckets(F.col("_words")).alias("_buckets"))


def totals(rows: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): occurrences of each bucket's features. Counted within tasks first.

    explode_outer, as Spark has a filter on the array's size run below explode, where the whole expression is evaluated again for each part of it."""
    return bucketed(rows, text).select(F.explode_outer("_buckets").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(target: DataFrame, source: DataFrame) -> list[int]:
    """The gain of each bucket, from two tables of totals; BUCKETS numbers, whatever the input."""
    t, s = target.withColumnRenamed("n", "t"), source.withColumnRenamed("n", "s")
    both = target.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(t, "bucket", "left").join(s, "bucket", "left").fillna(0, ["t", "s"])
    both = stored(both, "totals")
    all_t, all_s = both.agg(F.sum("t"), F.sum("s")).first()
    share = ((F.col("t") + 1).cast("double") * F.lit(float(all_s + BUCKETS))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + BUCKETS)))
    return [r["gain"] for r in both.orderBy("bucket").select(F.floor(SCALE * F.log(share)).alias("gain")).collect()]


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise from the id, in units of 1 / SCALE, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-SCALE * F.log(-F.log(u)))


def scored(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    rows = bucketed(docs, text, F.col(key).alias("doc_id"))
    total = F.aggregate("_buckets", F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("_buckets").cast("long").alias("n_features"), total.alias("_total"))
    weight = F.expr("(_total - pmod(_total, greatest(n_features, 1))) div greatest(n_features, 1)")
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"))).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank: from 1 for the drawn documents, null for the others."""
    gain = gains(totals(target), totals(docs, text))
    rows = stored(scored(docs, gain, key, text).withColumn("_long", F.col("n_words") >= min_words), "scores")
    drawn = rows.where("_long").count() * percent // 100
    placed = running(rows, ["_long"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")], _before=F.lit(1).cast("long"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_long") & (F.col("_before") < drawn), F.col("_before") + 1).alias("rank"))

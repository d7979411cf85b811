"""Chronological splits as a column, folds, seasonal coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermarc.errors import SplitError
from thermarc.operators.windows import numbered


def by_dates(df: DataFrame, ts: str, train_end: str, validation_end: str) -> DataFrame:
    """Adds `partition`: before the first date, before the second, from it on; null without a timestamp."""
    if train_end >= validation_end:
        raise SplitError("dates out of order", train_end=train_end, validation_end=validation_end)
    t = F.col(ts)
    return df.withColumn("partition", F.when(t < F.lit(train_end).cast("date"), "train").when(t < F.lit(validation_end).cast("date"), "validation").when(t.isNotNull(), "test"))


def by_fractions(df: DataFrame, ts: str, order: list[str], train: float = 0.7, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """Adds `partition` by place in the order (ts, *order): the first int(n * train) rows and so on. `order` must make the order total."""
    if abs(train + validation + test - 1) > 1e-9:
        raise SplitError("fractions must sum to 1", train=train, validation=validation, test=test)
    n = df.count()
    a, b = int(n * train), int(n * train) + int(n * validation)
    return numbered(df, ts, order).withColumn("partition", F.when(F.col("row_no") <= a, "train").when(F.col("row_no") <= b, "validation").otherwise("test")).drop("row_no")


def rolling_folds(df: DataFrame, ts: str, order: list[str], k: int) -> DataFrame:
    """(fold, part) rows: fold f trains on the first f blocks of n // (k + 1) rows and tests on the next; the last one takes the rest."""
    if k < 1:
        raise SplitError("at least one fold", k=k)
    n = df.count()
    block = n // (k + 1)
    if not block:
        raise SplitError("too few rows for the folds", rows=n, k=k)
    rows = numbered(df, ts, order).withColumn("_block", F.least(F.floor((F.col("row_no") - 1) / block), F.lit(k)))
    return rows.withColumn("fold", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_block")).cast("int"), F.lit(k)))).withColumn("part", F.when(F.col("_block") < F.col("fold"), "train").otherwise("test")).drop("_block", "row_no")


#: Months that a training span needs to see all seasons.
YEAR_MONTHS = 12


def coverage_warnings(df: DataFrame, ts: str, ambient: str | None = None) -> DataFrame:
    """(code, detail): a training span of under twelve months, months tested but not trained, and test values of the ambient condition beyond the trained ones. Each
    may look like degradation in the test part."""
    c = seasonal_coverage(df, ts)
    part = lambda p: F.when(F.col("partition") == p, F.col(ambient))
    found = [
        F.when(F.col("train_months") < YEAR_MONTHS, F.struct(F.lit("SHORT_TRAINING").alias("code"), F.col("train_months").cast("string").alias("detail"))),
        F.when(F.col("untrained") != "", F.struct(F.lit("UNTRAINED_MONTHS").alias("code"), F.col("untrained").alias("detail"))),
    ]
    if ambient:
        r = df.agg(*[F.round(f(part(p)), 3).alias(f"_{n}_{p}") for p in ("train", "test") for n, f in (("low", F.min), ("high", F.max))])
        c = c.crossJoin(r)  # one row with one row
        beyond = (F.col("_low_test") < F.col("_low_train")) | (F.col("_high_test") > F.col("_high_train"))
        span = F.concat_ws(" ", *[x for p in ("train", "test") for x in (F.lit(p), F.col(f"_low_{p}").cast("string"), F.lit("to"), F.col(f"_high_{p}").cast("string"))])
        found.append(F.when(beyond, F.struct(F.lit("AMBIENT_BEYOND_TRAINING").alias("code"), span.alias("detail"))))
    return c.select(F.inline(F.array_compact(F.array(*found))))


def seasonal_coverage(df: DataFrame, ts: str, ambient: str | None = None) -> DataFrame:
    """Months of the training span and calendar months of each part; months tested but not trained."""
    train, test = F.col("partition") == "train", F.col("partition") == "test"
    days = F.floor(F.timestamp_diff("SECOND", F.min(F.when(train, F.col(ts))), F.max(F.when(train, F.col(ts)))) / 86400)
    months = lambda part: F.array_sort(F.collect_set(F.when(part, F.month(ts))))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    one = df.agg(F.round(days / 30.4375, 3).alias("train_months"), months(train).alias("_a"), months(test).alias("_b"), *([F.round(F.min(F.when(train, F.col(ambient))), 4).alias("ambient_min"), F.round(F.max(F.when(train, F.col(ambient))), 4).alias("ambient_max")] if ambient else []))
    one = one.withColumn("_c", F.array_except("_b", "_a"))
    return one.select("train_months", *(["ambient_min", "ambient_max"] if ambient else []), text("_a").alias("train_calendar"), text("_b").alias("test_calendar"), text("_c").alias("untrained"), (F.col("train_months") < 12).alias("short_training"))

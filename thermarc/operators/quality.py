"""Validation rules, deduplication and cleaning. Each is one aggregation or window over the table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.errors import ConfigError, ConflictError
from thermarc.operators.windows import at_home, islands, long_rows, with_neighbours, with_previous


def null_profile(df: DataFrame, columns: list[str], warn_at: float = 0.5) -> DataFrame:
    """Null count and fraction of each column, and the finding's level."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__n_null") for c in columns], F.count("*").alias("_n"))
    one = one.select("*", *[(F.col(f"{c}__n_null") / F.col("_n")).alias(f"{c}__fraction") for c in columns])
    rows = long_rows(one, columns, {"n_null": "long", "fraction": "double"})
    return rows.withColumn("level", F.when(F.col("fraction") >= warn_at, "WARNING").otherwise("INFO"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """'empty' or 'constant' or 'varying' for each column; min = max tells a constant, no distinct count."""
    one = df.agg(*[x for c in columns for x in (F.count(c).alias(f"{c}__n"), (F.min(c) == F.max(c)).alias(f"{c}__same"))])
    kind = F.when(F.col("n") == 0, "empty").when(F.col("same"), "constant").otherwise("varying")
    return long_rows(one, columns, {"n": "long", "same": "boolean"}).select("column_name", F.col("n").alias("n_values"), kind.alias("kind"))


def out_of_range(bounds: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in bounds.items()}


def range_findings(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """How many values of each bounded column lie strictly outside."""
    one = df.agg(*[F.count_if(bad).alias(f"{c}__n_out") for c, bad in out_of_range(bounds).items()])
    return long_rows(one, list(bounds), {"n_out": "long"})


def deltas(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Adds `delta_s`, the seconds since the row before of the same key."""
    rows = with_previous(df, [key], [ts], [ts])
    return rows.withColumn("delta_s", F.timestamp_diff("SECOND", F.col(f"prev_{ts}"), F.col(ts))).drop(f"prev_{ts}")


def timestamp_gaps(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key: rows, excess duplicates, the modal interval (the smallest of several), gaps above it, the largest gap."""
    known = df.where(F.col(ts).isNotNull())
    steps = deltas(known.select(key, ts).distinct(), key, ts)
    modal = steps.groupBy(key).agg(F.mode("delta_s", True).alias("modal_s"))
    counts = known.groupBy(key).agg(F.count("*").alias("n_rows"))
    gaps = (
        steps.join(modal, key).groupBy(key, "modal_s")
        .agg(F.count("*").alias("_distinct"), F.count_if(F.col("delta_s") > F.col("modal_s")).alias("n_gaps"), F.max("delta_s").alias("largest_s"))
    )
    return counts.join(gaps, key).select(key, "n_rows", (F.col("n_rows") - F.col("_distinct")).alias("n_duplicates"), "modal_s", "n_gaps", "largest_s")


def sampling_histogram(df: DataFrame, key: str, ts: str) -> DataFrame:
    return deltas(df, key, ts).where(F.col("delta_s").isNotNull()).groupBy("delta_s").agg(F.count("*").alias("n"))


def dataset_report(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.array_join(F.array_sort(F.collect_set(key)), ",").alias("keys"))


def step_changes(df: DataFrame, key: str, ts: str, value: str, window: int = 144, magnitude: float = 5.0) -> DataFrame:
    """Level shifts: the median of the `window` values up to a row against that from it on; one row, the largest, for each run of candidates."""
    known = df.where(F.col(value).isNotNull()).select(key, ts, value)
    size = known.groupBy(F.struct(key).alias("_own")).agg(F.count("*").alias("_n"))
    rows, w = with_neighbours(known, [key], [ts], window - 1, window - 1, "idx")
    behind, ahead = w.rowsBetween(-(window - 1), 0), w.rowsBetween(0, window - 1)
    middle = lambda frame: F.when(F.count(value).over(frame) >= window // 2, F.percentile(value, 0.5).over(frame))
    rows = at_home(rows.withColumns({"before": middle(behind), "after": middle(ahead)}))
    rows = rows.withColumn("_own", F.struct(key)).join(size, "_own").drop("_own")
    hits = rows.where((F.col("_n") >= 2 * window) & (F.abs(F.col("after") - F.col("before")) > magnitude)).withColumn("delta", F.abs(F.col("after") - F.col("before")))
    runs = islands(hits, [key], [ts, "idx"], ["idx"], (F.col("idx") - F.col("prev_idx")) > window)
    best = F.max_by(F.struct(ts, "delta", "before", "after"), F.struct("delta", (-F.col("idx")).alias("_first")))
    runs = runs.groupBy(key, "island").agg(best.alias("_best"))
    return runs.select(key, f"_best.{ts}", *[F.round(f"_best.{c}", 4).alias(n) for c, n in (("delta", "magnitude"), ("before", "before"), ("after", "after"))])


#: Rows that a task of dedup_conflicts groups, whatever the table's size.
ROWS_A_TASK = 250_000


def dedup_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (without nulls) whose rows differ in content. Rows are counted first: they move once, by key and without the content, into as many tasks as they need."""
    rest = [c for c in df.columns if c not in keys]
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    rows = known.select(*keys, F.xxhash64(*rest).alias("_content")).repartition(-(-known.count() // ROWS_A_TASK) or 1, *keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("_content").alias("n_contents")).where("n_contents > 1")


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def check_conflicts(df: DataFrame, keys: list[str]) -> None:
    """Rows with one key and different contents are refused: to choose one would make up a record."""
    if clash := dedup_conflicts(df, keys).limit(5).collect():
        raise ConflictError("rows with one key have different contents", examples=[tuple(r[k] for k in keys) for r in clash])


def deduplicate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """dedup_keep_first, after a check that rows with one key agree."""
    check_conflicts(df.drop(*[c for c in order if c not in keys]), keys)
    return dedup_keep_first(df, keys, order)


#: Cleaning steps: name -> (reason, keep condition over a settings dict).
CLEANING: dict[str, tuple[str, Callable[[dict], Column]]] = {
    "drop_unparseable_timestamps": ("no timestamp", lambda s: F.col(s["timestamp"]).isNotNull()),
    "drop_missing_all_targets": ("no target has a value", lambda s: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in s["targets"]])),
    "drop_missing_any_target": ("a target has no value", lambda s: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in s["targets"]])),
    "drop_missing_any_predictor": ("a predictor has no value", lambda s: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in s["predictors"]])),
}
NULLIFY = "nullify_impossible_predictor_values"


def nullify_impossible(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(~F.coalesce(bad, F.lit(False)), F.col(c)) for c, bad in out_of_range(bounds).items()})


def clean(df: DataFrame, steps: list[str], settings: dict) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all steps in order, and the audit: rows before and after each. The audit is one aggregation."""
    if unknown := [s for s in steps if s not in CLEANING and s != NULLIFY]:
        raise ConfigError("unknown cleaning step", steps=unknown)
    if NULLIFY in steps and "drop_missing_any_predictor" not in steps[steps.index(NULLIFY) :]:
        raise ConfigError("values made null must be dropped afterwards", step=NULLIFY)
    bounds = {c: b for c, b in settings.get("bounds", {}).items() if c in settings["predictors"]}
    # Flags refer to the values as the steps before leave them.
    flagged, alive = df, F.lit(True)
    counts = []
    for k, name in enumerate(steps):
        before = alive
        if name == NULLIFY:
            bad = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in out_of_range(bounds).values()], F.lit(False))
            flagged = flagged.withColumn(f"_bad{k}", bad)
            flagged = nullify_impossible(flagged, bounds)
            touched = F.count_if(before & F.col(f"_bad{k}"))
        else:
            flagged = flagged.withColumn(f"_keep{k}", CLEANING[name][1](settings))
            alive = alive & F.col(f"_keep{k}")
            touched = F.lit(0).cast("long")
        counts.append((k, name, "values outside their range" if name == NULLIFY else CLEANING[name][0], F.count_if(before), F.count_if(alive), touched))
    one = flagged.agg(*[x.alias(f"_{k}_{n}") for k, _, _, b, a, t in counts for n, x in (("before", b), ("after", a))], *[t.alias(f"_{k}_rows") if steps[k] == NULLIFY else F.max(F.lit(0)).cast("long").alias(f"_{k}_rows") for k, _, _, _, _, t in counts])
    audit = one.select(F.inline(F.array(*[F.struct(F.lit(k + 1).alias("step"), F.lit(name).alias("rule"), F.lit(why).alias("reason"), F.col(f"_{k}_before").alias("n_before"), F.col(f"_{k}_after").alias("n_after"), F.col(f"_{k}_rows").alias("n_changed")) for k, name, why, *_ in counts])))
    return flagged.where(alive).select(*df.columns), audit


def impossible_rows(df: DataFrame, part: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with an impossible value in each part of a split."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in out_of_range(bounds).values()])
    return df.groupBy(part).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_impossible"))


def validate(df: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(rule_id, level, n, message): the findings of all registered rules. A rule is a function of the table that returns level, n and message."""
    if not rules:
        raise ConfigError("no validation rules")
    parts = [f(df).select(F.lit(name).alias("rule_id"), "level", F.col("n").cast("long").alias("n"), "message") for name, f in rules.items()]
    return reduce(DataFrame.unionByName, parts)

"""Censuses of status logs and measurements, coverage, evidence queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.operators.residuals import exact_percentiles
from thermarc.operators.windows import carried, islands, with_previous

EPOCH = "1970-01-01"
DISTINCT = 200


def hours(start: str = "start", end: str = "end") -> Column:
    return F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 3600


def counted(log: DataFrame, by: str, field: str) -> DataFrame:
    """(by, field): the values of a field with their counts, 'value=n' in order of the values. Counted before they meet; values are a vocabulary."""
    n = log.where(F.col(field).isNotNull()).groupBy(by, field).agg(F.count("*").alias("_n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", F.col(field), F.col("_n").cast("string"))))
    return n.groupBy(by).agg(F.array_join(parts, "|").alias(f"{field}s"))


def code_inventory(log: DataFrame, fields: tuple[str, ...] = ("message",), keywords: tuple[str, ...] = ()) -> DataFrame:
    """A row for each code: occurrences, turbines, hours, rows with and without a duration, first and last, statuses, longest row, years,
    the counted values of `fields` (messages, categories), and, with keywords, a flag that selects nothing: whether a message has one."""
    h, joined = hours(), lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    out = log.groupBy("code").agg(
        F.count("*").alias("n"), F.count_distinct("turbine_id").alias("n_turbines"), joined("turbine_id").alias("turbines"), F.round(F.coalesce(F.sum(h), F.lit(0.0)), 6).alias("hours"),
        F.count(h).alias("n_timed"), F.count_if(h.isNull()).alias("n_untimed"), F.min("start").alias("first"), F.max("start").alias("last"),
        joined("status").alias("statuses"), F.round(F.max(h), 6).alias("longest_hours"),
        F.array_join(F.array_sort(F.collect_set(F.year("start"))).cast("array<string>"), "|").alias("years"),
    )
    for f in fields:
        out = out.join(counted(log, "code", f), "code", "left")
    if keywords:
        hit = reduce(lambda a, b: a | b, [F.contains(F.lower(f"{f}s"), F.lit(k)) for f in fields for k in keywords])
        out = out.withColumn("has_keyword", F.coalesce(hit, F.lit(False)))
    return out


def long_events(log: DataFrame, least_hours: float = 6.0, statuses: tuple[str, ...] = ("Stop", "Warning")) -> DataFrame:
    """Stops and warnings of more than so many hours."""
    return log.where(F.col("status").isin(*statuses)).withColumn("hours", hours()).where(F.col("hours") > least_hours)


def interval_census(df: DataFrame, key: str, ts: str, top: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The most frequent intervals (delta_s, n), the largest gaps (key, start, end, delta_s), and irregular intervals of each key (other than its modal one)."""
    steps = with_previous(df.select(key, ts).where(F.col(ts).isNotNull()).distinct(), [key], [ts], [ts]).withColumnRenamed(f"prev_{ts}", "start").where("start is not null")
    steps = steps.select(key, "start", F.col(ts).alias("end"), F.timestamp_diff("SECOND", F.col("start"), F.col(ts)).alias("delta_s"))
    modal = steps.groupBy(key).agg(F.mode("delta_s", True).alias("_m"), F.count("*").alias("n_intervals"))
    irregular = steps.join(F.broadcast(modal), key).groupBy(key, "n_intervals").agg(F.first("_m").alias("modal_s"), F.count_if(F.col("delta_s") != F.col("_m")).alias("n_irregular"))
    frequent = steps.groupBy("delta_s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "delta_s").limit(top)
    return frequent, steps.orderBy(F.desc("delta_s"), key, "start").limit(top), irregular


def channel_groups(columns: list[str], groups: dict[str, tuple[list[str], list[str]]]) -> dict[str, list[str]]:
    """Columns by name: a group takes those that hold all its words and end in none of its suffixes."""
    return {g: [c for c in columns if all(w in c.lower() for w in words) and not c.lower().endswith(tuple(suffixes))] for g, (words, suffixes) in groups.items()}


def taxonomy_hours(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(hours()), F.lit(0.0)), 6).alias("hours"))


def turbine_year_pivot(log: DataFrame, statuses: list[str]) -> DataFrame:
    """Counts and hours by status (two columns each) for each turbine and year. Known statuses: no pass to find them."""
    cells = [x for s in statuses for x in (F.count_if(F.col("status") == s).alias(s), F.round(F.coalesce(F.sum(F.when(F.col("status") == s, hours())), F.lit(0.0)), 6).alias(f"{s}_hours"))]
    return log.groupBy("turbine_id", F.year("start").cast("long").alias("year")).agg(*cells)


def presence_signature(log: DataFrame) -> DataFrame:
    """Codes by the years in which they occur."""
    years = log.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set(F.year("start"))).cast("array<string>"), "|").alias("signature"))
    return years.groupBy("signature").agg(F.count("*").alias("n_codes"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


def completeness(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Populated, '-' and empty cells of each text column."""
    one = raw.agg(*[x for c in columns for x in (F.count_if((F.trim(c) != "") & (F.trim(c) != "-")).alias(f"{c}_p"), F.count_if(F.trim(c) == "-").alias(f"{c}_d"), F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(f"{c}_e"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_p").alias("n_populated"), F.col(f"{c}_d").alias("n_dash"), F.col(f"{c}_e").alias("n_empty")) for c in columns])))


def distinct_up_to(df: DataFrame, columns: list[str], most: int = DISTINCT) -> DataFrame:
    """(column_name, n_distinct): the distinct values of each column, counted up to `most`; nulls are none.

    A task keeps at most `most` values a column and looks at it no more when it has them; the sets then merge. So a row is
    read once whatever the number of columns, and a task passes on columns x most values.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set] = {c: set() for c in columns}
        for batch in batches:
            for c, values in held.items():
                if len(values) < most:
                    new = pc.unique(batch.column(c)).drop_null().to_pylist()
                    values.update(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in new)
        rows = [(c, v) for c, values in held.items() for v in sorted(values)[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["column_name", "value"])

    values = df.select(*columns).mapInArrow(seen, "column_name string, value string").distinct()
    found = values.groupBy("column_name").agg(F.least(F.count("*"), F.lit(most)).alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return every.join(found, "column_name", "left").na.fill(0, ["n_distinct"])


def column_facts(df: DataFrame, columns: list[str], ts: str) -> DataFrame:
    """Null share, first and last known time, range, mean, spread, distinct values (DISTINCT at most are told apart) and flags of each column: two passes, whatever the number of columns; partial sums and sets merge in Spark."""
    one = df.agg(F.count("*").alias("_n"), *[x.alias(f"{c}__{n}") for c in columns for n, x in (
        ("known", F.count(c)), ("first", F.min(F.when(F.col(c).isNotNull(), F.col(ts)))), ("last", F.max(F.when(F.col(c).isNotNull(), F.col(ts)))),
        ("low", F.min(c)), ("high", F.max(c)), ("mean", F.avg(c)), ("std", F.stddev_samp(c)))])
    row = lambda c: F.struct(
        F.lit(c).alias("column_name"), F.round(1 - F.col(f"{c}__known") / F.col("_n"), 6).alias("null_share"), F.col(f"{c}__first").alias("first_known"), F.col(f"{c}__last").alias("last_known"),
        *[F.round(F.col(f"{c}__{n}"), 6).alias(n) for n in ("low", "high", "mean", "std")], (F.col(f"{c}__std") < 1e-6).alias("low_variance"),
    )
    facts = one.select(F.inline(F.array(*[row(c) for c in columns])))
    return facts.join(distinct_up_to(df, columns), "column_name").withColumn("constant", F.col("n_distinct") == 1)  # a row for each column


def coverage_sessions(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Runs of covered times of a turbine without a step above its modal one: start, end, samples."""
    steps = with_previous(df.select("turbine_id", ts).distinct(), ["turbine_id"], [ts], [ts]).withColumn("_d", F.timestamp_diff("SECOND", F.col(f"prev_{ts}"), F.col(ts))).drop(f"prev_{ts}")
    modal = steps.groupBy("turbine_id").agg(F.mode("_d", True).alias("_m"))
    runs = islands(steps.join(F.broadcast(modal), "turbine_id"), ["turbine_id"], [ts], [ts], F.coalesce(F.col("_d") > F.col("_m"), F.lit(True)))
    return runs.groupBy("turbine_id", "island").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("island")


def as_of(left: DataFrame, right: DataFrame, at: str, ts: str, take: list[str], by: str = "turbine_id") -> DataFrame:
    """Each left row with `take` of the last right row of its turbine at or before it: both are sorted together in cells, whose last right rows are carried on; no pairs, and no task holds a turbine."""
    a = left.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in take])
    b = right.select(F.col(by), F.col(ts).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_{c}") for c in take])
    both = a.unionByName(b, allowMissingColumns=True)
    held = carried(both, [by], ["_t", "_side"], F.when(F.col("_side") == 0, F.struct(*[f"_{c}" for c in take])), "_asof").where("_side = 1")
    return held.withColumns({f"asof_{c}": F.col("_asof")[f"_{c}"] for c in take}).drop("_t", "_side", "_asof", *[f"_{c}" for c in take])


def preceding_coverage(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Hours of unbroken coverage before each status row (0 before the first; none without coverage), summed up by code."""
    rows = as_of(log, sessions, "start", "start", ["start", "end"])
    until = F.least(F.col("asof_end"), F.col("start"))
    h = F.when(F.col("asof_start").isNotNull(), F.timestamp_diff("SECOND", F.col("asof_start"), until) / 3600).otherwise(0.0)
    rows = rows.select("code", h.alias("_h"))
    middle = exact_percentiles(rows, ["code"], "_h", {"_m": 0.5}).select(F.col("code").alias("_code"), "_m")
    out = rows.groupBy("code").agg(
        F.round(F.min("_h"), 6).alias("least"), F.round(F.max("_h"), 6).alias("most"),
        F.count_if(F.col("_h") >= 720).alias("n_month"), F.count_if(F.col("_h") == 0).alias("n_none"),
    )
    return out.join(middle, F.col("code").eqNullSafe(F.col("_code"))).select("code", "least", F.round("_m", 6).alias("median"), "most", "n_month", "n_none")


def occurrence_gaps(log: DataFrame, order: list[str]) -> DataFrame:
    """Hours from the end of the occurrence before, of the same turbine and code."""
    rows = with_previous(log, ["turbine_id", "code"], ["start", *order], ["end"])
    return rows.withColumn("gap_hours", F.timestamp_diff("SECOND", F.col("prev_end"), F.col("start")) / 3600).drop("prev_end")


def keyword_candidates(df: DataFrame, text: list[str], keywords: list[str]) -> DataFrame:
    """Rows with a keyword in a text field, whatever the case: the sorted keywords and fields."""
    has = lambda c, k: F.coalesce(F.contains(F.lower(c), F.lit(k)), F.lit(False))
    any_of = lambda hits: reduce(lambda a, b: a | b, hits, F.lit(False))
    words = F.array_compact(F.array(*[F.when(any_of([has(c, k) for c in text]), F.lit(k)) for k in sorted(keywords)]))
    fields = F.array_compact(F.array(*[F.when(any_of([has(c, k) for k in keywords]), F.lit(c)) for c in sorted(text)]))
    return df.select("*", F.array_join(words, ",").alias("keywords"), F.array_join(fields, ",").alias("fields")).where("keywords <> ''")


def surrounding_rows(log: DataFrame, target: str, days: int = 120) -> DataFrame:
    """Rows of turbines with the target code, from `days` before its first to `days` after its last occurrence there."""
    span = F.make_dt_interval(F.lit(days))
    around = log.where(F.col("code") == target).groupBy("turbine_id").agg((F.min("start") - span).alias("_a"), (F.max("start") + span).alias("_b"))
    return log.join(F.broadcast(around), "turbine_id").where((F.col("start") >= F.col("_a")) & (F.col("start") <= F.col("_b"))).drop("_a", "_b")  # a row for each turbine


def preceding_stats(measured: DataFrame, occurrences: DataFrame, value: str, days: int = 60, occurrence_id: str = "occurrence_id", cell_days: int = 30) -> DataFrame:
    """Rows and mean of a value in [start - days, start) of each occurrence; both sides are dealt to cells of a month."""
    cell = lambda c: F.floor(F.datediff(F.to_date(c), F.lit(EPOCH).cast("date")) / cell_days)
    o = occurrences.select(occurrence_id, "turbine_id", F.col("start").alias("_b"), (F.col("start") - F.make_dt_interval(F.lit(days))).alias("_a"))
    o = o.withColumn("_cell", F.explode(F.sequence(cell("_a"), cell("_b"))))
    hit = measured.withColumn("_cell", cell("timestamp")).join(o, ["turbine_id", "_cell"]).where((F.col("timestamp") >= F.col("_a")) & (F.col("timestamp") < F.col("_b")))
    n = hit.groupBy(occurrence_id).agg(F.count("*").alias("n"), F.count(value).alias("n_known"), F.avg(value).alias("mean"))
    return occurrences.select(occurrence_id).join(n, occurrence_id, "left").na.fill(0, ["n", "n_known"])


def correlation_by_bin(df: DataFrame, a: str, b: str, condition: str, edges: list[float], by: list[str]) -> DataFrame:
    """Pearson correlation in right-closed bins of a condition; null for fewer than three pairs."""
    bin_ = sum((F.when(F.col(condition) > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(condition).isNotNull())
    return known.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.corr(a, b), 6)).alias("corr"))


def describe_by_bin(df: DataFrame, value: str, condition: str, edges: list[float], by: list[str]) -> DataFrame:
    """n, mean, spread and range of a value in right-closed bins of a condition; of fewer than three values only n."""
    bin_ = sum((F.when(F.col(condition) > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    enough = lambda x, n: F.when(F.count("*") >= 3, F.round(x, 6)).alias(n)
    known = df.where(F.col(value).isNotNull() & F.col(condition).isNotNull())
    return known.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), enough(F.avg(value), "mean"), enough(F.stddev_samp(value), "std"), enough(F.min(value), "min"), enough(F.max(value), "max"))


def modal_profile(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The most frequent whole value (the smallest of several; halves round to even) and the shares within 1 and 2 of it."""
    known = df.where(F.col(value).isNotNull())
    modal = known.groupBy(*by).agg(F.mode(F.bround(value), True).alias("modal"))
    far = F.abs(F.col(value) - F.col("modal"))
    return known.join(F.broadcast(modal), by).groupBy(*by, "modal").agg(F.round(F.avg((far <= 1).cast("double")), 6).alias("within_1"), F.round(F.avg((far <= 2).cast("double")), 6).alias("within_2"))


def covered_fraction(df: DataFrame, columns: list[str], ts: str = "timestamp") -> DataFrame:
    """Per turbine and year: rows, and those with a time and all columns."""
    whole = F.col(ts).isNotNull()
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.groupBy("turbine_id", F.year(ts).cast("long").alias("year")).agg(F.count("*").alias("n"), F.count_if(whole).alias("n_covered"), F.round(F.count_if(whole) / F.count("*"), 6).alias("share"))


def fleet_maximum(long: DataFrame, value: str = "ewma") -> DataFrame:
    """The greatest value of each target and the turbine that has it."""
    each = long.groupBy("target", "turbine_id").agg(F.max(value).alias("_v"))
    return each.groupBy("target").agg(F.round(F.max("_v"), 6).alias("maximum"), F.max_by("turbine_id", F.struct("_v", "turbine_id")).alias("turbine_id"))


def context_stats(long: DataFrame, periods: DataFrame) -> DataFrame:
    """n, mean, extremes of ewma and the largest |residual| by turbine, target and period [start, end). Rows meet periods by the day."""
    day = lambda c: F.datediff(F.to_date(c), F.lit(EPOCH).cast("date"))
    p = periods.withColumn("_day", F.explode(F.sequence(day("start"), day("end"))))
    hit = long.withColumn("_day", day("timestamp")).join(p, "_day").where((F.col("timestamp") >= F.col("start")) & (F.col("timestamp") < F.col("end")))
    r = lambda c, n: F.round(c, 6).alias(n)
    return hit.groupBy("turbine_id", "target", "period").agg(F.count("*").alias("n"), r(F.avg("ewma"), "mean_ewma"), r(F.max("ewma"), "max_ewma"), r(F.min("ewma"), "min_ewma"), r(F.max(F.abs("normalized_residual")), "max_residual"))

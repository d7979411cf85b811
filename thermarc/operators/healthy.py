"""The healthy population: exclusion windows, attribution by priority, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reasons in order of priority. A row excluded for several is counted under the first.
PRIORITY = [
    "known_fault_period",
    "pre_fault_window",
    "post_maintenance_window",
    "maintenance_period",
    "alarm_period",
    "shutdown_or_invalid_state",
    "author_designated_event_span",
    "author_designated_artefact",
    "sensor_failure_or_step_change",
    "curtailment",
    "below_minimum_active_power",
]


def rank(reason: Column) -> Column:
    """1 for the first reason. An unknown reason stops the job: its window would exclude nothing, unseen."""
    place = F.array_position(F.array(*[F.lit(r) for r in PRIORITY]), reason).cast("int")
    return F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown exclusion reason: "), F.coalesce(reason, F.lit("null")))).cast("int"))


def derive_windows(faults: DataFrame, maintenance: DataFrame, steps: DataFrame | None = None, alarms: DataFrame | None = None, pre_days: int = 30, post_days: int = 2, half_days: float = 1.0) -> DataFrame:
    """(turbine_id, start, end, reason): faults and the days before, maintenance and the days after, both sides of step changes, alarms."""
    day = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n) * 86400))
    cols = lambda df, a, b, why: df.select("turbine_id", a.alias("start"), b.alias("end"), F.lit(why).alias("reason"))
    out = cols(faults, F.col("start"), F.col("end"), "known_fault_period").unionByName(cols(faults, F.col("start") - day(pre_days), F.col("start"), "pre_fault_window"))
    out = out.unionByName(cols(maintenance, F.col("start"), F.col("end"), "maintenance_period")).unionByName(cols(maintenance, F.col("end"), F.col("end") + day(post_days), "post_maintenance_window"))
    if steps is not None:
        out = out.unionByName(cols(steps, F.col("timestamp") - day(half_days), F.col("timestamp") + day(half_days), "sensor_failure_or_step_change"))
    return out if alarms is None else out.unionByName(cols(alarms, F.col("start"), F.col("end"), "alarm_period"))


def alarm_windows(log: DataFrame, first: str, last: str, statuses: tuple[str, ...] = ("Stop", "Warning")) -> DataFrame:
    """(turbine_id, start, end) of stops and warnings that begin in [first, last) and have an end, cut at last."""
    upto = F.lit(last).cast("timestamp_ntz")
    rows = log.where(F.col("status").isin(*statuses) & F.col("end").isNotNull() & (F.col("start") >= F.lit(first).cast("timestamp_ntz")) & (F.col("start") < upto))
    return rows.select("turbine_id", "start", F.least("end", upto).alias("end"))


#: Days a window's cells are long: the range join becomes an equi-join on (cell of the time).
CELL_DAYS = 7


def cells(df: DataFrame, start: str, end: str, out: str = "_cell") -> DataFrame:
    """A row for each cell that the interval touches."""
    n = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / CELL_DAYS)
    return df.withColumn(out, F.explode(F.sequence(n(start), n(end))))


def cell(ts: str) -> Column:
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / CELL_DAYS)


def _by_cell(windows: DataFrame, *fields: str) -> tuple[DataFrame, DataFrame]:
    """The windows of each turbine and week, and of each week for all turbines, as arrays: few a cell."""
    w = cells(windows, "start", "end").withColumn("_w", F.struct("start", "end", *fields))
    own = w.where("turbine_id <> ''").groupBy(F.col("turbine_id").alias("_t"), "_cell").agg(F.collect_list("_w").alias("_own"))
    return own, w.where("turbine_id = ''").groupBy("_cell").agg(F.collect_list("_w").alias("_all"))


def _meeting(rows: DataFrame, windows: DataFrame, *fields: str) -> DataFrame:
    """Rows with `_hits`, the windows that hold them (start <= timestamp <= end): joins on turbine and week, and on the week."""
    own, everyone = _by_cell(windows, *fields)
    rows = rows.withColumn("_cell", cell("timestamp"))
    rows = rows.join(own, (rows["turbine_id"] == own["_t"]) & (rows["_cell"] == own["_cell"]), "left").drop("_t", own["_cell"]).join(everyone, "_cell", "left").drop("_cell")
    none = F.array().cast(own.schema["_own"].dataType)
    both = F.concat(F.coalesce("_own", none), F.coalesce("_all", none))
    inside = F.filter(both, lambda w: (F.col("timestamp") >= w["start"]) & (F.col("timestamp") <= w["end"]))
    return rows.withColumn("_hits", inside).drop("_own", "_all")


def attribute(df: DataFrame, windows: DataFrame, floor: float | None = None, power: str = "active_power") -> DataFrame:
    """Adds `reason` (null: healthy): windows hold start <= timestamp <= end, an empty turbine means all.

    A row meets the windows of its turbine and week as one array, so rows move once and don't multiply. A missing
    power is no reason; an unknown reason raises.
    """
    rows = _meeting(df, windows.withColumn("_rank", rank(F.col("reason"))), "_rank")
    hit = F.array_min(F.transform("_hits", lambda w: w["_rank"]))
    low = F.lit(None).cast("int") if floor is None else F.when(F.coalesce(F.col(power) < floor, F.lit(False)), F.lit(len(PRIORITY)))
    return rows.withColumn("reason", F.get(F.array(*[F.lit(r) for r in PRIORITY]), F.least(hit, low) - 1)).drop("_hits")


def report(attributed: DataFrame) -> DataFrame:
    """Rows and share by reason ('accepted' where there is none)."""
    n = attributed.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n_rows"))
    total = attributed.agg(F.count("*").alias("_n"))
    return n.crossJoin(F.broadcast(total)).select("reason", "n_rows", F.round(100 * F.col("n_rows") / F.col("_n"), 4).alias("percent"))  # one row with one row


def guard_windows(windows: DataFrame, attributed: DataFrame, window_id: str = "window_id") -> DataFrame:
    """Fault windows with the rows they cover and those of them that were accepted; none covered, or some accepted, is a warning."""
    rows = _meeting(attributed.select("turbine_id", "timestamp", "reason"), windows, window_id).select("reason", F.explode("_hits").alias("w"))
    n = rows.groupBy(F.col(f"w.{window_id}").alias(window_id)).agg(F.count("*").alias("n_rows"), F.count_if(F.col("reason").isNull()).alias("n_accepted"))
    out = windows.select(window_id).join(n, window_id, "left").na.fill(0, ["n_rows", "n_accepted"])
    return out.withColumn("finding", F.when(F.col("n_rows") == 0, "covers no row").when(F.col("n_accepted") > 0, "overlaps accepted rows").otherwise("ok"))

"""Status logs as events, persistent runs, matching of detections and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermarc.operators.windows import islands

VOCABULARY = ["Informational", "Stop", "Warning", "Communication"]


def parse_status(raw: DataFrame, start: str = "Timestamp start", end: str = "Timestamp end") -> DataFrame:
    """Typed rows with `rejected`: a reason, or null. '-', empty, nan and NaT mean no end."""
    open_end = F.lower(F.trim(F.col(end))).isin("-", "", "nan", "nat") | F.col(end).isNull()
    a, b = F.expr(f"try_to_timestamp(`{start}`)"), F.when(~open_end, F.expr(f"try_to_timestamp(`{end}`)"))
    rows = raw.withColumns({"start": a, "end": b})
    why = F.when(~F.coalesce(F.trim("Status").isin(VOCABULARY), F.lit(False)), "unknown status").when(F.col("start").isNull(), "no start").when(~open_end & F.col("end").isNull(), "unreadable end").when(F.col("end") < F.col("start"), "ends before it starts")
    return rows.withColumn("rejected", why)


def duration_seconds(text: str):
    """'HH:MM:SS' as seconds; null for anything else."""
    parts = F.split(F.trim(F.col(text)), ":")
    n = [F.expr(f"try_cast(split(trim(`{text}`), ':')[{k}] as double)") for k in range(3)]
    return F.when(F.size(parts) == 3, n[0] * 3600 + n[1] * 60 + n[2])


def persistent_runs(states: DataFrame, least: int = 3, keys=("turbine_id", "target"), order=("timestamp",)) -> DataFrame:
    """Runs of one direction of at least `least` rows, at their first; another direction breaks a run."""
    runs = islands(states, list(keys), list(order), ["state"], F.col("state") != F.col("prev_state")).where("state <> 0")
    return runs.groupBy(*keys, "island", "state").agg(F.min(order[0]).alias("timestamp"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


#: Length of the cells in which events and detections meet, in days.
CELL_DAYS = 14


def _cell(ts):
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / CELL_DAYS)


def match_events(events: DataFrame, detections: DataFrame, window_days: float = 14, event_id: str = "event_id") -> DataFrame:
    """Each event with its earliest detection in the days up to its start, and the lead time (null where none).

    An event is dealt to the cells its window touches, so the join is on turbine and cell.
    """
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_days * 86400.0))
    e = events.select(event_id, "turbine_id", "start", (F.col("start") - span).alias("_from"))
    e = e.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_from")), _cell(F.col("start")))))
    d = detections.select(F.col("turbine_id"), F.col("timestamp").alias("_at"), _cell(F.col("timestamp")).alias("_cell"))
    hit = e.join(d, ["turbine_id", "_cell"]).where((F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("start"))).groupBy(event_id).agg(F.min("_at").alias("detected"))
    out = events.join(hit, event_id, "left")
    minutes = F.timestamp_diff("SECOND", F.col("detected"), F.col("start")) / 60
    return out.withColumns({"lead_minutes": minutes, "lead_floored": (F.floor(minutes / 10) * 10).cast("long")})


def false_alarms(detections: DataFrame, events: DataFrame, window_days: float = 14) -> DataFrame:
    """Detections outside every event's [start - window, end or start] of their turbine."""
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_days * 86400.0))
    e = events.select(F.col("turbine_id"), (F.col("start") - span).alias("_from"), F.coalesce("end", "start").alias("_to"))
    e = e.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_from")), _cell(F.col("_to"))))).alias("e")
    d = detections.withColumn("_cell", _cell(F.col("timestamp"))).alias("d")
    inside = (F.col("d.turbine_id") == F.col("e.turbine_id")) & (F.col("d._cell") == F.col("e._cell")) & (F.col("d.timestamp") >= F.col("_from")) & (F.col("d.timestamp") <= F.col("_to"))
    return d.join(e, inside, "left_anti").drop("_cell")


def evaluate(matched: DataFrame, alarms: DataFrame, least_events: int = 2) -> DataFrame:
    """Counts, and the share of detected events where there are enough to say so (else null)."""
    n = matched.agg(F.count("*").alias("n_events"), F.count("detected").alias("n_detected"))
    a = alarms.agg(F.count("*").alias("n_false"))
    out = n.crossJoin(a)  # one row with one row
    return out.withColumn("n_missed", F.col("n_events") - F.col("n_detected")).withColumn("rate", F.when(F.col("n_events") >= least_events, F.round(F.col("n_detected") / F.col("n_events"), 6)))


def window_open_flags(flags: DataFrame, opens: str, n: int = 3, flag: str = "alarm") -> DataFrame:
    """Turbines whose first n flags from a time on are all true: already alarming."""
    k = F.row_number().over(Window.partitionBy("turbine_id").orderBy("timestamp"))
    first = flags.where(F.col("timestamp") >= F.lit(opens).cast("timestamp_ntz")).withColumn("_k", k).where(F.col("_k") <= n)
    return first.groupBy("turbine_id").agg(F.count("*").alias("n_rows"), (F.bool_and(flag) & (F.count("*") == n)).alias("already"))

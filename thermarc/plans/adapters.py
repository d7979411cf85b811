"""Canonical views over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: event type -> channel
CHANNELS = {"view": "wind_speed", "click": "active_power", "signup": "ambient_temperature", "error": "gearbox_oil_temperature", "purchase": "gearbox_bearing_temperature"}
PREDICTORS = ["wind_speed", "active_power", "ambient_temperature"]
TARGETS = ["gearbox_oil_temperature", "gearbox_bearing_temperature"]
STREAMS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turbine(col: str):
    return F.concat(F.lit("T"), (F.col(col) % 6 + 1).cast("string"))


def scada(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour cells of six turbines; a channel without an event is null."""
    e = table(spark, sf_dir, "events")
    cell = F.date_trunc("DAY", "ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.floor(F.hour("ts") / 6) * 6).cast("int"))
    return e.groupBy(turbine("user_id").alias("turbine_id"), cell.alias("timestamp")).agg(*[F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 9).alias(c) for k, c in CHANNELS.items()])


def scada_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of six turbines, for the models: a day has all channels more often than six hours have."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("DAY", "ts").cast("timestamp_ntz")
    return e.groupBy(turbine("user_id").alias("turbine_id"), day.alias("timestamp")).agg(*[F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 9).alias(c) for k, c in CHANNELS.items()])


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams (turbine, event type) with actual, prediction and raw residual; event_id makes orders total."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", turbine("user_id").alias("turbine_id"), F.col("event_type").alias("target"), F.col("ts").alias("timestamp"), F.col("value").alias("actual"), k.alias("prediction"), (F.col("value") - k).alias("raw_residual"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    end = F.when(F.col("o_orderstatus") != "P", start + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 200).cast("int")))
    status = F.when(F.col("o_orderpriority").startswith("1"), "Stop").when(F.col("o_orderpriority").startswith("2"), "Warning").when(F.col("o_orderpriority").startswith("3"), "Communication").otherwise("Informational")
    return o.select(F.col("o_orderkey").alias("occurrence_id"), turbine("o_custkey").alias("turbine_id"), start.alias("start"), end.alias("end"), F.col("o_orderpriority").alias("code"), status.alias("status"), F.col("o_orderpriority").alias("message"))


def exclusion_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hours to both sides of large errors; the reason by the value's band."""
    e = table(spark, sf_dir, "events").where("event_type = 'error' and value > 200")
    half = F.make_dt_interval(F.lit(0), F.lit(12))
    reason = F.when(F.col("value") > 260, "known_fault_period").when(F.col("value") > 230, "pre_fault_window").otherwise("post_maintenance_window")
    return e.select(F.col("event_id").alias("window_id"), F.when(F.col("event_id") % 9 == 0, "").otherwise(turbine("user_id")).alias("turbine_id"), (F.col("ts") - half).alias("start"), (F.col("ts") + half).alias("end"), reason.alias("reason"))


def high_cells(spark: SparkSession, sf_dir: str, channel: str, sigmas: float) -> DataFrame:
    """(event_id, turbine_id, timestamp, z): the six-hour cells whose channel is more than so many standard deviations above the mean of all cells.

    They are at most 1 / (1 + sigmas^2) of the cells (Cantelli), however many events a cell has; single events above a fixed value would at last cover all of the time.
    """
    cells = scada(spark, sf_dir).select("turbine_id", "timestamp", F.col(channel).alias("_value")).where("_value is not null")
    of_all = cells.agg(F.avg("_value").alias("_mean"), F.stddev_pop("_value").alias("_sigma"))
    z = (F.col("_value") - F.col("_mean")) / F.nullif(F.col("_sigma"), F.lit(0.0))
    found = cells.crossJoin(F.broadcast(of_all)).withColumn("z", z).where(F.col("z") > sigmas)
    return found.select(F.concat_ws("/", "turbine_id", F.date_format("timestamp", "yyyy-MM-dd HH")).alias("event_id"), "turbine_id", "timestamp", "z")


def experiment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hours to both sides of the middle of cells with a high oil temperature; the reason by how high it is. A ninth of them, by a hash, holds for all turbines."""
    hours = lambda n: F.make_dt_interval(F.lit(0), F.lit(n))
    reason = F.when(F.col("z") > 3.0, "known_fault_period").when(F.col("z") > 2.5, "pre_fault_window").otherwise("post_maintenance_window")
    cells = high_cells(spark, sf_dir, "gearbox_oil_temperature", 2.0)
    return cells.select(F.when(F.crc32("event_id") % 9 == 0, "").otherwise(F.col("turbine_id")).alias("turbine_id"), (F.col("timestamp") - hours(9)).alias("start"), (F.col("timestamp") + hours(15)).alias("end"), reason.alias("reason"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", turbine("l_suppkey").alias("turbine_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


SCADA = """scada as (
  select 'T' || (user_id % 6 + 1) as turbine_id, date_trunc('day', ts)::timestamp + to_hours((hour(ts) // 6 * 6)::int) as timestamp,
    round(avg(value) filter (event_type = 'view'), 9) as wind_speed, round(avg(value) filter (event_type = 'click'), 9) as active_power,
    round(avg(value) filter (event_type = 'signup'), 9) as ambient_temperature, round(avg(value) filter (event_type = 'error'), 9) as gearbox_oil_temperature,
    round(avg(value) filter (event_type = 'purchase'), 9) as gearbox_bearing_temperature
  from events group by 1, 2)"""
DAYS = SCADA.replace("scada as", "days as").replace("date_trunc('day', ts)::timestamp + to_hours((hour(ts) // 6 * 6)::int)", "date_trunc('day', ts)::timestamp")
RESIDUALS = """res as (
  select event_id, 'T' || (user_id % 6 + 1) as turbine_id, event_type as target, ts as timestamp, value as actual,
    cast(json_extract_string(props, '$.k') as double) as prediction, value - cast(json_extract_string(props, '$.k') as double) as raw_residual
  from events)"""
STATUS = """log as (
  select o_orderkey as occurrence_id, 'T' || (o_custkey % 6 + 1) as turbine_id, o_orderdate::timestamp as start,
    case when o_orderstatus <> 'P' then o_orderdate::timestamp + to_hours((o_orderkey % 200)::int) end as "end", o_orderpriority as code,
    case substr(o_orderpriority, 1, 1) when '1' then 'Stop' when '2' then 'Warning' when '3' then 'Communication' else 'Informational' end as status,
    o_orderpriority as message
  from orders)"""
WINDOWS = """win as (
  select event_id as window_id, case when event_id % 9 = 0 then '' else 'T' || (user_id % 6 + 1) end as turbine_id, ts - interval 12 hour as start, ts + interval 12 hour as "end",
    case when value > 260 then 'known_fault_period' when value > 230 then 'pre_fault_window' else 'post_maintenance_window' end as reason
  from events where event_type = 'error' and value > 200)"""
DATED = """dated as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'T' || (l_suppkey % 6 + 1) as turbine_id, l_shipdate::timestamp as timestamp, l_quantity, l_extendedprice, l_discount, l_tax
  from lineitem)"""
MAD = """c as (select target, median(raw_residual) as center from res group by 1),
mad as (select target, center, 1.4826 * median(abs(raw_residual - center)) as scale from res join c using (target) group by 1, 2),
norm as (select res.*, (raw_residual - center) / scale as normalized_residual from res join mad using (target))"""
#: The recursion as a weighted sum over the rows before, which a database can also do.
EWMA = """seq as (select *, row_number() over (partition by turbine_id, target order by timestamp, event_id) as t from norm),
ew as (
  select a.event_id, a.turbine_id, a.target, a.timestamp, a.t, a.normalized_residual, sum(0.2 * pow(0.8, a.t - b.t) * b.normalized_residual) as ewma
  from seq a join seq b on a.turbine_id = b.turbine_id and a.target = b.target and b.t <= a.t and a.t - b.t < 200 group by all),
sig as (select target, stddev_samp(normalized_residual) as sigma from norm group by 1),
st as (
  select ew.*, 3 * sigma * sqrt(0.2 / 1.8) as upper, -3 * sigma * sqrt(0.2 / 1.8) as lower,
    case when ewma > 3 * sigma * sqrt(0.2 / 1.8) then 1 when ewma < -3 * sigma * sqrt(0.2 / 1.8) then -1 else 0 end as state
  from ew join sig using (target))"""

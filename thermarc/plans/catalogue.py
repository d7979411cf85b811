"""All registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermarc.cluster import stored
from thermarc.config import Config, Model, Tuning
from thermarc.operators import census, detect, events, findings, healthy, matched, models, quality, residuals, rules, split, stats
from thermarc.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BOUNDS = {"wind_speed": (10.0, 240.0), "active_power": (5.0, 250.0), "ambient_temperature": (0.5, 245.0)}
CHANNELS = [*A.PREDICTORS, *A.TARGETS]
SETTINGS = {"timestamp": "timestamp", "targets": A.TARGETS, "predictors": A.PREDICTORS, "bounds": BOUNDS}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = A.residuals(spark, sf_dir)
    return residuals.normalize(long, residuals.mad_stats(long))


def states(spark: SparkSession, sf_dir: str, time_varying: bool = False) -> DataFrame:
    n = normalized(spark, sf_dir)
    return residuals.with_limits(residuals.ewma(n, order=("timestamp", "event_id")), residuals.sigmas_of(n), time_varying=time_varying)


def cells_of_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States on a common grid: the last of each turbine, target and six hours."""
    s = states(spark, sf_dir)
    cell = F.date_trunc("DAY", "timestamp").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.floor(F.hour("timestamp") / 6) * 6).cast("int"))
    last = lambda c: F.max_by(c, F.struct("timestamp", "event_id")).alias(c)
    return s.groupBy("turbine_id", "target", cell.alias("timestamp")).agg(last("state"), last("ewma"), last("upper"), last("normalized_residual"))


GRID_SQL = """grid as (
  select turbine_id, target, date_trunc('day', timestamp)::timestamp + to_hours((hour(timestamp) // 6 * 6)::int) as timestamp, arg_max(state, t) as state, arg_max(ewma, t) as ewma, arg_max(upper, t) as upper
  from st group by 1, 2, 3)"""
W = "with "
BASE = W + ", ".join([A.RESIDUALS, A.MAD, A.EWMA])
TWO = ["error", "purchase"]


# ---- sources, projections, filters


@query(W + A.SCADA + " select * from scada")
def canonical_projection(spark, sf_dir):
    return A.scada(spark, sf_dir)


@query("select event_id, (ts at time zone 'Europe/London') at time zone 'UTC' as utc, month(ts)::int as month from events")
def utc_normalize(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.select("event_id", F.convert_timezone(F.lit("Europe/London"), F.lit("UTC"), F.col("ts")).alias("utc"), F.month("ts").alias("month"))


@query(W + A.DATED + " select turbine_id, count(*) as n from dated where timestamp >= '1996-01-01' and timestamp < '1997-12-31'::date + 1 group by 1")
def span_filter(spark, sf_dir):
    ts = F.col("timestamp")
    return A.dated(spark, sf_dir).where((ts >= F.lit("1996-01-01").cast("date")) & (ts < F.date_add(F.lit("1997-12-31").cast("date"), 1))).groupBy("turbine_id").agg(F.count("*").alias("n"))


@query("""select l_orderkey, l_linenumber, count(*) as n_rows, count(distinct (l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax)) as n_contents
from lineitem group by 1, 2 having n_contents > 1""")
def dedup_conflicts(spark, sf_dir):
    return quality.dedup_conflicts(A.dated(spark, sf_dir).drop("turbine_id"), ["l_orderkey", "l_linenumber"])


@query(W + A.DATED + """ select * from dated qualify row_number() over (partition by l_orderkey, l_linenumber order by timestamp, l_partkey, l_suppkey, l_extendedprice) = 1""")
def dedup_keep_first(spark, sf_dir):
    return quality.dedup_keep_first(A.dated(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["timestamp", "l_partkey", "l_suppkey", "l_extendedprice"])


@query(W + A.DATED + """, kept as (select * from dated qualify row_number() over (partition by l_orderkey, l_linenumber order by timestamp, l_partkey, l_suppkey, l_extendedprice) = 1)
select turbine_id, count(*) as n_removed from (select * from dated except all select * from kept) group by 1""")
def removed_rows_except(spark, sf_dir):
    rows = A.dated(spark, sf_dir)
    return rows.exceptAll(dedup_keep_first(spark, sf_dir)).groupBy("turbine_id").agg(F.count("*").alias("n_removed"))


def _per_column(template: str, joiner: str = " union all ", columns: list[str] = CHANNELS) -> str:
    return joiner.join(template.format(c=c, lo=BOUNDS.get(c, (0, 0))[0], hi=BOUNDS.get(c, (0, 0))[1]) for c in columns)


@query(W + A.SCADA + " " + _per_column("select '{c}' as column_name, count(*) filter ({c} is null) as n_null, count(*) filter ({c} is null) / count(*) as fraction, case when count(*) filter ({c} is null) / count(*) >= 0.5 then 'WARNING' else 'INFO' end as level from scada"))
def null_profile(spark, sf_dir):
    return quality.null_profile(A.scada(spark, sf_dir), CHANNELS)


@query(W + A.SCADA + " " + _per_column("select '{c}' as column_name, count({c}) as n_values, case when count({c}) = 0 then 'empty' when count(distinct {c}) = 1 then 'constant' else 'varying' end as kind from scada"))
def constant_columns(spark, sf_dir):
    return quality.constant_columns(A.scada(spark, sf_dir), CHANNELS)


@query(W + A.SCADA + " " + _per_column("select '{c}' as column_name, count(*) filter ({c} < {lo} or {c} > {hi}) as n_out from scada", columns=A.PREDICTORS))
def range_findings(spark, sf_dir):
    return quality.range_findings(A.scada(spark, sf_dir), BOUNDS)


@query(W + A.STATUS + """, d as (select turbine_id, start, date_diff('second', lag(start) over (partition by turbine_id order by start), start) as delta from (select distinct turbine_id, start from log)),
f as (select turbine_id, delta, count(*) as n from d where delta is not null group by 1, 2),
m as (select turbine_id, delta as modal_s from f qualify row_number() over (partition by turbine_id order by n desc, delta) = 1),
c as (select turbine_id, count(*) as n_rows from log group by 1)
select c.turbine_id, n_rows, n_rows - count(*) as n_duplicates, modal_s, count(*) filter (delta > modal_s) as n_gaps, max(delta) as largest_s
from c join m using (turbine_id) join d using (turbine_id) group by c.turbine_id, n_rows, modal_s""")
def timestamp_gaps(spark, sf_dir):
    return quality.timestamp_gaps(A.status_log(spark, sf_dir), "turbine_id", "start")


@query(W + A.SCADA + """ select delta_s, count(*) as n from (select date_diff('second', lag(timestamp) over (partition by turbine_id order by timestamp), timestamp) as delta_s from scada) where delta_s is not null group by 1""")
def sampling_histogram(spark, sf_dir):
    return quality.sampling_histogram(A.scada(spark, sf_dir), "turbine_id", "timestamp")


@query(W + A.SCADA + " select count(*) as n_rows, min(timestamp) as first_ts, max(timestamp) as last_ts, string_agg(distinct turbine_id, ',' order by turbine_id) as keys from scada")
def dataset_report(spark, sf_dir):
    return quality.dataset_report(A.scada(spark, sf_dir), "turbine_id", "timestamp")


@query(W + A.SCADA + """, k as (select turbine_id, timestamp, gearbox_oil_temperature as v, row_number() over w as idx, count(*) over (partition by turbine_id) as n,
  case when count(*) over (w rows between 11 preceding and current row) >= 6 then quantile_cont(gearbox_oil_temperature, 0.5) over (w rows between 11 preceding and current row) end as before,
  case when count(*) over (w rows between current row and 11 following) >= 6 then quantile_cont(gearbox_oil_temperature, 0.5) over (w rows between current row and 11 following) end as after
  from scada where gearbox_oil_temperature is not null window w as (partition by turbine_id order by timestamp)),
h as (select *, abs(after - before) as delta from k where n >= 24 and abs(after - before) > 5),
g as (select *, sum(new) over (partition by turbine_id order by idx) as run from (select *, case when coalesce(idx - lag(idx) over (partition by turbine_id order by idx) > 12, true) then 1 else 0 end as new from h))
select turbine_id, timestamp, round(delta, 4) as magnitude, round(before, 4) as before, round(after, 4) as after from g qualify row_number() over (partition by turbine_id, run order by delta desc, idx) = 1""")
def step_changes(spark, sf_dir):
    return quality.step_changes(A.scada(spark, sf_dir), "turbine_id", "timestamp", "gearbox_oil_temperature", window=12)


@query(W + A.SCADA + " select turbine_id, timestamp from scada where gearbox_oil_temperature is not null and gearbox_bearing_temperature is not null")
def clean_drop_targets(spark, sf_dir):
    rows, _ = quality.clean(A.scada(spark, sf_dir), ["drop_unparseable_timestamps", "drop_missing_all_targets", "drop_missing_any_target"], SETTINGS)
    return rows.select("turbine_id", "timestamp")


_NULLED = ", nulled as (select turbine_id, timestamp, gearbox_oil_temperature, gearbox_bearing_temperature, " + _per_column("case when not ({c} < {lo} or {c} > {hi}) then {c} end as {c}", ", ", A.PREDICTORS) + " from scada)"


@query(W + A.SCADA + _NULLED + " select turbine_id, timestamp, wind_speed, active_power, ambient_temperature from nulled where wind_speed is not null and active_power is not null and ambient_temperature is not null")
def clean_nullify_impossible(spark, sf_dir):
    rows, _ = quality.clean(A.scada(spark, sf_dir), [quality.NULLIFY, "drop_missing_any_predictor"], SETTINGS)
    return rows.select("turbine_id", "timestamp", *A.PREDICTORS)


@query(W + A.SCADA + """, f as (select gearbox_oil_temperature is not null or gearbox_bearing_temperature is not null as a, wind_speed is not null and active_power is not null and ambient_temperature is not null
    and not (wind_speed < 10 or wind_speed > 240 or active_power < 5 or active_power > 250 or ambient_temperature < 0.5 or ambient_temperature > 245) as b,
    coalesce(wind_speed < 10 or wind_speed > 240, false) or coalesce(active_power < 5 or active_power > 250, false) or coalesce(ambient_temperature < 0.5 or ambient_temperature > 245, false) as bad from scada),
n as (select count(*) as n, count(*) filter (a) as na, count(*) filter (a and b) as nb, count(*) filter (a and bad) as changed from f)
select 1 as step, 'drop_missing_all_targets' as rule, 'no target has a value' as reason, n as n_before, na as n_after, 0::bigint as n_changed from n
union all select 2, 'nullify_impossible_predictor_values', 'values outside their range', na, na, changed from n
union all select 3, 'drop_missing_any_predictor', 'a predictor has no value', na, nb, 0 from n""")
def cleaning_audit(spark, sf_dir):
    _, audit = quality.clean(A.scada(spark, sf_dir), ["drop_missing_all_targets", quality.NULLIFY, "drop_missing_any_predictor"], SETTINGS)
    return audit


@query(W + A.DATED + """ select case when timestamp < '1997-01-01' then 'train' when timestamp < '1999-01-01' then 'validation' else 'test' end as partition, count(*) as n_rows, count(*) filter (l_discount > 0.09 or l_quantity > 49) as n_impossible from dated group by 1""")
def impossible_by_partition(spark, sf_dir):
    rows = split.by_dates(A.dated(spark, sf_dir), "timestamp", "1997-01-01", "1999-01-01")
    return quality.impossible_rows(rows, "partition", {"l_discount": (0.0, 0.09), "l_quantity": (0.0, 49.0)})


# ---- healthy population, splits

_RANKED = """, rk as (select *, case reason when 'known_fault_period' then 1 when 'pre_fault_window' then 2 else 3 end as r from win),
attr as (select s.turbine_id, s.timestamp, s.active_power, min(r) as hit from scada s left join rk w on (w.turbine_id = '' or w.turbine_id = s.turbine_id) and s.timestamp between w.start and w."end" group by all),
att as (select turbine_id, timestamp, case hit when 1 then 'known_fault_period' when 2 then 'pre_fault_window' when 3 then 'post_maintenance_window' else case when active_power < 50 then 'below_minimum_active_power' end end as reason from attr)"""


def attributed(spark, sf_dir) -> DataFrame:
    return healthy.attribute(A.scada(spark, sf_dir), A.exclusion_windows(spark, sf_dir), floor=50.0)


@query(W + ", ".join([A.SCADA, A.WINDOWS]) + _RANKED + " select turbine_id, timestamp, reason from att")
def exclusion_attribution(spark, sf_dir):
    return attributed(spark, sf_dir).select("turbine_id", "timestamp", "reason")


@query(W + ", ".join([A.SCADA, A.WINDOWS]) + _RANKED + " select coalesce(reason, 'accepted') as reason, count(*) as n_rows, round(100 * count(*) / sum(count(*)) over (), 4) as percent from att group by 1")
def healthy_report(spark, sf_dir):
    return healthy.report(attributed(spark, sf_dir))


@query(W + ", ".join([A.SCADA, A.WINDOWS]) + _RANKED + """ select window_id, count(a.timestamp) as n_rows, count(a.timestamp) filter (a.reason is null) as n_accepted,
case when count(a.timestamp) = 0 then 'covers no row' when count(a.timestamp) filter (a.reason is null) > 0 then 'overlaps accepted rows' else 'ok' end as finding
from win w left join att a on (w.turbine_id = '' or w.turbine_id = a.turbine_id) and a.timestamp between w.start and w."end" group by 1""")
def guard5_findings(spark, sf_dir):
    return healthy.guard_windows(A.exclusion_windows(spark, sf_dir), attributed(spark, sf_dir))


@query(W + A.DATED + " select case when timestamp < '1997-01-01' then 'train' when timestamp < '1999-01-01' then 'validation' else 'test' end as partition, count(*) as n, min(timestamp) as first, max(timestamp) as last from dated group by 1")
def split_explicit_dates(spark, sf_dir):
    return split.by_dates(A.dated(spark, sf_dir), "timestamp", "1997-01-01", "1999-01-01").groupBy("partition").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


_ORDER = ["turbine_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_PLACED = ", p as (select *, row_number() over (order by timestamp, turbine_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i, count(*) over () as n from dated)"


@query(W + A.DATED + _PLACED + """ select case when i <= floor(n * 0.7) then 'train' when i <= floor(n * 0.7) + floor(n * 0.15) then 'validation' else 'test' end as partition, count(*) as n, sum(l_orderkey)::bigint as keys, min(timestamp) as first from p group by 1""")
def split_fraction(spark, sf_dir):
    return split.by_fractions(A.dated(spark, sf_dir), "timestamp", _ORDER).groupBy("partition").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.min("timestamp").alias("first"))


@query(W + A.DATED + _PLACED + """, b as (select *, least((i - 1) // (n // 5), 4) as block from p)
select fold::int as fold, case when block < fold then 'train' else 'test' end as part, count(*) as n, sum(l_orderkey)::bigint as keys from b, range(1, 5) f(fold) where block <= fold group by 1, 2""")
def rolling_origin_folds(spark, sf_dir):
    return split.rolling_folds(A.dated(spark, sf_dir), "timestamp", _ORDER, 4).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query(W + A.DATED + """, s as (select *, case when timestamp < '1995-09-01' then 'train' when timestamp < '1999-01-01' then 'validation' else 'test' end as partition from dated),
o as (select round(floor(date_diff('second', min(timestamp) filter (partition = 'train'), max(timestamp) filter (partition = 'train')) / 86400) / 30.4375, 3) as train_months,
  list_sort(list(distinct month(timestamp)) filter (partition = 'train')) as a, list_sort(list(distinct month(timestamp)) filter (partition = 'test')) as b from s)
select train_months, array_to_string(a, ',') as train_calendar, array_to_string(b, ',') as test_calendar, array_to_string(list_filter(b, lambda x: not list_contains(a, x)), ',') as untrained, train_months < 12 as short_training from o""")
def seasonal_coverage(spark, sf_dir):
    return split.seasonal_coverage(split.by_dates(A.dated(spark, sf_dir), "timestamp", "1995-09-01", "1999-01-01"), "timestamp")


# ---- residuals

_PRED = ", pr as (select *, 0.5 * wind_speed + 10 as p_oil, 0.25 * active_power + 20 as p_bearing from scada)"


@query(W + A.SCADA + _PRED + """ select turbine_id, timestamp, 'gearbox_oil_temperature' as target, gearbox_oil_temperature as actual, round(p_oil, 6) + 0.0 as prediction, round(gearbox_oil_temperature - p_oil, 6) + 0.0 as raw_residual from pr
union all select turbine_id, timestamp, 'gearbox_bearing_temperature', gearbox_bearing_temperature, round(p_bearing, 6) + 0.0, round(gearbox_bearing_temperature - p_bearing, 6) + 0.0 from pr""")
def unpivot_residuals(spark, sf_dir):
    wide = A.scada(spark, sf_dir).withColumns({"prediction_gearbox_oil_temperature": 0.5 * F.col("wind_speed") + 10, "prediction_gearbox_bearing_temperature": 0.25 * F.col("active_power") + 20})
    return rounded(residuals.unpivot(wide, ["turbine_id", "timestamp"], A.TARGETS), "prediction", "raw_residual")


_NORM_OUT = " select event_id, target, round(({v} - center) / scale, 6) + 0.0 as normalized_residual from res join {s} using (target)"


def _normal(spark, sf_dir, kind: str) -> DataFrame:
    long = A.residuals(spark, sf_dir)
    return rounded(residuals.normalize(long, residuals.NORMALIZERS[kind](long)).select("event_id", "target", "normalized_residual"), "normalized_residual")


@query(W + A.RESIDUALS + ", s as (select target, avg(raw_residual) as center, stddev_samp(raw_residual) as scale from res group by 1)" + _NORM_OUT.format(v="raw_residual", s="s"))
def normalize_sigma(spark, sf_dir):
    return _normal(spark, sf_dir, "sigma")


@query(W + ", ".join([A.RESIDUALS, A.MAD]) + " select event_id, target, round(normalized_residual, 6) + 0.0 as normalized_residual from norm")
def normalize_mad(spark, sf_dir):
    return _normal(spark, sf_dir, "mad")


@query(W + A.RESIDUALS + ", s as (select target, median(raw_residual) as center, (quantile_cont(raw_residual, 0.75) - quantile_cont(raw_residual, 0.25)) / 1.349 as scale from res group by 1)" + _NORM_OUT.format(v="raw_residual", s="s"))
def normalize_percentile(spark, sf_dir):
    return _normal(spark, sf_dir, "percentile")


@query(W + ", ".join([A.RESIDUALS, A.MAD]) + """, e as (select quantile_cont(prediction, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e from res),
b as (select res.*, greatest(0, least(4, len(list_filter(e, lambda x: x <= prediction)) - 1))::int as bin from res, e),
bc as (select target, bin, median(raw_residual) as bc from b group by 1, 2),
bs as (select target, bin, bc, 1.4826 * median(abs(raw_residual - bc)) as bs, count(*) as n from b join bc using (target, bin) group by 1, 2, 3)
select event_id, target, b.bin, round((raw_residual - case when n >= 2 and bs > 0 then bc else center end) / case when n >= 2 and bs > 0 then bs else scale end, 6) + 0.0 as normalized_residual
from b join mad using (target) join bs on b.target = bs.target and b.bin = bs.bin""")
def normalize_condition_binned(spark, sf_dir):
    long = A.residuals(spark, sf_dir)
    edges = residuals.condition_edges(long, "prediction", 5)
    return rounded(residuals.normalize_by_condition(long, edges, "prediction").select("event_id", "target", "bin", "normalized_residual"), "normalized_residual")


@query(BASE + " select event_id, turbine_id, target, t, round(ewma, 6) + 0.0 as ewma, round(upper, 6) + 0.0 as upper, state from st")
def ewma_states(spark, sf_dir):
    return rounded(states(spark, sf_dir).select("event_id", "turbine_id", "target", F.col("t").cast("long").alias("t"), "ewma", "upper", "state"), "ewma", "upper")


@query(BASE + " select event_id, t, round(upper * sqrt(1 - pow(0.8, 2 * t)), 6) + 0.0 as upper, case when ewma > upper * sqrt(1 - pow(0.8, 2 * t)) then 1 when ewma < lower * sqrt(1 - pow(0.8, 2 * t)) then -1 else 0 end as state from st")
def ewma_time_varying_limits(spark, sf_dir):
    return rounded(states(spark, sf_dir, True).select("event_id", F.col("t").cast("long").alias("t"), "upper", "state"), "upper")


@query(BASE + """ select turbine_id, target, count(*) as n_points, count(*) filter (state <> 0) as n_exceed, round(max(ewma), 6) as max_ewma, round(count(*) filter (state <> 0) / count(*), 6) as empirical_rate,
round(0.0026997960632601965::double, 6) as theoretical_rate, round(count(*) filter (state <> 0) / count(*) / 0.0026997960632601965::double, 4) as inflation, count(*) filter (state <> 0) / count(*) / 0.0026997960632601965::double > 2.0 as material from st group by 1, 2""")
def in_control_report(spark, sf_dir):
    """The flagship: exceedances of each stream, with the empirical and the theoretical rate."""
    return residuals.in_control_report(states(spark, sf_dir))


# ---- detection

_STREAM = "partition by turbine_id, target order by timestamp, event_id"


def _detector(df: DataFrame) -> DataFrame:
    return df.select("event_id", "turbine_id", "target", "state")


@query(W + ", ".join([A.RESIDUALS, A.MAD]) + f" select event_id, turbine_id, target, case when sum((normalized_residual > 0.5)::int) over w = 3 then 1 when sum((normalized_residual < -0.5)::int) over w = 3 then -1 else 0 end as state from norm window w as ({_STREAM} rows between 2 preceding and current row)")
def comparator_consecutive(spark, sf_dir):
    return _detector(detect.consecutive(normalized(spark, sf_dir), "normalized_residual", 0.5, 3, order=("timestamp", "event_id")))


@query(W + ", ".join([A.RESIDUALS, A.MAD]) + f""", u as (select event_id, turbine_id, target, sum((normalized_residual > 0.8)::int) over w as up, sum((normalized_residual < -0.8)::int) over w as down from norm window w as ({_STREAM} rows between 5 preceding and current row))
select event_id, turbine_id, target, case when up >= 3 and up >= down then 1 when down >= 3 then -1 else 0 end as state from u""")
def comparator_rolling_count(spark, sf_dir):
    return _detector(detect.rolling_count(normalized(spark, sf_dir), "normalized_residual", 0.8, 6, 3, order=("timestamp", "event_id")))


@query(W + ", ".join([A.RESIDUALS, A.MAD]) + f" select event_id, turbine_id, target, case when count(*) over w = 8 and avg(normalized_residual) over w > 0.6 then 1 when count(*) over w = 8 and avg(normalized_residual) over w < -0.6 then -1 else 0 end as state from norm window w as ({_STREAM} rows between 7 preceding and current row)")
def comparator_rolling_mean(spark, sf_dir):
    return _detector(detect.rolling_mean(normalized(spark, sf_dir), "normalized_residual", 0.6, 8, order=("timestamp", "event_id")))


@query(BASE + ", " + GRID_SQL + """ select turbine_id, timestamp, max(state) filter (target = 'error') as state_error, round(max(ewma) filter (target = 'error'), 6) + 0.0 as ewma_error,
max(state) filter (target = 'purchase') as state_purchase, round(max(ewma) filter (target = 'purchase'), 6) + 0.0 as ewma_purchase from grid where target in ('error', 'purchase') group by 1, 2""")
def coordinated_states(spark, sf_dir):
    rows = cells_of_states(spark, sf_dir).where(F.col("target").isin(TWO))
    return rounded(detect.coordinate(rows, TWO), "ewma_error", "ewma_purchase")


#: Lower limits, so that the alarms of these small tables are many.
_LOW = ", low as (select turbine_id, target, timestamp, ewma, upper, case when ewma > upper / 3 then 1 when ewma < -upper / 3 then -1 else 0 end as state from grid where target in ('error', 'purchase'))"
_ALARM = ", al as (select turbine_id, timestamp, count(*) = 2 and (count(*) filter (state = 1) >= 1 or count(*) filter (state = -1) >= 1) as alarm from low group by 1, 2)"


def low_states(spark, sf_dir) -> DataFrame:
    rows = cells_of_states(spark, sf_dir).where(F.col("target").isin(TWO))
    return rows.withColumn("state", F.when(F.col("ewma") > F.col("upper") / 3, 1).when(F.col("ewma") < -F.col("upper") / 3, -1).otherwise(0))


def alarms(spark, sf_dir) -> DataFrame:
    return detect.coordinated_alarms(low_states(spark, sf_dir), 2, 1)


@query(BASE + ", " + GRID_SQL + _LOW + _ALARM + " select * from al")
def coordinated_alarms(spark, sf_dir):
    return alarms(spark, sf_dir)


def curve(spark, sf_dir, k: int = 1) -> DataFrame:
    return detect.sweep(cells_of_states(spark, sf_dir).where(F.col("target").isin(TWO)), 3.0, 2, SWEEP, k)


SWEEP = [0.25 * k for k in range(1, 17)]
_CURVE = """, pts as (select turbine_id, timestamp, count(*) as n, list_sort(list(ewma / upper * 3), 'DESC') as up, list_sort(list(-ewma / upper * 3), 'DESC') as down from grid where target in ('error', 'purchase') group by 1, 2),
kth as (select turbine_id, timestamp, case when n = 2 then greatest(up[{k}], down[{k}]) else -1e300 end as v from pts),
fl as (select turbine_id, timestamp, m * 0.25 as multiplier, v > m * 0.25 as alarm from kth, range(1, 17) r(m)),
ed as (select *, alarm and not coalesce(lag(alarm) over (partition by turbine_id, multiplier order by timestamp), false) as edge from fl),
ty as (select sum(s) / (365.25 * 86400) as y from (select turbine_id, date_diff('second', min(timestamp), max(timestamp)) + median(d) as s from (select turbine_id, timestamp, date_diff('second', lag(timestamp) over (partition by turbine_id order by timestamp), timestamp) as d from kth) group by 1)),
curve as (select multiplier::double as multiplier, count(*) filter (edge) as n_events, count(*) filter (alarm) as n_alarmed, count(*) as n_points, count(*) filter (alarm) / count(*) as alarm_fraction, count(*) filter (edge) / any_value(y) as events_per_year from ed, ty group by 1)"""


@query(BASE + ", " + GRID_SQL + _CURVE.format(k=1) + " select multiplier, n_events, n_alarmed, n_points, round(alarm_fraction, 6) as alarm_fraction, round(events_per_year, 6) as events_per_year from curve")
def threshold_sweep(spark, sf_dir):
    return rounded(curve(spark, sf_dir), "alarm_fraction", "events_per_year")


@query(BASE + ", " + GRID_SQL + _CURVE.format(k=1) + """, seg as (select multiplier as m0, events_per_year as r0, lead(multiplier) over (order by multiplier) as m1, lead(events_per_year) over (order by multiplier) as r1 from curve),
x as (select rate::double as rate, m1, case when r0 = r1 then m1 else m0 + (r0 - rate) / (r0 - r1) * (m1 - m0) end as m, m1 is not null and rate between least(r0, r1) and greatest(r0, r1) as inside from seg, (select unnest([5, 20, 60, 120, 100000]) as rate))
select rate, round(arg_max(m, m1) filter (inside), 6) as multiplier from x group by 1""")
def matched_multiplier(spark, sf_dir):
    return rounded(detect.match_rates(curve(spark, sf_dir), [5, 20, 60, 120, 100000]), "multiplier")


@query(BASE + ", " + GRID_SQL + """, pts as (select turbine_id, timestamp, count(*) as n, list_sort(list(ewma / upper * 3), 'DESC') as up, list_sort(list(-ewma / upper * 3), 'DESC') as down from grid where target in ('error', 'purchase') group by 1, 2),
kth as (select turbine_id, timestamp, k, case when n = 2 then greatest(up[k], down[k]) else -1e300 end as v from pts, (select unnest([1, 2]) as k)),
fl as (select turbine_id, timestamp, k, m * 0.25 as multiplier, v > m * 0.25 as alarm from kth, range(1, 17) r(m)),
ed as (select *, alarm and not coalesce(lag(alarm) over (partition by turbine_id, k, multiplier order by timestamp), false) as edge from fl),
ty as (select sum(s) / (365.25 * 86400) as y from (select turbine_id, date_diff('second', min(timestamp), max(timestamp)) + median(d) as s from (select turbine_id, timestamp, date_diff('second', lag(timestamp) over (partition by turbine_id order by timestamp), timestamp) as d from pts) group by 1)),
curve as (select k, multiplier::double as m0, count(*) filter (edge) / any_value(y) as r0 from ed, ty group by 1, 2),
seg as (select *, lead(m0) over (partition by k order by m0) as m1, lead(r0) over (partition by k order by m0) as r1 from curve),
x as (select k, rate::double as rate, m1, case when r0 = r1 then m1 else m0 + (r0 - rate) / (r0 - r1) * (m1 - m0) end as m, m1 is not null and rate between least(r0, r1) and greatest(r0, r1) as inside from seg, (select unnest([5, 20, 60, 120, 100000]) as rate))
select rate, case k when 1 then 'any target' else 'both targets' end as pipeline, round(arg_max(m, m1) filter (inside), 6) as multiplier, arg_max(m, m1) filter (inside) is not null as reachable from x group by rate, k""")
def matched_comparison(spark, sf_dir):
    """Both pipelines at the same rates of false alarms."""
    curves = curve(spark, sf_dir, 1).withColumn("pipeline", F.lit("any target")).unionByName(curve(spark, sf_dir, 2).withColumn("pipeline", F.lit("both targets")))
    return rounded(detect.comparison(curves, [5, 20, 60, 120, 100000]), "multiplier")


_RUNS = """, ch as (select *, case when coalesce(alarm <> lag(alarm) over (partition by turbine_id order by timestamp), true) then 1 else 0 end as new from al),
isl as (select *, sum(new) over (partition by turbine_id order by timestamp) as run from ch),
ep as (select turbine_id, min(timestamp) as start, count(*) as length from isl where alarm group by turbine_id, run)"""


@query(BASE + ", " + GRID_SQL + _LOW + _ALARM + _RUNS + """ select count(*) as n_episodes, count(*) filter (length < 3) as n_isolated, count(*) filter (length >= 3) as n_sustained, quantile_cont(length, 0.5)::double as median_length, quantile_cont(length, 0.9)::double as p90_length from ep""")
def episode_stats(spark, sf_dir):
    return detect.episode_stats(detect.episodes(alarms(spark, sf_dir)))


@query(BASE + ", " + GRID_SQL + _LOW + _ALARM + _RUNS + """, bo as (select turbine_id, timestamp, count(*) = 2 and (count(*) filter (state = 1) >= 2 or count(*) filter (state = -1) >= 2) as alarm from low group by 1, 2),
c2 as (select *, case when coalesce(alarm <> lag(alarm) over (partition by turbine_id order by timestamp), true) then 1 else 0 end as new from bo),
i2 as (select *, sum(new) over (partition by turbine_id order by timestamp) as run from c2), e2 as (select count(*) as length from i2 where alarm group by turbine_id, run),
s as (select b::int as boundary, (select count(*) from ep where length < b) as iso1, (select count(*) from ep where length >= b) as sus1, (select count(*) from e2 where length < b) as iso2, (select count(*) from e2 where length >= b) as sus2 from (select unnest([2, 3, 5, 10]) as b))
select boundary, iso1, sus1, iso2, sus2, case when iso2 < iso1 and (case when sus1 = 0 then sus2 = 0 else abs(sus2 - sus1) <= 0.2 * sus1 end) then 'met' when iso2 < iso1 then 'trade-off' else 'not met' end as verdict from s""")
def matched_verdict(spark, sf_dir):
    low = low_states(spark, sf_dir)
    eps = [detect.episodes(detect.coordinated_alarms(low, 2, k)).withColumn("k", F.lit(k)) for k in (1, 2)]
    bounds = F.explode(F.array(*[F.lit(b) for b in (2, 3, 5, 10)]))
    both = eps[0].unionByName(eps[1]).select("k", "length", bounds.alias("boundary"))
    n = both.groupBy("boundary").agg(*[F.count_if((F.col("k") == k) & c).alias(f"{name}{k}") for k in (1, 2) for name, c in (("iso", F.col("length") < F.col("boundary")), ("sus", F.col("length") >= F.col("boundary")))])
    return n.withColumn("verdict", detect.verdict(F.col("iso1"), F.col("sus1"), F.col("iso2"), F.col("sus2"), F.lit(0.0)))


@query(BASE + ", " + ", ".join([GRID_SQL, A.SCADA]) + _LOW + _ALARM + """, pt as (select al.* from al semi join (select turbine_id, timestamp from scada where wind_speed > 80) k using (turbine_id, timestamp)),
e as (select *, alarm and not coalesce(lag(alarm) over (partition by turbine_id order by timestamp), false) as first from pt)
select count(*) as n_rows, count(*) filter (first) as n_episodes, round(count(*) filter (first) / (count(*) * 360.0 / (365.25 * 1440)), 6) as rate from e""")
def slice_rate(spark, sf_dir):
    keys = A.scada(spark, sf_dir).where("wind_speed > 80")
    return rounded(detect.slice_rate(alarms(spark, sf_dir), keys, 360.0), "rate")


# ---- events

_PERSIST = """, z as (select *, case when coalesce(state <> lag(state) over (partition by turbine_id, target order by timestamp), true) then 1 else 0 end as new from low),
zz as (select *, sum(new) over (partition by turbine_id, target order by timestamp) as run from z),
per as (select turbine_id, target, state, min(timestamp) as timestamp, count(*) as length from zz where state <> 0 group by turbine_id, target, state, run having count(*) >= 2)"""
_EVENTS = ", ev as (select event_id, 'T' || (user_id % 6 + 1) as turbine_id, ts as start, case when event_id % 2 = 0 then ts + interval 6 hour end as \"end\" from events where event_type = 'error' and value > 150)"


def runs(spark, sf_dir) -> DataFrame:
    return events.persistent_runs(low_states(spark, sf_dir), 2)


def faults(spark, sf_dir) -> DataFrame:
    e = A.table(spark, sf_dir, "events").where("event_type = 'error' and value > 150")
    return e.select("event_id", A.turbine("user_id").alias("turbine_id"), F.col("ts").alias("start"), F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(6))).alias("end"))


@query(BASE + ", " + GRID_SQL + _LOW + _PERSIST + " select * from per")
def persistent_runs(spark, sf_dir):
    return runs(spark, sf_dir)


@query(BASE + ", " + GRID_SQL + _LOW + _PERSIST + _EVENTS + """ select ev.event_id, ev.turbine_id, ev.start, min(p.timestamp) as detected, round(date_diff('second', min(p.timestamp), ev.start) / 60, 6) as lead_minutes, (floor(date_diff('second', min(p.timestamp), ev.start) / 600) * 10)::bigint as lead_floored
from ev left join per p on p.turbine_id = ev.turbine_id and p.timestamp between ev.start - interval 2 day and ev.start group by 1, 2, 3""")
def event_match(spark, sf_dir):
    return rounded(events.match_events(faults(spark, sf_dir), runs(spark, sf_dir), 2).select("event_id", "turbine_id", "start", "detected", "lead_minutes", "lead_floored"), "lead_minutes")


@query(BASE + ", " + GRID_SQL + _LOW + _PERSIST + _EVENTS + """ select * from per p where not exists (select 1 from ev where ev.turbine_id = p.turbine_id and p.timestamp between ev.start - interval 3 hour and coalesce(ev."end", ev.start))""")
def false_alarm_episodes(spark, sf_dir):
    return events.false_alarms(runs(spark, sf_dir), faults(spark, sf_dir), 0.125)


@query(BASE + ", " + GRID_SQL + _LOW + _PERSIST + _EVENTS + """, m as (select ev.event_id, min(p.timestamp) as d from ev left join per p on p.turbine_id = ev.turbine_id and p.timestamp between ev.start - interval 3 hour and ev.start group by 1),
f as (select count(*) as n_false from per p where not exists (select 1 from ev where ev.turbine_id = p.turbine_id and p.timestamp between ev.start - interval 3 hour and coalesce(ev."end", ev.start)))
select count(*) as n_events, count(d) as n_detected, any_value(n_false) as n_false, count(*) - count(d) as n_missed, case when count(*) >= 2 then round(count(d) / count(*), 6) end as rate from m, f""")
def event_evaluation(spark, sf_dir):
    found, known = runs(spark, sf_dir), faults(spark, sf_dir)
    return events.evaluate(events.match_events(known, found, 0.125), events.false_alarms(found, known, 0.125))


@query(BASE + ", " + GRID_SQL + _LOW + _ALARM + """, k as (select *, row_number() over (partition by turbine_id order by timestamp) as k from al where timestamp >= '2024-01-10')
select turbine_id, count(*) as n_rows, bool_and(alarm) and count(*) = 3 as already from k where k <= 3 group by 1""")
def window_open_flags(spark, sf_dir):
    return events.window_open_flags(alarms(spark, sf_dir), "2024-01-10")


_RAW = """raw as (select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as a, case when o_orderkey % 11 = 0 then '-' when o_orderkey % 13 = 0 then 'soon' else strftime(o_orderdate + to_hours((o_orderkey % 50 - 5)::int), '%Y-%m-%d %H:%M:%S') end as b,
case when o_orderkey % 17 = 0 then 'Gone' when o_orderpriority like '1%' then 'Stop' else 'Warning' end as s from orders)"""


@query(W + _RAW + """, p as (select id, a::timestamp as start, case when b <> '-' then try_cast(b as timestamp) end as e, s, b from raw)
select id, start, e as "end", case when s = 'Gone' then 'unknown status' when b <> '-' and e is null then 'unreadable end' when e < start then 'ends before it starts' end as rejected from p""")
def status_parse(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    key, fmt = F.col("o_orderkey"), "yyyy-MM-dd HH:mm:ss"
    end = F.when(key % 11 == 0, "-").when(key % 13 == 0, "soon").otherwise(F.date_format(F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (key % 50 - 5).cast("int")), fmt))
    raw = o.select(key.alias("id"), F.date_format("o_orderdate", fmt).alias("Timestamp start"), end.alias("Timestamp end"), F.when(key % 17 == 0, "Gone").when(F.col("o_orderpriority").startswith("1"), "Stop").otherwise("Warning").alias("Status"))
    rows = events.parse_status(raw)
    return rows.select("id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "rejected")


# ---- censuses and evidence

_H = "date_diff('second', start, \"end\") / 3600"


@query(W + A.STATUS + f""", ms as (select code, string_agg(message || '=' || n, '|' order by message || '=' || n) as messages from (select code, message, count(*) as n from log group by 1, 2) group by 1)
select code, count(*) as n, count(distinct turbine_id) as n_turbines, string_agg(distinct turbine_id, '|' order by turbine_id) as turbines, round(coalesce(sum({_H}), 0), 6) as hours, count("end") as n_timed, count(*) - count("end") as n_untimed, min(start) as first, max(start) as last,
string_agg(distinct status, '|' order by status) as statuses, round(max({_H}), 6) as longest_hours, string_agg(distinct year(start)::varchar, '|' order by year(start)::varchar) as years, any_value(messages) as messages, any_value(contains(lower(messages), 'urgent')) as has_keyword from log join ms using (code) group by code""")
def code_inventory(spark, sf_dir):
    return census.code_inventory(A.status_log(spark, sf_dir), keywords=("urgent",))


@query(W + A.STATUS + f""" select occurrence_id, turbine_id, code, round({_H}, 6) as hours from log where status in ('Stop', 'Warning') and {_H} > 6""")
def long_events(spark, sf_dir):
    return rounded(census.long_events(A.status_log(spark, sf_dir)).select("occurrence_id", "turbine_id", "code", "hours"), "hours")


_STEPS = """, st0 as (select turbine_id, lag(start) over (partition by turbine_id order by start) as a, start as b from (select distinct turbine_id, start from log)), sp as (select turbine_id, a as start, b as "end", date_diff('second', a, b) as delta_s from st0 where a is not null)"""


@query(W + A.STATUS + _STEPS + " select delta_s, count(*) as n from sp group by 1 order by n desc, delta_s limit 10")
def frequent_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir)[0]


@query(W + A.STATUS + _STEPS + ' select turbine_id, start, "end", delta_s from sp order by delta_s desc, turbine_id, start limit 10')
def largest_gaps(spark, sf_dir):
    return _intervals(spark, sf_dir)[1]


@query(W + A.STATUS + _STEPS + ", mo as (select turbine_id, delta_s as modal_s, sum(n) over (partition by turbine_id)::bigint as n_intervals, n as k from (select turbine_id, delta_s, count(*) as n from sp group by 1, 2) qualify row_number() over (partition by turbine_id order by n desc, delta_s) = 1) select turbine_id, n_intervals, modal_s, n_intervals - k as n_irregular from mo")
def irregular_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir)[2]


def _intervals(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    return census.interval_census(A.status_log(spark, sf_dir).select("turbine_id", F.col("start").alias("at")), "turbine_id", "at")


@query(W + A.STATUS + f" select status, count(*) as n, round(coalesce(sum({_H}), 0), 6) as hours from log group by 1")
def taxonomy_hours(spark, sf_dir):
    return census.taxonomy_hours(A.status_log(spark, sf_dir), "status")


@query(W + A.STATUS + """ select turbine_id, year(start) as year, count(*) filter (status = 'Stop') as "Stop", count(*) filter (status = 'Warning') as "Warning", count(*) filter (status = 'Communication') as "Communication", count(*) filter (status = 'Informational') as "Informational", """ + ", ".join(f"round(coalesce(sum({_H}) filter (status = '{x}'), 0), 6) as \"{x}_hours\"" for x in ("Stop", "Warning", "Communication", "Informational")) + " from log group by 1, 2")
def turbine_year_pivot(spark, sf_dir):
    return census.turbine_year_pivot(A.status_log(spark, sf_dir), ["Stop", "Warning", "Communication", "Informational"])


@query(W + A.STATUS + """, c as (select code || '-' || (occurrence_id % 400) as code, start from log), y as (select code, string_agg(distinct year(start)::varchar, '|' order by year(start)::varchar) as signature from c group by 1)
select signature, count(*) as n_codes, string_agg(code, ',' order by code) as codes from y group by 1""")
def presence_signature(spark, sf_dir):
    log = A.status_log(spark, sf_dir).withColumn("code", F.concat_ws("-", "code", (F.col("occurrence_id") % 400).cast("string")))
    return census.presence_signature(log)


@query("""with r as (select case when o_orderkey % 7 = 0 then '-' when o_orderkey % 5 = 0 then '' else o_orderpriority end as a, case when o_orderkey % 9 = 0 then null else o_orderstatus end as b from orders)
select 'a' as field, count(*) filter (trim(a) not in ('', '-')) as n_populated, count(*) filter (trim(a) = '-') as n_dash, count(*) filter (a is null or trim(a) = '') as n_empty from r
union all select 'b', count(*) filter (trim(b) not in ('', '-')), count(*) filter (trim(b) = '-'), count(*) filter (b is null or trim(b) = '') from r""")
def completeness(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = A.table(spark, sf_dir, "orders").select(F.when(key % 7 == 0, "-").when(key % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("a"), F.when(key % 9 != 0, F.col("o_orderstatus")).alias("b"))
    return census.completeness(raw, ["a", "b"])


@query(W + A.SCADA + " " + _per_column("select '{c}' as column_name, round(1 - count({c}) / count(*), 6) as null_share, min(timestamp) filter ({c} is not null) as first_known, max(timestamp) filter ({c} is not null) as last_known, round(min({c}), 6) as low, round(max({c}), 6) as high, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, stddev_samp({c}) < 1e-6 as low_variance, least(count(distinct {c}), 200) as n_distinct, count(distinct {c}) = 1 as constant from scada"))
def column_facts(spark, sf_dir):
    return census.column_facts(A.scada(spark, sf_dir), CHANNELS, "timestamp")


_COVER = """, cov as (select distinct turbine_id, timestamp from scada where wind_speed is not null and gearbox_oil_temperature is not null),
dd as (select *, date_diff('second', lag(timestamp) over (partition by turbine_id order by timestamp), timestamp) as d from cov),
mo as (select turbine_id, d as m from (select turbine_id, d, count(*) as n from dd where d is not null group by 1, 2) qualify row_number() over (partition by turbine_id order by n desc, d) = 1),
ru as (select *, sum(case when coalesce(d > m, true) then 1 else 0 end) over (partition by turbine_id order by timestamp) as run from dd join mo using (turbine_id)),
ses as (select turbine_id, min(timestamp) as start, max(timestamp) as "end", count(*) as n from ru group by turbine_id, run)"""


def sessions(spark, sf_dir) -> DataFrame:
    return census.coverage_sessions(A.scada(spark, sf_dir).where("wind_speed is not null and gearbox_oil_temperature is not null"))


@query(W + A.SCADA + _COVER + " select * from ses")
def coverage_sessions(spark, sf_dir):
    return sessions(spark, sf_dir)


_JAN = ", lg as (select event_id as occurrence_id, 'T' || (user_id % 6 + 1) as turbine_id, ts as start, event_type as code from events)"


def january(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("occurrence_id"), A.turbine("user_id").alias("turbine_id"), F.col("ts").alias("start"), F.col("event_type").alias("code"))


@query(W + A.SCADA + _COVER + _JAN + """, j as (select lg.code, case when s.start is null then 0 else date_diff('second', s.start, least(s."end", lg.start)) / 3600 end as h from lg asof left join ses s on lg.turbine_id = s.turbine_id and lg.start >= s.start)
select code, round(min(h), 6) as least, round(median(h), 6) as median, round(max(h), 6) as most, count(*) filter (h >= 720) as n_month, count(*) filter (h = 0) as n_none from j group by 1""")
def preceding_coverage_asof(spark, sf_dir):
    return census.preceding_coverage(january(spark, sf_dir), sessions(spark, sf_dir))


@query(W + A.STATUS + """ select occurrence_id, round(date_diff('second', lag("end") over (partition by turbine_id, code order by start, occurrence_id), start) / 3600, 6) as gap_hours from log""")
def occurrence_gaps(spark, sf_dir):
    return rounded(census.occurrence_gaps(A.status_log(spark, sf_dir), ["occurrence_id"]).select("occurrence_id", "gap_hours"), "gap_hours")


@query(W + A.SCADA + _JAN + """ select occurrence_id, count(s.timestamp) as n, count(s.gearbox_oil_temperature) as n_known, round(sum(s.gearbox_oil_temperature), 6) as total from lg left join scada s on s.turbine_id = lg.turbine_id and s.timestamp >= lg.start - interval 60 day and s.timestamp < lg.start group by 1""")
def preceding_window_stats(spark, sf_dir):
    found = census.preceding_stats(A.scada(spark, sf_dir), january(spark, sf_dir), "gearbox_oil_temperature")
    return found.select("occurrence_id", "n", "n_known", F.round(F.col("mean") * F.col("n_known"), 6).alias("total"))


@query(W + A.STATUS + """, t as (select turbine_id, min(start) - interval 120 day as a, max(start) + interval 120 day as b from log where code = '1-URGENT' group by 1) select occurrence_id from log join t using (turbine_id) where start between a and b""")
def surrounding_rows(spark, sf_dir):
    return census.surrounding_rows(A.status_log(spark, sf_dir), "1-URGENT").select("occurrence_id")


@query(W + A.SCADA + """, b as (select turbine_id, (active_power > 40)::int + (active_power > 80)::int + (active_power > 120)::int as bin, wind_speed as x, gearbox_oil_temperature as y from scada where active_power is not null and wind_speed is not null and gearbox_oil_temperature is not null)
select turbine_id, bin, count(*) as n, case when count(*) >= 3 then round(corr(x, y), 6) end as corr from b group by 1, 2""")
def corr_by_bin(spark, sf_dir):
    return census.correlation_by_bin(A.scada(spark, sf_dir), "wind_speed", "gearbox_oil_temperature", "active_power", [40.0, 80.0, 120.0], ["turbine_id"])


@query(W + A.SCADA + """, b as (select turbine_id, (active_power > 40)::int + (active_power > 80)::int + (active_power > 120)::int as bin, gearbox_oil_temperature as y from scada where active_power is not null and gearbox_oil_temperature is not null)
select turbine_id, bin, count(*) as n, """ + ", ".join(f"case when count(*) >= 3 then round({f}(y), 6) end as {n}" for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))) + " from b group by 1, 2")
def describe_by_bin(spark, sf_dir):
    return census.describe_by_bin(A.scada(spark, sf_dir), "gearbox_oil_temperature", "active_power", [40.0, 80.0, 120.0], ["turbine_id"])


@query(W + A.SCADA + " select turbine_id, count(*) as n, round(corr(wind_speed, gearbox_oil_temperature), 6) as corr from scada where wind_speed is not null and gearbox_oil_temperature is not null group by 1")
def correlation_overall(spark, sf_dir):
    known = A.scada(spark, sf_dir).where("wind_speed is not null and gearbox_oil_temperature is not null")
    return known.groupBy("turbine_id").agg(F.count("*").alias("n"), F.round(F.corr("wind_speed", "gearbox_oil_temperature"), 6).alias("corr"))


@query(W + A.SCADA + """, k as (select turbine_id, gearbox_oil_temperature as v from scada where gearbox_oil_temperature is not null),
m as (select turbine_id, r as modal from (select turbine_id, round_even(v, 0) as r, count(*) as n from k group by 1, 2) qualify row_number() over (partition by turbine_id order by n desc, r) = 1)
select turbine_id, modal, round(avg((abs(v - modal) <= 1)::int), 6) as within_1, round(avg((abs(v - modal) <= 2)::int), 6) as within_2 from k join m using (turbine_id) group by 1, 2""")
def modal_profile(spark, sf_dir):
    return census.modal_profile(A.scada(spark, sf_dir), "gearbox_oil_temperature", ["turbine_id"])


@query(W + A.SCADA + " select turbine_id, year(timestamp) as year, count(*) as n, count(*) filter (gearbox_oil_temperature is not null and gearbox_bearing_temperature is not null) as n_covered, round(count(*) filter (gearbox_oil_temperature is not null and gearbox_bearing_temperature is not null) / count(*), 6) as share from scada group by 1, 2")
def covered_fraction(spark, sf_dir):
    return census.covered_fraction(A.scada(spark, sf_dir), A.TARGETS)


@query(W + A.SCADA + " select turbine_id, count(*) as n, count(gearbox_oil_temperature) as n_known, round(1 - count(gearbox_oil_temperature) / count(*), 6) as null_share, round(avg(gearbox_oil_temperature), 6) as mean, round(stddev_samp(gearbox_oil_temperature), 6) as std, round(min(gearbox_oil_temperature), 6) as min, round(max(gearbox_oil_temperature), 6) as max, " + ", ".join(f"round(quantile_cont(gearbox_oil_temperature, {q}), 6) as {n}" for q, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))) + " from scada group by 1")
def describe(spark, sf_dir):
    return stats.describe(A.scada(spark, sf_dir), "gearbox_oil_temperature", ["turbine_id"])


@query("""with k as (select doc_id, lower(text) as t, lower(source) as s from documents)
select doc_id, array_to_string(list_filter(['apache', 'license', 'src1', 'token'], lambda w: contains(t, w) or contains(s, w)), ',') as keywords,
array_to_string(list_filter(['source', 'text'], lambda f: len(list_filter(['apache', 'license', 'src1', 'token'], lambda w: contains(case when f = 'text' then t else s end, w))) > 0), ',') as fields
from k where len(list_filter(['apache', 'license', 'src1', 'token'], lambda w: contains(t, w) or contains(s, w))) > 0""")
def keyword_candidates(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return census.keyword_candidates(d, ["text", "source"], ["license", "token", "apache", "src1"]).select("doc_id", "keywords", "fields")


@query(BASE + " select target, round(max(v), 6) as maximum, arg_max(turbine_id, {'v': v, 't': turbine_id}) as turbine_id from (select target, turbine_id, max(ewma) as v from st where timestamp >= '2024-01-08' and timestamp < '2024-01-20' group by 1, 2) group by 1")
def fleet_max(spark, sf_dir):
    t = F.col("timestamp")
    part = states(spark, sf_dir).where((t >= F.lit("2024-01-08").cast("timestamp_ntz")) & (t < F.lit("2024-01-20").cast("timestamp_ntz")))
    return census.fleet_maximum(part)


@query(BASE + """, p as (select * from (values ('early', timestamp '2024-01-01', timestamp '2024-01-11'), ('late', timestamp '2024-01-11', timestamp '2024-02-01')) x(period, a, b))
select turbine_id, target, period, count(*) as n, round(avg(ewma), 6) as mean_ewma, round(max(ewma), 6) as max_ewma, round(min(ewma), 6) as min_ewma, round(max(abs(normalized_residual)), 6) as max_residual from st join p on timestamp >= a and timestamp < b group by 1, 2, 3""")
def context_stats(spark, sf_dir):
    spans = spark.sql("select * from values ('early', timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-11'), ('late', timestamp_ntz'2024-01-11', timestamp_ntz'2024-02-01') as p(period, start, end)")
    return census.context_stats(states(spark, sf_dir), spans)


# ---- rules

_COORD = ", co as (select turbine_id, timestamp, max(state) filter (target = 'error') as o, max(ewma) filter (target = 'error') as eo, max(state) filter (target = 'purchase') as b, max(ewma) filter (target = 'purchase') as eb from low group by 1, 2)"


def rule_states(spark, sf_dir) -> DataFrame:
    wide = detect.coordinate(low_states(spark, sf_dir), TWO)
    return wide.withColumnsRenamed({"state_error": "state_gearbox_oil_temperature", "ewma_error": "ewma_gearbox_oil_temperature", "state_purchase": "state_gearbox_bearing_temperature", "ewma_purchase": "ewma_gearbox_bearing_temperature"})


@query(BASE + ", " + GRID_SQL + _LOW + _COORD + """, r as (
select turbine_id, timestamp, 'FMEA-001' as rule_id, 'gear_teeth_wear' as mechanism, (o <> 1)::int as v, (o = 1)::int as s from co where o is not null and b is not null
union all select turbine_id, timestamp, 'FMEA-002', 'hss_bearing_failure', (b <> 1)::int, (b = 1)::int from co where o is not null and b is not null
union all select turbine_id, timestamp, 'FMEA-003', 'lss_planetary_bearing_failure', (o <> 1)::int + (b <> 0)::int, (o = 1)::int + (b = 0)::int from co where o is not null and b is not null
union all select turbine_id, timestamp, 'FMEA-004', 'lubrication_system_degradation', (o <> 1)::int + (b <> 1)::int, (o = 1)::int + (b = 1)::int from co where o is not null and b is not null)
select turbine_id, timestamp, row_number() over (partition by turbine_id, timestamp order by v, s desc, rule_id)::int as rank, rule_id, mechanism, v as n_violated, s as n_support, case when v = 0 then 'plausible_preliminary' else 'weak' end as confidence from r where s > 0""")
def rule_assessment(spark, sf_dir):
    return rules.assess(rule_states(spark, sf_dir), rules.INITIAL, ["gearbox_oil_temperature", "gearbox_bearing_temperature"])


@query(BASE + ", " + GRID_SQL + _LOW + _COORD + """, x as (select *, coalesce(o <> 0, false) or coalesce(b <> 0, false) as odd from co),
y as (select *, sum(new) over (partition by turbine_id order by timestamp) as run from (select *, case when coalesce(odd <> lag(odd) over (partition by turbine_id order by timestamp), true) then 1 else 0 end as new from x))
select turbine_id, timestamp, round(greatest(abs(eo), abs(eb)), 6) as severity, row_number() over (partition by turbine_id, run order by timestamp)::int as persistence, o as state_gearbox_oil_temperature, b as state_gearbox_bearing_temperature from y where odd""")
def diagnostic_events(spark, sf_dir):
    return rounded(rules.diagnostic_events(rule_states(spark, sf_dir), ["gearbox_oil_temperature", "gearbox_bearing_temperature"]), "severity")


# ---- statistics and metrics


@query(W + A.RESIDUALS + """ select turbine_id, target, count(*) as n, round(sqrt(avg(power(prediction - actual, 2))), 6) as rmse, round(avg(abs(prediction - actual)), 6) as mae, round(1 - sum(power(prediction - actual, 2)) / nullif(var_pop(actual) * count(*), 0), 6) as r2, round(avg(prediction - actual), 6) + 0.0 as bias from res group by 1, 2""")
def regression_metrics(spark, sf_dir):
    return rounded(stats.regression_metrics(A.residuals(spark, sf_dir), ["turbine_id", "target"]), "rmse", "mae", "r2", "bias")


@query(W + A.RESIDUALS + """, e as (select min(prediction) as lo, max(prediction) as hi from res), b as (select res.*, ((prediction > lo + (hi - lo) / 4)::int + (prediction > lo + (hi - lo) * 2 / 4)::int + (prediction > lo + (hi - lo) * 3 / 4)::int) as bin from res, e)
select target, bin, count(*) as n, round(sqrt(avg(power(prediction - actual, 2))), 6) as rmse, round(avg(abs(prediction - actual)), 6) as mae, round(1 - sum(power(prediction - actual, 2)) / nullif(var_pop(actual) * count(*), 0), 6) as r2, round(avg(prediction - actual), 6) + 0.0 as bias from b group by 1, 2""")
def condition_sliced_metrics(spark, sf_dir):
    return rounded(stats.sliced_metrics(A.residuals(spark, sf_dir), "prediction", 4, ["target"]), "rmse", "mae", "r2", "bias")


@query(W + A.RESIDUALS + """, c as (select timestamp, event_id, raw_residual - avg(raw_residual) over () as c from res where target = 'error'),
l as (select c, """ + ", ".join(f"lag(c, {k}) over (order by timestamp, event_id) as c{k}" for k in range(1, 6)) + """ from c)
""" + " union all ".join(f"select {k}::int as lag, round(sum(c * c{k}) / sum(c * c), 6) + 0.0 as acf from l" for k in range(1, 6)))
def acf_lags(spark, sf_dir):
    rows = A.residuals(spark, sf_dir).where("target = 'error'")
    return rounded(stats.autocorrelation(rows, "raw_residual", "timestamp", ["event_id"], [1, 2, 3, 4, 5]), "acf")


@query(W + A.RESIDUALS + """, d as (select row_number() over (order by timestamp, event_id) as i, power(actual - prediction, 2) - power(actual - 60, 2) as d from res where target = 'error'),
n as (select count(*) as n, avg(d) as m, var_pop(d) as v, floor(pow(count(*), 1 / 3.0))::int as lags from d), c as (select i, d - m as c from d, n),
g as (select k.k, sum(a.c * b.c) / (select sum(c * c) from c) as acf from c a, range(1, 200) k(k), c b, n where k.k <= lags and b.i = a.i + k.k group by k.k),
l as (select sum((1 - k / (lags + 1)) * acf) as s from g, n), z as (select n, lags, m / sqrt(v * (1 + 2 * s) / n) as z from n, l), t as (select *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) as t from z)
select n, lags, round(z, 6) as statistic, round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2), 4) + 0.0 as p_value, n < 30 as small from t""")
def dm_test(spark, sf_dir):
    """With the default number of lags. (SQL has no error function; its p-value is a rational approximation, good to 1e-6.)"""
    a = F.col("actual")
    rows = A.residuals(spark, sf_dir).where("target = 'error'").withColumns({"la": (a - F.col("prediction")) * (a - F.col("prediction")), "lb": (a - 60) * (a - 60)})
    r = stats.diebold_mariano(rows, "la", "lb", "timestamp", ["event_id"])
    return spark.createDataFrame([(r["n"], r["lags"], round(r["statistic"], 6), round(r["p_value"], 4), r["small"])], "n long, lags int, statistic double, p_value double, small boolean")


_DRAWS = """, v as (select row_number() over (order by timestamp, event_id) as i, raw_residual * raw_residual as sq from res where target = 'error'),
n as (select count(*) as n, ((count(*) + 7) // 8) as blocks from v),
dr as (select id // blocks as rep, id % blocks as k, (('0x' || substr(md5('42:' || id), 1, 12))::bigint % (n - 8 + 1)) + 1 as s from n, range(200 * blocks) r(id)),
tk as (select rep, s + j as i from dr, n, range(8) b(j) where j < case when k = blocks - 1 then n - (blocks - 1) * 8 else 8 end),
st as (select rep, sqrt(avg(sq)) as v from tk join v using (i) group by 1)"""


@query(W + A.RESIDUALS + _DRAWS + """ select round((select sqrt(avg(sq)) from v), 6) as estimate, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(*) as replicates from st""")
def block_bootstrap_ci(spark, sf_dir):
    rows = A.residuals(spark, sf_dir).where("target = 'error'").select("timestamp", "event_id", "raw_residual")
    squares = {"sq": F.col("raw_residual") * F.col("raw_residual")}
    return rounded(stats.bootstrap(rows, "timestamp", ["event_id"], squares, F.sqrt("sq"), 8, 200), "estimate", "low", "high")


@query(W + A.RESIDUALS + """, o as (select 'threshold_' || p as parameter, (select count(*) from res where abs(raw_residual) > p)::double as outcome from (select unnest([20, 40, 60]) as p) union all select 'threshold_20', 100.0) select parameter, max(outcome) - min(outcome) as spread from o group by 1""")
def tornado(spark, sf_dir):
    long = A.residuals(spark, sf_dir)
    n = long.agg(*[F.count_if(F.abs("raw_residual") > p).cast("double").alias(f"threshold_{p}") for p in (20, 40, 60)])
    rows = n.unpivot([], [f"threshold_{p}" for p in (20, 40, 60)], "parameter", "outcome").unionByName(spark.sql("select 'threshold_20' as parameter, 100.0d as outcome"))
    return stats.tornado(rows)


# ---- models


def schema_of_events():
    from thermarc.schema import Schema, Variable

    return Schema(
        "1.0.0",
        (
            Variable("timestamp", "timestamp"), Variable("turbine_id", "turbine_id"),
            *(Variable(c, "predictor", "", *BOUNDS[c]) for c in A.PREDICTORS), *(Variable(c, "target") for c in A.TARGETS),
        ),
    )


def _features(*predictors: str, targets=tuple(A.TARGETS)):
    from thermarc.guards import FeatureConfig

    return FeatureConfig(predictors or tuple(A.PREDICTORS), tuple(targets))


def complete(spark, sf_dir) -> DataFrame:
    return models.known_rows(A.scada_days(spark, sf_dir), *A.PREDICTORS, *A.TARGETS)


@query(W + A.SCADA + """, k as (select * from scada where wind_speed is not null and gearbox_oil_temperature is not null), c as (select regr_slope(gearbox_oil_temperature, wind_speed) as b, regr_intercept(gearbox_oil_temperature, wind_speed) as a from k)
select turbine_id, timestamp, round(a + b * wind_speed, 5) + 0.0 as prediction from k, c""")
def ols_baseline_single(spark, sf_dir):
    rows = models.known_rows(A.scada(spark, sf_dir), "wind_speed", "gearbox_oil_temperature")
    m = models.create("linear").fit(rows, _features("wind_speed", targets=["gearbox_oil_temperature"]), schema_of_events())
    return m.predict(rows).select("turbine_id", "timestamp", (F.round("prediction_gearbox_oil_temperature", 5) + F.lit(0.0)).alias("prediction"))


#: Least squares with three predictors by their covariances: the inverse of a symmetric matrix, written out.
_NORMAL = f""", k as (select turbine_id, timestamp, wind_speed as x1, active_power as x2, ambient_temperature as x3, gearbox_oil_temperature as oil, gearbox_bearing_temperature as bearing from days where {' and '.join(f'{c} is not null' for c in CHANNELS)}),
m as (select avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, var_pop(x1) as s11, var_pop(x2) as s22, var_pop(x3) as s33, covar_pop(x1, x2) as s12, covar_pop(x1, x3) as s13, covar_pop(x2, x3) as s23 from k),
tg as (""" + " union all ".join(f"select 'gearbox_{t}_temperature' as target, avg({t}) as my, var_pop({t}) as vy, covar_pop(x1, {t}) as c1, covar_pop(x2, {t}) as c2, covar_pop(x3, {t}) as c3 from k" for t in ("oil", "bearing")) + """),
ad as (select *, s22 * s33 - s23 * s23 as a11, s13 * s23 - s12 * s33 as a12, s12 * s23 - s13 * s22 as a13, s11 * s33 - s13 * s13 as a22, s12 * s13 - s11 * s23 as a23, s11 * s22 - s12 * s12 as a33 from m, tg),
be as (select *, (a11 * c1 + a12 * c2 + a13 * c3) / (s11 * a11 + s12 * a12 + s13 * a13) as b1, (a12 * c1 + a22 * c2 + a23 * c3) / (s11 * a11 + s12 * a12 + s13 * a13) as b2, (a13 * c1 + a23 * c2 + a33 * c3) / (s11 * a11 + s12 * a12 + s13 * a13) as b3 from ad)"""


@query(W + A.DAYS + _NORMAL + """ select d.turbine_id, d.timestamp, """ + ", ".join(f"round(max(my + b1 * (wind_speed - m1) + b2 * (active_power - m2) + b3 * (ambient_temperature - m3)) filter (target = '{t}'), 5) + 0.0 as baseline_{t}" for t in A.TARGETS) + " from days d, be group by 1, 2")
def ols_baseline_multi(spark, sf_dir):
    m = models.create("linear", "baseline").fit(complete(spark, sf_dir), _features(), schema_of_events())
    return m.predict(A.scada_days(spark, sf_dir)).select("turbine_id", "timestamp", *[(F.round(f"baseline_{t}", 5) + F.lit(0.0)).alias(f"baseline_{t}") for t in A.TARGETS])


def small_search() -> Tuning:
    """The whole search as configured: twelve candidates of up to 600 trees. It has its name from when it was smaller; tests replace it by one that is."""
    return Tuning()


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = stored(split.by_fractions(complete(spark, sf_dir), "timestamp", ["turbine_id"]), "parts")
    return rows.where("partition = 'train'").drop("partition"), rows.where("partition = 'validation'").drop("partition")


@query()
def gbt_nbm(spark, sf_dir):
    """The first candidate of the search, with as many trees as the validation rows allow."""
    t = small_search()
    train, validation = _parts(spark, sf_dir)
    m = models.create("gbt", **t.fixed(), **t.candidates()[0]).fit(train, _features(), schema_of_events(), validation=validation)
    return m.predict(A.scada_days(spark, sf_dir)).select("turbine_id", "timestamp", *[F.round(f"prediction_{t}", 5).alias(f"prediction_{t}") for t in A.TARGETS])


@query()
def tuning_grid(spark, sf_dir):
    t = small_search()
    train, validation = _parts(spark, sf_dir)
    base = models.create("linear", "baseline").fit(train, _features(), schema_of_events())
    errors = models.target_rmse(base.predict(validation), tuple(A.TARGETS), "baseline")
    _, trials = models.tune(train, validation, _features(), schema_of_events(), t.candidates(), errors, t.selection, **t.fixed())
    return spark.createDataFrame([(x["max_depth"], x["learning_rate"], x["subsample"], x["score"]) for x in trials], "max_depth int, learning_rate double, subsample double, score double")


@query()
def joint_nbm(spark, sf_dir):
    """Joint trees of both targets: the first candidate of the search, with all of its trees and patience."""
    t = small_search()
    train, validation = _parts(spark, sf_dir)
    m = models.create("joint", **t.fixed(), **t.candidates()[0]).fit(train, _features(), schema_of_events(), validation=validation)
    return m.predict(A.scada_days(spark, sf_dir)).select("turbine_id", "timestamp", *[F.round(f"prediction_{t}", 5).alias(f"prediction_{t}") for t in A.TARGETS])


@query()
def joint_tuning_grid(spark, sf_dir):
    """All configured candidates of joint trees."""
    t = small_search()
    train, validation = _parts(spark, sf_dir)
    base = models.create("linear", "baseline").fit(train, _features(), schema_of_events())
    errors = models.target_rmse(base.predict(validation), tuple(A.TARGETS), "baseline")
    _, trials = models.tune(train, validation, _features(), schema_of_events(), t.candidates(), errors, t.selection, kind="joint", **t.fixed())
    return spark.createDataFrame([(x["max_depth"], x["learning_rate"], x["subsample"], x["score"], x["best_iteration"]) for x in trials], "max_depth int, learning_rate double, subsample double, score double, best_iteration int")


_WITHOUT = " union all ".join(
    f"select '{A.PREDICTORS[k - 1]}' as without, target, vy - (s{j}{j} * c{i} * c{i} - 2 * s{i}{j} * c{i} * c{j} + s{i}{i} * c{j} * c{j}) / (s{i}{i} * s{j}{j} - s{i}{j} * s{i}{j}) as v from be" for i, j, k in ((2, 3, 1), (1, 3, 2), (1, 2, 3))
)


@query(W + A.DAYS + _NORMAL + f", e as (select 'none' as without, target, vy - b1 * c1 - b2 * c2 - b3 * c3 as v from be union all {_WITHOUT}) select without, target, round(sqrt(v), 6) as rmse from e")
def predictor_ablation(spark, sf_dir):
    """Errors of the baseline with all predictors and without each."""
    rows, out = stored(complete(spark, sf_dir), "rows"), []
    for drop in [None, *A.PREDICTORS]:
        use = [p for p in A.PREDICTORS if p != drop]
        m = models.create("linear").fit(rows, _features(*use), schema_of_events())
        out += [(drop or "none", t, round(e, 6)) for t, e in models.target_rmse(m.predict(rows), tuple(A.TARGETS), "prediction").items()]
    return spark.createDataFrame(out, "without string, target string, rmse double")


def _experiment(spark, sf_dir):
    """The experiment over days with the whole search and explicit windows."""
    from thermarc.plans import experiment

    return experiment.run(A.scada_days(spark, sf_dir), Config(model=Model(tuning=small_search())), schema_of_events(), A.experiment_windows(spark, sf_dir))


@query()
def pipeline_end_to_end(spark, sf_dir):
    """Metrics of an experiment: main model and baseline, validation and test."""
    got = _experiment(spark, sf_dir)
    return spark.createDataFrame([(m["role"], m["model"], m["partition"], m["target"], m["n"], m["rmse"], m["bias"]) for m in got.metrics], "role string, model string, partition string, target string, n long, rmse double, bias double")


def _extremes(spark, sf_dir, channel: str) -> DataFrame:
    """The six-hour cells with very high values of a channel: the faults (oil) and the maintenance (bearing) of the experiments."""
    end = F.col("timestamp") + F.make_dt_interval(F.lit(0), F.lit(6))
    return A.high_cells(spark, sf_dir, channel, 2.5).select("event_id", "turbine_id", F.col("timestamp").alias("start"), end.alias("end"))


@query()
def experiment_report(spark, sf_dir):
    """What an experiment with joint trees says: accuracy with bootstrap intervals and the comparison with the baseline, alarms in control, events against detections, and the
    diagnosis, as (section, item, name, value)."""
    from thermarc.plans import experiment

    config = Config(model=Model(name="joint", tuning=small_search()))
    config = config.override("healthy_state.fault_pre_exclusion_days", 1).override("detection.control_limit_sigma", 1.0).override("detection.persistence", 2)
    got = experiment.run(A.scada_days(spark, sf_dir), config, schema_of_events(), A.experiment_windows(spark, sf_dir), faults=_extremes(spark, sf_dir, A.TARGETS[0]), maintenance=_extremes(spark, sf_dir, A.TARGETS[1]))
    rows = [("trial", f"{t['max_depth']}/{t['learning_rate']}/{t['subsample']}", "score", t["score"]) for t in got.trials]
    for r in experiment.accuracy(got, config, replicates=200, parts=("test",)):
        rows += [("accuracy", f"{r['role']}/{r['target']}", k, float(v)) for k, v in r.items() if isinstance(v, int | float)]
    rows += [("in_control", r["target"], k, float(r[k])) for r in got.in_control for k in ("n_points", "n_exceed", "empirical_rate", "theoretical_rate")]
    rows += [("events", "all", k, float(v)) for k, v in (got.evaluation or {}).items() if v is not None]
    said = experiment.diagnosis(got, config)
    n = said.agg(F.count("*").alias("n"), F.count_if(F.contains(F.col("text"), F.lit("FMEA-"))).alias("n_explained")).first()
    rows += [("diagnosis", "all", k, float(n[k])) for k in ("n", "n_explained")]
    return spark.createDataFrame(rows, "section string, item string, name string, value double")


# ---- pipelines at matched rates, for several smoothing weights

SWEEP_BASE, SWEEP_EXTENSION, SWEEP_STEP, SWEEP_END = tuple(0.5 + 0.25 * k for k in range(9)), (2.75, 3.0, 3.25), 0.5, 6.0
SWEEP_RATES = (200.0, 100.0, 60.0, 30.0, 10.0)
HALF = "2024-01-16"


def sweep_points(spark, sf_dir) -> DataFrame:
    """Levels of both targets on a common grid: the last of each turbine, target and six hours, for three weights."""
    n = normalized(spark, sf_dir)
    smoothed = residuals.ewmas(n, matched.LAMBDAS, order=("timestamp", "event_id"))
    cell = F.date_trunc("DAY", "timestamp").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.floor(F.hour("timestamp") / 6) * 6).cast("int"))
    last = [F.max_by(f"ewma_{i}", F.struct("timestamp", "event_id")).alias(f"ewma_{i}") for i in range(len(matched.LAMBDAS))]
    cells = smoothed.where(F.col("target").isin(TWO)).groupBy("turbine_id", "target", cell.alias("timestamp")).agg(*last)
    return matched.points(cells, residuals.sigmas_of(n), TWO)


def _values(numbers) -> str:
    return ", ".join(map(str, numbers))


_LEVELS = f""", lam as (select unnest([{_values(matched.LAMBDAS)}])::double as weight),
e3 as (select a.turbine_id, a.target, a.timestamp, a.t, weight, sum(weight * pow(1 - weight, a.t - b.t) * b.normalized_residual) as ewma
  from seq a join seq b on a.turbine_id = b.turbine_id and a.target = b.target and b.t <= a.t and a.t - b.t < 400, lam where a.target in ('error', 'purchase') group by all),
g3 as (select turbine_id, target, weight, date_trunc('day', timestamp)::timestamp + to_hours((hour(timestamp) // 6 * 6)::int) as timestamp, arg_max(ewma, t) as ewma from e3 group by all),
l3 as (select turbine_id, weight, timestamp, max(ewma / (sigma * sqrt(weight / (2 - weight)))) filter (target = 'error') as a, max(ewma / (sigma * sqrt(weight / (2 - weight)))) filter (target = 'purchase') as b from g3 join sig using (target) group by all),
pp as (select turbine_id, weight, timestamp, 'single_error' as pipeline, abs(a) as level from l3 where a is not null union all select turbine_id, weight, timestamp, 'single_purchase', abs(b) from l3 where b is not null
  union all select turbine_id, weight, timestamp, 'single_union', case when a is not null and b is not null then greatest(abs(a), abs(b)) else '-infinity'::double end from l3
  union all select turbine_id, weight, timestamp, 'coordinated', case when a is not null and b is not null then greatest(least(a, b), least(-a, -b)) else '-infinity'::double end from l3),
pv as (select *, coalesce(lag(level) over (partition by turbine_id, weight, pipeline order by timestamp), '-infinity'::double) as before from pp where {{part}}),
py as (select pipeline, sum(s) / (365.25 * 86400) as turbine_years from (select pipeline, turbine_id, date_diff('second', min(timestamp), max(timestamp)) + median(d) as s
  from (select pipeline, turbine_id, timestamp, date_diff('second', lag(timestamp) over (partition by pipeline, turbine_id order by timestamp), timestamp) as d from (select distinct pipeline, turbine_id, timestamp from pv)) group by 1, 2) group by 1)"""


@query(BASE + _LEVELS.format(part="true") + f""", gr as (select unnest([{_values(sorted({*matched.BASE, *matched.EXTENSION, *SWEEP_BASE, *SWEEP_EXTENSION}))}])::double as multiplier)
select weight, pipeline, multiplier, count(*) filter (level > multiplier and before <= multiplier) as n_events, count(*) filter (level > multiplier) as n_alarmed, count(*) as n_points,
  round(count(*) filter (level > multiplier and before <= multiplier) / any_value(turbine_years), 6) as events_per_year
from pv join py using (pipeline), gr group by 1, 2, 3""")
def sweep_curves(spark, sf_dir):
    """The operating curves of three weights and four pipelines, from one histogram."""
    seen = stored(matched.with_before(sweep_points(spark, sf_dir)), "points")
    grid = sorted({*matched.BASE, *matched.EXTENSION, *SWEEP_BASE, *SWEEP_EXTENSION})
    curve = matched.rated(matched.curves(seen, grid), matched.years(seen, TWO))
    return rounded(curve.drop("turbine_years"), "events_per_year")


def _sweep_report_sql() -> str:
    wide = sorted({*SWEEP_BASE, *SWEEP_EXTENSION, *[SWEEP_BASE[-1] + SWEEP_STEP * k for k in range(9)], *[SWEEP_EXTENSION[-1] + SWEEP_STEP * k for k in range(7)]})
    wide = [m for m in wide if m <= SWEEP_END]
    least = min(SWEEP_RATES)
    match = lambda out, curve: f"""{out}_seg as (select weight, pipeline, multiplier as m0, rate0 as r0, lead(multiplier) over w as m1, lead(rate0) over w as r1 from {curve} window w as (partition by weight, pipeline order by multiplier)),
{out} as (select weight, pipeline, rate, arg_max(m, m1) filter (inside) as multiplier from (select weight, pipeline, rate, m1, case when r0 = r1 then m1 else m0 + (r0 - rate) / (r0 - r1) * (m1 - m0) end as m,
  m1 is not null and rate between least(r0, r1) and greatest(r0, r1) as inside from {out}_seg, rates) group by 1, 2, 3)"""  # noqa: E731
    runs = lambda out, points, at: f"""{out} as (select weight, pipeline, rate, turbine_id, run, count(*) as length from (select *, sum(case when before <= multiplier then 1 else 0 end) over (partition by weight, pipeline, rate, turbine_id order by timestamp) as run
  from {points} join {at} using (weight, pipeline) where level > multiplier) group by all)"""  # noqa: E731
    counts = ", ".join(f"count(*) filter (length < {b}) as isolated_{b}, count(*) filter (length >= {b}) as sustained_{b}" for b in matched.BOUNDARIES)
    zero = ", ".join(f"case when reachable then coalesce({k}_{b}, 0) end as {k}_{b}" for b in matched.BOUNDARIES for k in ("isolated", "sustained"))
    said = ", ".join(
        f"""case when u.achieved is null or c.achieved is null then null when abs(u.achieved - c.achieved) > 0.05 * greatest(u.achieved, c.achieved) then 'not interpretable'
  when c.isolated_{b} < u.isolated_{b} and (case when u.sustained_{b} = 0 then c.sustained_{b} = 0 else abs(c.sustained_{b} - u.sustained_{b}) <= 0.2 * u.sustained_{b} end) then 'met' when c.isolated_{b} < u.isolated_{b} then 'trade-off' else 'not met' end as verdict_{b}"""
        for b in matched.BOUNDARIES
    )
    return (BASE + ", " + A.SCADA + _LEVELS.format(part=f"timestamp < '{HALF}'") + f""",
sv as (select *, coalesce(lag(level) over (partition by turbine_id, weight, pipeline order by timestamp), '-infinity'::double) as before from pp
  semi join (select turbine_id, timestamp from scada where wind_speed > 80) k using (turbine_id, timestamp) where timestamp >= '{HALF}'),
gr as (select unnest([{_values(wide)}])::double as multiplier), rates as (select unnest([{_values(SWEEP_RATES)}])::double as rate),
cu as (select weight, pipeline, multiplier, count(*) filter (level > multiplier and before <= multiplier) / any_value(turbine_years) as rate0 from pv join py using (pipeline), gr group by 1, 2, 3),
en as (select weight, min(rate0) > {least} as more from cu where multiplier = {SWEEP_BASE[-1]} and pipeline in ('single_union', 'coordinated') group by 1),
cv as (select cu.* from cu join en using (weight) where multiplier in ({_values(SWEEP_BASE)}) or (more and multiplier in ({_values(SWEEP_EXTENSION)}))),
su as (select weight, pipeline, multiplier, count(*) filter (level > multiplier and before <= multiplier) / (count(*) * 360.0 / (365.25 * 1440)) as rate0, count(*) * 360.0 / (365.25 * 1440) as slice_years from sv, gr group by 1, 2, 3),
la as (select weight, max(multiplier) as last from cv group by 1),
strict as (select weight, multiplier, min(rate0) as lowest from su join la using (weight) where pipeline in ('single_union', 'coordinated') and multiplier >= last and ((multiplier - last) / {SWEEP_STEP}) % 1 = 0 group by 1, 2),
ch as (select weight, multiplier from (select *, coalesce(max((lowest <= {least})::int) over (partition by weight order by multiplier rows between unbounded preceding and 1 preceding), 0) as low from strict) where low = 0),
us as (select su.* from su semi join (select weight, multiplier from cv union select * from ch) g using (weight, multiplier)),
{match("ma", "cv")}, {match("ms", "us")},
{runs("ep", "pv", "ma")}, {runs("es", "sv", "ma")}, {runs("eb", "pv", "ms")},
nv as (select weight, pipeline, rate, count(*) as n_episodes, quantile_cont(length, 0.5)::double as median_length, quantile_cont(length, 0.9)::double as p90_length, {counts} from ep group by 1, 2, 3),
ns as (select weight, pipeline, rate, count(*) as slice_episodes from es group by 1, 2, 3), nb as (select weight, pipeline, rate, count(*) as back from eb group by 1, 2, 3),
sy as (select weight, pipeline, max(slice_years) as slice_years from us group by 1, 2),
o as (select ma.weight, ma.pipeline, ma.rate, ma.multiplier is not null as reachable, ma.multiplier, case when ma.multiplier is not null then coalesce(nv.n_episodes, 0) / turbine_years end as achieved,
  case when ma.multiplier is not null then coalesce(nv.n_episodes, 0) end as n_episodes, median_length, p90_length, nv.* exclude (weight, pipeline, rate, n_episodes, median_length, p90_length), 1 / turbine_years as resolution, ma.rate * turbine_years < 10 as coarse,
  case when ma.multiplier is not null then coalesce(slice_episodes, 0) / slice_years end as slice_achieved, ms.multiplier as slice_multiplier, case when ms.multiplier is not null then coalesce(back, 0) / turbine_years end as validation_at_slice
  from ma join py using (pipeline) left join nv using (weight, pipeline, rate) left join ns using (weight, pipeline, rate) left join ms using (weight, pipeline, rate) left join nb using (weight, pipeline, rate) left join sy using (weight, pipeline)),
z as (select * replace ({zero}) from o),
v as (select u.weight, u.rate, {said} from z u join z c on u.weight = c.weight and u.rate = c.rate where u.pipeline = 'single_union' and c.pipeline = 'coordinated')
select z.weight, z.pipeline, z.rate, reachable, round(multiplier, 6) as multiplier, round(achieved, 6) as achieved, n_episodes, median_length, round(p90_length, 6) as p90_length, {", ".join(f"{k}_{b}" for b in matched.BOUNDARIES for k in ("isolated", "sustained"))},
  round(resolution, 6) as resolution, coarse, round(slice_achieved, 6) as slice_achieved, round(slice_multiplier, 6) as slice_multiplier, round(validation_at_slice, 6) as validation_at_slice, {", ".join(f"verdict_{b}" for b in matched.BOUNDARIES)}
from z join v using (weight, rate)""")


@query(_sweep_report_sql())
def sweep_report(spark, sf_dir):
    """Weights, rates and pipelines: matched on the first half of the month, looked at over the windy rows of the second."""
    table = stored(sweep_points(spark, sf_dir), "points")
    keys = A.scada(spark, sf_dir).where("wind_speed > 80")
    day = F.lit(HALF).cast("timestamp_ntz")
    report, _ = matched.matched(table.where(F.col("timestamp") < day), table.where(F.col("timestamp") >= day), keys, TWO, rates=SWEEP_RATES, base=SWEEP_BASE, extension=SWEEP_EXTENSION, slice_step=SWEEP_STEP, slice_end=SWEEP_END, step_minutes=360.0)
    return rounded(report, "multiplier", "achieved", "p90_length", "resolution", "slice_achieved", "slice_multiplier", "validation_at_slice")


# ---- findings


def _logged(spark, sf_dir) -> DataFrame:
    """Events as canonical rows with one channel each, in the order of their ids; some without a time, one channel never measured and one always the same."""
    e = A.table(spark, sf_dir, "events")
    channels = [F.when(F.col("event_type") == k, F.col("value")).alias(c) for k, c in A.CHANNELS.items()]
    return e.select("event_id", A.turbine("user_id").alias("turbine_id"), F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("timestamp"), *channels, F.lit(None).cast("double").alias("rotor_speed"), F.lit(1.0).alias("pitch_angle"))


_LOGGED_COLUMNS = ["turbine_id", "timestamp", *A.CHANNELS.values(), "rotor_speed", "pitch_angle"]
_FINDINGS = W + f"""base as (select event_id, 'T' || (user_id % 6 + 1) as turbine_id, case when event_id % 97 <> 0 then ts end as timestamp, {", ".join(f"case when event_type = '{k}' then value end as {c}" for k, c in A.CHANNELS.items())}, null::double as rotor_speed, 1.0::double as pitch_angle from events),
o as (select *, lag(timestamp) over (partition by turbine_id order by timestamp nulls first, event_id) as prev, lag(timestamp) over (partition by turbine_id order by event_id) as prior from base),
st as (select turbine_id, date_sub('second', prev, timestamp) as d, count(*) as n from o where prev is not null and timestamp is not null group by 1, 2),
mo as (select turbine_id, d as modal from st qualify row_number() over (partition by turbine_id order by n desc, d) = 1),
f as (
  select 'TIMESTAMP' as rule, 'ERROR' as level, 'TIMESTAMP.UNPARSEABLE' as code, null as subject, count(*) as n, 'times that could not be read' as message, null as detail from o where timestamp is null having count(*) > 0
  union all select 'TIMESTAMP', 'WARNING', 'TIMESTAMP.DUPLICATE', null, count(*), 'rows of a turbine with a time that it has already', null from o where prev = timestamp having count(*) > 0
  union all select 'TIMESTAMP', 'ERROR', 'TIMESTAMP.NAIVE', 'timestamp', null, 'times without a time zone', null
  union all select 'TIMESTAMP', 'INFO', 'TIMESTAMP.ORDER', turbine_id, count(*), 'rows that stand after later ones', null from o where timestamp < prior group by 4
  union all select 'TIMESTAMP', 'WARNING', 'TIMESTAMP.GAP', turbine_id, sum(n)::bigint, 'steps longer than the usual one', 'usual ' || any_value(modal) || ' largest ' || max(d) from st join mo using (turbine_id) where d > modal group by 4
  union all select 'SCHEMA', 'WARNING', 'SCHEMA.VERSION', '0.9.0', null, 'made under another version of the schema', '1.0.0'
  """ + "".join(f"""union all select 'MISSING', case when count(*) filter ({c} is null) / count(*) >= 0.5 then 'WARNING' else 'INFO' end, 'MISSING.NULLS', '{c}', count(*) filter ({c} is null), 'missing values', round(count(*) filter ({c} is null) / count(*), 6)::varchar from o having count(*) filter ({c} is null) > 0
  union all select 'CONSTANT', 'WARNING', 'CONSTANT.EMPTY', '{c}', null, 'no value at all', null from o having count({c}) = 0
  union all select 'CONSTANT', 'INFO', 'CONSTANT.SINGLE_VALUE', '{c}', null, 'one value only', null from o having count({c}) > 0 and min({c}) = max({c})
  """ for c in _LOGGED_COLUMNS) + "".join(f"union all select 'RANGE', 'ERROR', 'RANGE.IMPOSSIBLE', '{c}', count(*), 'values outside their bounds', '{lo} to {hi}' from o where {c} < {lo} or {c} > {hi} having count(*) > 0\n  " for c, (lo, hi) in BOUNDS.items()) + ") select * from f"


@query(_FINDINGS)
def validation_findings(spark, sf_dir):
    """All rules' findings, from one aggregation."""
    return findings.validate(_logged(spark, sf_dir), schema_of_events(), version="0.9.0", sequence="event_id")


@query(W + A.SCADA + """, p as (select *, case when timestamp < '2024-01-12' then 'train' when timestamp < '2024-01-16' then 'validation' else 'test' end as partition from scada),
m as (select round(floor(date_diff('second', min(timestamp) filter (partition = 'train'), max(timestamp) filter (partition = 'train')) / 86400) / 30.4375, 3) as months, round(min(ambient_temperature) filter (partition = 'train'), 3) as a, round(max(ambient_temperature) filter (partition = 'train'), 3) as b,
  round(min(ambient_temperature) filter (partition = 'test'), 3) as c, round(max(ambient_temperature) filter (partition = 'test'), 3) as d from p),
u as (select string_agg(distinct month(timestamp)::varchar, ',' order by month(timestamp)::varchar) as untrained from p where partition = 'test' and month(timestamp) not in (select month(timestamp) from p where partition = 'train'))
select 'SHORT_TRAINING' as code, months::varchar as detail from m where months < 12 union all select 'UNTRAINED_MONTHS', untrained from u where untrained is not null
union all select 'AMBIENT_BEYOND_TRAINING', 'train ' || a || ' to ' || b || ' test ' || c || ' to ' || d from m where c < a or d > b""")
def coverage_warnings(spark, sf_dir):
    return split.coverage_warnings(split.by_dates(A.scada(spark, sf_dir), "timestamp", "2024-01-12", "2024-01-16"), "timestamp", "ambient_temperature")


# ---- sensitivity

SENSITIVITY = {
    "validation.step_change_window_samples": [6], "validation.step_change_min_magnitude_c": [25.0], "healthy_state.fault_pre_exclusion_days": [0], "healthy_state.maintenance_post_exclusion_days": [0],
    "healthy_state.minimum_active_power_kw": [10.0], "healthy_state.step_change_exclusion_days": [0.25], "residual.normalization": ["sigma"], "detection.lam": [0.5],
    "detection.control_limit_sigma": [2.0], "detection.persistence": [3], "evaluation.event_match_window_days": [1],
}


@query()
def sensitivity_suite(spark, sf_dir):
    """Every provisional setting varied by itself, with step changes switched on so that their settings act: which stage it changes, what comes of it, which conclusions flip."""
    from thermarc.plans import staged

    config = Config(model=Model(name="linear"))
    for path, value in (("healthy_state.exclude_step_changes", True), ("validation.step_change_window_samples", 4), ("validation.step_change_min_magnitude_c", 15.0), ("healthy_state.fault_pre_exclusion_days", 1), ("healthy_state.minimum_active_power_kw", 20.0), ("healthy_state.step_change_exclusion_days", 0.5), ("detection.control_limit_sigma", 0.5), ("detection.persistence", 2)):
        config = config.override(path, value)
    source = staged.Sources("days", stored(A.scada_days(spark, sf_dir), "days"), schema_of_events(), A.experiment_windows(spark, sf_dir), _extremes(spark, sf_dir, A.TARGETS[0]), _extremes(spark, sf_dir, A.TARGETS[1]))
    rows = staged.suite(source, config, SENSITIVITY)
    names = ["n_accepted", "rmse", "baseline_rmse", "n_outside", "n_detections", "n_events", "n_found", "n_false"]
    return spark.createDataFrame([(r["parameter"], r["value"], r["stage"], *[r[n] for n in names], ", ".join(r["flips"])) for r in rows], "parameter string, value string, stage string, " + ", ".join(f"{n} double" for n in names) + ", flips string")

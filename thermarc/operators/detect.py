"""Detectors over streams, coordination of targets, sweeps of the threshold, matching of rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.errors import ConfigError
from thermarc.operators.windows import at_home, islands, with_neighbours, with_previous

STREAM = ("turbine_id", "target")
YEAR_S = 365.25 * 86400
#: The grid of multipliers: 2 to 6 by a quarter, to 12 by a half, to 40 by one.
GRID = [2 + k / 4 for k in range(17)] + [6.5 + k / 2 for k in range(12)] + [13.0 + k for k in range(28)]


def _directions(x: Column, threshold: float) -> tuple[Column, Column]:
    return F.when(x > threshold, 1).otherwise(0), F.when(x < -threshold, 1).otherwise(0)


def _over_last(df: DataFrame, n: int, keys, order, state) -> DataFrame:
    """Adds what `state` makes of the window of the last n rows of the stream."""
    rows, w = with_neighbours(df, list(keys), list(order), before=n - 1)
    return at_home(rows.withColumn("state", state(w.rowsBetween(-(n - 1), 0))), "_t")


def consecutive(df: DataFrame, value: str, threshold: float, n: int, keys=STREAM, order=("timestamp",)) -> DataFrame:
    """state: n exceedances in a row on one side, the last included."""

    def state(w):
        up, down = (F.sum(x).over(w) for x in _directions(F.col(value), threshold))
        return F.when(up == n, 1).when(down == n, -1).otherwise(0)

    return _over_last(df, n, keys, order, state)


def rolling_count(df: DataFrame, value: str, threshold: float, window: int, k: int, keys=STREAM, order=("timestamp",)) -> DataFrame:
    """state: at least k exceedances on one side in the last `window` rows; up wins a tie."""

    def state(w):
        up, down = (F.sum(x).over(w) for x in _directions(F.col(value), threshold))
        return F.when((up >= k) & (up >= down), 1).when(down >= k, -1).otherwise(0)

    return _over_last(df, window, keys, order, state)


def rolling_mean(df: DataFrame, value: str, threshold: float, window: int, keys=STREAM, order=("timestamp",)) -> DataFrame:
    """state of the mean over full windows without a missing value."""

    def state(w):
        mean = F.when(F.count(value).over(w) == window, F.avg(value).over(w))
        return F.when(mean > threshold, 1).when(mean < -threshold, -1).otherwise(0)

    return _over_last(df, window, keys, order, state)


def coordinate(states: DataFrame, targets: list[str]) -> DataFrame:
    """One row for each turbine and timestamp: state_<target> and ewma_<target>, null where a target is missing."""
    aggs = [x for t in targets for x in (F.max(F.when(F.col("target") == t, F.col("state"))).alias(f"state_{t}"), F.max(F.when(F.col("target") == t, F.col("ewma"))).alias(f"ewma_{t}"))]
    return states.groupBy("turbine_id", "timestamp").agg(*aggs)


def coordinated_alarms(states: DataFrame, n_targets: int, k: int | None = None) -> DataFrame:
    """alarm: at least k targets (all, without k) above, or as many below; a point with a missing target never alarms."""
    k = n_targets if k is None else k
    if not 1 <= k <= n_targets:
        raise ConfigError("k must be between 1 and the number of targets", k=k)
    n = states.groupBy("turbine_id", "timestamp").agg(F.count("*").alias("_n"), F.count_if(F.col("state") == 1).alias("_up"), F.count_if(F.col("state") == -1).alias("_down"))
    return n.select("turbine_id", "timestamp", ((F.col("_n") == n_targets) & ((F.col("_up") >= k) | (F.col("_down") >= k))).alias("alarm"))


def rising(flag: str, keys=("turbine_id",), order=("timestamp",)) -> Column:
    """The first row of a run of true flags, as an expression over whole streams; `rises` does not hold a stream in one task."""
    return F.col(flag) & ~F.coalesce(F.lag(flag).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(False))


def rises(flags: DataFrame, flag: str = "alarm", keys=("turbine_id",), order=("timestamp",), out: str = "edge") -> DataFrame:
    """Adds whether a row is the first of a run of true flags."""
    rows = with_previous(flags, list(keys), list(order), [flag])
    return rows.withColumn(out, F.col(flag) & ~F.coalesce(f"prev_{flag}", F.lit(False))).drop(f"prev_{flag}")


def turbine_years(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row: the sum over turbines of last - first + median interval, in years."""
    steps = with_previous(df.select("turbine_id", ts).distinct(), ["turbine_id"], [ts], [ts]).withColumn("_d", F.timestamp_diff("SECOND", F.col(f"prev_{ts}"), F.col(ts)))
    each = steps.groupBy("turbine_id").agg((F.timestamp_diff("SECOND", F.min(ts), F.max(ts)) + F.median("_d")).alias("_s"))
    return each.agg((F.sum("_s") / YEAR_S).alias("turbine_years"))


def sweep(states: DataFrame, base: float, n_targets: int, grid: list[float], k: int | None = None) -> DataFrame:
    """The operating curve: for each multiplier, events (rising edges), alarmed points, their share and events a turbine-year.

    One job: the limits scale with the multiplier, so each row is looked at once for all of them and the alarms
    of a turbine and timestamp are bits of an array; nothing is multiplied by the grid before it is counted.
    """
    k = n_targets if k is None else k
    level = F.col("ewma") / F.col("upper") * base  # the multiplier at which the point is on the limit
    side = lambda c: F.sort_array(F.collect_list(c), asc=False)
    points = states.groupBy("turbine_id", "timestamp").agg(F.count("*").alias("_n"), side(level).alias("_up"), side(-level).alias("_down"))
    # At least k targets are above exactly where the k-th highest level is.
    kth = F.when(F.col("_n") == n_targets, F.greatest(F.get("_up", F.lit(k - 1)), F.get("_down", F.lit(k - 1))))
    points = points.select("turbine_id", "timestamp", F.coalesce(kth, F.lit(float("-inf"))).alias("_kth"))
    points = with_previous(points, ["turbine_id"], ["timestamp"], ["_kth"]).withColumn("_before", F.coalesce("prev__kth", F.lit(float("-inf"))))
    counts = points.agg(F.count("*").alias("n_points"), *[x for i, m in enumerate(grid) for x in (F.count_if(F.col("_kth") > m).alias(f"_a{i}"), F.count_if((F.col("_kth") > m) & (F.col("_before") <= m)).alias(f"_e{i}"))])
    rows = F.array(*[F.struct(F.lit(float(m)).alias("multiplier"), F.col(f"_e{i}").alias("n_events"), F.col(f"_a{i}").alias("n_alarmed")) for i, m in enumerate(grid)])
    curve = counts.select("n_points", F.inline(rows)).crossJoin(F.broadcast(turbine_years(points)))  # each row with the one of years
    return curve.select("multiplier", "n_events", "n_alarmed", "n_points", (F.col("n_alarmed") / F.col("n_points")).alias("alarm_fraction"), (F.col("n_events") / F.col("turbine_years")).alias("events_per_year"))


def match_rates(curve: DataFrame, rates: list[float]) -> DataFrame:
    """The multiplier of each rate: the strictest segment of the curve that brackets it, interpolated; null where none does."""
    if any(r < 0 for r in rates):
        raise ConfigError("a rate can't be negative", rates=rates)
    by = [c for c in ("weight", "pipeline") if c in curve.columns]
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("multiplier")  # the curve has a row for each multiplier
    seg = curve.select(*by, F.col("multiplier").alias("m0"), F.col("events_per_year").alias("r0"), F.lead("multiplier").over(w).alias("m1"), F.lead("events_per_year").over(w).alias("r1"))
    wanted = seg.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    inside = (F.least("r0", "r1") <= F.col("rate")) & (F.col("rate") <= F.greatest("r0", "r1")) & F.col("m1").isNotNull()
    m = F.when(F.col("r0") == F.col("r1"), F.col("m1")).otherwise(F.col("m0") + (F.col("r0") - F.col("rate")) / (F.col("r0") - F.col("r1")) * (F.col("m1") - F.col("m0")))
    return wanted.groupBy(*by, "rate").agg(F.max_by(F.when(inside, m), F.when(inside, F.col("m1"))).alias("multiplier"))


def needed_grid(curve: DataFrame, smallest: float, fine: float = 12.0) -> DataFrame:
    """The curve up to the multiplier `fine`, and beyond it only where the rate there is still above the smallest wanted one."""
    by = ["pipeline"] if "pipeline" in curve.columns else []
    end = curve.where(F.col("multiplier") == fine).select(*by, F.col("events_per_year").alias("_rate"))
    rows = curve.join(end, by, "left") if by else curve.crossJoin(F.broadcast(end))  # one row
    return rows.where((F.col("multiplier") <= fine) | (F.coalesce("_rate", F.lit(float("inf"))) > smallest)).drop("_rate")


def comparison(curves: DataFrame, rates: list[float]) -> DataFrame:
    """(rate, pipeline, multiplier, reachable) of every wanted rate and pipeline, in that order: the only table in which pipelines are compared."""
    return match_rates(curves, rates).withColumn("reachable", F.col("multiplier").isNotNull()).orderBy("rate", "pipeline")


def episodes(flags: DataFrame, flag: str = "alarm", keys=("turbine_id",), order=("timestamp",)) -> DataFrame:
    """Runs of true flags: first row and length."""
    runs = islands(flags, list(keys), list(order), [flag], F.col(flag) != F.col(f"prev_{flag}")).where(F.col(flag))
    return runs.groupBy(*keys, "island").agg(F.min(order[0]).alias("start"), F.count("*").alias("length")).drop("island")


def episode_stats(eps: DataFrame, sustained: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    return eps.groupBy(*by).agg(
        F.count("*").alias("n_episodes"), F.count_if(F.col("length") < sustained).alias("n_isolated"), F.count_if(F.col("length") >= sustained).alias("n_sustained"),
        F.percentile("length", 0.5).alias("median_length"), F.percentile("length", 0.9).alias("p90_length"),
    )


def verdict(single: Column, single_sustained: Column, both: Column, both_sustained: Column, gap: Column, tolerance: float = 0.2, most_gap: float = 0.05) -> Column:
    """Fewer isolated episodes with as many sustained ones (within the tolerance; of none, none) is 'met'; rates too far apart can't be read."""
    alike = F.when(single_sustained == 0, both_sustained == 0).otherwise(F.abs(both_sustained - single_sustained) <= tolerance * single_sustained)
    return F.when(gap > most_gap, "not interpretable").when((both < single) & alike, "met").when(both < single, "trade-off").otherwise("not met")


def slice_rate(flags: DataFrame, keys: DataFrame, step_minutes: float = 10.0) -> DataFrame:
    """Episodes a turbine-year over the rows of `keys` (turbine_id, timestamp), by row time."""
    part = flags.join(keys.select("turbine_id", "timestamp").distinct(), ["turbine_id", "timestamp"], "left_semi")
    n = rises(part, out="_first").agg(F.count("*").alias("n_rows"), F.count_if("_first").alias("n_episodes"))
    years = F.col("n_rows") * step_minutes / (365.25 * 1440)
    return n.withColumn("rate", F.when(years > 0, F.col("n_episodes") / years))

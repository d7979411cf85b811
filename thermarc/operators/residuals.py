"""Residual streams: unpivot, normalizers, control charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.cluster import stored
from thermarc.errors import FitError, GuardError
from thermarc.operators.windows import numbered

#: The scale of a median absolute deviation, and of an interquartile range, for a normal distribution.
MAD_SCALE, IQR_SCALE = 1.4826, 1.349
HEALTHY = ("training", "validation")


def unpivot(wide: DataFrame, ids: list[str], targets: list[str], prediction: str = "prediction_{}") -> DataFrame:
    """One row for each target: actual, prediction, raw_residual = actual - prediction."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("actual"), F.col(prediction.format(t)).alias("prediction")) for t in targets])
    return wide.select(*ids, F.inline(pairs)).withColumn("raw_residual", F.col("actual") - F.col("prediction"))


def _source(source: str) -> None:
    if source not in HEALTHY:
        raise GuardError("threshold statistics come from healthy parts only", source=source)


def sigma_stats(long: DataFrame, source: str = "training", value: str = "raw_residual") -> DataFrame:
    _source(source)
    return long.groupBy("target").agg(F.avg(value).alias("center"), F.stddev_samp(value).alias("scale"), F.count(value).alias("n"))


#: Rank error of the approximate quantiles that bracket an exact one: one in so many.
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and the named percentiles of each group, exact and interpolated. Nulls are left out.

    Approximate quantiles bracket each order statistic; only the few values between them are kept apart, those
    below are counted. So no task holds a group's values. The table of brackets has a row for each group; it is stored, so that Spark knows its
    size: where it is small it is broadcast, where groups are many the rows meet it by their group, and hot groups are split.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    known = df.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).alias("_v"))
    marks = [x for p in shares.values() for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
    rough = stored(known.groupBy("_g").agg(F.count("*").alias("n"), F.percentile_approx("_v", marks, ACCURACY).alias("_q")), "brackets")
    held = known.join(rough, "_g")
    v, q, few = F.col("_v"), F.col("_q"), F.col("n") <= ACCURACY  # of few values the brackets hold all: a rank to the side would be outside
    below = lambda k: ~few & (v < q[2 * k])
    inside = lambda k: few | (v <= q[2 * k + 1])
    places = [F.when(below(k), F.struct(F.lit(k).alias("k"), F.lit(None).cast("double").alias("v"))).when(inside(k), F.struct(F.lit(k).alias("k"), v.cast("double").alias("v"))) for k in range(len(shares))]
    counts = held.select("_g", "n", F.inline(F.array_compact(F.array(*places)))).groupBy("_g", "n", "k", "v").agg(F.count("*").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy("_g", "k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    share = F.get(F.array(*[F.lit(float(p)) for p in shares.values()]), F.col("k"))
    ranked = counts.withColumns({"_upto": upto, "_r": share * (F.col("n") - 1)})
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("v")))
    found = ranked.groupBy("_g", "n", "k", "_r").agg(at(F.floor("_r")).alias("_lo"), at(F.ceil("_r")).alias("_hi"))
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_r") - F.floor("_r"))
    each = found.groupBy("_g", "n").agg(*[F.max(F.when(F.col("k") == k, x)).alias(name) for k, name in enumerate(shares)])
    return each.select(*[F.col("_g")[k].alias(k) for k in keys], "n", *shares)


def _mad(df: DataFrame, keys: list[str], value: str, center: str, scale: str) -> DataFrame:
    """Exact medians: of the values, then of the distances from it."""
    middle = stored(exact_percentiles(df, keys, value, {center: 0.5}).drop("n"), "medians")
    far = df.select(*keys, value).join(middle, keys).withColumn("_far", F.abs(F.col(value) - F.col(center)))  # a row for each group
    return exact_percentiles(far, [*keys, center], "_far", {scale: 0.5}).withColumn(scale, MAD_SCALE * F.col(scale))


def mad_stats(long: DataFrame, source: str = "training", value: str = "raw_residual") -> DataFrame:
    _source(source)
    return _mad(long, ["target"], value, "center", "scale").select("target", "center", "scale", "n")


def percentile_stats(long: DataFrame, source: str = "training", value: str = "raw_residual", low: float = 0.25, high: float = 0.75) -> DataFrame:
    _source(source)
    p = exact_percentiles(long, ["target"], value, {"_low": low, "center": 0.5, "_high": high})
    return p.select("target", "center", ((F.col("_high") - F.col("_low")) / IQR_SCALE).alias("scale"), "n")


NORMALIZERS = {"sigma": sigma_stats, "mad": mad_stats, "percentile": percentile_stats}


def check_stats(stats: DataFrame) -> DataFrame:
    """The statistics, after a check of their few rows."""
    rows = stats.collect()  # a row for each target
    if not rows:
        raise FitError("no statistics: the table is empty")
    if bad := [r["target"] for r in rows if r["n"] < 2 or not r["scale"]]:
        raise FitError("fewer than two values, or no spread", targets=bad)
    return stats


def normalize(long: DataFrame, stats: DataFrame, value: str = "raw_residual") -> DataFrame:
    held = F.broadcast(stats.select("target", "center", "scale"))
    return long.join(held, "target").withColumn("normalized_residual", (F.col(value) - F.col("center")) / F.col("scale")).drop("center", "scale")


def bin_of(edges: list[float], value: Column) -> Column:
    """0 to len(edges) - 2; a missing condition falls into the last bin."""
    n = len(edges) - 1
    place = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return F.when(value.isNull() | F.isnan(value), n - 1).otherwise(F.greatest(F.lit(0), F.least(place, F.lit(n - 1)))).cast("int")


def condition_edges(long: DataFrame, condition: str, bins: int) -> list[float]:
    got = exact_percentiles(long, [], condition, {f"e{k}": k / bins for k in range(bins + 1)}).first()
    if not got:
        raise FitError("the condition has no value", condition=condition)
    return [got[f"e{k}"] for k in range(bins + 1)]


def normalize_by_condition(long: DataFrame, edges: list[float], condition: str, value: str = "raw_residual") -> DataFrame:
    """MAD normalization within bins of a condition; bins of fewer than two values or without spread use their target's."""
    rows = long.withColumn("bin", bin_of(edges, F.col(condition)))
    fine = _mad(rows, ["target", "bin"], value, "_c", "_s").where("n >= 2 and _s > 0").drop("n")
    coarse = mad_stats(long, value=value).select("target", "center", "scale")
    out = rows.join(F.broadcast(coarse), "target").join(F.broadcast(fine), ["target", "bin"], "left")
    return out.withColumn("normalized_residual", (F.col(value) - F.coalesce("_c", "center")) / F.coalesce("_s", "scale")).drop("center", "scale", "_c", "_s")


def ewma(long: DataFrame, lam: float = 0.2, keys: tuple[str, ...] = ("turbine_id", "target"), order: tuple[str, ...] = ("timestamp",), value: str = "normalized_residual", out: str = "ewma") -> DataFrame:
    """z_t = lam x_t + (1 - lam) z_(t-1), z_0 = 0, a missing x counts as 0, rows count and not time. Also `t`, the row's 1-based place.

    Streams are cut into chunks of rows over which the memory fades below 1e-18; a chunk also gets the rows of the one
    before, and in it the recursion is a sum with growing weights. No task holds a stream. Windows only, no Python.
    """
    if not 0 < lam <= 1:
        raise FitError("the smoothing weight must be over 0 and at most 1", lam=lam)
    keep = 1 - lam
    rows = numbered(long, order[0], list(order[1:]), "t", tuple(keys))
    x = F.coalesce(F.col(value), F.lit(0.0))
    if keep == 0:
        return rows.withColumn(out, x)
    size = math.ceil(math.log(1e-18) / math.log(keep))
    home = F.floor((F.col("t") - 1) / size)
    rows = rows.withColumn("_chunk", F.explode(F.array(home, home + 1)))
    k = F.col("t") - 1 - (F.col("_chunk") - 1) * size  # from 0, through the chunk before and this one
    within = Window.partitionBy(*keys, "_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(out, lam * F.pow(F.lit(keep), k) * F.sum(x * F.pow(F.lit(keep), -k)).over(within))
    return rows.where(F.col("_chunk") == home).drop("_chunk")


def ewmas(long: DataFrame, lambdas: tuple[float, ...], keys: tuple[str, ...] = ("turbine_id", "target"), order: tuple[str, ...] = ("timestamp",), value: str = "normalized_residual") -> DataFrame:
    """ewma_0, ewma_1, ... of several weights below 1 in one pass: chunks as long as the slowest weight needs. Also `t`."""
    if not lambdas or not all(0 < x < 1 for x in lambdas):
        raise FitError("the smoothing weights must be over 0 and below 1", lambdas=list(lambdas))
    size = max(math.ceil(math.log(1e-18) / math.log(1 - x)) for x in lambdas)
    if 2 * size * -math.log(1 - max(lambdas)) > 650:  # the growing weights of the fastest would leave the range of doubles
        raise FitError("the smoothing weights are too far apart for one pass", lambdas=list(lambdas))
    rows = numbered(long, order[0], list(order[1:]), "t", tuple(keys))
    home = F.floor((F.col("t") - 1) / size)
    rows = rows.withColumn("_chunk", F.explode(F.array(home, home + 1)))
    k = F.col("t") - 1 - (F.col("_chunk") - 1) * size
    within = Window.partitionBy(*keys, "_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    x = F.coalesce(F.col(value), F.lit(0.0))
    rows = rows.withColumns({f"ewma_{i}": lam * F.pow(F.lit(1 - lam), k) * F.sum(x * F.pow(F.lit(1 - lam), -k)).over(within) for i, lam in enumerate(lambdas)})
    return rows.where(F.col("_chunk") == home).drop("_chunk")


def limit(lam: float, multiplier: float, sigma: Column, t: Column | None = None) -> Column:
    """The steady limit, or with t the one that starts small and grows to it."""
    steady = F.lit(multiplier) * sigma * math.sqrt(lam / (2 - lam))
    return steady if t is None else steady * F.sqrt(1 - F.pow(F.lit(1 - lam), 2 * t))


def with_limits(smoothed: DataFrame, sigmas: DataFrame, lam: float = 0.2, multiplier: float = 3.0, time_varying: bool = False) -> DataFrame:
    """Adds upper, lower, and state: 1 above, -1 below, 0 else. sigmas: (target, sigma)."""
    up = limit(lam, multiplier, F.col("sigma"), F.col("t") if time_varying else None)
    rows = smoothed.join(F.broadcast(sigmas), "target").withColumns({"upper": up, "lower": -up}).drop("sigma")
    return rows.withColumn("state", F.when(F.col("ewma") > F.col("upper"), 1).when(F.col("ewma") < F.col("lower"), -1).otherwise(0))


def sigmas_of(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy("target").agg(F.stddev_samp("normalized_residual").alias("sigma"))


def theoretical_rate(multiplier: float) -> float:
    """Both tails of a normal distribution. Spark has no erf; the driver computes one number."""
    return 1 - math.erf(multiplier / math.sqrt(2))


def in_control_report(states: DataFrame, multiplier: float = 3.0, keys: tuple[str, ...] = ("turbine_id", "target"), material: float = 2.0) -> DataFrame:
    rate = theoretical_rate(multiplier)
    out = states.groupBy(*keys).agg(F.count("*").alias("n_points"), F.count_if(F.col("state") != 0).alias("n_exceed"), F.round(F.max("ewma"), 6).alias("max_ewma"))
    out = out.withColumns({"empirical_rate": F.round(F.col("n_exceed") / F.col("n_points"), 6), "theoretical_rate": F.round(F.lit(rate), 6), "inflation": F.round(F.col("n_exceed") / F.col("n_points") / F.lit(rate), 4)})
    return out.withColumn("material", F.col("inflation") > material)

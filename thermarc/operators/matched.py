"""Pipelines compared at matched rates of false alarms: several smoothing weights, pipelines and rates in one report.

A point's level is the multiplier of the control limit on which it lies, so one number tells for which multipliers it alarms. Pipelines: each target by itself
(single_<target>), any target (single_union), all targets on one side (coordinated; a point that lacks a target alarms in neither of these two).

All weights and pipelines are columns of one table of points. Curves come from a histogram of (place of the level in the grid, place of the
level before): at most grid^2 counts for each weight and pipeline, whatever the points, from which alarms and rising edges of every multiplier are
sums. Only points that alarm at a matched multiplier become rows of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.cluster import stored
from thermarc.operators import detect
from thermarc.operators.windows import carried, with_previous

#: The weights, the wanted rates a turbine-year, and the grids of multipliers.
LAMBDAS = (0.1, 0.2, 0.3)
RATES = (200.0, 100.0, 50.0, 20.0, 10.0, 5.0, 2.0, 1.0, 0.5)
BASE = tuple(2.0 + 0.25 * i for i in range(17)) + tuple(6.5 + 0.5 * i for i in range(12))
EXTENSION = tuple(float(m) for m in range(13, 21))
SLICE_STEP, SLICE_END = 2.0, 40.0
#: Rows from which an episode is sustained: the stated boundary, then those looked at afterwards.
BOUNDARIES = (3, 2, 5, 10)
UNION, COORDINATED = "single_union", "coordinated"


def pipelines(targets: list[str]) -> list[str]:
    return [*[f"single_{t}" for t in targets], UNION, COORDINATED]


def _name(i: int, pipeline: str) -> str:
    return f"level_{i}_{pipeline}"


def points(smoothed: DataFrame, sigmas: DataFrame, targets: list[str], lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """A row for each turbine and timestamp with the level of every weight and pipeline: null where a target's pipeline has no point, minus
    infinity where the other two lack a target. smoothed: turbine_id, timestamp, target and ewma_0, ewma_1, ... in the order of the weights."""
    rows = smoothed.join(sigmas.select("target", "sigma"), "target")  # a row for each target
    level = lambda i, t: F.max(F.when(F.col("target") == t, F.col(f"ewma_{i}") / (F.col("sigma") * math.sqrt(lambdas[i] / (2 - lambdas[i]))))).alias(f"_{i}_{t}")
    wide = rows.groupBy("turbine_id", "timestamp").agg(*[level(i, t) for i in range(len(lambdas)) for t in targets])
    out = ["turbine_id", "timestamp"]
    for i in range(len(lambdas)):
        own = [F.col(f"_{i}_{t}") for t in targets]
        whole = F.lit(True)
        for x in own:
            whole &= x.isNotNull()
        up, down = (own[0], -own[0]) if len(own) == 1 else (F.least(*own), F.least(*[-x for x in own]))
        most = F.abs(own[0]) if len(own) == 1 else F.greatest(*[F.abs(x) for x in own])
        out += [F.abs(x).alias(_name(i, f"single_{t}")) for t, x in zip(targets, own, strict=True)]
        out += [F.coalesce(F.when(whole, x), F.lit(float("-inf"))).alias(_name(i, p)) for p, x in ((UNION, most), (COORDINATED, F.greatest(up, down)))]
    return wide.select(*out)


def _levels(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c.startswith("level_")]


def _apart(table: DataFrame, lambdas: tuple[float, ...]) -> Column:
    """weight, pipeline, level and the level before of every weight and pipeline, as an array."""
    one = lambda c: F.struct(F.lit(float(lambdas[int(c.split("_")[1])])).alias("weight"), F.lit(c.split("_", 2)[2]).alias("pipeline"), F.col(c).alias("level"), F.coalesce(f"prev_{c}", F.lit(float("-inf"))).alias("before"))
    return F.array(*[one(c) for c in _levels(table)])


def with_before(table: DataFrame) -> DataFrame:
    """Points with prev_<level>: the level of the pipeline's point before, of the same turbine."""
    return with_previous(table, ["turbine_id"], ["timestamp"], _levels(table), skip_nulls=True)


def years(table: DataFrame, targets: list[str]) -> DataFrame:
    """(pipeline, turbine_years): by the timestamps at which a pipeline has points."""
    out = detect.turbine_years(table).withColumn("pipeline", F.explode(F.array(F.lit(UNION), F.lit(COORDINATED))))
    for t in targets:
        has = table.where(F.col(_name(0, f"single_{t}")).isNotNull())
        out = out.unionByName(detect.turbine_years(has).withColumn("pipeline", F.lit(f"single_{t}")))
    return out


def curves(table: DataFrame, grid: list[float], lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """(weight, pipeline, multiplier, n_events, n_alarmed, n_points) of each weight and pipeline. table: points with the levels before."""
    held = F.array(*[F.lit(float(m)) for m in grid])
    place = lambda c: F.size(F.filter(held, lambda m: m < c))
    each = table.select(F.inline(_apart(table, lambdas))).where("level is not null")
    counts = each.groupBy("weight", "pipeline", place(F.col("level")).alias("place"), place(F.col("before")).alias("was")).agg(F.count("*").alias("n"))
    counts = stored(counts, "level-histogram")
    n = counts.groupBy("weight", "pipeline").agg(F.sum("n").alias("n_points"))
    alarmed = counts.where("place > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("place") - 1)))
    alarmed = alarmed.groupBy("weight", "pipeline", "k").agg(F.sum("n").alias("n_alarmed"), F.sum(F.when(F.col("was") <= F.col("k"), F.col("n")).otherwise(0)).alias("n_events"))
    every = n.select("weight", "pipeline", "n_points", F.posexplode(held).alias("k", "multiplier"))
    out = every.join(alarmed, ["weight", "pipeline", "k"], "left").na.fill(0, ["n_alarmed", "n_events"])
    return out.select("weight", "pipeline", "multiplier", "n_events", "n_alarmed", "n_points")


def rated(curve: DataFrame, turbine_years: DataFrame) -> DataFrame:
    return curve.join(turbine_years, "pipeline").withColumn("events_per_year", F.col("n_events") / F.col("turbine_years"))


def row_rated(curve: DataFrame, step_minutes: float = 10.0) -> DataFrame:
    """Rates by the time that the rows stand for: for parts of a period."""
    y = F.col("n_points") * step_minutes / (365.25 * 1440)
    return curve.withColumn("turbine_years", y).withColumn("events_per_year", F.when(y > 0, F.col("n_events") / y))


def _strictest(curve: DataFrame) -> DataFrame:
    """(weight, multiplier, lowest): the lower rate of the two compared pipelines."""
    two = curve.where(F.col("pipeline").isin(UNION, COORDINATED))
    return two.groupBy("weight", "multiplier").agg(F.min("events_per_year").alias("lowest"))


def on_grid(curve: DataFrame, smallest: float, base: tuple[float, ...] = BASE, extension: tuple[float, ...] = EXTENSION) -> DataFrame:
    """The curve on the base grid, and on its extension where the rate at the base's end is still above the smallest wanted one."""
    end = _strictest(curve).where(F.col("multiplier") == base[-1]).select("weight", (F.col("lowest") > smallest).alias("_more"))
    return curve.join(end, "weight").where(F.col("multiplier").isin(*base) | (F.col("_more") & F.col("multiplier").isin(*extension))).drop("_more")


def on_slice_grid(curve: DataFrame, used: DataFrame, smallest: float, step: float = SLICE_STEP, end: float = SLICE_END) -> DataFrame:
    """The slice's curve on the grid that the validation curve used, and on in steps until the rate is low enough or the grid ends."""
    last = used.groupBy("weight").agg(F.max("multiplier").alias("_last"))
    rows = curve.join(last, "weight")
    n = (F.col("multiplier") - F.col("_last")) / step
    chain = _strictest(curve).join(last, "weight").where((n >= 0) & (n == F.floor(n)) & (F.col("multiplier") <= end))
    before = Window.partitionBy("weight").orderBy("multiplier").rowsBetween(Window.unboundedPreceding, -1)
    chain = chain.withColumn("_low", F.coalesce(F.max((F.col("lowest") <= smallest).cast("int")).over(before), F.lit(0))).where("_low = 0").select("weight", "multiplier")
    grid = used.select("weight", "multiplier").unionByName(chain).distinct()
    return rows.drop("_last").join(grid, ["weight", "multiplier"])


def episodes(table: DataFrame, at: DataFrame, lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """(weight, pipeline, rate, start, length) of the alarms at a multiplier for each weight, pipeline and rate. at: a few rows weight, pipeline, rate, multiplier."""
    keys = ["weight", "pipeline", "rate", "turbine_id"]
    each = table.select("turbine_id", "timestamp", F.inline(_apart(table, lambdas))).where("level is not null")
    alarmed = each.join(F.broadcast(at.where("multiplier is not null")), ["weight", "pipeline"]).where("level > multiplier")  # weights x pipelines x rates
    runs = carried(alarmed, keys, ["timestamp"], F.when(F.col("before") <= F.col("multiplier"), F.col("timestamp")), "start")
    return runs.groupBy(*keys, "start").agg(F.count("*").alias("length"))


def episode_counts(eps: DataFrame, boundaries: tuple[int, ...] = BOUNDARIES) -> DataFrame:
    both = [x for b in boundaries for x in (F.count_if(F.col("length") < b).alias(f"isolated_{b}"), F.count_if(F.col("length") >= b).alias(f"sustained_{b}"))]
    return eps.groupBy("weight", "pipeline", "rate").agg(F.count("*").alias("n_episodes"), F.percentile("length", 0.5).alias("median_length"), F.percentile("length", 0.9).alias("p90_length"), *both)


def verdict(single: str, both: str, boundary: int, tolerance: float = 0.2, most_gap: float = 0.05) -> Column:
    """detect.verdict of the columns <prefix>_isolated_<b>, ..., with the gap between the achieved rates."""
    a, b = F.col(f"{single}_achieved"), F.col(f"{both}_achieved")
    gap = F.when(F.greatest(a, b) > 0, F.abs(a - b) / F.greatest(a, b)).otherwise(0.0)
    return detect.verdict(*[F.col(f"{p}_{k}_{boundary}") for p in (single, both) for k in ("isolated", "sustained")], gap, tolerance, most_gap)


def matched(validation: DataFrame, monitoring: DataFrame, keys: DataFrame, targets: list[str], lambdas: tuple[float, ...] = LAMBDAS, rates: tuple[float, ...] = RATES, base: tuple[float, ...] = BASE, extension: tuple[float, ...] = EXTENSION, slice_step: float = SLICE_STEP, slice_end: float = SLICE_END, step_minutes: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """The report and the curves on the grids used.

    A row for each weight, rate and pipeline: the multiplier matched on the validation points, what it achieves there (episodes, isolated and sustained ones, lengths), its rate
    over the healthy slice `keys` of the monitoring points, the multiplier matched on that slice and its rate on the validation points; and the verdicts
    at each boundary (of any target against all of them; null where one of the two can't be reached).
    """
    wide = sorted({*base, *extension, *[base[-1] + slice_step * k for k in range(int((slice_end - base[-1]) / slice_step) + 1)], *[extension[-1] + slice_step * k for k in range(int((slice_end - extension[-1]) / slice_step) + 1)]})
    seen = stored(with_before(validation), "validation-points")
    per = stored(years(validation, targets), "turbine-years")
    curve = stored(on_grid(rated(curves(seen, wide, lambdas), per), min(rates), base, extension), "curves")
    part = stored(with_before(monitoring.join(keys.select("turbine_id", "timestamp").distinct(), ["turbine_id", "timestamp"], "left_semi")), "slice-points")
    on_slice = row_rated(curves(part, wide, lambdas), step_minutes)
    used = stored(on_slice_grid(on_slice, curve.select("weight", "multiplier").distinct(), min(rates), slice_step, slice_end), "slice-curves")
    at = stored(detect.match_rates(curve, list(rates)), "matched")
    slice_at = stored(detect.match_rates(used, list(rates)), "slice-matched").withColumnRenamed("multiplier", "slice_multiplier")
    by = ["weight", "pipeline", "rate"]
    counts = episode_counts(episodes(seen, at, lambdas))
    on_keys = episodes(part, at, lambdas).groupBy(*by).agg(F.count("*").alias("slice_episodes"))
    back = episodes(seen, slice_at.withColumnRenamed("slice_multiplier", "multiplier"), lambdas).groupBy(*by).agg(F.count("*").alias("_back"))
    rows = used.groupBy("weight", "pipeline").agg(F.max("turbine_years").alias("slice_years"))
    out = at.join(per, "pipeline").join(counts, by, "left").join(on_keys, by, "left").join(slice_at, by, "left").join(back, by, "left").join(rows, ["weight", "pipeline"], "left")
    known, there = F.col("multiplier").isNotNull(), F.col("slice_multiplier").isNotNull()
    zero = ["n_episodes", *[f"{k}_{b}" for b in BOUNDARIES for k in ("isolated", "sustained")]]
    out = out.withColumns({c: F.when(known, F.coalesce(c, F.lit(0))) for c in zero})
    out = out.withColumns({
        "reachable": known, "achieved": F.when(known, F.col("n_episodes") / F.col("turbine_years")), "resolution": 1 / F.col("turbine_years"), "coarse": F.col("rate") * F.col("turbine_years") < 10,
        "slice_achieved": F.when(known, F.coalesce("slice_episodes", F.lit(0)) / F.col("slice_years")), "validation_at_slice": F.when(there, F.coalesce("_back", F.lit(0)) / F.col("turbine_years")),
    })
    both = ["achieved", *[f"{k}_{b}" for b in BOUNDARIES for k in ("isolated", "sustained")]]
    side = lambda p: out.where(F.col("pipeline") == p).select("weight", "rate", *[F.col(c).alias(f"{p}_{c}") for c in both])
    said = side(UNION).join(side(COORDINATED), ["weight", "rate"])
    comparable = F.col(f"{UNION}_achieved").isNotNull() & F.col(f"{COORDINATED}_achieved").isNotNull()
    said = said.select("weight", "rate", *[F.when(comparable, verdict(UNION, COORDINATED, b)).alias(f"verdict_{b}") for b in BOUNDARIES])
    kept = [*by, "reachable", "multiplier", "achieved", "n_episodes", "median_length", "p90_length", *zero[1:], "resolution", "coarse", "slice_achieved", "slice_multiplier", "validation_at_slice"]
    return out.join(said, ["weight", "rate"], "left").select(*kept, *[f"verdict_{b}" for b in BOUNDARIES]), curve

"""Error metrics, autocorrelation, forecast comparison, bootstrap."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermarc.errors import ConfigError, FitError
from thermarc.operators.residuals import exact_percentiles
from thermarc.operators.windows import numbered


def regression_metrics(df: DataFrame, by: list[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """n, RMSE, MAE, R2 (null without spread) and bias = mean(prediction - actual), in one pass."""
    a, e = F.col(actual), F.col(prediction) - F.col(actual)
    known = df.where(a.isNotNull() & F.col(prediction).isNotNull())
    spread = F.var_pop(a) * F.count(a)
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"), F.avg(e).alias("bias"),
    )


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """Right-closed bins; the first edge is lowered by a thousandth of the range."""
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        low, high = low - pad, high + pad
        return [low + (high - low) * k / bins for k in range(bins + 1)]
    edges = [low + (high - low) * k / bins for k in range(bins + 1)]
    return [edges[0] - 0.001 * (high - low), *edges[1:]]


def sliced_metrics(df: DataFrame, condition: str, bins: int, by: list[str]) -> DataFrame:
    """regression_metrics in equal-width bins of a condition; empty bins don't appear."""
    lo, hi = df.agg(F.min(condition), F.max(condition)).first()
    if lo is None:
        raise FitError("the condition has no value", condition=condition)
    edges = equal_width_edges(lo, hi, bins)
    b = sum((F.when(F.col(condition) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0)).cast("int")
    return regression_metrics(df.where(F.col(condition).isNotNull()).withColumn("bin", b), [*by, "bin"])


def autocorrelation(df: DataFrame, value: str, ts: str, order: list[str], lags: list[int]) -> DataFrame:
    """(lag, acf) of one series in the order (ts, *order): biased, over the whole sum of squares.

    Numbered rows go to cells; the last rows of a cell go to the next one too, so that windows in a cell see every lag.
    """
    rows = numbered(df.where(F.col(value).isNotNull()).select(value, ts, *[c for c in order if c not in (value, ts)]), ts, order, "_i")
    mean = rows.agg(F.avg(value).alias("_m"))
    c = rows.crossJoin(F.broadcast(mean)).select("_i", (F.col(value) - F.col("_m")).alias("_c"))  # rows with one number
    cell = max(1024, 8 * max(lags))
    home = F.floor((F.col("_i") - 1) / cell)
    dealt = c.withColumn("_cell", F.explode(F.array_distinct(F.array(home, F.floor((F.col("_i") - 1 + max(lags)) / cell)))))
    w = Window.partitionBy("_cell").orderBy("_i")
    products = dealt.select("_i", "_cell", (F.col("_c") * F.col("_c")).alias("_all"), *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_p{k}") for k in lags])
    sums = products.where(F.col("_cell") == home).agg(F.sum("_all").alias("_all"), *[F.sum(f"_p{k}").alias(f"_p{k}") for k in lags])
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("_all") > 0, F.col(f"_p{k}") / F.col("_all")).alias("acf")) for k in lags]))
    return sums.select(rows).where("acf is not null")


def block_length(acf: dict[int, float], n: int) -> int:
    """Twice the first lag with a correlation inside the white-noise band, between 2 and n // 4."""
    if n < 8:
        raise FitError("too few values for blocks", n=n)
    if n < 16:
        return 2
    first = next((k for k in sorted(acf) if abs(acf[k]) < 1.96 / math.sqrt(n)), n // 4)
    return max(2, min(2 * first, n // 4))


def default_lags(n: int) -> int:
    """The cube root in floating point, cut off: 64 gives 3, 125 gives 4."""
    return int(n ** (1 / 3))


def diebold_mariano(df: DataFrame, loss_a: str, loss_b: str, ts: str, order: list[str], lags: int | None = None) -> dict:
    """Compares two forecasts by the mean loss difference over its Bartlett long-run variance. The sums are one job; the tail a number."""
    rows = df.where(F.col(loss_a).isNotNull() & F.col(loss_b).isNotNull()).withColumn("_d", F.col(loss_a) - F.col(loss_b))
    n, mean, sq = rows.agg(F.count("*"), F.avg("_d"), F.var_pop("_d")).first()
    if n < 4:
        raise FitError("too few pairs", n=n)
    lags = default_lags(n) if lags is None else lags
    acf = {r["lag"]: r["acf"] for r in autocorrelation(rows, "_d", ts, order, list(range(1, lags + 1))).collect()} if lags else {}
    long_run = sq * (1 + 2 * sum((1 - k / (lags + 1)) * (acf.get(k) or 0.0) for k in range(1, lags + 1)))
    if long_run <= 0:
        return {"n": n, "lags": lags, "statistic": 0.0, "p_value": 1.0, "small": n < 30}
    s = mean / math.sqrt(long_run / n)
    return {"n": n, "lags": lags, "statistic": s, "p_value": math.erfc(abs(s) / math.sqrt(2)), "small": n < 30}


def bootstrap(df: DataFrame, ts: str, order: list[str], terms: dict[str, Column], finish: Column | dict[str, Column], block: int, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Moving-block bootstrap: (estimate, low, high) of `finish`, an expression of the means of `terms`. Of several named
    expressions, from the same draws: (<name>, <name>_low, <name>_high).

    Block starts are drawn by a hash of the seed and the draw's number, whatever the size. Sums of the block that begins at each
    row come from windows over cells of rows (a cell also gets the first rows of the next), so a replicate costs its blocks and not its rows.
    """
    if block < 2 or replicates < 100 or not 0 < confidence < 1:
        raise ConfigError("block of 2 at least, 100 replicates at least, confidence between 0 and 1", block=block, replicates=replicates, confidence=confidence)
    rows = numbered(df, ts, order, "_i").select("_i", *[v.alias(k) for k, v in terms.items()])
    n = rows.count()
    if n <= block:
        raise FitError("the series must be longer than a block", n=n, block=block)
    blocks, cell = -(-n // block), 64 * block
    last = n - (blocks - 1) * block  # the last block is cut so that a replicate has n rows
    home = F.floor((F.col("_i") - 1) / cell)
    dealt = rows.withColumn("_cell", F.explode(F.array_distinct(F.array(home, F.greatest(F.lit(0), F.floor((F.col("_i") - block) / cell))))))
    w = lambda size: Window.partitionBy("_cell").orderBy("_i").rowsBetween(0, size - 1)
    sums = dealt.select("_i", "_cell", *[F.sum(k).over(w(size)).alias(f"{k}_{name}") for k in terms for name, size in (("whole", block), ("cut", last))])
    sums = sums.where(F.col("_cell") == home).drop("_cell")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = df.sparkSession.range(replicates * blocks).select(F.floor(F.col("id") / blocks).alias("rep"), (F.col("id") % blocks).alias("k"), (F.pmod(draw, F.lit(n - block + 1)) + 1).alias("_i"))
    means = [(F.sum(F.when(F.col("k") == blocks - 1, F.col(f"{k}_cut")).otherwise(F.col(f"{k}_whole"))) / n).alias(k) for k in terms]
    several = isinstance(finish, dict)
    wanted = finish if several else {"estimate": finish}
    ends_of = {k: (f"{k}_low", f"{k}_high") if several else ("low", "high") for k in wanted}
    each = drawn.join(sums, "_i").groupBy("rep").agg(*means).select(*[v.alias(f"v_{k}") for k, v in wanted.items()])
    tail = (1 - confidence) / 2
    ends = each.agg(*[F.percentile(f"v_{k}", p).alias(name) for k in wanted for p, name in zip((tail, 1 - tail), ends_of[k], strict=True)], F.count("*").alias("replicates"))
    whole = rows.agg(*[F.avg(k).alias(k) for k in terms]).select(*[v.alias(k) for k, v in wanted.items()])
    return whole.crossJoin(ends)  # one row with one row


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, non-null, null share, mean, spread and quantiles, rounded to six places."""
    shares = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    one = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("n_known"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    ends = exact_percentiles(df, by, value, shares).drop("n").withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    one = one.join(ends, same, "left")
    r = lambda c: F.round(c, 6)
    return one.select(*by, "n", "n_known", r(1 - F.col("n_known") / F.col("n")).alias("null_share"), *[r(c).alias(c) for c in ("mean", "std", "min", "max")], *[r(q).alias(q) for q in shares])


def tornado(outcomes: DataFrame) -> DataFrame:
    """Range of the outcome for each parameter: (parameter, spread)."""
    return outcomes.groupBy("parameter").agg((F.max("outcome") - F.min("outcome")).alias("spread"))


def lag(value: str, k: int, keys: list[str], order: list[str]) -> Column:
    return F.lag(value, k).over(Window.partitionBy(*keys).orderBy(*order))

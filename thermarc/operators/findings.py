"""Validation findings of all rules from one aggregation.

A rule declares aggregates of the rows and turns their totals into findings. The aggregates of all rules are computed together, by turbine and time step, in one
pass over the table (with each row's predecessor, found in cells of the streams); what the rules then read has a row for each turbine and distinct step.

Findings: (rule, level, code, subject, n, message, detail). subject is a column, a turbine or a role; n is null where nothing is counted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.cluster import stored
from thermarc.errors import ConfigError
from thermarc.operators import quality
from thermarc.operators.windows import with_previous
from thermarc.schema import Schema

SCHEMA = "rule string, level string, code string, subject string, n long, message string, detail string"
COLUMNS = ["rule", "level", "code", "subject", "n", "message", "detail"]


@dataclass(frozen=True)
class Table:
    """What rules may ask about: the rows' columns and types, the schema, the version that the rows were made under, the name of a column with their sequence."""

    schema: Schema
    dtypes: dict[str, str]
    version: str | None = None
    sequence: str | None = None
    ts: str = "timestamp"
    turbine: str = "turbine_id"

    def measured(self) -> list[str]:
        return [c for c in self.dtypes if not c.startswith("_") and c != self.sequence]


@dataclass(frozen=True)
class Rule:
    """aggregates: name -> aggregate over the rows, which also have _delta (seconds since the row before of the turbine), _same (its time is that row's) and _back
    (it comes before the row that it follows in sequence). findings: of the table of totals, with turbine_id, _delta and the aggregates of this and all other rules."""

    name: str
    aggregates: Callable[[Table], dict[str, Column]] = field(default=lambda t: {})
    findings: Callable[[DataFrame, Table], list[DataFrame]] = field(default=lambda facts, t: [])


def _found(df: DataFrame, level, code: str, subject, n, message: str, detail=None) -> DataFrame:
    text = lambda x: (F.lit(x) if isinstance(x, str) or x is None else x).cast("string")
    return df.select(text(level).alias("level"), F.lit(code).alias("code"), text(subject).alias("subject"), (F.lit(n) if n is None else n).cast("long").alias("n"), F.lit(message).alias("message"), text(detail).alias("detail"))


def _each(facts: DataFrame, sums: dict[str, dict[str, Column]]) -> DataFrame:
    """A row (subject, ...) for each subject, of aggregates over all facts."""
    one = facts.agg(*[x.alias(f"{k}__{name}") for k, cols in sums.items() for name, x in cols.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("subject"), *[F.col(f"`{k}__{name}`").alias(name) for name in cols]) for k, cols in sums.items()])))


def _timestamps(facts: DataFrame, t: Table) -> list[DataFrame]:
    total = facts.agg(F.sum("n_unparsed").alias("unparsed"), F.sum("n_same").alias("same"))
    out = [
        _found(total.where("unparsed > 0"), "ERROR", "TIMESTAMP.UNPARSEABLE", None, F.col("unparsed"), "times that could not be read"),
        _found(total.where("same > 0"), "WARNING", "TIMESTAMP.DUPLICATE", None, F.col("same"), "rows of a turbine with a time that it has already"),
    ]
    if t.dtypes[t.ts] == "timestamp_ntz":
        out.append(_found(total, "ERROR", "TIMESTAMP.NAIVE", t.ts, None, "times without a time zone"))
    each = facts.groupBy(t.turbine).agg(F.sum("n_back").alias("back"))
    out.append(_found(each.where("back > 0"), "INFO", "TIMESTAMP.ORDER", F.col(t.turbine), F.col("back"), "rows that stand after later ones"))
    steps = facts.where("_delta is not null").groupBy(t.turbine, "_delta").agg(F.sum("n_rows").alias("n"))
    modal = steps.groupBy(t.turbine).agg(F.max_by("_delta", F.struct("n", (-F.col("_delta")).alias("_d"))).alias("modal"))
    gaps = steps.join(modal.withColumnRenamed(t.turbine, "_t"), F.col(t.turbine).eqNullSafe(F.col("_t"))).where("_delta > modal").groupBy(t.turbine, "modal").agg(F.sum("n").alias("n"), F.max("_delta").alias("largest"))
    out.append(_found(gaps, "WARNING", "TIMESTAMP.GAP", F.col(t.turbine), F.col("n"), "steps longer than the usual one", F.concat_ws(" ", F.lit("usual"), F.col("modal").cast("string"), F.lit("largest"), F.col("largest").cast("string"))))
    return out


def _missing(facts: DataFrame, t: Table) -> list[DataFrame]:
    each = _each(facts, {c: {"n": F.sum(f"null_{c}"), "share": F.sum(f"null_{c}") / F.sum("n_rows")} for c in t.measured()})
    level = F.when(F.col("share") >= 0.5, "WARNING").otherwise("INFO")
    return [_found(each.where("n > 0"), level, "MISSING.NULLS", F.col("subject"), F.col("n"), "missing values", F.round("share", 6))]


def _constant(facts: DataFrame, t: Table) -> list[DataFrame]:
    each = _each(facts, {c: {"n": F.sum("n_rows") - F.sum(f"null_{c}"), "same": F.min(f"low_{c}") == F.max(f"high_{c}")} for c in t.measured()})
    return [_found(each.where("n = 0"), "WARNING", "CONSTANT.EMPTY", F.col("subject"), None, "no value at all"), _found(each.where("n > 0 and same"), "INFO", "CONSTANT.SINGLE_VALUE", F.col("subject"), None, "one value only")]


def _ranges(facts: DataFrame, t: Table) -> list[DataFrame]:
    bounds = {c: b for c, b in t.schema.bounds().items() if c in t.dtypes}
    if not bounds:
        return []
    each = _each(facts, {c: {"n": F.sum(f"out_{c}"), "bounds": F.lit(f"{lo} to {hi}")} for c, (lo, hi) in bounds.items()})
    return [_found(each.where("n > 0"), "ERROR", "RANGE.IMPOSSIBLE", F.col("subject"), F.col("n"), "values outside their bounds", F.col("bounds"))]


def _roles(facts: DataFrame, t: Table) -> list[DataFrame]:
    one, out = facts.sparkSession.range(1), []
    for role in ("target", "predictor"):
        if not set(t.schema.names(role)) & set(t.dtypes):
            out.append(_found(one, "ERROR", "SCHEMA.ROLE_ABSENT", role, None, "no column of this role"))
    if t.version is not None and t.version != t.schema.version:
        out.append(_found(one, "WARNING", "SCHEMA.VERSION", t.version, None, "made under another version of the schema", t.schema.version))
    return out


#: The rules, by name. A caller's own are added to a copy.
RULES: dict[str, Rule] = {
    r.name: r
    for r in (
        Rule("TIMESTAMP", lambda t: {"n_unparsed": F.count_if(F.col(t.ts).isNull()), "n_same": F.count_if("_same"), "n_back": F.count_if("_back")}, _timestamps),
        Rule("MISSING", lambda t: {f"null_{c}": F.count_if(F.col(c).isNull()) for c in t.measured()}, _missing),
        Rule("CONSTANT", lambda t: {f"{k}_{c}": f(c) for c in t.measured() for k, f in (("low", F.min), ("high", F.max))}, _constant),
        Rule("RANGE", lambda t: {f"out_{c}": F.count_if((F.col(c) < lo) | (F.col(c) > hi)) for c, (lo, hi) in t.schema.bounds().items() if c in t.dtypes}, _ranges),
        Rule("SCHEMA", findings=_roles),
    )
}


def facts(df: DataFrame, table: Table, rules: dict[str, Rule]) -> DataFrame:
    """The totals of all rules by turbine and step: one aggregation."""
    ts, by = table.ts, table.turbine
    rows = with_previous(df, [by], [ts], [ts]) if table.sequence is None else with_previous(df, [by], [ts, table.sequence], [ts])
    rows = rows.withColumns({"_delta": F.timestamp_diff("SECOND", F.col(f"prev_{ts}"), F.col(ts)), "_same": F.coalesce(F.col(f"prev_{ts}") == F.col(ts), F.lit(False)), "_back": F.lit(False)}).drop(f"prev_{ts}")
    if table.sequence is not None:
        rows = with_previous(rows, [by], [table.sequence], [ts], cell=F.floor(F.col(table.sequence) / 4096).cast("long"))
        rows = rows.withColumn("_back", F.coalesce(F.col(ts) < F.col(f"prev_{ts}"), F.lit(False))).drop(f"prev_{ts}")
    aggregates = {"n_rows": F.count("*")}
    for r in rules.values():
        aggregates |= r.aggregates(table)
    return stored(rows.groupBy(by, "_delta").agg(*[x.alias(n) for n, x in aggregates.items()]), "facts")


def validate(df: DataFrame, schema: Schema, version: str | None = None, sequence: str | None = None, rules: dict[str, Rule] = RULES, steps: tuple[int, float] | None = None, ts: str = "timestamp", turbine: str = "turbine_id") -> DataFrame:
    """The findings of all rules, and with `steps` (window, magnitude) of level shifts of the targets too, which need windows of their own."""
    if not rules:
        raise ConfigError("no validation rules")
    if absent := [c for c in (ts, turbine) if c not in df.columns]:
        raise ConfigError("rows without a time or a turbine can't be validated", columns=absent)
    t = Table(schema, dict(df.dtypes), version, sequence, ts, turbine)
    held = facts(df, t, rules)
    parts = [x.withColumn("rule", F.lit(r.name)) for r in rules.values() for x in r.findings(held, t)]
    for c in [c for c in schema.names("target") if steps and c in df.columns]:
        found = quality.step_changes(df, turbine, ts, c, *steps)
        detail = F.concat_ws(" ", F.lit(c), F.col(ts).cast("string"), F.col("magnitude").cast("string"))
        parts.append(_found(found, "WARNING", "STEP_CHANGE.SHIFT", F.col(turbine), None, "a lasting shift of the level", detail).withColumn("rule", F.lit("STEP_CHANGE")))
    if not parts:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, parts).select(*COLUMNS)

"""Interpretation of coordinated states by a table of rules."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermarc.errors import RuleError
from thermarc.operators.windows import islands, numbered

#: The words that every rule's rationale must hold.
OVERLAP_CAVEAT = "three of five gearbox failure modes share the oil-temperature signature"
REQUIREMENTS = {"high": [1], "low": [-1], "normal": [0], "any": [-1, 0, 1]}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    mechanism: str
    pattern: dict[str, str]
    validated: bool = False
    source: str | None = None
    rationale: str = ""
    extra: dict = field(default_factory=dict)


def load_rules(text: str, caveat: str | None = OVERLAP_CAVEAT) -> list[Rule]:
    """Rules from YAML: {version: x.y.z, rules: [{rule_id, mechanism, pattern, ...}]}."""
    doc = yaml.safe_load(text) or {}
    if len(str(doc.get("version", "")).split(".")) != 3:
        raise RuleError("the version must have three parts", version=doc.get("version"))
    out = []
    for r in doc.get("rules") or []:
        if extra := set(r) - {"rule_id", "mechanism", "pattern", "validated", "source", "rationale"}:
            raise RuleError("unknown fields", fields=sorted(extra))
        out.append(Rule(**r))
    return check_rules(out, caveat)


def check_rules(rules: list[Rule], caveat: str | None = None) -> list[Rule]:
    """The rules, if they are well formed; with a caveat, each rationale must hold it."""
    if not rules:
        raise RuleError("no rules")
    ids = [r.rule_id for r in rules]
    if len(set(ids)) < len(ids):
        raise RuleError("rule ids must be unique", ids=ids)
    for r in rules:
        if not r.pattern or set(r.pattern.values()) - set(REQUIREMENTS):
            raise RuleError("a pattern needs signals with high, low, normal or any", rule=r.rule_id)
        if r.validated and not r.source:
            raise RuleError("a validated rule needs its source", rule=r.rule_id)
        if caveat and caveat not in r.rationale:
            raise RuleError("the rationale must hold the caveat", rule=r.rule_id, caveat=caveat)
    return rules


def assess(states: DataFrame, rules: list[Rule], signals: list[str], keys: tuple[str, ...] = ("turbine_id", "timestamp")) -> DataFrame:
    """A row for each state and rule that applies (all its signals known) with at least one met requirement other than 'any'; rank 1 is best.

    Rules are few and become expressions over the row: no join.
    """
    rows = []
    for r in rules:
        if set(r.pattern) - set(signals):
            continue  # the signal isn't measured here
        known = F.lit(True)
        for s in r.pattern:
            known = known & F.col(f"state_{s}").isNotNull()
        met = {s: F.col(f"state_{s}").isin(REQUIREMENTS[need]) for s, need in r.pattern.items()}
        support = sum((met[s].cast("int") for s, need in r.pattern.items() if need != "any"), F.lit(0))
        violated = sum(((~met[s]).cast("int") for s in r.pattern), F.lit(0))
        rows.append(F.when(known & (support > 0), F.struct(violated.alias("n_violated"), (-support).alias("_support"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.mechanism).alias("mechanism"))))
    ranked = F.array_sort(F.array_compact(F.array(*rows)))
    out = states.select(*keys, F.posexplode(ranked).alias("_k", "r"))
    confidence = F.when(F.col("r.n_violated") == 0, "plausible_preliminary").otherwise("weak")
    return out.select(*keys, (F.col("_k") + 1).alias("rank"), "r.rule_id", "r.mechanism", "r.n_violated", (-F.col("r._support")).alias("n_support"), confidence.alias("confidence"))


def diagnostic_events(states: DataFrame, signals: list[str]) -> DataFrame:
    """Anomalous states with severity (the largest |ewma|) and persistence (rows of the run so far, this one included)."""
    odd = F.lit(False)
    for s in signals:
        odd = odd | F.coalesce(F.col(f"state_{s}") != 0, F.lit(False))
    rows = numbered(states.withColumns({"_odd": odd, "_stream": F.struct("turbine_id")}), "timestamp", [], "_t", ("_stream",)).drop("_stream")
    rows = islands(rows, ["turbine_id"], ["timestamp", "_t"], ["_odd"], F.col("_odd") != F.col("prev__odd")).where("_odd")
    place = (F.col("_t") - F.col("island")["_t"] + 1).cast("int")
    severity = F.array_max(F.array(*[F.abs(F.col(f"ewma_{s}")) for s in signals]))
    return rows.select("turbine_id", "timestamp", severity.alias("severity"), place.alias("persistence"), *[f"state_{s}" for s in signals])


def sentence(signal: str, state: Column, ewma: Column) -> Column:
    word = F.when(state == 1, "high").when(state == -1, "low").otherwise("normal")
    return F.format_string(f"{signal} is %s (%+.2f)", word, ewma)


def banner(rule: Rule) -> str:
    """What stands beside a hypothesis that no source has confirmed."""
    return "" if rule.validated else "NOT VALIDATED: preliminary hypothesis, no maintenance advice"


def operator_text(assessed: DataFrame, events: DataFrame, rules: list[Rule], signals: list[str]) -> DataFrame:
    """(turbine_id, timestamp, text): what an operator reads of each event, its candidates in order of rank; without any, that too is said.

    The candidates of an event are as many as rules, so they meet in one row.
    """
    held = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, f" [{banner(r)}]" if banner(r) else "")])
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("mechanism"), F.lit(" ("), F.col("rule_id"), F.lit(", "), F.col("confidence"), F.lit(")"), F.element_at(held, F.col("rule_id")))
    found = assessed.groupBy("turbine_id", "timestamp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "; ").alias("_lines"))
    said = [F.when(F.col(f"state_{s}").isNull(), F.lit(f"{s} has no observation")).otherwise(sentence(s, F.col(f"state_{s}"), F.col(f"ewma_{s}")) if f"ewma_{s}" in events.columns else F.concat(F.lit(f"{s} is "), F.when(F.col(f"state_{s}") == 1, "high").when(F.col(f"state_{s}") == -1, "low").otherwise("normal"))) for s in sorted(signals)]
    text = F.concat_ws(" | ", F.concat(F.lit("severity "), F.format_number("severity", 2)), F.concat(F.lit("persistence "), F.col("persistence").cast("string")), *said, F.coalesce("_lines", F.lit("no rule fits")))
    return events.join(found, ["turbine_id", "timestamp"], "left").select("turbine_id", "timestamp", text.alias("text"))


#: Ids, mechanisms, patterns and sources of the starting rules. All are unvalidated.
INITIAL = check_rules(
    [
        Rule("FMEA-001", "gear_teeth_wear", {"gearbox_oil_temperature": "high", "gearbox_bearing_temperature": "any"}, False, "Qiu et al. (2016); Qiu et al. (2014)", f"Friction heats the oil first. {OVERLAP_CAVEAT}"),
        Rule("FMEA-002", "hss_bearing_failure", {"gearbox_bearing_temperature": "high", "gearbox_oil_temperature": "any"}, False, "Bangalore & Tjernberg (2015); Qiu et al. (2014)", f"The bearing heats first. {OVERLAP_CAVEAT}"),
        Rule("FMEA-003", "lss_planetary_bearing_failure", {"gearbox_oil_temperature": "high", "gearbox_bearing_temperature": "normal"}, False, "Qiu et al. (2014)", f"That bearing has no sensor; only the oil shows it. {OVERLAP_CAVEAT}"),
        Rule("FMEA-004", "lubrication_system_degradation", {"gearbox_oil_temperature": "high", "gearbox_bearing_temperature": "high"}, False, "Qiu et al. (2014); Shafiee & Dinmohammadi (2014)", f"Less heat is taken away everywhere. {OVERLAP_CAVEAT}"),
        Rule("FMEA-005", "electrical_generator_side_influence", {"generator_bearing_front_temperature": "high", "generator_bearing_rear_temperature": "high", "gearbox_oil_temperature": "normal"}, False, "Qiu et al. (2016)", f"Heat of the generator's side speaks against the gearbox. {OVERLAP_CAVEAT}"),
    ],
    OVERLAP_CAVEAT,
)

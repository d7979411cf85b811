"""The canonical schema: names, roles, units and plausible ranges as column metadata."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from thermarc.errors import SchemaError

ROLES = ("timestamp", "turbine_id", "predictor", "target", "status", "alarm", "maintenance", "excluded")


@dataclass(frozen=True)
class Variable:
    name: str
    role: str
    unit: str = ""
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Schema:
    version: str
    variables: tuple[Variable, ...]

    def __post_init__(self):
        names = [v.name for v in self.variables]
        if not re.fullmatch(r"\d+\.\d+\.\d+", self.version):
            raise SchemaError("the version must be x.y.z", version=self.version)
        if len(set(names)) < len(names):
            raise SchemaError("names must be unique", names=names)
        if bad := [v.role for v in self.variables if v.role not in ROLES]:
            raise SchemaError("unknown roles", roles=bad)
        for role in ("timestamp", "turbine_id"):
            if sum(v.role == role for v in self.variables) != 1:
                raise SchemaError("exactly one variable must have this role", role=role)
        if not self.names("target"):
            raise SchemaError("a target is needed")

    def names(self, *roles: str) -> list[str]:
        return [v.name for v in self.variables if not roles or v.role in roles]

    def bounds(self, *roles: str) -> dict[str, tuple[float, float]]:
        return {v.name: (v.low, v.high) for v in self.variables if v.low is not None and v.high is not None and (not roles or v.role in roles)}

    def struct(self) -> T.StructType:
        kind = {"timestamp": T.TimestampType(), "turbine_id": T.StringType(), "status": T.StringType()}
        return T.StructType([T.StructField(v.name, kind.get(v.role, T.DoubleType()), True, {"role": v.role, "unit": v.unit, "low": v.low, "high": v.high}) for v in self.variables])

    def sha256(self) -> str:
        content = [[v.name, v.role, v.unit, v.low, v.high] for v in self.variables]
        return hashlib.sha256(json.dumps([self.version, content], separators=(",", ":")).encode()).hexdigest()

    def extended(self, version: str, *more: Variable) -> Schema:
        if tuple(map(int, version.split("."))) <= tuple(map(int, self.version.split("."))):
            raise SchemaError("an extension needs a higher version", version=version, held=self.version)
        return Schema(version, (*self.variables, *more))


#: The canonical variables with their plausible ranges (strictly outside is impossible).
DEFAULT = Schema(
    "1.3.0",
    (
        Variable("timestamp", "timestamp"),
        Variable("turbine_id", "turbine_id"),
        Variable("wind_speed", "predictor", "m/s", 0.0, 120.0),
        Variable("rotor_speed", "predictor", "rpm", -1.0, 100.0),
        Variable("generator_speed", "predictor", "rpm", -5.0, 5000.0),
        Variable("active_power", "predictor", "kW"),
        Variable("pitch_angle", "predictor", "deg", -360.0, 360.0),
        Variable("ambient_temperature", "predictor", "degC", -90.0, 70.0),
        Variable("nacelle_temperature", "predictor", "degC", -90.0, 120.0),
        Variable("gearbox_oil_temperature", "target", "degC", -90.0, 200.0),
        Variable("gearbox_bearing_temperature", "target", "degC", -90.0, 250.0),
    ),
)


def content_hash(df: DataFrame) -> str:
    """The same for the same set of rows in any order: sums of row hashes."""
    from pyspark.sql import functions as F

    h = F.xxhash64(*df.columns)
    n, low, high, x = df.agg(F.count("*"), F.sum(F.pmod(h, F.lit(2**31))), F.sum(F.pmod(F.shiftright(h, 31), F.lit(2**31))), F.bit_xor(h)).first()
    return hashlib.sha256(json.dumps([sorted(df.columns), n, low, high, x]).encode()).hexdigest()

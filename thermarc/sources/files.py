"""Measurement and status files: declared columns, banners, encodings, inventories."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermarc.cluster import stored
from thermarc.errors import IngestError, SchemaError
from thermarc.functions.timeutil import get_zone
from thermarc.operators.quality import check_conflicts, deduplicate
from thermarc.schema import Schema
from thermarc.sources import provenance
from thermarc.sources.provenance import Dataset

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "cp1252", "latin-1")


@dataclass(frozen=True)
class Mapping:
    """Raw to canonical names and how the files are written. The turbine is a column, a constant or part of the file name."""

    columns: dict[str, str]
    timezone: str
    timestamp: str
    turbine_column: str | None = None
    turbine_constant: str | None = None
    filename_pattern: str | None = None
    skip_lines: int = 0
    header_prefix: str = ""
    missing: str = "NaN"
    encoding: str | None = None
    extra: dict = field(default_factory=dict)

    def check(self, schema: Schema) -> None:
        get_zone(self.timezone)
        if sum(x is not None for x in (self.turbine_column, self.turbine_constant, self.filename_pattern)) != 1:
            raise SchemaError("exactly one way to name the turbine is needed")
        if self.filename_pattern is not None and re.compile(self.filename_pattern).groups < 1:
            raise SchemaError("the file name's pattern needs a group", pattern=self.filename_pattern)
        names = list(self.columns.values())
        if len(set(names)) < len(names):
            raise SchemaError("canonical names must be unique", names=names)
        if bad := [n for n in names if n not in schema.names() or n in schema.names("timestamp", "turbine_id")]:
            raise SchemaError("not a measured variable of the schema", names=bad)
        if not set(names) & set(schema.names("target")):
            raise SchemaError("a target must be mapped")


def head(spark: SparkSession, path: str, lines: int) -> list[str]:
    """A file's first lines, read by Spark (the path may be in any store it knows)."""
    return [r["value"] for r in spark.read.text(path).limit(lines).collect()]


def detect_encoding(spark: SparkSession, path: str) -> dict[str, str]:
    """The first of ENCODINGS that each file's bytes fit; bytes stay on the executors."""

    def fits(batches):
        for pdf in batches:
            out = []
            for b in pdf["content"]:
                for e in ENCODINGS:
                    try:
                        bytes(b).decode(e)
                        break
                    except UnicodeDecodeError:
                        continue
                out.append(e)
            yield pdf[["path"]].assign(encoding=out)

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(fits, "path string, encoding string")
    return {r["path"]: r["encoding"] for r in rows.collect()}


def banner(spark: SparkSession, path: str, lines: int = 10) -> dict[str, str]:
    """'# Key: value' lines before the header."""
    got = (re.match(r"#\s*([^:]+):\s*(.*)", x) for x in head(spark, path, lines))
    return {m[1].strip(): m[2].strip() for m in got if m}


def _turbine(mapping: Mapping) -> Column:
    if mapping.turbine_constant is not None:
        return F.lit(mapping.turbine_constant)
    if mapping.turbine_column is not None:
        return F.col(f"`{mapping.turbine_column}`").cast("string")
    found = F.regexp_extract(F.col("_metadata.file_name"), mapping.filename_pattern, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no turbine in the file name "), F.col("_metadata.file_name"))))


def read_csv(spark: SparkSession, path: str, mapping: Mapping, schema: Schema) -> DataFrame:
    """Canonical rows of one kind of file: declared columns only, UTC once, '' and the missing token as null."""
    mapping.check(schema)
    first = head(spark, path, mapping.skip_lines + 1)
    if len(first) <= mapping.skip_lines:
        raise IngestError("the file has no header", path=path)
    names = [c.strip() for c in first[mapping.skip_lines].removeprefix(mapping.header_prefix).strip().split(",")]
    need = [*mapping.columns, mapping.timestamp, *([mapping.turbine_column] if mapping.turbine_column else [])]
    if absent := sorted(set(need) - set(names)):
        raise IngestError("declared columns are absent", columns=absent, path=path)
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).options(header=not mapping.header_prefix, encoding=mapping.encoding or "utf-8", nullValue=mapping.missing, comment="#" if mapping.header_prefix or mapping.skip_lines else "\0")
    raw = raw.csv(path)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    value = lambda c: F.when(~F.isnan(number(c)), number(c))  # noqa: E731  NaN is missing, and missing is null
    return raw.select(
        F.to_utc_timestamp(F.expr(f"try_to_timestamp(`{mapping.timestamp}`)"), mapping.timezone).alias("timestamp"), _turbine(mapping).alias("turbine_id"),
        *[value(r).alias(c) for r, c in mapping.columns.items()], F.col("_metadata.file_name").alias("source_file"),
    )


def _spanned(spark: SparkSession, paths: list[str], mapping: Mapping, schema: Schema, start: str | None, end: str | None) -> DataFrame:
    """The rows of all files in the span, with the file's place in the list (_k) and name."""
    rows = reduce(DataFrame.unionByName, [read_csv(spark, p, mapping, schema).withColumn("_k", F.lit(k)) for k, p in enumerate(paths)])
    if start:
        rows = rows.where(F.col("timestamp") >= F.lit(start).cast("date"))
    return rows.where(F.col("timestamp") < F.date_add(F.lit(end).cast("date"), 1)) if end else rows


def ingest(spark: SparkSession, paths: list[str], mapping: Mapping, schema: Schema, start: str | None = None, end: str | None = None) -> DataFrame:
    """All files together: the span's days (both included), one row for each turbine and time, in the files' order."""
    rows = _spanned(spark, paths, mapping, schema, start, end)
    # The source is no content: copies of a row in two files agree.
    return deduplicate(rows.withColumn("_order", F.struct("_k", "source_file")).drop("_k", "source_file"), ["turbine_id", "timestamp"], ["_order"]).drop("_order")


def mapping_sha256(mapping: Mapping) -> str:
    """Identity of a mapping."""
    return hashlib.sha256(json.dumps(asdict(mapping), sort_keys=True, default=str).encode()).hexdigest()


def ingest_dataset(spark: SparkSession, paths: list[str], mapping: Mapping, schema: Schema, start: str | None = None, end: str | None = None, note: str = "") -> Dataset:
    """ingest, with the record of every file, each row's source file, and how many rows of each file were copies of earlier ones (`removed`)."""
    rows = _spanned(spark, paths, mapping, schema, start, end)
    keys = ["turbine_id", "timestamp"]
    check_conflicts(rows.drop("_k", "source_file"), keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_k", "source_file"))
    held = stored(rows.withColumn("_place", place), "ingested")
    removed = held.where("_place > 1").groupBy("source_file").agg(F.count("*").alias("n_removed"))
    records = provenance.capture(spark, paths, timezone=mapping.timezone, encoding=mapping.encoding or "utf-8", schema_version=schema.version, mapping_sha256=mapping_sha256(mapping), note=note)
    return Dataset(held.where("_place = 1").drop("_k", "_place"), schema.version, tuple(records), removed=removed).derived(held.where("_place = 1").drop("_k", "_place"), "ingest")


def banners(spark: SparkSession, paths: list[str], fields: dict[str, str], prefix: str = "#", strict: bool = True) -> DataFrame:
    """source_file and the declared fields (name -> key of a '<prefix> key: value' line) of each file, one row a file. The first value of a key counts.

    strict: a file without one of them is refused; else its field is null.
    """
    line = F.regexp_extract_all(F.col("value"), F.lit(f"^{re.escape(prefix)}\\s*([^:]+?)\\s*:\\s*(.*?)\\s*$"), 1)
    text = spark.read.text(paths).select(F.col("_metadata.file_name").alias("source_file"), "value", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))  # lines of a block are read in order
    key = F.when(F.col("value").startswith(prefix), F.get(line, F.lit(0)))
    value = F.regexp_extract("value", f"^{re.escape(prefix)}\\s*[^:]+?\\s*:\\s*(.*?)\\s*$", 1)
    rows = text.select("source_file", "_at", key.alias("_key"), value.alias("_value"))
    out = rows.groupBy("source_file").agg(*[F.min_by("_value", F.when(F.col("_key") == k, F.col("_at"))).alias(n) for n, k in fields.items()])
    if not strict:
        return out
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(k)) for n, k in fields.items()]))
    refused = F.raise_error(F.concat(F.lit("no banner line in "), F.col("source_file"), F.lit(" for "), F.array_join(missing, ", ")))
    return out.select(F.when(F.size(missing) > 0, refused.cast("string")).otherwise(F.col("source_file")).alias("source_file"), *fields)


def read_status(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Status rows as text, nothing taken for missing."""
    return spark.read.options(header=True, comment=comment, nullValue="\0", emptyValue="").csv(path)


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files with class by name, size, time and SHA-256."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(folder)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = F.when(name.endswith(".parquet"), "parquet").when(name.contains("status") & name.endswith(".csv"), "status").when(name.endswith(".csv"), "measurement").when(name.rlike(r"\.(md|pdf|txt)$"), "document").when(name.startswith("."), "noise").otherwise("other")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), kind.alias("kind"), F.col("length").alias("size"), "modificationTime", F.sha2("content", 256).alias("sha256"))


def located(paths: list[str], expected: int) -> list[str]:
    if len(paths) != expected:
        raise IngestError("not the declared number of files", found=len(paths), expected=expected)
    return sorted(paths)

"""Where rows come from: records of source files, the chain of what was made of them, proofs that files stayed as they are.

A file's hash is that of its lines as a multiset: sums of line hashes with the number of lines and bytes. So one Spark job hashes all files, and a
large file is many tasks; lines that only change places are not told apart. Files may be in any store that Spark reads. What comes to the driver is a row for each file.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermarc.errors import ProvenanceError
from thermarc.schema import content_hash


@dataclass(frozen=True)
class FileRecord:
    """Identity of a source file and how it was read."""

    path: str
    name: str
    size_bytes: int
    n_lines: int
    content_sha256: str
    ingested_at: str = ""
    timezone: str = ""
    encoding: str = ""
    schema_version: str = ""
    mapping_sha256: str = ""
    note: str = ""


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, name, size_bytes, n_lines, low, high, mixed) of each file with a line, in one aggregation."""
    h = F.xxhash64("value")
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size_bytes"))
    half = lambda x: F.sum(F.pmod(x, F.lit(2**31)))  # noqa: E731  sums of 31 bits don't overflow
    return lines.groupBy("path", "name", "size_bytes").agg(F.count("*").alias("n_lines"), half(h).alias("low"), half(F.shiftright(h, 31)).alias("high"), F.bit_xor(h).alias("mixed"))


def capture(spark: SparkSession, paths: list[str], **how: str) -> list[FileRecord]:
    """Records of the files, in the order of their paths. how: timezone, encoding, schema_version, mapping_sha256, note. An absent or empty file is refused."""
    if not paths:
        raise ProvenanceError("no source files")
    at, out = datetime.now(UTC).isoformat(), []
    try:
        rows = file_hashes(spark, paths).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ProvenanceError("a source file is missing", paths=paths) from e
        raise
    for r in sorted(rows, key=lambda r: r["path"]):
        body = json.dumps([r["size_bytes"], r["n_lines"], r["low"], r["high"], r["mixed"]])
        out.append(FileRecord(r["path"], r["name"], r["size_bytes"], r["n_lines"], hashlib.sha256(body.encode()).hexdigest(), at, **how))
    if not out:
        raise ProvenanceError("the source files are empty", paths=paths)
    return out


def verify(spark: SparkSession, records: list[FileRecord] | tuple[FileRecord, ...]) -> None:
    """Hashes the files again; one that changed or went is refused."""
    now = {r.path: r.content_sha256 for r in capture(spark, [r.path for r in records])}
    if changed := sorted(r.path for r in records if now.get(r.path) != r.content_sha256):
        raise ProvenanceError("source files have changed since they were read", paths=changed)


@contextmanager
def read_only(spark: SparkSession, paths: list[str]) -> Iterator[list[FileRecord]]:
    """Proves that what runs inside leaves the files as they were: hashed before and after."""
    before = capture(spark, paths)
    yield before
    verify(spark, before)


@dataclass(frozen=True)
class Dataset:
    """Canonical rows bound to their sources; without records there is none. stages: (name, hash of the rows) of all that was made of them."""

    frame: DataFrame
    schema_version: str
    records: tuple[FileRecord, ...]
    stages: tuple[tuple[str, str], ...] = ()
    removed: DataFrame | None = None

    def __post_init__(self):
        if not self.records:
            raise ProvenanceError("a dataset needs the records of its sources")

    def derived(self, frame: DataFrame, stage: str) -> Dataset:
        """What a stage made, with its hash; sources and earlier stages stay."""
        return replace(self, frame=frame, stages=(*self.stages, (stage, content_hash(frame))))

    def verify_sources(self) -> None:
        verify(self.frame.sparkSession, self.records)

    def verify_rows(self) -> None:
        """The rows still are what the last stage made."""
        if self.stages and content_hash(self.frame) != self.stages[-1][1]:
            raise ProvenanceError("the rows are not those of the last stage", stage=self.stages[-1][0])

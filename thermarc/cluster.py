"""What jobs need of the cluster: the package on the executors and a shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers. Once for each Spark application.

    Nothing is sent where PYTHONPATH names the package's folder already (a deployed package).
    """
    app, here = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or str(here.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    to = Path(tempfile.mkdtemp(prefix="thermarc-")) / "thermarc_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in here.rglob("*.py"):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local one is set only where none is (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = f"file://{tempfile.mkdtemp(prefix='thermarc-shared-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's setting to free a query's shuffle files when the query ends, and not when the driver's garbage collector finds them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    held = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")  # what the table needed is in the table: no later step reads its shuffles
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREE_SHUFFLES) if held is None else conf.set(FREE_SHUFFLES, held)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in the shared folder, by name. `put` writes and reads one back, `drop` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        return _written(df, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Folder:
    """Small text files of a folder on any file system that Spark reaches, by Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, pattern: str) -> list[str]:
        """Paths below the folder that match a glob, sorted."""
        found = self._fs.globStatus(self._path(self.at(pattern))) or []
        below = self._path(self.root).toUri().getPath().rstrip("/") + "/"
        return sorted(f.getPath().toUri().getPath().removeprefix(below) for f in found)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(self.at(name)), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(self.at(old)), self._path(self.at(new)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later stages don't repeat what made it, and a lost executor loses none of it."""
    return _written(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")

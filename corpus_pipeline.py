"""A document pipeline of the training-data operators.

STAGES are applied in order; each one's result is written as Parquet in the shared
folder and read again as the next one's documents. All but the last return the columns
of documents, those named like a stage's own results too.

Near-duplicates are told by shingles of five words (op10's query, by its contract, takes two).

Defined results: the quality rules reject null and empty texts, and those without words. Rows with a null id take part in the quality
rules, the benchmark search and the encoding, lose no line and are no one's duplicate. Repeated rows and ties: equal rows go or
stay together, but of near-duplicates (equal texts too) the smallest id stays. Texts are taken whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermarc.cluster import stored
from thermarc.llm import bpe, decontamination, line_dedup, near_dedup, quality_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines, and long sentences of lines, whose template an earlier document has go, and documents that they leave without a word. n_chars follows the text."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ("n_lines", "n_dropped", "kept")}  # columns of these names stay what they were
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own), sentences=True).where("kept").drop(*own).withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return near_dedup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the byte-level BPE in place of the text."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near),
    ("decontamination", benchmark),
    ("byte_bpe", encode),
]

#: Byte-pair encoding and the latent search are no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

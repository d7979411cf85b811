"""Byte-level BPE: overlapping chunks, stitched where their pre-token boundaries agree.

A text of up to `chunk` characters is one chunk. A longer one becomes overlapping
chunks, rows of their own that other tasks pre-tokenise. In the overlap of two
neighbours the first boundary that both found, after a character that is no white
space, is the cut: the split pattern never looks back, so from a common boundary on
both go on alike. The pieces between cuts are encoded in parallel and their ids
joined in order. Chunks whose overlap has no such boundary (one endless
pre-token, say) are encoded as one piece.

Defined results: a null text counts as empty and has no ids; strings of special
tokens are ordinary text; repeated rows are encoded each, so ties don't matter. Extra columns stay, but one named
as the ids (or, in decode and digests, as their results) is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermarc.cluster import ship
from thermarc.llm.tokens import text_slices

CHUNK, OVERLAP = 16_384, 512
#: Characters before a chunk's end where a boundary may depend on what follows (the longest contraction has three).
GUARD = 4


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes for all executors. Its size is fixed by the tokenizer (under 1 MB), not by the data."""
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@functools.cache
def _encoding(ranks_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _ids(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values).view(np.int32) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _encode_rows(ranks: Broadcast, pattern: str, text: str):
    """Slices of a few MB of text, and ids as arrays: a worker's memory doesn't follow the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for whole in batches:
            k = whole.schema.get_field_index(text)
            rest = [i for i in range(whole.num_columns) if i != k]
            for b in text_slices(whole, text):
                ids = _ids([enc.encode_to_numpy(t.as_py() or "", disallowed_special=()) for t in b.column(k)])
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), ids], names=[*(b.schema.names[i] for i in rest), "ids"])

    return run


def _id_slices(batch: pa.RecordBatch, ids: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` ids (a longer row alone)."""
    start, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_pylist()):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _rows_of(column: pa.Array) -> Iterator[np.ndarray]:
    for v in column:
        yield v.values.to_numpy() if v.is_valid else np.empty(0, np.int32)


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in zip(b.column("_row").to_pylist(), b.column("_text").to_pylist(), strict=True):
                starts = range(0, len(t), chunk)
                parts = [t[s : s + chunk + overlap] for s in starts]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], names=["_row", "_k", "_part"]
                )

    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    """Adds the boundaries at a chunk's head and tail, as offsets from the neighbours' common start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        for b in batches:
            head, tail = [], []
            for t in b.column("_part").to_pylist():
                ends = [m.end() for m in split.finditer(t)]
                good = [e for e in ends if e <= len(t) - GUARD and not t[e - 1].isspace()]
                head.append([e for e in good if e < overlap])
                tail.append([e - chunk for e in good if e > chunk])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=[*b.schema.names, "_head", "_tail"]
            )

    return run


def _encode_long(docs: DataFrame, ranks: Broadcast, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Row id and ids of texts of several chunks. Input: _row, _text."""
    parts = docs.mapInArrow(_chunks(chunk, overlap), "_row long, _k int, _part string")
    # Chunks of one long text go to other tasks.
    parts = parts.repartition("_row", "_k").mapInArrow(_boundaries(pattern, chunk, overlap), T.StructType([*parts.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("_head", "_tail"))]))
    order = Window.partitionBy("_row").orderBy("_k")
    cut = F.array_min(F.array_intersect(F.col("_head"), F.lag("_tail").over(order)))
    parts = parts.withColumn("_from", F.when(F.col("_k") == 0, 0).otherwise(cut))
    # A piece runs from a chunk's cut to the next cut; chunks without a cut between them are one piece.
    parts = parts.withColumns({"_next": F.lead("_from").over(order), "_more": F.lead("_k").over(order).isNotNull(), "_piece": F.count("_from").over(order)})
    end = F.when(F.col("_more"), F.coalesce("_next", F.lit(0)) + chunk).otherwise(F.length("_part"))
    start = F.coalesce("_from", F.lit(0))
    own = F.substring(F.col("_part"), start + 1, F.greatest(F.lit(0), end - start))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", own.alias("_own")))), lambda x: x["_own"]), "")
    todo = parts.groupBy("_row", "_piece").agg(joined.alias("_part")).select("_row", F.col("_piece").alias("_k"), "_part")
    coded = todo.mapInArrow(_encode_rows(ranks, pattern, "_part"), "_row long, _k long, ids array<int>")
    return coded.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All columns but the text, and `ids` array<int>, as the tiktoken library gives them."""
    if not 2 * GUARD < overlap < chunk:
        raise ValueError("the overlap must be longer than the guard and shorter than a chunk")
    ranks = vocabulary(docs.sparkSession, ranks_path)
    keep = [c for c in docs.columns if c not in (text, "ids")]
    fits = F.coalesce(F.length(text), F.lit(0)) <= chunk
    short = docs.where(fits).select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*short.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    short = short.mapInArrow(_encode_rows(ranks, pattern, "_text"), schema)
    # The row number is stable: it depends on the scan's partitions only, and the job that reads it is one.
    long = docs.where(~fits).withColumn("_row", F.monotonically_increasing_id())
    ids = _encode_long(long.select("_row", F.col(text).alias("_text")), ranks, pattern, chunk, overlap)
    return short.unionByName(long.select("_row", *keep).join(ids, "_row").drop("_row"))


def decode(coded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds the decoded raw bytes (not always valid UTF-8 for other ids than encode's)."""
    ranks = vocabulary(coded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for whole in batches:
            for b in _id_slices(whole, ids):
                got = [enc.decode_bytes(v.tolist()) for v in _rows_of(b.column(ids))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, out])

    coded = coded.drop(out)
    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(out, T.BinaryType())]))


def digests(coded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """n_tokens, and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded bytes, in place of the ids."""
    ranks = vocabulary(coded.sparkSession, ranks_path)
    keep = [c for c in coded.columns if c not in (ids, "n_tokens", "ids_sha256", "decoded_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for whole in batches:
            for b in _id_slices(whole, ids):
                rows = [(len(v), hashlib.sha256(v.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(v.tolist())).hexdigest()) for v in _rows_of(b.column(ids))]
                n, of_ids, of_bytes = (list(x) for x in zip(*rows, strict=True))
                cols = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return coded.mapInArrow(run, T.StructType([*coded.select(*keep).schema.fields, *added]))

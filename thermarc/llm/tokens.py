"""Hashed words of Arrow text columns, for operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; longer batches are cut, so a worker's memory doesn't follow the batch size.
SLICE_BYTES = 4_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def text_slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES of text (a longer text alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > SLICE_BYTES:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets of rows, code of each word, the words of the codes). Words are runs of other characters than ASCII white space, A-Z in lower case; nulls are empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    codes, words = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    ends = ends - ends[0]
    if "" in words:  # before the first or after the last word of a text
        full = codes != words.index("")
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        codes = codes[full]
    return ends, codes, words


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles of k words, in order; of all its words where there are fewer."""
    ends, codes, words = word_codes(texts)
    h = mix(hash_words(words))[codes] if len(codes) else np.empty(0, np.uint64)
    n = max(0, len(h) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = rolled * GOLD + h[j : j + n]
    rolled = mix(rolled)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            one = np.zeros(1, np.uint64)
            for x in h[a:b]:
                one = one * GOLD + x
            yield mix(one ^ np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)

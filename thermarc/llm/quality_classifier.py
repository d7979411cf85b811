"""Quality grades by ordinal cumulative-link regression.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight vector over hashed text features is shared by
all grades, ordered thresholds tell them apart. Features are the words, their shapes (letters'
case, digits, marks) and repeats of the word before, each hashed and of length 1 as a group.

The fit takes about MAX_ROWS graded rows at most, chosen by a hash of their id; scoring covers all rows
and has no exchange.

Defined results: null and empty texts have grade 0 for certain. Without graded rows of two grades the
grades' rates are everyone's probabilities. Null grades and ids are left out; of several grades of an id the
least counts. Repeated rows are scored each, ties in the fit go by the order of ids. Ids may be of any type. Texts are taken whole. Other columns
stay, those of the result's names are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermarc.cluster import ship
from thermarc.llm.tokens import hash_words, text_slices

MAX_ROWS = 10_000
WORD_BITS, SHAPE_BITS = 16, 12
WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 2
KEEP = 0.5
PULL, STEPS, RATE = 1e-4, 250, 0.05
_space = re.compile(r"[\x20\x09-\x0D]+")
_marks = re.compile(r"[\W_]+")


def shape(word: str) -> str:
    """The runs of kinds of characters: 'Word,' is 'Aa,', 'WORD!!' is 'A!'."""
    out = ""
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if not c.isalpha() else "o"
        if not out.endswith(k):
            out += k
    return out


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text; empty for a text without words."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    codes, words = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    ends = ends - ends[0]
    full = np.fromiter(map(bool, words), bool, len(words))[codes] if len(codes) else np.empty(0, bool)
    ends, codes = np.concatenate([[0], np.cumsum(full)])[ends], codes[full] if len(codes) else codes
    word = (hash_words([_marks.sub("", w.lower()) for w in words]) % np.uint64(1 << WORD_BITS)).astype(np.int64)
    form = (hash_words([shape(w) for w in words]) % np.uint64(1 << SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        c = codes[a:b]
        if not len(c):
            out.append((np.empty(0, np.int64), np.empty(0)))
            continue
        place, value = [], []
        for of in (word, form):
            p, n = np.unique(of[c], return_counts=True)
            v = n / len(c)
            place.append(p)
            value.append(v / np.sqrt(v @ v))
        again = float((c[1:] == c[:-1]).mean()) if len(c) > 1 else 0.0
        place.append(np.array([WIDTH - 2, WIDTH - 1]))
        value.append(np.array([again, min(1.0, 5 / len(c))]))
        out.append((np.concatenate(place), np.concatenate(value)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """Rows of P(grade = 0), P(grade = 1), ..."""
        at_most = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))
        bounds = np.concatenate([np.zeros((len(z), 1)), at_most, np.ones((len(z), 1))], axis=1)
        return np.diff(bounds, axis=1)


def fit_rows(x: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood by full-batch Adam steps; thresholds are a first one and positive gaps."""
    counts = np.bincount(grades, minlength=n_grades) + 0.5
    cum = np.cumsum(counts)[:-1] / counts.sum()
    theta = np.log(cum / (1 - cum))
    model = Model(np.zeros(WIDTH), theta)
    if len(np.unique(grades)) < 2:
        return model
    place, value = np.concatenate([p for p, _ in x]), np.concatenate([v for _, v in x])
    row = np.repeat(np.arange(len(x)), [len(p) for p, _ in x])
    params = np.concatenate([np.zeros(WIDTH), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, s = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, STEPS + 1):
        w, first, gaps = params[:WIDTH], params[WIDTH], np.exp(params[WIDTH + 1 :])
        theta = first + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, w[place] * value, minlength=len(x))
        up = np.concatenate([theta, [np.inf]])[grades] - z
        lo = np.concatenate([[-np.inf], theta])[grades] - z
        su, sl = 1 / (1 + np.exp(-np.clip(up, -60, 60))), 1 / (1 + np.exp(-np.clip(lo, -60, 60)))
        su, sl = np.where(np.isinf(up), 1.0, su), np.where(np.isinf(lo), 0.0, sl)
        p = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / p, sl * (1 - sl) / p
        gz = (du - dl) / len(x)  # of the negative log-likelihood
        gt = np.zeros(len(theta))
        for j in range(len(theta)):
            gt[j] = (-du[grades == j].sum() + dl[grades == j + 1].sum()) / len(x)
        grad = np.concatenate([np.bincount(place, gz[row] * value, minlength=WIDTH) + PULL * w, [gt.sum()], [gt[j + 1 :].sum() * gaps[j] for j in range(len(gaps))]])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        params = params - RATE * 4 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return Model(params[:WIDTH], params[WIDTH] + np.concatenate([[0], np.cumsum(np.exp(params[WIDTH + 1 :]))]))


def fit(docs: DataFrame, grades: DataFrame, train: Column, n_grades: int, max_rows: int = MAX_ROWS) -> Model:
    """A model from the rows of grades (doc_id, grade) for which `train`, a condition on doc_id, holds."""
    ship(docs.sparkSession)
    known = grades.where("doc_id is not null and grade is not null").where(train).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(share * 2**53))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the bounded choice is broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                got = features(b.column("text"))
                cols = [pa.array([p for p, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), *cols], names=["doc_id", "grade", "place", "value"])

    table = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, grade int, place array<int>, value array<float>").orderBy("doc_id").toArrow()  # max_rows short rows
    place, value = table.column("place").combine_chunks(), table.column("value").combine_chunks()
    if not isinstance(place, pa.ListArray) or not len(place):
        return Model(np.zeros(WIDTH), np.zeros(n_grades - 1))
    e, p, v = place.offsets.to_numpy(), place.values.to_numpy().astype(np.int64), value.values.to_numpy().astype(float)
    x = [(p[a:b], v[a:b]) for a, b in zip(e[:-1], e[1:], strict=True)]
    return fit_rows(x, np.clip(table.column("grade").to_numpy(), 0, n_grades - 1), n_grades)


RESULT = (
    T.StructType()
    .add("expected_grade", T.DoubleType()).add("tail_probability", T.DoubleType())
    .add("kept", T.BooleanType()).add("grade_probabilities", T.ArrayType(T.DoubleType()))
)


def grade(docs: DataFrame, model: Model, text: str = "text", at_least: int = 1, keep: float = KEEP) -> DataFrame:
    """All columns, the expected grade, P(grade >= at_least), and whether that selects the text."""
    ship(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in RESULT.names])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        n = len(model.thresholds) + 1
        for whole in batches:
            for b in text_slices(whole, text):
                got = features(b.column(text))
                p = model.probabilities(np.array([float(model.weights[i] @ v) for i, v in got]))
                p[[not len(i) for i, _ in got]] = np.eye(n)[0]
                tail = p[:, at_least:].sum(axis=1)
                cols = [pa.array(p @ np.arange(n)), pa.array(tail), pa.array(tail >= keep), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *RESULT.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT.fields]))

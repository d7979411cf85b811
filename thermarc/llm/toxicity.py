"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all terms that LEAST_DOCS training texts, and one in LEAST_SHARE, have. Terms are words and their beginnings of 4
to 8 letters (inflected forms share these). A term's weight is its inverse document frequency, raised by up to BOOST
where the labels say that it tells them apart (the likelihood ratio of document counts, in which near-duplicates of one
label count once); no term is left out, so nearly every text has neighbours. The nearest examples by exact cosine come
from a block-max inverted index: examples stand in blocks, each term keeps a block's greatest weight, and blocks are
scored in order of the bounds these give until none can change the nearest NEAREST. Votes are
weighted by distance, then calibrated on training rows that are no examples. The nearest
examples and the heaviest words in common are the evidence.

The fit takes at most about MAX_ROWS labelled rows, chosen by a hash of their id. All of these that don't calibrate are
examples, in parts of about PART, each packed by the task that builds it; the driver holds them packed and sends them to the executors, which
arrange them in groups of similar examples. Everything else covers all rows.

Defined results: null and empty texts, and texts without a known term, get the calibrated rate of training
texts without one. Without labels of both kinds every score is the rate of label 1 (0 without labels).
Rows with several labels are toxic if one says so, and so is a text that stands in rows of both labels; null labels and ids
are left out of the fit. Repeated rows are scored each. An empty table gives an empty result. Ids of any type will do; other
columns stay, those of the result's names are replaced. Texts are taken whole.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermarc.cluster import Scratch, ship
from thermarc.llm.near_dedup import near_duplicates
from thermarc.llm.tokens import text_slices, word_codes

#: Labelled rows of the fit at most, and examples of a part of the index.
MAX_ROWS, PART = 24_000, 4096
#: A term stands in at least so many training texts, and in at least one of so many.
LEAST_DOCS, LEAST_SHARE = 3, 1000
#: A telling term's weight is raised from likelihood ratio RATIOS[0] on, by BOOST times from RATIOS[1] on.
BOOST, RATIOS = 15.0, (15.0, 100.0)
NEAREST, BLOCK, WAVE, POWER, PRIOR_VOTES = 15, 256, 4, 4, 0.25
#: Terms that at least one in so many examples has are kept as whole rows of weights, not as postings.
DENSE = 16
#: Groups of similar examples, found in FEATURES frequent terms. Terms whose postings give a first bound of the nearest.
GROUPS, FEATURES, HEAVIEST = 2, 256, 16
#: Postings and entries arranged at a time.
RUN = 1 << 19
#: Texts looked up together. A term is a row of their matrix product with a group if it saves more postings than it has cells, at so many cells a posting; rows at a time.
TOGETHER, CELLS, ROWS = 512, 400, 256
THRESHOLD = 0.3
#: Heaviest words of a text looked at for evidence.
WORDS = 8
BEGINNINGS = range(4, 9)
#: Of the training rows, one in CALIBRATE calibrates; the others are examples.
CALIBRATE = 3
_no_word = re.compile(r"[\W_]+")


def bare_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    ends, codes, words = word_codes(texts)
    return ends, codes, [w.lower() if w.isalnum() else _no_word.sub("", w).lower() for w in words]


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) >= n)] if word else []


def _beginnings(words: list[str]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(strings, which words have them) of the words themselves and of their beginnings by length, in the order of terms_of."""
    column = pa.array(words, pa.string())
    length = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    yield column, length > 0
    for n in BEGINNINGS:
        yield pc.utf8_slice_codeunits(column, 0, n), length >= n


def all_terms(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """(a word's terms in a row, -1 for none; the terms' names)."""
    rows, names = np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int64), []
    for k, (strings, has) in enumerate(_beginnings(words)):
        coded = strings.filter(pa.array(has)).dictionary_encode()
        rows[has, k] = coded.indices.to_numpy() + len(names)
        names += [f"{t}~" for t in coded.dictionary.to_pylist()] if k else coded.dictionary.to_pylist()
    return rows, names


def term_places(ends: np.ndarray, codes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every occurrence of a term, rows in order. `terms` has a word's terms in a row, -1 for none."""
    known = terms >= 0
    n = known.sum(axis=1)
    if not n.any() or not len(codes):
        return (np.empty(0, np.int64),) * 2
    first, flat = np.concatenate([[0], np.cumsum(n)]), terms[known]
    times = n[codes]
    row = np.repeat(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), times)
    within = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return row, flat[np.repeat(first[codes], times) + within]


def _document_counts(rows: DataFrame) -> DataFrame:
    """(word, pos, neg): in how many toxic and other training texts each word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                ends, codes, words = bare_words(b.column("text"))
                terms, names = all_terms(words)
                row, term = term_places(ends, codes, terms)
                pairs = np.unique(row * (len(names) + 1) + term)
                toxic = b.column("toxic").to_numpy(zero_copy_only=False)[pairs // (len(names) + 1)]
                word = pairs % (len(names) + 1)
                pos = np.bincount(word[toxic == 1], minlength=len(names))
                neg = np.bincount(word[toxic == 0], minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pos), pa.array(neg)], names=["word", "pos", "neg"])

    parts = rows.mapInArrow(run, "word string, pos long, neg long")
    return parts.where("word <> ''").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _one_of_near_copies(rows: DataFrame) -> DataFrame:
    """(text, toxic): one row of each group of near-duplicates and label."""
    groups = near_duplicates(rows).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    least = F.min(F.struct("doc_id", "text")).alias("least")
    return rows.join(groups, "doc_id").groupBy("component_id", "toxic").agg(least).select("least.text", "toxic")


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n), of


#: What an index makes of its examples.
ARRANGED = ("row_of", "dense", "example", "value", "start", "most", "first")


@dataclass
class Index:
    """Examples in blocks. A term has an entry for each block, with its greatest weight there; an entry's postings are the block's examples with the term, and their weights.
    Frequent terms, which bound nothing, are rows of a matrix instead: what they give is known before the blocks are put in order.
    `more` are further parts with the same terms; ids, labels and counts are those of all parts, places go through them.
    Built parts are held and sent packed; their arrays are made where they are first looked at."""

    words: dict[str, int]
    weight: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.empty(0))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0))
    rate: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    blocks: int = 0
    more: list[Index] = field(default_factory=list)
    own: int = 0
    packed: tuple = ()

    def term_counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends of texts, terms, how often each stands in its text)."""
        ends, codes, words = bare_words(texts)
        row, term = term_places(ends, codes, self.known_terms(words))
        keys, n = np.unique(row * max(1, len(self.words)) + term, return_counts=True)
        row, term = np.divmod(keys, max(1, len(self.words)))
        return np.searchsorted(row, np.arange(len(texts) + 1)), term, n

    def known_terms(self, words: list[str]) -> np.ndarray:
        """A word's known terms in a row, -1 for none."""
        if "_sets" not in self.__dict__:
            kinds = [[w for w in self.words if not w.endswith("~")], *([w for w in self.words if len(w) == n + 1 and w.endswith("~")] for n in BEGINNINGS)]
            self._sets = [(pa.array([w.removesuffix("~") for w in kind], pa.string()), np.array([*(self.words[w] for w in kind), -1], np.int64)) for kind in kinds]
        rows = np.empty((len(words), len(self._sets)), np.int64)
        for k, ((strings, has), (known, place)) in enumerate(zip(_beginnings(words), self._sets, strict=True)):
            rows[:, k] = np.where(has, place[pc.fill_null(pc.index_in(strings, value_set=known), -1).to_numpy(zero_copy_only=False)], -1)
        return rows

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights of length 1) of each text; empty without a known term."""
        ends, term, n = self.term_counts(texts)
        w = (1 + np.log(n)) * self.weight[term] if len(term) else np.empty(0)
        return [(term[a:b], w[a:b] / max(1e-12, float(np.sqrt(w[a:b] @ w[a:b])))) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def build(self, examples: list[tuple]) -> None:
        """examples: (id, label, terms, weights, votes it counts for), put into an order that has similar ones in the same blocks."""
        examples = sorted(examples, key=lambda x: (x[1], int(x[2][np.argmax(x[3])]), np.asarray(x[2]).astype(">i4").tobytes(), str(x[0])))
        self.ids = np.array([x[0] for x in examples])
        self.labels, self.counts = np.array([x[1] for x in examples], float), np.array([x[4] for x in examples], float)
        self.own, self.blocks = len(examples), -(-len(examples) // BLOCK)
        at = np.repeat(np.arange(len(examples), dtype=np.int32), [len(x[2]) for x in examples])
        term = np.concatenate([x[2] for x in examples]).astype(np.int32) if examples else np.empty(0, np.int32)
        order = np.argsort(term, kind="stable")  # examples ascend within a term
        at, term = at[order], term[order]
        times = np.concatenate([x[5] for x in examples])[order] if examples and len(examples[0]) > 5 else None
        if times is None:
            self._arrange(at, term, np.concatenate([x[3] for x in examples]).astype(np.float32)[order] if examples else np.empty(0, np.float32))
            return
        norm, gaps = self._norms(at, term, times), np.diff(at, prepend=np.int32(0))
        self.packed = (len(at), norm, *(bytes(pa.compress(x.astype(np.int32).tobytes(), "zstd", asbytes=True)) for x in (np.bincount(term, minlength=len(self.words)), gaps, times)))

    def _norms(self, at: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        return np.sqrt(np.bincount(at, np.square((1 + np.log(times)) * self.weight[term]), minlength=len(self.ids)))

    def _values(self, at: np.ndarray, term: np.ndarray, times: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return ((1 + np.log(times)) * self.weight[term] / np.maximum(1e-12, norm[at])).astype(np.float32)

    def _arrange(self, at: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        """Matrix, postings and entries from (example, term, weight), ordered by term and example."""
        n, here = self.blocks * BLOCK, np.bincount(term, minlength=len(self.words))
        frequent = np.flatnonzero(here * DENSE >= max(1, self.own))
        self.row_of = np.full(len(self.words), -1, np.int32)
        self.row_of[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), n), np.float32)
        is_frequent = self.row_of[term] >= 0
        self.dense[self.row_of[term[is_frequent]], at[is_frequent]] = w[is_frequent]
        at, self.value, term = at[~is_frequent], w[~is_frequent], term[~is_frequent]
        self.example = at.astype(np.uint16 if n < 1 << 16 else np.int32)
        entry = term * np.int64(self.blocks) + at // BLOCK
        self._bound(np.bincount(entry, minlength=len(self.words) * self.blocks))

    def _bound(self, of_entry: np.ndarray) -> None:
        """Where entries start, and their greatest weights, from the number of postings of each."""
        self.start, self.most = np.zeros(len(of_entry) + 1, np.int32), np.zeros(len(of_entry), np.float32)
        np.cumsum(of_entry, out=self.start[1:])
        for a in range(0, len(of_entry), RUN):
            full = a + np.flatnonzero(of_entry[a : a + RUN])
            if len(full):
                here = slice(self.start[full[0]], self.start[full[-1] + 1])
                self.most[full] = np.maximum.reduceat(self.value[here], self.start[full] - here.start) * np.float32(1 + 1e-6)
        self.first = np.arange(len(self.words) + 1, dtype=np.int64) * self.blocks

    def __getattr__(self, name: str) -> np.ndarray:
        """The arrays of a packed part, when one is first looked at."""
        if name not in ARRANGED or not self.__dict__.get("packed"):
            raise AttributeError(name)
        at, term, times, norm = self._unpacked()
        self._arrange(at, term, self._values(at, term, times, norm))
        return self.__dict__[name]

    def _unpacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(example, term, how often, length of each example's vector), ordered by term and example."""
        n, norm, *packed = self.packed
        df, gaps, times = (np.frombuffer(pa.decompress(x, 4 * m, "zstd"), np.int32) for x, m in zip(packed, (len(self.words), n, n), strict=True))
        return np.cumsum(gaps, dtype=np.int32), np.repeat(np.arange(len(df), dtype=np.int32), df), times, norm

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, term, weight) of all parts' postings, part by part, by term and example, some at a time."""
        for offset, part in self.parts():
            at, term, times, norm = part._unpacked()
            for a in range(0, len(at), RUN):
                here = slice(a, a + RUN)
                yield at[here] + np.int32(offset), term[here], part._values(at[here], term[here], times[here], norm)

    def __getstate__(self) -> dict:
        """What goes to the executors: counts of terms and gaps between examples, compressed, in place of the arrays made of them."""
        return {k: v for k, v in self.__dict__.items() if k not in ("_sets", "_grouped", "_sent") and not (self.packed and k in ARRANGED)}

    def grouped(self) -> Grouped:
        """The same examples in groups of similar ones."""
        if "_grouped" not in self.__dict__:
            self._grouped = Grouped.of(self)
        return self._grouped

    def add(self, part: Index) -> None:
        """One more part, built with the same terms. The first one is the index itself."""
        if len(self.ids):
            if not len(part.ids):
                return
            self.more.append(part)
            self.ids, self.labels, self.counts = (np.concatenate([getattr(self, n), getattr(part, n)]) for n in ("ids", "labels", "counts"))
            return
        for n in ("ids", "labels", "counts", "blocks", "own", "packed", *(ARRANGED if not part.packed else ())):
            setattr(self, n, getattr(part, n))

    def parts(self) -> list[tuple[int, Index]]:
        """(place of its first example, part) of each part."""
        sizes = [len(p.ids) for p in self.more]
        return list(zip([0, *(len(self.ids) - np.cumsum(sizes[::-1])[::-1] if sizes else [])], [self, *self.more], strict=True))

    def known(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the part's frequent terms give to each text and example."""
        q = np.zeros((len(vectors), len(self.dense)), np.float32)
        for k, (t, w) in enumerate(vectors):
            row = self.row_of[t]
            q[k, row[row >= 0]] = w[row >= 0]
        return q @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, known: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples of all parts with a cosine over 0; ties go to the first places."""
        places, cosines = np.empty(0, np.int64), np.empty(0)
        for j, (offset, part) in enumerate(self.parts()):
            of_frequent = part.known([(terms, weights)])[0] if known is None else known[j]
            rare = part.row_of[terms] < 0
            lists = part._lists(terms[rare])
            places, cosines = part._nearer(terms[rare], *lists, weights[rare].astype(np.float32), k, of_frequent, np.arange(offset, offset + part.own), places, cosines)
        return places, cosines

    def _lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's postings start, and their number."""
        start = self.start[self.first[terms]].astype(np.int64)
        return start, self.start[self.first[terms + 1]] - start

    def _nearer(self, terms: np.ndarray, start: np.ndarray, times: np.ndarray, weights: np.ndarray, k: int, known: np.ndarray, place_of: np.ndarray, places: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of those found and this part's examples: blocks in order of their bounds, in waves, until none can change them."""
        if not self.blocks:
            return places, cosines
        bound = (known.reshape(self.blocks, BLOCK).max(axis=1) + weights @ self.most.reshape(-1, self.blocks)[terms]) * (1 + 1e-5)
        least = max(cosines[k - 1] - 1e-5, 0.0) if len(places) >= k else 0.0
        if bound.max() < least:
            return places, cosines
        if not len(places):
            heavy = np.argpartition(-weights, HEAVIEST)[:HEAVIEST] if len(weights) > HEAVIEST else np.arange(len(weights))
            least = _kth_at_least(self._added(start[heavy], times[heavy], weights[heavy], known), k) - 1e-5  # what some terms give is a lower bound
        order, size = np.argsort(-bound, kind="stable"), WAVE
        order = order[bound[order] > 0]
        while True:
            order = order[bound[order] >= least]
            if not len(order):
                return places, cosines
            if 3 * len(order) > self.blocks:  # so many that whole lists are added up faster
                size = self.blocks
            wave, order, size = order[:size], order[size:], 2 * size
            if 3 * len(wave) > self.blocks:
                got = self._added(start, times, weights, known)
            else:
                got = self._added_of(wave, terms, weights, known)
            least = max(least, _kth_at_least(got, k) - 2e-6)
            hit = np.flatnonzero(got >= max(least, 1e-12))
            places, cosines = np.concatenate([places, place_of[hit]]), np.concatenate([cosines, got[hit]])
            best = np.lexsort((places, -cosines.round(6)))[:k]
            places, cosines = places[best], cosines[best]
            if len(places) >= k:
                least = max(least, cosines[k - 1] - 1e-5)

    def _added(self, start: np.ndarray, times: np.ndarray, weights: np.ndarray, known: np.ndarray) -> np.ndarray:
        """What is known of each example's cosine and what these lists of postings give to it."""
        posting = np.repeat(start - (np.cumsum(times) - times), times)
        posting += np.arange(len(posting))
        w = self.value.take(posting)
        w *= np.repeat(weights, times)
        return known + np.bincount(self.example.take(posting), w, minlength=len(known))

    def _added_of(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The same for the examples of some blocks; 0 for those of others."""
        entry = (self.first[terms][:, None] + blocks).ravel()
        posting, of = _ranges(self.start[entry], self.start[entry + 1])
        got = np.zeros((self.blocks, BLOCK))
        added = np.bincount(self.example[posting], np.repeat(weights, len(blocks))[of] * self.value[posting], minlength=len(known))
        got[blocks] = (known + added).reshape(got.shape)[blocks]
        return got.ravel()

    def has(self, place: int, term: int) -> bool:
        """Whether an example has a term."""
        offset, part = next(x for x in reversed(self.parts()) if x[0] <= place)
        if part.row_of[term] >= 0:
            return bool(part.dense[part.row_of[term], place - offset] > 0)
        return bool((part.example[part.start[part.first[term]] : part.start[part.first[term + 1]]] == place - offset).any())

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**POWER
        counted = w * self.counts[places]
        return float((counted @ self.labels[places] + PRIOR_VOTES * self.rate) / (counted.sum() + PRIOR_VOTES)) if len(places) else self.rate

    def votes(self, texts: pa.Array) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """(vote, places of the nearest, terms, weights) of each text."""
        vectors, found = self.vectors(texts), self.grouped()
        near = found.nearest(vectors)
        return [(self.vote(*n), n[0], t, w) for n, (t, w) in zip(near, vectors, strict=True)]

    def score(self, vote: float) -> float:
        return logistic(vote, self.slope, self.shift)


@dataclass
class Grouped:
    """The examples of an index in groups of similar ones, each an index of its own. Texts like one group's examples are looked up together:
    terms that many of them and of the group's examples have are rows of a matrix, made for these texts; the others' blocks are searched text by text."""

    places: list[np.ndarray]
    groups: list[Index]
    like: np.ndarray

    @classmethod
    def of(cls, index: Index) -> Grouped:
        if not len(index.ids):
            return cls([], [], np.zeros((len(index.words), 0), np.float32))
        of_example, n_terms = _similar(index), len(index.words)
        n_groups = int(of_example.max()) + 1
        places = [np.flatnonzero(of_example == g) for g in range(n_groups)]
        local, df = np.zeros(len(of_example), np.int32), np.zeros((n_groups, n_terms), np.int64)
        for at, term, _ in index.runs():
            df += np.bincount(of_example[at] * n_terms + term, minlength=df.size).reshape(df.shape)
        found = cls(places, [], np.zeros((n_terms, n_groups), np.float32))
        for g, p in enumerate(places):
            local[p] = np.arange(len(p))
            group = Index(index.words, index.weight, blocks=-(-len(p) // BLOCK), own=len(p))
            group.row_of, group.dense = np.full(n_terms, -1, np.int32), np.zeros((0, group.blocks * BLOCK), np.float32)
            group.example, group.value = np.empty(df[g].sum(), np.uint16 if len(p) < 1 << 16 else np.int32), np.empty(df[g].sum(), np.float32)
            found.groups.append(group)
        free, of_entry = np.cumsum(df, axis=1) - df, [np.zeros(n_terms * g.blocks, np.int32) for g in found.groups]
        for at, term, w in index.runs():
            in_group = of_example[at]
            for g, group in enumerate(found.groups):
                here = np.flatnonzero(in_group == g)
                t, example, v = term[here], local[at[here]], w[here]
                n = np.bincount(t, minlength=n_terms)
                to = np.repeat(free[g] - (np.cumsum(n) - n), n)
                to += np.arange(len(t))
                group.example[to], group.value[to] = example, v
                free[g] += n
                np.add.at(of_entry[g], t.astype(np.int64) * group.blocks + example // BLOCK, 1)
                found.like[:, g] += np.bincount(t, v, minlength=n_terms) / group.own
        for group, n in zip(found.groups, of_entry, strict=True):
            group._bound(n)
        return found

    def shared(self, place: int, terms: np.ndarray) -> set[int]:
        """Those of the terms that an example has."""
        g = next(g for g, p in enumerate(self.places) if len(p) > (j := np.searchsorted(p, place)) and p[j] == place)
        at = int(np.searchsorted(self.places[g], place))
        return {t for t in terms.tolist() if self.groups[g].has(at, t)}

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, cosines) of the k nearest examples of each vector, as Index.nearest gives them."""
        likes = np.array([w @ self.like[t] for t, w in vectors]).reshape(len(vectors), len(self.groups))
        long = [len(t) for t, _ in vectors]
        out, order = [(np.empty(0, np.int64), np.empty(0))] * len(vectors), np.lexsort((long, likes.argmax(axis=1))).tolist() if self.groups else []
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            row = np.repeat(np.arange(len(some)), [long[j] for j in some])
            term, w = np.concatenate([vectors[j][0] for j in some]), np.concatenate([vectors[j][1] for j in some]).astype(np.float32)
            met = [self._meet(g, row, term, w, len(some)) for g in self.groups]
            for n, j in enumerate(some):
                for g in np.argsort(-likes[j], kind="stable").tolist() if long[j] else []:
                    known, ends, *rest = met[g]
                    out[j] = self.groups[g]._nearer(*(x[ends[n] : ends[n + 1]] for x in rest), k, known[n], self.places[g], *out[j])
        return out

    def _meet(self, group: Index, row: np.ndarray, term: np.ndarray, w: np.ndarray, n_rows: int) -> tuple[np.ndarray, ...]:
        """(what the terms that pay as rows of a matrix give to each text and example; ends of the texts, terms, their lists and weights of the others)."""
        n, n_terms = group.blocks * BLOCK, len(group.words)
        df = np.diff(group.start[group.first])
        times = np.bincount(term, minlength=n_terms)
        pays = np.flatnonzero(df * times.astype(float) * CELLS > (n_rows + 8.0) * n + CELLS * df)
        column = np.full(n_terms, -1)
        column[pays] = np.arange(len(pays))
        of = column[term]
        q = np.zeros((len(pays), n_rows), np.float32)
        q[of[of >= 0], row[of >= 0]] = w[of >= 0]
        known = np.zeros((n_rows, n), np.float32)
        for a in range(0, len(pays), ROWS):
            some = pays[a : a + ROWS]
            posting, r = _ranges(group.start[group.first[some]].astype(np.int64), group.start[group.first[some + 1]])
            rows = np.zeros((len(some), n), np.float32)
            rows[r, group.example[posting]] = group.value[posting]
            known += q[a : a + ROWS].T @ rows
        rest = (of < 0) & (df[term] > 0)
        return known, np.searchsorted(row[rest], np.arange(n_rows + 1)), term[rest], *group._lists(term[rest]), w[rest]


def _similar(index: Index, rounds: int = 8) -> np.ndarray:
    """A group of each example, by k-means over its most frequent terms. What is found depends on no group."""
    n, df = len(index.ids), np.zeros(len(index.words), np.int64)
    for _, part in index.parts():
        df += np.frombuffer(pa.decompress(part.packed[2], 4 * len(df), "zstd"), np.int32)
    column = np.full(len(df), -1)
    frequent = np.argsort(-df, kind="stable")[:FEATURES]
    column[frequent] = np.arange(len(frequent))
    x = np.zeros((n, len(frequent)), np.float32)
    for at, term, _ in index.runs():
        has = np.flatnonzero(column[term] >= 0)
        x[at[has], column[term[has]]] = np.log1p(n / df[term[has]])
    x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    draw, centres = np.random.default_rng(0), x[:1]
    while len(centres) < min(GROUPS, n // (4 * BLOCK)):
        far = np.clip(1 - (x @ centres.T).max(axis=1), 0, None).astype(float) ** 2
        if far.sum() <= 1e-9:
            break
        centres = np.concatenate([centres, x[draw.choice(n, p=far / far.sum())][None]])
    for _ in range(rounds):
        group = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[group == g].sum(axis=0) for g in range(len(centres))])
        centres = sums / np.maximum(1e-12, np.linalg.norm(sums, axis=1, keepdims=True))
    group = (x @ centres.T).argmax(axis=1)
    return np.unique(group, return_inverse=True)[1]


def _kth_at_least(got: np.ndarray, k: int) -> float:
    """A number that the k greatest reach: the k-th of the greatest of runs."""
    most = got.reshape(-1, 32).max(axis=1)
    return float(np.partition(most, len(most) - k)[len(most) - k]) if len(most) >= k else 0.0


def logistic(vote: float, slope: float, shift: float) -> float:
    v = min(max(vote, 1e-6), 1 - 1e-6)
    return float(1 / (1 + np.exp(-(slope * np.log(v / (1 - v)) + shift))))


def calibrate(votes: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the votes' log-odds, by Newton steps with a weak pull to (1, 0)."""
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], axis=1)
    b, pull = np.array([1.0, 0.0]), np.diag([1.0, 0.1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ b)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (labels - p) - pull @ (b - [1.0, 0.0]))
        b = b + np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about max_rows labelled rows at most, a row for each text. The ids of that bounded choice are broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").where(train).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(share * 2**53))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_ROWS, part_rows: int = PART) -> Index:
    """An index and calibration from the labelled rows for which `train`, a condition on doc_id, holds."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = scratch.put("rows", training_rows(docs, labels, train, max_rows))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    index = Index({}, np.empty(0), rate=pos / max(1, pos + neg))
    if not pos or not neg:
        scratch.drop("rows")
        return index
    once = scratch.put("once", _one_of_near_copies(rows))
    m = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = lambda c, of: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (m[1] + m[0]) / ((F.col("pos") + F.col("neg")) * of))).otherwise(0.0)
    terms = _document_counts(once).where(F.col("pos") + F.col("neg") >= max(LEAST_DOCS, (m[0] + m[1]) / LEAST_SHARE)).select("word", (F.col("pos") + F.col("neg")).alias("df"), (2 * (part("pos", m[1]) + part("neg", m[0]))).alias("ratio"))
    found = terms.orderBy("word").toArrow()  # the terms of max_rows texts
    index.words = {w: k for k, w in enumerate(found.column("word").to_pylist())}
    tells = np.clip((found.column("ratio").to_numpy() - RATIOS[0]) / (RATIOS[1] - RATIOS[0]), 0, 1)
    index.weight = (np.log((m[1] + m[0] + 1) / (found.column("df").to_numpy() + 1)) + 0.1) * (1 + BOOST * tells)
    held = spark.sparkContext.broadcast(index)
    draw = lambda name: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(name)), 11) / F.lit(float(2**53))
    calibrates = draw("calibrate") < 1 / CALIBRATE
    chosen = rows.where(~calibrates)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                ends, term, n = held.value.term_counts(b.column("text"))
                cols = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (term, n)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *cols], names=["doc_id", "toxic", "terms", "times"])

    def build(table: pa.Table) -> pa.Table:
        cols = zip(table.column("doc_id").to_pylist(), table.column("toxic").to_pylist(), table.column("terms"), table.column("times"), strict=True)
        weight = held.value.weight
        of_part = [(i, y, t.values.to_numpy(), (1 + np.log(n.values.to_numpy())) * weight[t.values.to_numpy()], 1.0, n.values.to_numpy()) for i, y, t, n in cols]
        part = Index(held.value.words, weight)
        part.build([x for x in of_part if len(x[2])])
        made = {n: getattr(part, n) for n in ("ids", "labels", "counts", "blocks", "own", "packed")}
        return pa.table({"part": table.column("part")[:1], "made": pa.array([pickle.dumps((made, [x[1] for x in of_part if not len(x[2])]))], pa.binary())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    n_parts = max(1, -(-chosen.count() // part_rows))
    examples = chosen.mapInArrow(vectors, f"doc_id {kind}, toxic int, terms array<int>, times array<int>").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)))
    made = examples.groupBy("part").applyInArrow(build, "part long, made binary").toArrow()  # each part packed where it is made: some MB
    bare = []
    for k in np.argsort(made.column("part").to_numpy()).tolist():
        state, without = pickle.loads(made.column("made")[k].as_py())
        bare += without
        part = Index(index.words, index.weight)
        part.__dict__.update(state)
        index.add(part)
    del made
    index.rate = (sum(bare) + index.rate) / (len(bare) + 1)
    held.destroy()
    held = spark.sparkContext.broadcast(index)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([v for v, *_ in held.value.votes(b.column("text"))], pa.float64())], names=["toxic", "vote"])

    check = rows.where(calibrates).mapInArrow(votes, "toxic int, vote double").toArrow()  # two numbers a row, of max_rows / CALIBRATE
    if check.num_rows:
        order = np.lexsort((check.column("toxic").to_numpy(), check.column("vote").to_numpy()))
        index.slope, index.shift = calibrate(check.column("vote").to_numpy()[order], check.column("toxic").to_numpy()[order].astype(float))
    index._sent = (spark.sparkContext.applicationId, held)  # score sends no other: workers have its examples arranged
    scratch.drop("rows", "once")
    return index


RESULT = ("score", "predicted", "evidence", "evidence_words")


def score(docs: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns, and score, predicted, the three nearest examples' ids and the heaviest words shared with the nearest. No exchange."""
    ship(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in RESULT])
    context = docs.sparkSession.sparkContext
    app, held = index.__dict__.get("_sent", ("", None))
    if app != context.applicationId:
        held = context.broadcast(index)
    slope, shift = index.slope, index.shift
    ids = T.StringType() if index.ids.dtype.kind in "UO" else T.LongType()
    kinds = [T.DoubleType(), T.IntegerType(), T.ArrayType(ids), T.ArrayType(T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        names = list(index.words)
        for whole in batches:
            for b in text_slices(whole, text):
                got = []
                for vote, near, t, w in index.votes(b.column(text)):
                    heavy = t[np.argsort(-w, kind="stable")[:WORDS]]
                    first = index.grouped().shared(int(near[0]), heavy) if len(near) else ()
                    shared = [k for k in heavy.tolist() if k in first]
                    got.append((logistic(vote, slope, shift), index.ids[near[:3]].tolist(), [names[k] for k in shared]))
                cols = [
                    pa.array([s for s, _, _ in got], pa.float64()), pa.array([int(s >= threshold) for s, _, _ in got], pa.int32()),
                    pa.array([e for _, e, _ in got], pa.list_(pa.string() if ids == T.StringType() else pa.int64())), pa.array([w for _, _, w in got], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *RESULT])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(RESULT, kinds, strict=True)]]))

"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Labelled texts (a bounded sample of each label) are the index. Its terms are all words of the examples and the beginnings
of longer words, so that the forms of one stem count together. No term is left out: a term weighs its rarity times its lift,
the log ratio of its shares in the examples of label 1 and of label 0, less LESS standard errors (counted in one half of the
examples) and FLOOR at least. The bound nears the true ratio as examples are added, so rare terms need no more of them.

Examples stand in blocks. Postings of rare terms are added up first; frequent terms are dense, with the largest weight of
every block. A text is scored against the blocks with the highest bound first, then against all blocks whose bound reaches
the k-th best cosine found: the neighbours are exactly those of a full comparison, ties by index order. Their
distance-weighted vote is calibrated on the other half of the examples, each scored without itself.

Terms are counted, examples weighed and scored by tasks; the driver holds the postings only, which are sent once.

Rows: null and empty texts, and texts without a known term, get the calibrated score of the prior; texts are read whole;
repeated rows get equal scores; labels that are null are left out, an id labelled twice has its higher label; without
examples of both labels every score is 0. Examples with equal ids stand in the index once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, store, word_hashes

EXAMPLES = (4000, 3000)  # expected examples of label 0 and 1
PREFIXES = (3, 5, 7)  # characters of the beginnings that are terms
LESS = 2.0  # standard errors taken off the log ratio
FLOOR = 0.1  # weight of terms without lift
FREQUENT = 32  # a term is dense from one of so many examples on
NEIGHBOURS = 25
BLOCK = 64
_FIRST = 6  # blocks scored before the threshold is known
_TEXTS = 200  # texts scored at a time
# letters of any script stay; ASCII signs and digits part words; A-Z are lower-cased
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashes of words and beginnings, and their counts."""
    words, at = word_hashes(texts, table=_WORDS, prefixes=PREFIXES)
    return [np.unique(words[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray  # weights of the terms: rarity times lift
    weights: np.ndarray  # (blocks * frequent terms, examples of a block): dense postings, each example of length one
    top: np.ndarray  # (blocks, frequent terms)
    label: np.ndarray  # (blocks, examples of a block); -1 where a block is not full
    ids: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    dense: np.ndarray | None = None  # row of a frequent term among the dense ones, -1 for a rare term; None: all are frequent
    starts: np.ndarray | None = None  # postings of rare term t: starts[t] to starts[t + 1]
    places: np.ndarray | None = None
    rare: np.ndarray | None = None

    def vector(self, own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their weights."""
        if not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == own
        at = at[known]
        weight = (1 + np.log(counts[known])) * self.idf[at]
        return at, weight / np.sqrt((weight**2).sum()) if len(at) else weight

    def _rare_part(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What rare terms add to the cosine of every example."""
        begin, have = self.starts[at], self.starts[at + 1] - self.starts[at]
        posting = np.repeat(begin - np.cumsum(have) + have, have) + np.arange(have.sum())
        return np.bincount(self.places[posting], np.repeat(weight, have) * self.rare[posting], self.label.size)

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the k nearest examples of every text, best first."""
        blocks, frequent = self.top.shape
        postings = self.weights.reshape(blocks, frequent, BLOCK)
        query = np.zeros((len(vectors), frequent), self.weights.dtype)
        base = np.zeros((len(vectors), blocks, BLOCK), self.weights.dtype)
        for n, (at, weight) in enumerate(vectors):
            row = at if self.dense is None else self.dense[at]
            query[n, row[row >= 0]] = weight[row >= 0]
            if self.dense is not None:
                base[n] = self._rare_part(at[row < 0], weight[row < 0]).reshape(blocks, BLOCK)
        digits = 12 if self.weights.dtype == np.float64 else 6
        bound = query @ self.top.T + base.max(2) + 10.0**-digits
        score = np.full(base.shape, -1.0, base.dtype)
        use = self.label >= 0

        def fill(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(0)):
                texts = np.flatnonzero(chosen[:, b])
                score[texts, b] = np.where(use[b], query[texts] @ postings[b] + base[texts, b], -1)
                for n in texts if without is not None else ():
                    if without[n] // BLOCK == b:
                        score[n, b, without[n] % BLOCK] = -1

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :_FIRST], True, 1)
        fill(first)
        flat = score.reshape(len(vectors), -1)
        least = min(k, flat.shape[1])
        fill(~first & (bound >= np.partition(flat, -least, 1)[:, -least, None]))
        floor = np.partition(flat, -least, 1)[:, -least] - 10.0**-digits
        out = []
        for own, low in zip(flat, floor):
            place = np.flatnonzero((own >= low) & (own > 0))
            place = place[np.lexsort((place, -np.round(own[place], digits)))[:k]]
            out.append((place, own[place].astype(np.float64)))
        return out

    def nearest(self, at: np.ndarray, weight: np.ndarray, without: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples of one text."""
        return self.nearest_of([(at, weight)], [without], k)[0]

    def vote(self, place: np.ndarray, score: np.ndarray) -> float:
        """Log odds of the distance-weighted vote, drawn to even odds by one weak neighbour; without likeness there is no vote."""
        weight = score**2 / np.maximum(1e-3, 1 - score)
        toxic = float((weight * self.label.ravel()[place]).sum())
        return float(np.log((toxic + 0.05) / (weight.sum() - toxic + 0.05)))

    def scores(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        out: list[tuple[float, list[int]]] = []
        for begin in range(0, len(bags), _TEXTS):
            vectors = [self.vector(*x) for x in bags[begin : begin + _TEXTS]]
            for place, cosine in self.nearest_of(vectors):
                if not len(place):
                    out.append((self.prior, []))
                    continue
                odds = self.slope * self.vote(place, cosine) + self.shift
                out.append((float(1 / (1 + np.exp(-np.clip(odds, -30, 30)))), [int(x) for x in self.ids[place[:3]]]))
        return out

    def score(self, own: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        return self.scores([(own, counts)])[0]


def lift(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """Log ratio of a term's shares in label 1 and label 0, less LESS standard errors; FLOOR at least."""
    ratio = np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))
    return FLOOR + np.maximum(0, ratio - LESS * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = terms(column(batch, "text"))
        lists = [pa.array([x.view(np.int64).tolist() for x, _ in own], pa.list_(pa.int64())), pa.array([y.tolist() for _, y in own], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "label", "term", "times"])


@dataclass
class _Sample:
    """The examples in the order of the index: those with similar terms side by side keep block maxima low."""

    ids: np.ndarray
    label: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, got: pa.Table) -> _Sample | None:
        got = got.select(["doc_id", "label", "half"]).sort_by([("label", "ascending"), ("doc_id", "ascending")])
        out = cls(*(got[c].to_numpy() for c in ("doc_id", "label", "half")))
        return out if out.counted().all() else None

    def counted(self) -> np.ndarray:
        """Examples of label 0 and 1 in the half that lift is counted in."""
        return np.bincount(self.label[self.half == 0], minlength=2)

    def places(self, ids: np.ndarray) -> np.ndarray:
        order = np.argsort(self.ids)
        return order[np.searchsorted(self.ids, ids, sorter=order)].astype(np.int32)

    def groups(self) -> np.ndarray:
        """Of each example: with which others it is scored for the calibration; -1 if it is not."""
        held = self.half == 1
        return np.where(held, (np.cumsum(held) - 1) // _TEXTS, -1).astype(np.int32)

    def idf(self, have: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        here = self.counted()
        return (np.log(len(self.ids) / np.maximum(have, 1)) + 1) * lift(n0, n1, int(here[0]), int(here[1]))


def _weighed(term: pa.Array, times: pa.Array, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, places in the vocabulary and weights of the terms of examples; each example has length one."""
    have = pc.list_value_length(term).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(have)), have)
    at = np.searchsorted(vocabulary, pc.list_flatten(term).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.int32)
    weight = (1 + np.log(pc.list_flatten(times).to_numpy(zero_copy_only=False))).astype(np.float32)
    weight *= idf[at].astype(np.float32)
    weight /= np.sqrt(np.bincount(row, weight.astype(np.float64) ** 2, len(have))).astype(np.float32)[row]
    return np.concatenate(([0], np.cumsum(have))).astype(np.int32), at, weight


def _weigh(shared, sample: _Sample):
    """Examples as own (place in the index), part (group of the calibration), at and weight (of its terms)."""
    groups = sample.groups()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sample.places(batch.column(0).to_numpy(zero_copy_only=False))
            starts, at, weight = _weighed(batch.column(1), batch.column(2), *shared.value)
            lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in (at, weight)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(groups[own]), *lists], names=["own", "part", "at", "weight"])

    return run


def _in_order(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """own, at and weight of every row, by own; the arrays are parts of the table's."""
    out = []
    for batch in table.to_batches():
        at, weight = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "weight"))
        edges, values = [x.offsets.to_numpy() for x in (at, weight)], [x.values.to_numpy() for x in (at, weight)]
        out += [(own, *(v[e[k] : e[k + 1]] for e, v in zip(edges, values))) for k, own in enumerate(column(batch, "own"))]
    return sorted(out, key=lambda row: row[0])


def _votes(index: Index, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[float | None]:
    """Votes of the neighbours of examples, each without itself; none where nothing is alike."""
    near = index.nearest_of([(at, weight) for _, at, weight in rows], [own for own, _, _ in rows])
    return [index.vote(*x) if len(x[0]) else None for x in near]


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, examples: tuple[int, int] = EXAMPLES) -> Model | None:
    """Index of about that many examples of each label, chosen by a hash of the id; ``labels``: doc_id, label (0 or 1)."""
    marked = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    unit = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = marked.where(unit < F.when(F.col("label") == 1, min(1.0, examples[1] / sizes[1])).otherwise(min(1.0, examples[0] / sizes[0])))
    rows = documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), F.col("id") == F.col("doc_id")).select("doc_id", "label", "text")
    bags = rows.mapInArrow(_terms_of, "doc_id long, label int, term array<long>, times array<int>").dropDuplicates(["doc_id"])
    bags = store(bags.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")), "examples")
    sample = _Sample.of(bags.select("doc_id", "label", "half").toArrow())
    if sample is None:
        return None

    first = F.col("half") == 0
    counts = [F.count("*"), *[F.count(F.when(first & (F.col("label") == k), 1)) for k in (0, 1)]]
    counted = bags.select("label", "half", F.explode("term").alias("term")).groupBy("term").agg(*[c.cast("int").alias(n) for c, n in zip(counts, ("have", "n0", "n1"))])
    got = counted.toArrow()  # the terms of the bounded sample
    vocabulary = got["term"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary = vocabulary[order]
    have, n0, n1 = (got[c].to_numpy()[order].astype(np.float64) for c in ("have", "n0", "n1"))
    del got, order
    idf, starts = sample.idf(have, n0, n1), np.concatenate(([0], np.cumsum(have.astype(np.int64))))
    del have, n0, n1

    weighed = bags.select("doc_id", "term", "times").mapInArrow(_weigh(spark.sparkContext.broadcast((vocabulary, idf)), sample), "own int, part int, at array<int>, weight array<float>")
    weighed = store(weighed, "weighed")
    got = weighed.select("own", "at", "weight").toArrow()  # the bounded sample
    packed = _Packed(vocabulary, idf, starts, *_postings(starts, _in_order(got)), sample.label, sample.ids)
    del got
    shared = spark.sparkContext.broadcast(packed)

    def vote(table: pa.Table) -> pa.Table:
        own = _in_order(table)
        return pa.table({"own": pa.array([row[0] for row in own], pa.int32()), "vote": pa.array(_votes(shared.value, own), pa.float64())})

    votes = weighed.where("part >= 0").groupBy("part").applyInArrow(vote, "own int, vote double").toArrow().sort_by("own")
    return Model(shared, *_calibration(sample, sizes, votes["own"].to_numpy(), votes["vote"].to_pylist()))


def build(got: pa.Table, sizes: dict[int, int]) -> Index | None:
    """Index of examples (doc_id, label, term, times, half) that are at hand, by the steps of fit; ``sizes``: labelled rows by label."""
    sample = _Sample.of(got)
    if sample is None:
        return None
    of, label, half = sample.places(got["doc_id"].to_numpy()), got["label"].to_numpy(), got["half"].to_numpy()
    term, times = (got[c].combine_chunks() for c in ("term", "times"))
    vocabulary, at, have = np.unique(pc.list_flatten(term).to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(got.num_rows), pc.list_value_length(term).to_numpy(zero_copy_only=False))
    n0, n1 = (np.bincount(at, (half[row] == 0) & (label[row] == k), len(vocabulary)) for k in (0, 1))
    idf, starts = sample.idf(have, n0, n1), np.concatenate(([0], np.cumsum(have)))
    edges, at, weight = _weighed(term, times, vocabulary, idf)
    rows = sorted(((own, at[a:b], weight[a:b]) for own, a, b in zip(of.tolist(), edges[:-1], edges[1:])), key=lambda row: row[0])
    index = _unpack(vocabulary, idf, starts, *_postings(starts, rows), sample.label, sample.ids)
    held = [row for row in rows if sample.half[row[0]] == 1]
    votes = [v for k in range(0, len(held), _TEXTS) for v in _votes(index, held[k : k + _TEXTS])]
    index.prior, index.slope, index.shift = _calibration(sample, sizes, np.array([own for own, _, _ in held], np.int64), votes)
    return index


def _postings(starts: np.ndarray, rows: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights by term, of examples in the order of the index; an example has each of its terms once."""
    places, weights, free = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.float32), starts[:-1].copy()
    for own, at, weight in rows:
        to = free[at]
        places[to], weights[to] = own, weight
        free[at] += 1
    return places, weights


def _calibration(sample: _Sample, sizes: dict[int, int], held: np.ndarray, votes: list[float | None]) -> tuple[float, float, float]:
    """Prior, slope and shift: logistic regression of the label on the vote, over the half that the lift was not counted in.

    An example counts for the labelled rows that it stands for. Texts without a vote get the share of label 1 among
    examples without one.
    """
    label = sample.label
    stands_for = np.where(label == 1, sizes[1] / max(1, (label == 1).sum()), sizes[0] / max(1, (label == 0).sum()))
    spoke = np.array([v is not None for v in votes], bool)
    voted, silent = held[spoke], held[~spoke]
    total = stands_for[silent].sum() + 2
    prior = float(((stands_for * label)[silent].sum() + 1) / total) if len(silent) else 0.5
    # one example of each label at the other's typical vote keeps separable votes from an infinite slope
    x = np.array([*[v for v in votes if v is not None], 1.0, -1.0])
    y = np.array([*label[voted], 0, 1])
    weight = np.array([*stands_for[voted], 1.0, 1.0])
    weight /= weight.sum()
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        gap, curve = weight * (p - y), weight * p * (1 - p)
        hessian = np.array([[(curve * x * x).sum() + 1e-3, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(gap * x).sum() + 1e-3 * (slope - 1), gap.sum() + 1e-3 * shift])
        slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -1, 1))
    return prior, slope, shift


@dataclass
class _Packed:
    """The postings of all terms, as they are sent to the tasks, where they become an index."""

    vocabulary: np.ndarray
    idf: np.ndarray
    starts: np.ndarray  # postings of term t: starts[t] to starts[t + 1]
    places: np.ndarray
    weights: np.ndarray
    label: np.ndarray
    ids: np.ndarray

    def __reduce__(self):
        return _unpack, (self.vocabulary, self.idf, self.starts, self.places, self.weights, self.label, self.ids)


def _unpack(vocabulary, idf, starts, places, weights, label, ids) -> Index:
    have, blocks = np.diff(starts), -(-len(ids) // BLOCK)
    often = have * FREQUENT >= len(ids)
    dense = np.where(often, np.cumsum(often) - 1, -1)
    cube, held = np.zeros((blocks, int(often.sum()), BLOCK), np.float32), np.repeat(often, have)
    own = places[held]
    cube[own // BLOCK, np.repeat(dense[often], have[often]), own % BLOCK] = weights[held]
    full = np.full(blocks * BLOCK, -1)
    full[: len(label)] = label
    index = Index(vocabulary, idf, cube.reshape(-1, BLOCK), cube.max(2), full.reshape(blocks, BLOCK), np.pad(ids, (0, blocks * BLOCK - len(ids))), 0.0)
    index.dense, index.starts, index.places, index.rare = dense, np.concatenate(([0], np.cumsum(np.where(often, 0, have)))), places[~held], weights[~held]
    return index


@dataclass
class Model:
    """The index as the tasks hold it, and its calibration."""

    shared: Broadcast
    prior: float
    slope: float
    shift: float


def predict(spark: SparkSession, documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and the ids of the three nearest examples (evidence) of every document."""
    shared, calibration = (model.shared, (model.prior, model.slope, model.shift)) if model is not None else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value if shared is not None else None
        if own is not None:
            own.prior, own.slope, own.shift = calibration
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1000):
                texts = column(batch.slice(at, 1000), "text")
                out += own.scores(terms(texts)) if own is not None else [(0.0, [])] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")

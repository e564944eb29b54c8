"""Toxicity by nearest labelled examples (operator 1): exact TF-IDF cosine with a block-max inverted index.

Features are lower-cased words and word beginnings of 5 and 6 letters; of those that lean to label 1 on the
sample, the ``FEATURES`` with the highest chi-square span the vectors, so the cosine is that of what speaks for
the label in two texts and not of all their words.  The index keeps, for every feature, its postings
in blocks of examples and the largest weight of each block.  A query bounds every block by these
maxima, reads blocks in falling order of the bound, and stops when no bound can reach the k-th best
cosine: the neighbours are exact.  The queries of a batch go through this together.  Votes are weighted by distance and calibrated on the sample, each
example being left out of its own neighbours.

The fit reads a bounded sample: at most ``SAMPLE`` labelled documents of either label outside the
held-out fold, those with the smallest hash of their id, and the share of labels over all of that
fold.  Every document is scored.  Null and empty texts have no neighbours and get the score of an
empty vector; repeated rows get equal scores; a very long text is one row of counts; an empty table gives no
rows; with no labels or one label alone every score is the share of label 1.  A kept column that has the name
of a column made here (``score``, ``predicted``, ``evidence``) gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 2_500
FEATURES = 1_500
NEIGHBOURS = 24
BLOCK = 64
FOLDS = 5
THRESHOLD = 0.5
EVIDENCE = 3
#: Queries that go through the index together.
TOGETHER = 64
#: A feature of more than one in so many examples is a row of the matrix and has no postings.
HOT = 16
CACHE_WORDS = 400_000
_signs = ".,!?;:|*%&$#\"'()[]<>"


def features(word: str) -> list[str]:
    """Features of one lower-cased raw word."""
    w = word.strip(_signs)
    if not w:
        return []
    return [w] + [f"{w[:k]}\0" for k in (5, 6) if len(w) > k]


class Rows:
    """Sparse rows: row ``i`` has the columns ``at[cut[i]:cut[i + 1]]``, ascending, with ``values``."""

    def __init__(self, cut: np.ndarray, at: np.ndarray, values: np.ndarray):
        self.cut, self.at, self.values = cut, at, values
        self.n = len(cut) - 1
        self.row = np.repeat(np.arange(self.n), np.diff(cut))

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        cut = np.append(0, np.cumsum([len(at) for at, _ in rows])).astype(np.int64)
        return cls(cut, np.concatenate([np.zeros(0, np.int64), *(at for at, _ in rows)]), np.concatenate([np.zeros(0), *(v for _, v in rows)]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=values, minlength=self.n)


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + n[i] - 1`` for all i in one array."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class Vectors:
    """Counts of the chosen features in texts; the raw words seen are kept in a bounded table."""

    def __init__(self, vocabulary: list[str]):
        self.at = {w: i for i, w in enumerate(vocabulary)}
        self.width = max(1, len(vocabulary))
        self.groups: list[tuple[int, ...]] = [()]
        self.codes: dict[tuple[int, ...], int] = {(): 0}
        self.seen: dict[str, int] = {}

    def _code(self, word: str) -> int:
        ids = tuple(self.at[f] for f in features(word) if f in self.at)
        if ids not in self.codes:
            self.codes[ids] = len(self.groups)
            self.groups.append(ids)
        return self.codes[ids]

    def counts(self, texts: list[str]) -> Rows:
        """Features of each text and how often each occurs."""
        if len(self.seen) > CACHE_WORDS:
            self.seen = {}
        seen, parts = self.seen, []
        for text in texts:
            words = text.lower().split()
            codes = np.fromiter(map(seen.get, words, repeat(-1)), np.int64, len(words))
            for i in np.flatnonzero(codes < 0).tolist():
                codes[i] = seen[words[i]] = self._code(words[i])
            parts.append(codes[codes > 0])
        sizes = np.array([len(groups) for groups in self.groups])
        flat = np.concatenate([np.zeros(0, np.int64), *(x for g in self.groups for x in [np.array(g, np.int64)])])
        first = np.cumsum(sizes) - sizes
        codes = np.concatenate([np.zeros(0, np.int64), *parts])
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
        cells, n = np.unique(np.repeat(owner, sizes[codes]) * self.width + flat[_spread(first[codes], sizes[codes])], return_counts=True)
        return Rows(np.searchsorted(cells, np.arange(len(texts) + 1) * self.width), cells % self.width, n.astype(float))


class Index:
    """Block-max inverted index of unit vectors with labels."""

    def __init__(self, ids: list, labels: np.ndarray, rows: Rows | list[tuple[np.ndarray, np.ndarray]], n_features: int):
        rows = rows if isinstance(rows, Rows) else Rows.of(rows)
        n = rows.n
        self.idf = np.log((n + 1) / (np.bincount(rows.at, minlength=n_features) + 1)) + 0.1
        w, _ = self.weights_of(rows)
        # Examples with the same heaviest feature stand together, which keeps the bounds of blocks tight.
        heavy = [int(rows.at[a:b][np.argmax(w[a:b])]) if b > a else -1 for a, b in zip(rows.cut[:-1], rows.cut[1:], strict=True)]
        order = sorted(range(n), key=lambda i: (labels[i], heavy[i], i))
        self.ids, self.labels = [ids[i] for i in order], np.array([labels[i] for i in order], float)
        self.blocks = max(1, -(-n // BLOCK))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by_list = np.lexsort((place[rows.row], rows.at))
        self.places, self.values = place[rows.row][by_list], w[by_list]
        cell = rows.at[by_list] * self.blocks + self.places // BLOCK
        self.most = np.zeros(n_features * self.blocks)
        np.maximum.at(self.most, cell, self.values)
        self.most = self.most.reshape(n_features, self.blocks)
        # Features of many examples are rows of a small matrix, whose products are exact for all examples at once.
        df = np.bincount(rows.at, minlength=n_features)
        self.hot = np.full(n_features, -1)
        self.hot[df > n / HOT] = np.arange((df > n / HOT).sum())
        rest = self.hot[rows.at[by_list]] < 0
        self.dense = np.zeros((self.hot.max() + 1, self.blocks * BLOCK))
        self.dense[self.hot[rows.at[by_list]][~rest], self.places[~rest]] = self.values[~rest]
        self.most[self.hot >= 0] = 0
        self.places, self.values, cell = self.places[rest], self.values[rest], cell[rest]
        #: starts[f, b] .. starts[f, b + 1]: postings of feature f in block b.
        self.starts = np.searchsorted(cell, np.arange(n_features * self.blocks + 1))

    def weights(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """``weights_of`` one row."""
        w, length = self.weights_of(Rows.of([(at, counts)]))
        return w, float(length[0])

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_of`` one row."""
        near = self.nearest_of(Rows.of([(at, w)]), w, k)
        return near.at, near.values

    def weights_of(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF weights, and the length of each row before."""
        w = (1 + np.log(rows.values)) * self.idf[rows.at]
        length = np.sqrt(rows.sums(w * w))
        return w / length[rows.row], length

    def nearest_of(self, rows: Rows, w: np.ndarray, k: int = NEIGHBOURS, without: np.ndarray | None = None) -> Rows:
        """Per row the places and cosines of the k nearest examples with a positive cosine; ties by place.

        All rows go through their blocks together: in every round the rows that are still open, those whose next
        bound reaches their k-th best cosine, read as many blocks as in all rounds before.
        """
        weights = np.zeros((rows.n, len(self.dense)))
        often = self.hot[rows.at] >= 0
        weights[rows.row[often], self.hot[rows.at[often]]] = w[often]
        base = (weights @ self.dense).reshape(rows.n, self.blocks, BLOCK)
        bound = base.max(2)
        full = np.flatnonzero(np.diff(rows.cut))
        if len(full):
            bound[full] += np.add.reduceat(w[:, None] * self.most[rows.at], rows.cut[full])
        order = np.argsort(-bound, axis=1, kind="stable")
        sorted_bound = np.take_along_axis(bound, order, 1)
        owner, place, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        done, step, floor = 0, 4, np.zeros(rows.n)
        seldom = Rows(np.append(0, np.cumsum(rows.sums((~often).astype(float)))).astype(np.int64), rows.at[~often], w[~often])
        while done < self.blocks:
            open_rows = np.flatnonzero((sorted_bound[:, done] > 0) & (sorted_bound[:, done] >= floor - 1e-9))
            if not len(open_rows):
                break
            last = min(self.blocks, done + step)
            here = order[open_rows, done:last]
            sums = base[open_rows[:, None], here].ravel()
            sizes = np.diff(seldom.cut)[open_rows]
            at = _spread(seldom.cut[open_rows], sizes)
            turn = np.repeat(np.arange(len(open_rows)), sizes)
            # Bounded parts: a cell is a feature of a row and one of its next blocks.
            for a in range(0, len(at), 20_000):
                own, some = turn[a : a + 20_000], at[a : a + 20_000]
                cells = seldom.at[some][:, None] * self.blocks + here[own]
                begin, size = self.starts[cells].ravel(), (self.starts[cells + 1] - self.starts[cells]).ravel()
                flat, many = _spread(begin, size), size.reshape(cells.shape).sum(1)
                into = np.repeat((own[:, None] * here.shape[1] + np.arange(here.shape[1])).ravel() * BLOCK, size) + self.places[flat] % BLOCK
                sums += np.bincount(into, weights=self.values[flat] * np.repeat(seldom.values[some], many), minlength=len(sums))
            # What stays below the k-th best so far can't be among the k best.  Equal examples keep equal cosines.
            sums = np.round(sums, 12)
            new = np.flatnonzero(sums >= np.maximum(np.repeat(floor[open_rows], here.shape[1] * BLOCK), 1e-12))
            new_owner, new_place, sums = open_rows[new // (here.shape[1] * BLOCK)], here.ravel()[new // BLOCK] * BLOCK + new % BLOCK, sums[new]
            if without is not None:
                other = new_place != without[new_owner]
                new_owner, new_place, sums = new_owner[other], new_place[other], sums[other]
            owner, place, cosine = np.concatenate([owner, new_owner]), np.concatenate([place, new_place]), np.concatenate([cosine, sums])
            by = np.lexsort((place, -cosine, owner))
            owner, place, cosine = owner[by], place[by], cosine[by]
            first = np.searchsorted(owner, np.arange(rows.n + 1))
            best = np.arange(len(owner)) - first[owner] < k
            owner, place, cosine = owner[best], place[best], cosine[best]
            first = np.searchsorted(owner, np.arange(rows.n + 1))
            have = np.flatnonzero(np.diff(first) == k)
            floor[have] = cosine[first[have] + k - 1]
            done, step = last, step * 2
        return Rows(np.searchsorted(owner, np.arange(rows.n + 1)), place, cosine)

    def evidence(self, rows: Rows, without: np.ndarray | None = None) -> tuple[Rows, np.ndarray]:
        """Neighbours, and per row the inputs of the calibration: weighted vote, nearest cosine, length, and a product.

        ``TOGETHER`` rows go through the index at once, which bounds the memory.
        """
        w, length = self.weights_of(rows)
        found = []
        for a in range(0, rows.n, TOGETHER):
            b = min(rows.n, a + TOGETHER)
            part = Rows(rows.cut[a : b + 1] - rows.cut[a], rows.at[rows.cut[a] : rows.cut[b]], rows.values[rows.cut[a] : rows.cut[b]])
            found.append(self.nearest_of(part, w[rows.cut[a] : rows.cut[b]], without=None if without is None else without[a:b]))
        cut = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(x.cut) for x in found)])))
        near = Rows(cut, np.concatenate([np.zeros(0, np.int64), *(x.at for x in found)]), np.concatenate([np.zeros(0), *(x.values for x in found)]))
        votes = 1 / (0.2 + np.sqrt(np.maximum(0, 2 - 2 * near.values))) ** 2
        toxic = self.labels[near.at]
        share = near.sums(votes * toxic) / (near.sums(votes) + 0.5)
        closest = np.zeros(rows.n)
        np.maximum.at(closest, near.row, near.values * toxic)
        return near, np.stack([share, closest, np.log1p(length), share * np.log1p(length)], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias of a ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(h, a.T @ (weight * (p - y)) + ridge * b)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    """Index, vocabulary and calibration; about as large as the sample allows, so it may be broadcast."""

    def __init__(self, vocabulary: list[str], ids: list, labels: np.ndarray, rows: Rows, share: float):
        self.vocabulary, self.share = vocabulary, share
        self.index = Index(ids, labels, rows, max(1, len(vocabulary)))
        self.beta = None
        if len(labels) and 0 < labels.mean() < 1:
            place = {i: p for p, i in enumerate(self.index.ids)}
            _, x = self.index.evidence(rows, np.array([place[i] for i in ids]))
            # The sample holds the labels in other shares than the corpus.
            weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
            self.beta = logistic(x, labels, weight)

    def score(self, inputs: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(inputs), self.share)
        return 1 / (1 + np.exp(-np.clip(inputs @ self.beta[:-1] + self.beta[-1], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[DataFrame, float]:
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out("doc_id", FOLDS)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = usable.agg(F.avg("y")).first()[0]
    part = lambda y: usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(part(0).unionByName(part(1))), "doc_id")
    return common.stored(rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "toxicity-sample"), 0.5 if share is None else share


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """Choose features and build the index; the driver gets ``n_features`` words and the sample's vectors."""
    sample, share = _sample(docs, labels, label, limit)

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[str, list[int]] = {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            for f in {f for w in set((text or "").lower().split()) for f in features(w)}:
                n.setdefault(f, [0, 0])[y] += 1
        return pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], ["f", "n0", "n1"])

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    m0, m1 = float(totals.get(0, 0)), float(totals.get(1, 0))
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    c, d = m1 - a, m0 - b
    chi = (m0 + m1) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * m1 * m0)
    counted = common.arrow_map(sample, held, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    words = [] if not m0 * m1 else [r["f"] for r in counted.where((a >= 3) & (c + d > 0) & (a * m0 > b * m1)).orderBy(chi.desc(), "f").limit(n_features).select("f").collect()]

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = Vectors(words).counts([x or "" for x in batch.column("text").to_pylist()])
        lists = [pa.ListArray.from_arrays(pa.array(got.cut, pa.int32()), pa.array(x)) for x in (got.at, got.values)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists], ["doc_id", "y", "at", "n"])

    rows = common.arrow_map(sample, vectors, f"doc_id {dict(sample.dtypes)['doc_id']}, y int, at array<bigint>, n array<double>").orderBy("doc_id").collect()
    pairs = Rows.of([(np.array(r["at"], np.int64), np.array(r["n"], float)) for r in rows])
    return Model(words, [r["doc_id"] for r in rows], np.array([r["y"] for r in rows], float), pairs, share)


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``score``, ``predicted`` and the nearest examples (``evidence``)."""
    keep = [k for k in keep if k not in ("score", "predicted", "evidence")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        _, v = common.kept("toxicity", id(m), lambda: (m, Vectors(m.vocabulary)))
        kind = pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])
        for start, end in common.pieces(batch, most=1 << 20):
            near, inputs = m.index.evidence(v.counts([x or "" for x in batch.column("text")[start:end].to_pylist()]))
            scores = m.score(inputs)
            rank = np.arange(len(near.at)) - near.cut[near.row]
            top = np.flatnonzero(rank < EVIDENCE)
            found = pa.StructArray.from_arrays([pa.array([m.index.ids[i] for i in near.at[top].tolist()], pa.int64()), pa.array(near.values[top]), pa.array(m.index.labels[near.at[top]].astype(np.int32))], fields=list(kind))
            cut = np.append(0, np.cumsum(np.minimum(np.diff(near.cut), EVIDENCE)))
            made = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), found)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k)[start:end] for k in keep], *made], [*keep, "score", "predicted", "evidence"])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for k in keep for f in docs.schema if f.name == k)
    return common.arrow_map(docs.select(*keep, "text"), run, head + "score double, predicted int, evidence array<struct<doc_id:bigint,similarity:double,label:int>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over all documents, with the nearest examples as evidence."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", common.held_out("doc_id", FOLDS).alias("held_out"))
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")), ["doc_id", "held_out"])


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}

"""Toxicity by a chain of linear models.

Categories are predicted one after the other; each model reads hashed words and the earlier
categories' probabilities, which in training are out of fold.  The last link is toxicity itself.
The tables label toxicity only, so the earlier categories are learned from the labelled rows, in
whatever language they are: each is the set of toxic documents that hold its cue, a feature that is
far more frequent in toxic documents than in others, and each cue is the one that covers most of
the toxic documents that the cues before it leave.  Features are the hashed
words and word beginnings of a text, and once more those that come twice or often.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import columns, ship, slices
from plumbline.llm.shingles import blocks, word_hashes

#: Hashed word features; labelled rows that are learned from at most; folds; training steps; penalty.
FEATURE_BITS, TRAIN_ROWS, FOLDS, STEPS, PENALTY = 20, 8_000, 3, 120, 0.001
#: Features that are added to a model at once, and how often.
ACTIVE, ROUNDS = 400, 4
#: Documents that a feature must occur in to be learned.
LEAST_USES = 3
#: Probability from which a document is called toxic.
THRESHOLD = 0.5
#: Bytes of word beginnings that are features beside whole words: stems that inflected forms share.
BEGINNINGS = (5, 6, 7, 8, 9, 10)
#: Categories that are learned; how many times more frequent in toxic documents a cue must be.
CATEGORIES, ODDS = 4, 5.0
NAMES = [*(f"p_category_{k + 1}" for k in range(CATEGORIES)), "p_toxic"]
_NOT_WORD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct hashed words and word beginnings of each text, and those that come again."""
    out = [np.empty(0, np.int64)] * len(texts)
    for own, data, begins in blocks([t.lower() if t else t for t in texts]):
        whole, starts, *cut = word_hashes(data.translate(_NOT_WORD), BEGINNINGS)
        all_ = np.stack([whole, *cut]) >> np.uint64(64 - FEATURE_BITS)
        first = np.append(np.searchsorted(starts, begins), whole.size).tolist()
        for k, a, b in zip(own, first, first[1:]):
            once, n = np.unique(all_[:, a:b].astype(np.int64), return_counts=True)
            often = (once[n > len(all_)] * 0x9E3779B1 + 1) & ((1 << FEATURE_BITS) - 1)
            twice = (once[n > 1] * 0x85EBCA6B + 1) & ((1 << FEATURE_BITS) - 1)
            out[k] = np.unique(np.concatenate([once, twice, often]))
    return out


@dataclass
class Sparse:
    """Rows of presence features, one after the other."""

    index: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: Sequence[np.ndarray]) -> Sparse:
        return cls.packed(np.concatenate([np.empty(0, np.int32), *rows]), np.array([r.size for r in rows], np.int64))

    @classmethod
    def packed(cls, index: np.ndarray, sizes: np.ndarray) -> Sparse:
        return cls(index.astype(np.int32, copy=False), np.repeat(np.arange(sizes.size, dtype=np.int32), sizes), sizes.size)

    def frequent(self, least: int) -> Sparse:
        own = np.bincount(self.index, minlength=1 << FEATURE_BITS)[self.index] >= least
        return Sparse(self.index[own], self.row[own], self.n)

    def take(self, keep: np.ndarray) -> Sparse:
        number = np.full(self.n, -1, np.int32)
        number[keep] = np.arange(keep.size)
        own = number[self.row] >= 0
        return Sparse(self.index[own], number[self.row[own]], keep.size)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index], self.n)


@dataclass
class Link:
    """A logistic model over words and the earlier links' probabilities."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def scores(self, x: Sparse, earlier: np.ndarray) -> np.ndarray:
        z = x.dot(self.weights) + earlier @ self.chain + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Merged:
    """Rows with one feature for all that occur in the same rows: these have the same weight."""

    x: Sparse
    many: np.ndarray  # features that each stands for
    used: np.ndarray  # the features
    same: np.ndarray  # what each of these became

    @classmethod
    def of(cls, x: Sparse) -> Merged:
        held = np.bincount(x.index, minlength=1 << FEATURE_BITS) > 0
        used = np.flatnonzero(held)
        place = (np.cumsum(held) - 1)[x.index]
        mark = np.bincount(place, np.random.Generator(np.random.PCG64(5)).random(x.n)[x.row], used.size)
        _, first, same, many = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
        number = np.full(used.size, -1, np.int32)
        number[first] = np.arange(first.size)
        number = number[place]
        own = number >= 0
        return cls(Sparse(number[own], x.row[own], x.n), many, used, same.reshape(-1))

    def take(self, keep: np.ndarray) -> Merged:
        return Merged(self.x.take(keep), self.many, self.used, self.same)

    def spread(self, link: Link) -> Link:
        """A model of merged features as one of all."""
        return Link(np.bincount(self.used, (link.weights / self.many)[self.same], 1 << FEATURE_BITS), link.chain, link.bias)


def _part(x: Sparse, chosen: np.ndarray, size: int) -> Sparse:
    """The rows with the chosen features only, numbered anew."""
    number = np.full(size, -1, np.int32)
    number[chosen] = np.arange(chosen.size)
    own = number[x.index]
    held = own >= 0
    return Sparse(own[held], x.row[held], x.n)


def _fitted(data: Merged, earlier: np.ndarray, y: np.ndarray, steps: int, penalty: float) -> Link:
    """Full-batch logistic regression with per-weight steps; both classes weigh the same.

    The sum of the weights' sizes is penalised, so words that tell little have no weight.  Only
    features that pull by more than the penalty can get a weight: ACTIVE of the strongest are fitted,
    then those of the others that pull by more are added, until there are none.
    """
    x, many = data.x, data.many
    n, width = max(1, x.n), earlier.shape[1]
    w, c, b = np.zeros(many.size), np.zeros(width), 0.0
    positive = y.sum()
    if positive in (0, x.n):
        return Link(w, c, 30.0 if positive else -30.0)
    share = np.where(y > 0, n / (2 * positive), n / (2 * (n - positive)))
    chosen = np.empty(0, np.int64)
    for k in range(ROUNDS):
        error = share * (Link(w * many, c, b).scores(x, earlier) - y) / n
        pull = np.abs(np.bincount(x.index, error[x.row], many.size))
        pull[chosen] = 0.0
        more = np.argsort(-pull, kind="stable")[:ACTIVE]
        more = more[pull[more] > penalty]
        if not more.size:
            break
        chosen = np.sort(np.append(chosen, more))
        own, u, times = _part(x, chosen, many.size), w[chosen], many[chosen]
        seen, seen_c, seen_b = np.full(u.size, 1e-8), np.full(width, 1e-8), 1e-8
        for _ in range(steps if k == 0 else steps // 2):
            error = share * (Link(u * times, c, b).scores(own, earlier) - y) / n
            g = np.bincount(own.index, error[own.row], u.size)
            seen += g * g
            rate = 0.5 / np.sqrt(seen)
            moved = u - rate * g
            u = np.sign(moved) * np.maximum(0.0, np.abs(moved) - rate * penalty)
            g = earlier.T @ error
            seen_c += g * g
            c = c - 0.3 * g / np.sqrt(seen_c)
            g = error.sum()
            seen_b += g * g
            b -= 0.3 * g / np.sqrt(seen_b)
        w[chosen] = u
    return Link(w * many, c, b)


def fit(x: Sparse, earlier: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Link:
    """A logistic model of the rows' features and ``earlier`` columns."""
    data = Merged.of(x)
    return data.spread(_fitted(data, earlier, y, steps, penalty))


def fit_chain(x: Sparse, targets: np.ndarray, fold: np.ndarray) -> list[Link]:
    """One link for each column of ``targets``; later links see out-of-fold probabilities of earlier ones."""
    earlier, chain, data = np.zeros((x.n, 0)), [], Merged.of(x)
    for k in range(targets.shape[1]):
        chain.append(data.spread(_fitted(data, earlier, targets[:, k], STEPS, PENALTY)))
        if k + 1 < targets.shape[1]:
            out = np.zeros(x.n)
            for f in range(FOLDS):  # one fold's rows at a time are copied
                rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                link = _fitted(data.take(rest), earlier[rest], targets[rest, k], STEPS, PENALTY)
                out[own] = link.scores(data.take(own).x, earlier[own])
            earlier = np.column_stack([earlier, out])
    return chain


def categories(x: Sparse, toxic: np.ndarray, n: int = CATEGORIES) -> np.ndarray:
    """A column for each category: 1 for the toxic rows that hold its cue; all 0 where no cue is left."""
    own, out = toxic > 0, np.zeros((x.n, n))
    held = np.bincount(x.index[own[x.row]], minlength=1 << FEATURE_BITS)
    clean = np.bincount(x.index[~own[x.row]], minlength=1 << FEATURE_BITS)
    cue = held * max(1, (~own).sum()) > ODDS * (clean + 1) * max(1, own.sum())
    left = own.copy()
    for k in range(n):
        covered = np.bincount(x.index[left[x.row]], minlength=1 << FEATURE_BITS) * cue
        best = int(np.argmax(covered))
        if covered[best] < LEAST_USES:
            break
        rows = x.row[x.index == best]
        out[rows[own[rows]], k] = 1.0
        left[rows] = False
    return out


def chained(chain: list[Link], x: Sparse) -> np.ndarray:
    """The probabilities of all links, in order."""
    told = np.zeros((x.n, 0))
    for link in chain:
        told = np.column_stack([told, link.scores(x, told)])
    return told


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[Link]:
    """Learns the chain from TRAIN_ROWS labelled documents at most, those of least hashed id.

    Null ids, labels and texts are left out; a document labelled toxic anywhere counts as toxic; of
    several texts with one id the least is read.  The rows are in the order of their ids, so that the
    same tables give the same chain.
    """
    ship(docs.sparkSession)
    rows = columns(docs, id_col, text_col)
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_toxic")).where("_id is not null and _toxic is not null")
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([w.astype(np.int32) for w in features(batch.column(0).to_pylist())], pa.list_(pa.int32()))], names=["toxic", "fold", "words"])

    taken = rows.where("_text is not null").join(F.broadcast(known), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).orderBy("_id")
    taken = taken.select("_text", "_toxic", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("_fold"))
    got = taken.mapInArrow(read, "toxic int, fold int, words array<int>").toArrow()  # TRAIN_ROWS at most
    toxic = np.array(got.column("toxic").to_pylist(), float).reshape(-1)
    words = got.column("words").combine_chunks()
    x = Sparse.packed(words.flatten().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)).frequent(LEAST_USES)
    return fit_chain(x, np.column_stack([categories(x, toxic), toxic]), np.array(got.column("fold").to_pylist(), int).reshape(-1))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = [Link(np.bincount(at, w, 1 << FEATURE_BITS), c, b) for at, w, c, b in model.value]
        for own in slices(batches, 500):
            words = features(own.column(1).to_pylist())
            told = chained(chain, Sparse.of(words)) * np.array([w.size > 0 for w in words])[:, None]
            yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(told[:, j]) for j in range(told.shape[1]))], names=["_id", *NAMES])

    return run


def score(docs: DataFrame, chain: list[Link], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, the probability of each category, ``p_toxic`` and ``toxic``.

    Null and empty texts, and texts without words, have probability 0.
    Repeated rows are scored each; null ids are kept; further columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = columns(docs, id_col, text_col)
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), *(T.StructField(x, T.DoubleType()) for x in NAMES)])
    light = [(at := np.flatnonzero(k.weights), k.weights[at], k.chain, k.bias) for k in chain]
    told = rows.mapInArrow(_scored(spark.sparkContext.broadcast(light)), schema)
    return told.select(F.col("_id").alias(id_col), *NAMES, (F.col("p_toxic") >= threshold).alias("toxic"))

"""Toxicity by a chain of linear models.

The categories are predicted one after another; each later model also reads the earlier
categories' probabilities, which at training time are out-of-fold predictions, so that
a model never learns from probabilities fitted on its own rows.  The models are
L1-penalised logistic regressions over the presence of words plus four shares of the
text, fitted on the driver on a bounded sample of labelled rows (``MAX_ROWS``, half for
each value of the last category where there are enough).  Scoring is one narrow pass
with the models broadcast (``MAX_WORDS`` weights a category at most).

Defined results: a null or empty text has no words and gets the models' base
probabilities; without labelled rows of both values a category's probability is its
share (0 without labels); repeated rows are scored alike; labels that are null are not
read, and a doc_id's repeated labels count once each for the sample; other columns are
carried or not read; an empty table gives an empty one; a very long text is scored alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import doc_texts
from quarry.llm.kernels import Words, chunks, lookup, utf8

#: Labelled rows that a model is fitted on, at most.
MAX_ROWS = 6000
#: Bytes of their texts, at most: in the sample's order, rows beyond it are left out.
MAX_BYTES = 64_000_000
#: Words with a weight, at most: those in the most sampled documents.
MAX_WORDS = 20000
MIN_DOCS = 3
FOLDS = 4
PENALTY = 1e-3
STEPS = 120
#: (name, label column, value that means yes), in the chain's order.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
SHARES = 4

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


@dataclass
class Sparse:
    """Rows of word places, and the dense columns beside them."""

    row: np.ndarray
    word: np.ndarray
    dense: np.ndarray

    def times(self, w: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.word], minlength=len(self.dense)) + self.dense @ d

    def back(self, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.word, weights=r[self.row], minlength=n), self.dense.T @ r

    def some(self, rows: np.ndarray) -> Sparse:
        place = np.full(len(self.dense), -1, np.int64)
        place[rows] = np.arange(len(rows))
        keep = place[self.row] >= 0
        return Sparse(place[self.row[keep]], self.word[keep], self.dense[rows])


@dataclass
class Model:
    words: np.ndarray
    dense: np.ndarray
    base: float

    def probability(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.times(self.words, self.dense) + self.base, -40, 40)))


def fit(x: Sparse, y: np.ndarray, n_words: int, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Accelerated proximal gradient; words are penalised, shares and base are not."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(n_words), np.zeros(x.dense.shape[1]), float(np.log(share / (1 - share))))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    dense = np.hstack([x.dense, np.ones((len(y), 1))])
    x = Sparse(x.row, x.word, dense)
    # a bound of the curvature by power iteration
    v, d = np.ones(n_words), np.ones(dense.shape[1])
    size = 1.0
    for _ in range(12):
        v, d = x.back(weight * x.times(v, d), n_words)
        size = float(np.sqrt((v * v).sum() + (d * d).sum())) or 1.0
        v, d = v / size, d / size
    rate = 1 / (0.26 * size)
    w, b, u, c, t = np.zeros(n_words), np.zeros(dense.shape[1]), np.zeros(n_words), np.zeros(dense.shape[1]), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(u, c), -40, 40)))
        g, h = x.back(weight * (p - y), n_words)
        new = u - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        low = c - rate * h
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / s * (new - w), low + (t - 1) / s * (low - b)
        w, b, t = new, low, s
    return Model(w, b[:-1], float(b[-1]))


@dataclass
class Chain:
    """Sorted word hashes, how to scale the shares, a model per category, the threshold."""

    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(SHARES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(SHARES))
    models: list[Model] = field(default_factory=list)
    threshold: float = 0.5

    def features(self, column: pa.Array) -> Sparse:
        rows, words, dense, done = [], [], [], 0
        for a, b in chunks(column):
            part = Words(column.slice(a, b - a))
            place = lookup(self.hashes, part.hash)
            doc = part.doc_of_word()
            hit = place >= 0
            pair = np.unique(doc[hit] * max(1, len(self.hashes)) + place[hit])
            rows.append(pair // max(1, len(self.hashes)) + done)
            words.append(pair % max(1, len(self.hashes)))
            dense.append((shares(column.slice(a, b - a), part) - self.mean) / self.scale)
            done += b - a
        if not rows:
            return Sparse(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SHARES)))
        return Sparse(np.concatenate(rows), np.concatenate(words), np.concatenate(dense))

    def score(self, column: pa.Array) -> np.ndarray:
        """A column of probabilities for each category."""
        x, out = self.features(column), []
        for m in self.models:
            out.append(m.probability(x))
            x = Sparse(x.row, x.word, np.column_stack([x.dense, out[-1] - 0.5]))
        return np.column_stack(out)


def shares(column: pa.Array, part: Words) -> np.ndarray:
    """Upper-case letters, marks and digits among bytes; repeated words among words."""
    raw, at = utf8(column)
    out = np.zeros((len(at) - 1, SHARES))
    size = np.maximum(np.diff(at), 1)
    for k, table in enumerate((_UPPER, _MARK, _DIGIT)):
        total = np.concatenate([[0], np.cumsum(table[raw])])
        out[:, k] = (total[at[1:]] - total[at[:-1]]) / size
    order = np.lexsort((part.hash, doc := part.doc_of_word()))
    again = (part.hash[order][1:] == part.hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out[:, 3] = np.bincount(doc[order][1:][again], minlength=len(out)) / np.maximum(np.diff(part.first), 1)
    return out


def sample(docs: DataFrame, labels: DataFrame, chain=CHAIN, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list:
    """At most ``max_rows`` labelled (text, label, ...) rows, half for each value of the last."""
    names = [c for _, c, _ in chain]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in names)).dropna().distinct()
    picked = []
    for value in (0, 1):
        some = known.filter(F.col(names[-1]) == value).orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(max_rows // 2)
        picked += some.collect()
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, known.schema)
    # bounded by max_rows ids, and cut to as many rows where doc_ids repeat
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text"), *(F.col(c) for c in names)]
    found = doc_texts(docs).join(F.broadcast(ids), "doc_id").orderBy(*order).limit(max_rows)
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes).collect()
    return [(r["text"] or "", *(r[c] for c in names)) for r in found]


def train(rows: list, chain=CHAIN) -> Chain:
    out = Chain()
    if not rows:
        out.models = [fit(Sparse(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SHARES + k))), np.empty(0), 0) for k in range(len(chain))]
        return out
    texts = pa.array([r[0] for r in rows], pa.string())
    seen = []
    for a, b in chunks(texts):
        part = Words(texts.slice(a, b - a))
        pair = np.unique(np.stack([part.doc_of_word().astype(np.uint64), part.hash]), axis=1)
        seen.append(pair[1])
    hashes, docs = np.unique(np.concatenate(seen), return_counts=True)
    often = np.argsort(-docs, kind="stable")[: MAX_WORDS]
    often = often[docs[often] >= min(MIN_DOCS, len(rows))]
    out.hashes = np.sort(hashes[often])
    x = out.features(texts)
    out.mean, out.scale = x.dense.mean(axis=0), np.maximum(x.dense.std(axis=0), 1e-6)
    x.dense = (x.dense - out.mean) / out.scale
    fold = np.array([zlib.crc32(r[0].encode()) % FOLDS for r in rows])  # copies share a fold
    n = len(out.hashes)
    for k, (_, _, yes) in enumerate(chain):
        y = np.array([float(r[k + 1] == yes) for r in rows])
        held = np.zeros(len(rows))
        for f in range(FOLDS):
            inner, outer = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(outer):
                held[outer] = fit(x.some(inner), y[inner], n).probability(x.some(outer))
        out.models.append(fit(x, y, n))
        x = Sparse(x.row, x.word, np.column_stack([x.dense, held - 0.5]))
    out.threshold = best_threshold(held, y)
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap that gives the best F1 of the out-of-fold predictions."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    true = np.cumsum(y)
    f1 = 2 * true / (np.arange(1, len(y) + 1) + y.sum()) if y.sum() else np.zeros(len(y))
    f1[:-1][p[:-1] == p[1:]] = 0
    if not len(f1) or not f1.max():
        return 1.0
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def _scored(docs: DataFrame, labels: DataFrame, chain, max_rows: int):
    return docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, chain, max_rows), chain))


def toxicity(docs: DataFrame, labels: DataFrame, chain=CHAIN, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, p_<category> for each category of the chain, and toxic (the last one's verdict)."""
    sent = _scored(docs, labels, chain, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            p = model.score(b["text"]) if b.num_rows else np.empty((0, len(chain)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(p[:, k]) for k in range(len(chain))), pa.array(p[:, -1] >= model.threshold)], names=["doc_id", *(f"p_{n}" for n, _, _ in chain), "toxic"])

    kind = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"p_{n}", T.DoubleType()) for n, _, _ in chain), T.StructField("toxic", T.BooleanType())])
    return doc_texts(docs).mapInArrow(run, kind)


def drop_toxic(docs: DataFrame, labels: DataFrame, chain=CHAIN, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents, all columns, without those judged toxic."""
    sent = _scored(docs, labels, chain, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            yield b.filter(pa.array(model.score(b["text"])[:, -1] < model.threshold)) if b.num_rows else b

    return docs.mapInArrow(run, docs.schema)

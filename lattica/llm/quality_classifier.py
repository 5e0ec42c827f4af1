"""Quality classifier by supervised subword embeddings.

A document is the bag of its hashed words, word pairs and character n-grams.
Each has a learned vector; the vectors are averaged and a softmax layer turns
the average into class probabilities. Vectors and layer are trained together
by numpy stochastic gradient descent.

The layer is linear in the average, so for scoring each hash bucket's vector is
folded with it into one number, and a document's logit is the mean of its
buckets' numbers: one table look-up per feature over the raw bytes.

Defined cases: a null or empty text has no features and gets the bias alone;
without labels of both classes the model is untrained and scores the share of
label 1 (0.5 without labels); rows are scored one by one, so repeated rows,
ties and extra columns change nothing; texts are never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.tables import labelled_sample


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 17
    dim: int = 8
    ngrams: tuple[int, ...] = (3, 4)
    epochs: int = 6
    rate: float = 0.5
    #: Most labelled documents that training reads, and the bytes of text it learns from at most.
    max_training_docs: int = 3000
    max_training_bytes: int = 48 << 20
    #: Characters that training holds of a text at most; of longer ones, stretches from all over it.
    training_chars: int = 64 << 10
    threshold: float = 0.3
    seed: int = 7


@dataclass
class QualityModel:
    params: QualityParams
    #: Logit of label 1 against 0 that each bucket adds to the mean.
    table: np.ndarray
    bias: float


def features(chunk: A.Chunk, p: QualityParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, boundaries) for each kind of feature: those of document i are
    ``buckets[boundaries[i]:boundaries[i+1]]``."""
    mask = np.uint64(p.buckets - 1)
    w = A.words(chunk)
    h = A.word_hashes(chunk.buf, w)
    yield (h & mask).astype(np.int32), w.first
    at, doc = A.windows_inside(w.first, 2)
    left, right = h[at], h[at + 1] if len(at) else np.empty(0, np.uint64)
    pairs = np.where(left == right, np.uint64(1), A.mix(left * np.uint64(3) + right))  # a repeat is one pair whatever the word
    yield (pairs & mask).astype(np.int32), np.searchsorted(doc, np.arange(chunk.n + 1))
    b = chunk.buf.astype(np.uint32)
    for n in p.ngrams:
        if len(b) < n:
            yield np.empty(0, np.int32), np.zeros(chunk.n + 1, np.int64)
            continue
        g = np.full(len(b) - n + 1, n, np.uint32)
        for k in range(n):
            g *= np.uint32(0x9E3779B1)
            g ^= b[k : len(b) - n + 1 + k]
        g *= np.uint32(0x85EBCA6B)
        g >>= np.uint32(32 - (p.buckets - 1).bit_length())
        # the grams that start in the last n-1 bytes of a document belong to two; they are left out
        bounds = np.minimum(chunk.offsets, len(g))
        keep = np.ones(len(g), bool)
        for k in range(1, n):
            cut = chunk.offsets[1:] - k
            cut = cut[(cut >= 0) & (cut < len(g))]
            keep[cut] = False
        run = np.concatenate([[0], np.cumsum(keep)])
        yield g[keep].astype(np.int32), run[bounds]


def _bags(texts: list[str], p: QualityParams) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for chunk in A.chunks(pa.array(texts, pa.large_string())):
        parts = list(features(chunk, p))
        for i in range(chunk.n):
            ids, counts = np.unique(np.concatenate([x[f[i] : f[i + 1]] for x, f in parts]), return_counts=True)
            out.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[int], p: QualityParams = QualityParams()) -> QualityModel:
    """Fit vectors and softmax layer to (text, 0 or 1) by stochastic gradient descent."""
    y = np.asarray(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        logit = 0.0 if not len(y) else (4.0 if share else -4.0)
        return QualityModel(p, np.zeros(p.buckets, np.float32), logit)
    sizes = [len(t.encode()) for t in texts]
    # the shortest text of each label stays; of the others, in hashed order, all that fit
    kept = {min((i for i in range(len(y)) if y[i] == label), key=lambda i: (sizes[i], i)) for label in set(y.tolist())}
    total = sum(sizes[i] for i in kept)
    for i in sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode()), i)):
        if i not in kept and total + sizes[i] <= p.max_training_bytes:
            total += sizes[i]
            kept.add(i)
    kept = sorted(kept)
    bags, y = _bags([texts[i] for i in kept], p), y[kept]
    rng = np.random.RandomState(p.seed)
    vectors = (rng.rand(p.buckets, p.dim).astype(np.float32) - 0.5) * (2.0 / p.dim)
    layer, bias = (rng.rand(p.dim, 2).astype(np.float32) - 0.5), np.zeros(2, np.float32)
    steps, done = p.epochs * len(y), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(y)):
            rate = p.rate * (1 - done / steps)
            done += 1
            ids, share_of = bags[i]
            rows = vectors[ids]
            x = share_of @ rows
            z = x @ layer + bias
            e = np.exp(z - z.max())
            grad = e / e.sum()
            grad[y[i]] -= 1
            back = layer @ grad
            layer -= rate * np.outer(x, grad)
            bias -= rate * grad
            if len(ids):
                # counts sum to one, so a rare feature moves as far as it weighs in the mean
                vectors[ids] = rows - (rate * len(ids) / 8) * share_of[:, None] * back
    return QualityModel(p, vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def score_chunk(chunk: A.Chunk, model: QualityModel) -> np.ndarray:
    total, count = np.zeros(chunk.n), np.zeros(chunk.n, np.int64)
    for buckets, first in features(chunk, model.params):
        total += A.sums(model.table[buckets].astype(np.float64), first)
        count += np.diff(first)
    z = total / np.maximum(count, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), learn=None) -> QualityModel:
    """Train on the documents where ``learn`` holds that have a label. At most
    ``max_training_docs`` of these are read: those with the smallest hashed doc_id. Several labels of one document
    count as the smallest."""
    own = docs.where(F.lit(True) if learn is None else learn)
    rows = labelled_sample(own, labels, p.max_training_docs, p.training_chars)
    return train([r[1] for r in rows], [r[2] for r in rows], p)


def classify(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with score and predicted, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as its parameters say
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [score_chunk(c, m) for c in A.chunks(batch.column(batch.num_columns - 1))]
            score = np.concatenate(scores) if scores else np.empty(0)
            predicted = (score >= m.params.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score), pa.array(predicted)],
                names=[*batch.schema.names[:-1], "score", "predicted"],
            )

    return source.mapInArrow(run, f"{schema}, score double, predicted int")

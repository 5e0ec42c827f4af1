"""Quality rules: counts of a text, and a linear-chain conditional random field
that labels its lines.

Each line with a word is described by binary features (binned shares of
symbols, capitals, digits and repeated words, lengths, line ends, repeats of an
earlier line). Labels are known of documents only, so lines are labelled as instances of a
bag: a logistic regression of the document's label on its lines' features gives each line's
evidence, the document's label shifts it as a prior, and each document keeps at least one
line of its own label. A linear-chain CRF over the lines is trained on these labels by exact
gradients (forward-backward); Viterbi decoding then marks each line as content or
boilerplate, and the share of words in content lines decides whether the document is kept.

Defined cases: a null or empty text has no words and fails the base rules;
without labels of both kinds the CRF keeps what the base rules keep; equal
scores count as content; repeated rows and extra columns change nothing; every
line and word of long texts counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.language_model import Lockstep
from lattica.llm.tables import labelled_sample

BOILERPLATE, CONTENT = 0, 1
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _class(b"#*$%&|<>")
UPPER = _class(bytes(range(65, 91)))
LOWER = _class(bytes(range(97, 123)))
DIGIT = _class(b"0123456789")
SHOUT = _class(b"!?")
STOP = _class(b".!?:")
LEAD = ~((np.arange(256) & 0xC0) == 0x80)

#: Bin edges of the numeric line features.
SHARES = (0.02, 0.1, 0.3)
LENGTHS = (2, 5, 10, 20, 50)
N_FEATURES = 1 + 5 * (len(SHARES) + 1) + len(LENGTHS) + 1 + 2


@dataclass(frozen=True)
class RuleParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    content_share: float = 0.5
    #: Log-odds by which a document's label shifts the labels of its lines in training.
    prior: float = 1.0
    #: Labelled documents that training reads at most, and characters that it holds of a text; of longer ones, stretches from all over it.
    max_training_docs: int = 2000
    training_chars: int = 64 << 10
    steps: int = 80
    rate: float = 0.3
    decay: float = 1e-3


@dataclass
class LineModel:
    params: RuleParams
    weights: np.ndarray  # (features, 2)
    start: np.ndarray
    step: np.ndarray
    trained: bool


@dataclass
class Lines:
    """Lines with a word: ``first`` by document, words and features of each."""

    first: np.ndarray
    words: np.ndarray
    features: np.ndarray


def describe(chunk: A.Chunk) -> tuple[dict[str, np.ndarray], Lines]:
    """Base counts of each document, and the features of its lines."""
    buf = chunk.buf
    w = A.words(chunk)
    h = A.word_hashes(buf, w)
    doc = w.doc()
    base = {
        "n_words": np.diff(w.first),
        "word_chars": A.sums(IS_LEAD_WORD[buf], chunk.offsets),
        "n_symbols": A.sums(SYMBOL[buf], chunk.offsets),
    }
    # three-word windows found twice or more in their document
    at, own = A.windows_inside(w.first, 3)
    twice = np.zeros(len(at), bool)
    if len(at):
        triple = A.sequence_hashes(h, 3)[at] ^ A.mix(own.astype(np.uint64) + np.uint64(1))
        order = np.argsort(triple, kind="stable")
        same = triple[order[1:]] == triple[order[:-1]]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 3, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 3, -1)
    base["n_repeat_words"] = A.sums(np.cumsum(cover)[: len(h)] > 0, w.first)
    # lines
    cut = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([chunk.offsets[:-1], cut + 1]))
    start = start[start < len(buf)]
    # a line break that ends a document opens no line in the next one
    end = np.append(start[1:], len(buf))
    end = end - ((end > start) & (buf[np.maximum(end - 1, 0)] == 10))
    bounds = np.searchsorted(w.start, np.append(start, len(buf)))
    filled = np.diff(bounds) > 0
    start, end, lo = start[filled], end[filled], bounds[:-1][filled]
    hi = bounds[1:][filled]
    line_doc = np.searchsorted(chunk.offsets, start, side="right") - 1
    first = np.searchsorted(line_doc, np.arange(chunk.n + 1))
    digest = A.word_hashes(buf, A.Words(start, end, first)) ^ A.mix(line_doc.astype(np.uint64) + np.uint64(1))
    repeat = np.ones(len(start), bool)
    repeat[np.unique(digest, return_index=True)[1]] = False
    base["n_dup_lines"] = A.sums(repeat, first)
    return base, Lines(first, hi - lo, _features(buf, h, start, end, lo, hi, repeat))


def _features(buf, h, start, end, lo, hi, repeat) -> np.ndarray:
    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask[buf])])
        return (run[end] - run[start]) / np.maximum(of, 1)

    size, n = end - start, hi - lo
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same[2:] = np.cumsum(h[1:] == h[:-1])
    repeats = (same[hi] - same[np.minimum(lo + 1, hi)]) / np.maximum(n - 1, 1)
    letters = share(UPPER | LOWER, 1)
    shares = [share(SYMBOL, size), share(SHOUT, size), share(UPPER, letters), share(DIGIT, size), repeats]
    out = np.zeros((len(start), N_FEATURES), np.float32)
    out[:, 0] = 1
    rows, at = np.arange(len(start)), 1
    for x in shares:
        out[rows, at + np.searchsorted(SHARES, x)] = 1
        at += len(SHARES) + 1
    out[rows, at + np.searchsorted(LENGTHS, n)] = 1
    at += len(LENGTHS) + 1
    out[:, at] = repeat
    out[:, at + 1] = STOP[buf[np.maximum(end - 1, 0)]] if len(buf) else 0
    return out


IS_LEAD_WORD = LEAD & A.IS_WORD


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def evidence(lines: Lines, quality: np.ndarray, p: RuleParams) -> np.ndarray:
    """Log-odds that a line is of a document of label 1, by its own features alone; each label weighs the same."""
    x, y = lines.features, np.repeat(quality, np.diff(lines.first))
    cost = (len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1)))[y]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, 2 * p.steps + 1):
        g = x.T @ (cost * (1 / (1 + np.exp(-(x @ w))) - y)) / max(1, len(y)) + p.decay * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x @ w


def line_labels(lines: Lines, quality: np.ndarray, p: RuleParams = RuleParams()) -> np.ndarray:
    """Content or boilerplate for each line of documents with the labels ``quality``."""
    if len(np.unique(quality)) < 2:
        return np.repeat(quality, np.diff(lines.first))
    own = evidence(lines, quality, p) + np.repeat(np.where(quality == 1, p.prior, -p.prior), np.diff(lines.first))
    labels = (own >= 0).astype(np.int64)
    for i in np.flatnonzero(np.diff(lines.first)):
        a, b = lines.first[i], lines.first[i + 1]
        if not (labels[a:b] == quality[i]).any():
            labels[a + (np.argmax(own[a:b]) if quality[i] == 1 else np.argmin(own[a:b]))] = quality[i]
    return labels


def train(lines: Lines, labels: np.ndarray, p: RuleParams = RuleParams()) -> LineModel:
    """Maximum likelihood by Adam on exact gradients; ``labels`` marks each line."""
    m = LineModel(p, np.zeros((N_FEATURES, 2)), np.zeros(2), np.zeros((2, 2)), False)
    if len(np.unique(labels)) < 2:
        return m
    lock = Lockstep(lines.first)
    x, y = np.empty_like(lines.features), np.empty(len(labels), np.int64)
    x[lock.place], y[lock.place] = lines.features, labels
    # each class weighs the same
    cost = (len(y) / (2 * np.bincount(y, minlength=2)))[y]
    params = [m.weights, m.start, m.step]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in params]
    n0 = int(lock.active[0])
    for t in range(1, p.steps + 1):
        e = x @ m.weights
        fw, bw = np.empty_like(e), np.zeros_like(e)
        fw[:n0] = e[:n0] + m.start
        for s in range(1, lock.steps):
            o, n, b = lock.offset[s], lock.active[s], lock.offset[s - 1]
            fw[o : o + n] = e[o : o + n] + _log_sum(fw[b : b + n, :, None] + m.step, 1)
        pair = np.zeros((2, 2))
        for s in range(lock.steps - 1, 0, -1):
            o, n, b = lock.offset[s], lock.active[s], lock.offset[s - 1]
            bw[b : b + n] = _log_sum(m.step + (e[o : o + n] + bw[o : o + n])[:, None, :], 2)
            joint = fw[b : b + n, :, None] + m.step + (e[o : o + n] + bw[o : o + n])[:, None, :]
            joint = np.exp(joint - _log_sum(joint.reshape(n, 4), 1)[:, None, None])
            pair += np.add.reduce(joint, axis=0)
            np.add.at(pair, (y[b : b + n], y[o : o + n]), -1)
        post = np.exp(fw + bw - _log_sum(fw + bw, 1)[:, None])
        post[np.arange(len(y)), y] -= 1
        grads = [
            x.T @ (post * cost[:, None]) / len(y) + p.decay * m.weights,
            post[:n0].sum(axis=0) / len(y),
            pair / len(y) + p.decay * m.step,
        ]
        for v, g, (a, b) in zip(params, grads, moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= p.rate * (1 - (t - 1) / p.steps) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-9)
    m.trained = True
    return m


def decode(lines: Lines, m: LineModel) -> np.ndarray:
    """Viterbi label of each line; ties go to content."""
    if not len(lines.words):
        return np.empty(0, np.int64)
    lock = Lockstep(lines.first)
    e = lock.lay(lines.features @ m.weights)
    n = int(lock.active[0])
    best, back = e[:n] + m.start, np.zeros((len(e), 2), np.int8)
    finals = np.zeros((len(lock.order), 2))
    for s in range(1, lock.steps):
        o, k = lock.offset[s], lock.active[s]
        finals[k : len(best)] = best[k:]
        choice = best[:k, :, None] + m.step
        back[o : o + k] = choice[:, 1, :] >= choice[:, 0, :]
        best = e[o : o + k] + choice.max(axis=1)
    finals[: len(best)] = best
    label = (finals[:, 1] >= finals[:, 0]).astype(np.int64)
    out = np.empty(len(e), np.int64)
    lengths = np.diff(lines.first)[lock.order]
    for s in range(lock.steps - 1, -1, -1):
        o, k = lock.offset[s], lock.active[s]
        if s + 1 < lock.steps:
            going = lock.active[s + 1]
            nxt = lock.offset[s + 1]
            label[:going] = back[np.arange(nxt, nxt + going), label[:going]]
        out[o : o + k] = label[:k]
    assert len(lengths) == len(lock.order)
    return out[lock.place]


def content_share(lines: Lines, m: LineModel) -> np.ndarray:
    """Share of each document's words that are in content lines; 0 without words."""
    content = A.sums(np.where(decode(lines, m) == CONTENT, lines.words, 0), lines.first)
    return content / np.maximum(A.sums(lines.words, lines.first), 1)


def fit(docs: DataFrame, labels: DataFrame, p: RuleParams = RuleParams()) -> LineModel:
    """Train on lines of at most ``max_training_docs`` labelled documents."""
    rows = labelled_sample(docs, labels, p.max_training_docs, p.training_chars)
    chunk = next(A.chunks(pa.array([r[1] for r in rows], pa.large_string()), 1 << 40), None)
    if chunk is None:
        return train(Lines(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty((0, N_FEATURES))), np.empty(0), p)
    lines = describe(chunk)[1]
    return train(lines, line_labels(lines, np.array([r[2] for r in rows]), p), p)


def apply_rules(docs: DataFrame, m: LineModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with the base counts, base_failed, content_share and kept."""
    p = m.params
    shared = docs.sparkSession.sparkContext.broadcast(m)  # a few hundred numbers
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = {k: [np.empty(0, np.int64)] for k in BASE} | {"content_share": [np.empty(0)]}
            for c in A.chunks(batch.column(batch.num_columns - 1)):
                base, lines = describe(c)
                for k in BASE:
                    parts[k].append(base[k])
                parts["content_share"].append(content_share(lines, model))
            x = {k: np.concatenate(v) for k, v in parts.items()}
            failed = (x["n_words"] < p.min_words) | (100 * x["n_repeat_words"] > p.max_repeat_percent * x["n_words"])
            kept = ~failed & ((x["content_share"] >= p.content_share) | (not model.trained))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(x[k]) for k in BASE), pa.array(failed), pa.array(kept), pa.array(x["content_share"])],
                names=[*batch.schema.names[:-1], *BASE, "base_failed", "kept", "content_share"],
            )

    return source.mapInArrow(
        run, f"{schema}, {', '.join(f'{k} long' for k in BASE)}, base_failed boolean, kept boolean, content_share double"
    )

"""Language identification by a byte convolutional network.

A text is cut into windows of ``window`` bytes (the last one is padded). In
each window byte embeddings pass filters of several widths, a rectifier and max
pooling over the window, and a softmax layer gives language probabilities. A
document's log probabilities are the mean over all its windows, weighted by
their bytes. The network is trained in numpy on labelled text.

Defined cases: a null text or one without a letter is ``und`` with score 0;
without any labelled text everything is ``und``, with one labelled language every text with a letter is of it; every byte of long
texts is read; rows are scored one by one, so repeated rows, ties and extra columns
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.tables import bounded_sample

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    dim: int = 6
    #: Labelled documents of each language that training reads at most, and windows of each, evenly over the text.
    max_training_docs: int = 500
    max_training_windows: int = 4
    #: Characters that training holds of a text at most; of longer ones, stretches from all over it.
    training_chars: int = 8192
    epochs: int = 5
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


@dataclass
class LanguageModel:
    params: LanguageParams
    languages: list[str]
    weights: dict[str, np.ndarray]


def _unfold(x: np.ndarray, width: int) -> np.ndarray:
    """(windows, positions, width * dim) view of embedded windows (windows, bytes, dim)."""
    n, length, dim = x.shape
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * dim), (s[0], s[1], s[2]))


def _forward(windows: np.ndarray, w: dict[str, np.ndarray], p: LanguageParams) -> np.ndarray:
    """Pooled features of (windows, bytes); max(relu(x)) = relu(max(x))."""
    x = w["embed"][windows]
    pooled = [(_unfold(x, k) @ w[f"filter{k}"]).max(axis=1) + w[f"bias{k}"] for k in p.widths]
    return np.maximum(np.concatenate(pooled, axis=1), 0)


def cut_windows(chunk: A.Chunk, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all documents (zero padded), their documents and byte counts."""
    lengths = np.diff(chunk.offsets)
    counts = -(-lengths // size)
    doc = np.repeat(np.arange(chunk.n), counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = chunk.offsets[doc] + within * size
    used = np.minimum(size, chunk.offsets[doc + 1] - start)
    at = start[:, None] + np.arange(size)
    padded = np.concatenate([chunk.buf, np.zeros(size, np.uint8)])
    out = padded[at]
    out[np.arange(size) >= used[:, None]] = 0
    return out, doc, used


def train(texts: list[str], langs: list[str], p: LanguageParams = LanguageParams()) -> LanguageModel:
    """Adam on cross entropy over windows of labelled texts."""
    names = sorted(set(langs))
    rng = np.random.RandomState(p.seed)
    w = {"embed": rng.randn(256, p.dim).astype(np.float32) * 0.5}
    for k in p.widths:
        w[f"filter{k}"] = (rng.randn(k * p.dim, p.filters) * (1 / np.sqrt(k * p.dim))).astype(np.float32)
        w[f"bias{k}"] = np.zeros(p.filters, np.float32)
    w["out"] = (rng.randn(len(p.widths) * p.filters, max(1, len(names))) * 0.1).astype(np.float32)
    w["out_bias"] = np.zeros(max(1, len(names)), np.float32)
    xs, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data):
            continue
        own = cut_windows(A.Chunk(slice(0, 1), data, np.array([0, len(data)])), p.window)[0]
        own = own[np.unique(np.linspace(0, len(own) - 1, p.max_training_windows).round().astype(int))]
        xs.append(own)
        # short pieces too, so that short texts are known
        cut = own[:1].copy()
        cut[:, rng.randint(8, p.window) :] = 0
        xs.append(cut)
        ys += [names.index(lang)] * (len(own) + 1)
    if len(names) < 2 or not xs:
        return LanguageModel(p, names, w)
    x, y = np.concatenate(xs), np.array(ys)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    t, steps = 0, p.epochs * -(-len(y) // p.batch)
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), p.batch):
            pick = order[at : at + p.batch]
            t += 1
            grads = _gradients(x[pick], y[pick], w, p)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                rate = p.rate * (1 - (t - 1) / steps)
                w[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
    return LanguageModel(p, names, w)


def _gradients(x: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray], p: LanguageParams) -> dict[str, np.ndarray]:
    n, rows = len(x), np.arange(len(x))
    embedded = w["embed"][x]
    arg, top = [], []
    for k in p.widths:
        z = _unfold(embedded, k) @ w[f"filter{k}"]
        arg.append(z.argmax(axis=1))
        top.append(z.max(axis=1) + w[f"bias{k}"])
    pooled = np.maximum(np.concatenate(top, axis=1), 0)
    z = pooled @ w["out"] + w["out_bias"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    d = e / e.sum(axis=1, keepdims=True)
    d[rows, y] -= 1
    d /= n
    g = {"out": pooled.T @ d, "out_bias": d.sum(axis=0), "embed": np.zeros_like(w["embed"])}
    back = (d @ w["out"].T) * (pooled > 0)
    for i, k in enumerate(p.widths):
        own = back[:, i * p.filters : (i + 1) * p.filters]
        g[f"bias{k}"] = own.sum(axis=0)
        at = arg[i][:, :, None] + np.arange(k)  # bytes under each maximum
        seen = x[rows[:, None, None], at]
        g[f"filter{k}"] = np.einsum("nfkd,nf->kdf", w["embed"][seen], own).reshape(k * p.dim, p.filters)
        taps = w[f"filter{k}"].reshape(k, p.dim, p.filters)
        np.add.at(g["embed"], seen, np.einsum("nf,kdf->nfkd", own, taps))
    return g


def score_chunk(chunk: A.Chunk, m: LanguageModel, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its probability for each document."""
    x, doc, used = cut_windows(chunk, m.params.window)
    out = np.zeros((chunk.n, len(m.languages)))
    weight = np.zeros(chunk.n)
    for at in range(0, len(x), block):
        z = _forward(x[at : at + block], m.weights, m.params) @ m.weights["out"] + m.weights["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        np.add.at(out, doc[at : at + block], z * used[at : at + block, None])
        np.add.at(weight, doc[at : at + block], used[at : at + block])
    out /= np.maximum(weight, 1)[:, None]
    e = np.exp(out - out.max(axis=1, keepdims=True))
    return out.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)


def has_letter(chunk: A.Chunk) -> np.ndarray:
    """Whether each document has a letter of any script."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    found = A.sums(ascii_letter[chunk.buf], chunk.offsets) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in chunk.text(i).decode("utf-8", "replace"))
    return found


def fit(docs: DataFrame, p: LanguageParams = LanguageParams(), learn=None) -> LanguageModel:
    """Train on text and non-null lang of at most ``max_training_docs`` documents of each language where ``learn`` holds;
    texts of any length are learnt from."""
    own = docs.where(F.lit(True) if learn is None else learn).select("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    rows = sorted((r.doc_id, r.text, r.lang) for r in bounded_sample(own, p.max_training_docs, p.training_chars, "lang").collect())
    return train([r[1] for r in rows], [r[2] for r in rows], p)


def _predict(text: pa.Array, m: LanguageModel) -> tuple[pa.Array, pa.Array]:
    """lang_pred and score of each text."""
    names = np.array([*m.languages, UNDETERMINED], object)
    best, score = [np.empty(0, np.int64)], [np.empty(0)]
    for c in A.chunks(text, 1 << 18):
        ok = has_letter(c)
        if m.languages:
            b, s = score_chunk(c, m)
        else:
            ok, b, s = np.zeros(c.n, bool), np.zeros(c.n, np.int64), np.zeros(c.n)
        best.append(np.where(ok, b, len(m.languages)))
        score.append(np.where(ok, s, 0.0))
    return pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score))


def prediction(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) of a text column, beside any other columns."""
    shared = spark.sparkContext.broadcast(model)

    @A.gives_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        A.give_back()
        for x in batches:
            yield pa.StructArray.from_arrays(list(_predict(x, m)), ["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as its parameters say
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            best, score = _predict(batch.column(batch.num_columns - 1), m)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], best, score],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")

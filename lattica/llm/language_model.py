"""Hidden Markov language model with exact sequence likelihoods.

Tokens are the lower-cased (A-Z) words of a text and one end token. A hidden
state emits a word class, a class emits a word: p(w | state) = p(class | state)
* p(w | class). The most frequent words and the end token are classes of their
own, other words are classed by a hash of their last bytes, so the number of
classes is fixed while every training word keeps its own count in p(w | class).

1. Word counts over all training documents are aggregated by Spark and written
   to the shared folder (they grow with the vocabulary and are never collected).
2. Starting point: how often each word class comes before each of 64 groups of
   classes is summed over all training documents; states are the mixture of that
   table (its rows and columns are of fixed number, so the driver holds it).
3. Baum-Welch: expected counts are summed over partitions in each pass over all
   training documents.
4. Scoring: documents are dealt into blocks by hash; the distinct words of each
   block are joined with the counts and meet the block's texts again in a
   cogrouped Arrow function, where the scaled forward recursion runs over whole
   texts. A hot word is one row per block, never one per occurrence.

Words are identified by a 64-bit hash. Defined cases: a null or empty text is
the end token alone; without training documents counts are 0 (N = V = 0) and
the model is uniform; repeated rows are scored each; a null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.tables import saved

END = np.uint64(0x8A5CD789635D2DFF)


@dataclass(frozen=True)
class LMParams:
    states: int = 6
    own_classes: int = 2000
    suffix_classes: int = 2048
    #: Groups of next classes, and passes over the table of classes by groups that gives the starting point.
    groups: int = 64
    start_passes: int = 60
    #: Passes of Baum-Welch over all training documents.
    passes: int = 3
    smoothing: float = 0.1
    #: Training tokens for each block of scored documents.
    block_tokens: int = 3_000_000
    chunk_bytes: int = 4 << 20
    seed: int = 5


@dataclass
class WordClasses:
    """Class 0 is the end; 1..own are single words; the rest are suffix classes."""

    slots: np.ndarray
    slot_class: np.ndarray
    own: int
    suffixes: int

    @classmethod
    def of(cls, frequent: list[int], suffixes: int) -> WordClasses:
        slots, slot_class = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int32)
        own = 0
        for h in frequent:  # of two words in one slot the less frequent stays in its suffix class
            s = h & ((1 << 18) - 1)
            if not slot_class[s]:
                own += 1
                slots[s], slot_class[s] = h, own
        return cls(slots, slot_class, own, suffixes)

    @property
    def n(self) -> int:
        return 1 + self.own + self.suffixes

    def classify(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        s = (h & np.uint64((1 << 18) - 1)).astype(np.int64)
        return np.where(self.slots[s] == h, self.slot_class[s], 1 + self.own + suffix).astype(np.int32)


@dataclass
class LanguageModel:
    params: LMParams
    classes: WordClasses
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # (classes, states)
    #: Denominators of p(w | class) and of the base; tokens and distinct tokens of training.
    within: np.ndarray
    tokens: int
    distinct: int


def tokens(chunk: A.Chunk, suffixes: int) -> tuple[np.ndarray, np.ndarray, A.Words]:
    """Hashes and suffix classes of the lower-cased words of a chunk."""
    low = A.Chunk(chunk.rows, A.LOWER[chunk.buf], chunk.offsets)
    w = A.words(low)
    h = A.word_hashes(low.buf, w)
    b = low.buf.astype(np.uint32)
    s = np.zeros(len(h), np.uint32)
    for k in (1, 2, 3):
        at = w.end - k
        s = s * np.uint32(0x01000193) + np.where(at >= w.start, b[np.maximum(at, 0)], 0).astype(np.uint32)
    s *= np.uint32(0x9E3779B1)
    return h, ((s >> np.uint32(12)) % np.uint32(suffixes)).astype(np.int32), w


class Lockstep:
    """Sequences laid out step by step, longest first, so that one numpy call
    advances all that are still running."""

    def __init__(self, first: np.ndarray) -> None:
        lengths = np.diff(first)
        self.order = np.argsort(-lengths, kind="stable")
        ranked = lengths[self.order]
        self.steps = int(ranked[0]) if len(ranked) else 0
        self.active = np.searchsorted(-ranked, -np.arange(self.steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        step = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
        self.place = self.offset[step] + np.repeat(rank, lengths)

    def lay(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.place] = values
        return out


def forward(seq: np.ndarray, lock: Lockstep, m: LanguageModel, keep: bool = False):
    """Scaled forward recursion; natural log likelihood of each sequence in
    input order, and, if kept, all scaled alphas and scales."""
    n = int(lock.active[0]) if lock.steps else 0
    like = np.zeros(len(lock.order))
    emitted = m.emit[seq]
    alphas = np.empty_like(emitted) if keep else None
    scales = np.empty(len(seq)) if keep else None
    a = np.broadcast_to(m.start, (n, len(m.start)))
    product, pending = np.ones(n), 0
    for t in range(lock.steps):
        o, n = lock.offset[t], lock.active[t]
        a = (a[:n] if t == 0 else a[:n] @ m.step) * emitted[o : o + n]
        c = a.sum(axis=1)
        a /= c[:, None]
        if keep:
            alphas[o : o + n], scales[o : o + n] = a, c
        product[:n] *= c
        pending += 1
        if pending == 16 or t + 1 == lock.steps:  # class probabilities are above 1e-18, so no product underflows
            like[: len(product)] += np.log(product)
            product[:] = 1
            pending = 0
    out = np.empty_like(like)
    out[lock.order] = like
    return (out, alphas, scales) if keep else out


def expected_counts(seq: np.ndarray, lock: Lockstep, m: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, transitions and emissions, and the log likelihood."""
    like, alphas, scales = forward(seq, lock, m, keep=True)
    k = len(m.start)
    gamma, moves = alphas, np.zeros((k, k))
    beta = np.ones((len(lock.order), k))
    for t in range(lock.steps - 1, 0, -1):
        o, n, before = lock.offset[t], lock.active[t], lock.offset[t - 1]
        back = beta[:n] * m.emit[seq[o : o + n]] / scales[o : o + n, None]
        was = alphas[before : before + n]
        moves += was.T @ back
        beta[:n] = back @ m.step.T
        gamma[before : before + n] = was * beta[:n]
    emitted = np.stack([np.bincount(seq, gamma[:, j], minlength=m.classes.n) for j in range(k)], axis=1)
    starts = gamma[: lock.active[0]].sum(axis=0) if lock.steps else np.zeros(k)
    return starts, moves * m.step, emitted, float(like.sum())


def reestimate(m: LanguageModel, starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> None:
    s = m.params.smoothing
    m.start = (starts + s) / (starts + s).sum()
    m.step = (moves + s) / (moves + s).sum(axis=1, keepdims=True)
    m.emit = (emitted + s) / (emitted + s).sum(axis=0, keepdims=True)


def sequences(chunk: A.Chunk, m: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class sequence with ends, its bounds, word hashes with ends, and suffix classes are folded in."""
    h, suffix, w = tokens(chunk, m.classes.suffixes)
    first = w.first + np.arange(chunk.n + 1)
    ends = first[1:] - 1
    cls, ids = np.zeros(len(h) + chunk.n, np.int32), np.full(len(h) + chunk.n, END)
    inner = np.ones(len(cls), bool)
    inner[ends] = False
    cls[inner], ids[inner] = m.classes.classify(h, suffix), h
    return cls, first, ids, ends


def count_words(docs: DataFrame, p: LMParams) -> DataFrame:
    """(word, suffix, n): counts of all tokens of ``docs``; ends have suffix -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in A.chunks(batch.column(0), p.chunk_bytes):
                h, suffix, _ = tokens(c, p.suffix_classes)
                ids, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(ids, END).view(np.int64)),
                        pa.array(np.append(suffix[at], -1).astype(np.int32)),
                        pa.array(np.append(n, c.n)),
                    ],
                    names=["word", "suffix", "n"],
                )

    parts = docs.select("text").mapInArrow(run, "word long, suffix int, n long")
    return parts.groupBy("word").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"))


def fit(docs: DataFrame, p: LMParams = LMParams()) -> tuple[LanguageModel, DataFrame]:
    """The model and the table of counts (word, n) of the training ``docs`` (doc_id, text)."""
    counts = saved(count_words(docs, p), "lm-counts")
    per_class = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    within = np.zeros((p.suffix_classes, 2))
    ends = 0
    for r in per_class:  # as many rows as suffix classes
        if r.suffix < 0:
            ends = r.n
        else:
            within[r.suffix] = r.n, r.words
    n = int(within[:, 0].sum()) + ends
    v = int(within[:, 1].sum()) + (ends > 0)
    top = counts.where("suffix >= 0").orderBy(F.desc("n"), "word").limit(p.own_classes).collect()
    classes = WordClasses.of([r.word & ((1 << 64) - 1) for r in top], p.suffix_classes)
    for r in top:
        own = np.array([r.word], np.int64).view(np.uint64)
        if classes.classify(own, np.array([r.suffix]))[0] <= classes.own:
            within[r.suffix] -= r.n, 1
    rng = np.random.RandomState(p.seed)
    k = p.states
    step = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(step, 0.9)
    emit = rng.rand(classes.n, k) + 0.5
    m = LanguageModel(
        p, classes, np.full(k, 1 / k), step, emit / emit.sum(axis=0), within[:, 0] + 0.5 * (within[:, 1] + 1), n, v
    )
    if not ends:
        return m, counts.select("word", "n")
    begin(m, count_neighbours(docs, m))
    for _ in range(p.passes):
        reestimate(m, *gather_counts(docs, m))
    return m, counts.select("word", "n")


def group_of(cls: np.ndarray, p: LMParams) -> np.ndarray:
    """The most frequent classes are groups of their own, three quarters of all; others share the rest."""
    own = p.groups * 3 // 4
    return np.where(cls < own, cls, own + cls % (p.groups - own))


def count_neighbours(docs: DataFrame, m: LanguageModel) -> np.ndarray:
    """(classes, groups): how often a token of a class is followed by one of a group in all of ``docs``."""
    spark, p = docs.sparkSession, m.params
    shared = spark.sparkContext.broadcast(m)
    shape = m.classes.n, p.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            for part in A.chunks(batch.column(0), p.chunk_bytes):
                cls, _, _, ends = sequences(part, shared.value)
                inner = np.ones(len(cls), bool)
                inner[ends] = False
                at = np.flatnonzero(inner)
                total += np.bincount(cls[at].astype(np.int64) * shape[1] + group_of(cls[at + 1], p), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    total = np.zeros(shape[0] * shape[1])
    for r in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r.cell] = r.n
    shared.unpersist()
    return total.reshape(shape)


def begin(m: LanguageModel, pairs: np.ndarray) -> None:
    """States as the mixture p(state) p(class | state) p(next group | state) of the table of neighbours."""
    p, rng = m.params, np.random.RandomState(m.params.seed)
    rows, groups = m.emit, rng.rand(p.groups, p.states) + 0.5
    state, groups = m.start, groups / groups.sum(axis=0)
    if not pairs.sum():
        return
    for _ in range(p.start_passes):
        ratio = pairs / np.maximum((rows * state) @ groups.T, 1e-300)
        r, g = rows * state * (ratio @ groups) + 1e-9, groups * state * (ratio.T @ rows) + 1e-9
        state, rows, groups = r.sum(axis=0) / r.sum(), r / r.sum(axis=0), g / g.sum(axis=0)
    of_group = np.zeros((p.groups, p.states))
    np.add.at(of_group, group_of(np.arange(m.classes.n), p), rows * state)
    of_group /= np.maximum(of_group.sum(axis=1, keepdims=True), 1e-300)
    moves = (groups.T * state[:, None]) @ of_group
    reestimate(m, state, moves * pairs.sum(), rows * state * pairs.sum())


def gather_counts(docs: DataFrame, m: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Baum-Welch pass over all of ``docs``; only sums of the model's size come back."""
    spark, p = docs.sparkSession, m.params
    shared = spark.sparkContext.broadcast(m)  # classes times states
    k, c = p.states, m.classes.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, np.zeros(k + k * k + c * k)
        for batch in batches:
            for part in A.chunks(batch.column(0), p.chunk_bytes):
                cls, first, _, _ = sequences(part, model)
                lock = Lockstep(first)
                s, t, e, _ = expected_counts(lock.lay(cls), lock, model)
                total += np.concatenate([s, t.ravel(), e.ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "x"])

    sums = docs.select("text").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    total = np.zeros(k + k * k + c * k)
    for r in sums.collect():
        total[r.cell] = r.x
    shared.unpersist()
    return total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(c, k)


def score(docs: DataFrame, m: LanguageModel, counts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    spark, p = docs.sparkSession, m.params
    blocks = max(16, -(-m.tokens // p.block_tokens))
    dealt = docs.select(
        F.pmod(F.xxhash64(*keep, "text"), F.lit(blocks)).cast("int").alias("_block"), *keep, F.col("text").alias("_text")
    ).repartition(F.col("_block"))
    kept = [f for f in dealt.schema.fields if f.name in keep]
    shared = spark.sparkContext.broadcast(m)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, text = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1)
            for c in A.chunks(text, p.chunk_bytes):
                h, _, w = tokens(c, p.suffix_classes)
                own = block[c.rows][w.doc()]
                for b in np.unique(block[c.rows]):
                    ids = np.append(np.unique(h[own == b]), END)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), b, np.int32)), pa.array(ids.view(np.int64))], names=["_block", "word"]
                    )

    words = dealt.mapInArrow(vocabulary, "_block int, word long").distinct().join(counts, "word")

    def meet(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        model = shared.value
        ids = found.column("word").to_numpy().view(np.uint64)
        order = np.argsort(ids)
        ids, n = np.append(ids[order], np.uint64(_LAST)), np.append(found.column("n").to_numpy()[order], 0)
        cols = {x: [] for x in ("n_tokens", "n_known", "base_score", "score")}
        base = np.log10(model.tokens + 0.5 * (model.distinct + 1))
        for c in A.chunks(texts.column(texts.num_columns - 1), p.chunk_bytes):
            cls, first, words_of, _ = sequences(c, model)
            at = np.minimum(np.searchsorted(ids, words_of), len(ids) - 1)
            count = np.where(ids[at] == words_of, n[at], 0)
            log_count = np.log10(count + 0.5)
            suffix = cls - 1 - model.classes.own
            inside = np.where(suffix >= 0, log_count - np.log10(model.within)[np.maximum(suffix, 0)], 0.0)
            lock = Lockstep(first)
            like = forward(lock.lay(cls), lock, model) / np.log(10)
            cols["n_tokens"].append(np.diff(first))
            cols["n_known"].append(A.sums((count > 0).astype(np.int64), first))
            cols["base_score"].append(np.add.reduceat(log_count - base, first[:-1]))
            cols["score"].append(like + np.add.reduceat(inside, first[:-1]))
        out = {k.name: texts.column(k.name) for k in kept}
        for k, parts in cols.items():
            out[k] = pa.array(np.concatenate(parts) if parts else np.empty(0))
        out["train_tokens"] = pa.array(np.full(texts.num_rows, model.tokens))
        return pa.table({k: out[k] for k in (*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(kept, key=lambda f: keep.index(f.name)))
    return dealt.groupBy("_block").cogroup(words.groupBy("_block")).applyInArrow(
        meet, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


_LAST = (1 << 64) - 1

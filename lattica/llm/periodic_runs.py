"""Periodic runs: stretches of words that repeat themselves.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least max(``least``, ``times`` * q) words that neither neighbour extends.

1. For each text and lag, equal words that far apart are counted: words that occur often by
   the autocorrelation of their indicator, computed by an exact FFT; the others by the differences of
   their places, shift by shift.
2. A run of period q has at least its length less q matches at lag q. Runs found at smaller lags
   explain matches at the multiples of their periods, which are taken off. Only lags
   with enough matches left get an island scan.
3. A scan compares words a lag apart at every eighth of the lag, which any run must meet many
   times in a row, and reads in full only where it does. So a text of n words costs about n log n
   beside the counting, also where one word fills it.

Texts are rows, so a task holds one batch of texts; counting works through pieces of bounded size.

Defined cases: a null or empty text has no words and no runs; a doc_id may be null or
repeated, rows count by themselves; extra columns named in ``keep`` pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A


@dataclass(frozen=True)
class RunParams:
    least: int = 6
    times: int = 4

    def needed(self, lag: int) -> int:
        """Matches in a row at ``lag`` that make a run."""
        return max(self.least, self.times * lag) - lag


#: Differences that are counted at once.
_PIECE = 1 << 20
#: Cost of one entry of a transform, in differences of places.
_FFT_COST = 4.0


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def autocorrelation(places: np.ndarray, n: int, top: int) -> np.ndarray:
    """Pairs of ``places`` (in 0..n-1) at each lag 0..top. Counts are whole numbers below 2**31 and
    the transform's error stays far below one half, so rounding gives them exactly."""
    size = 1 << int(n + top).bit_length()
    x = np.zeros(size)
    x[places] = 1.0
    spectrum = np.fft.rfft(x)
    return np.rint(np.fft.irfft(spectrum.real**2 + spectrum.imag**2, size)[: top + 1]).astype(np.int64)


def lag_matches(ids: np.ndarray, first: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words at each lag of each text. ``ids`` are word numbers, text t has places ``first[t]`` to
    ``first[t + 1]`` and asks for the lags 1..``tops[t]``. Gives counts and where each text's counts start (lag 0)."""
    sizes = np.diff(first)
    base = np.concatenate([[0], np.cumsum(tops + 1)])
    out = np.zeros(base[-1], np.int64)
    if not len(ids):
        return out, base
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ids, text))  # stable: by text, word, place
    t, w = text[order], ids[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (w[1:] != w[:-1])])
    start = np.flatnonzero(new)
    many = np.diff(np.append(start, len(order)))
    # a word is heavy where its pairs cost more than a transform of its text
    n = sizes[t[start]].astype(float)
    heavy = many * (many - 1.0) / 2 > _FFT_COST * n * np.log2(n + 2)
    for g in np.flatnonzero(heavy):
        own = int(t[start[g]])
        top = int(tops[own])
        if top:
            found = autocorrelation(order[start[g] : start[g] + many[g]] - first[own], int(sizes[own]), top)
            out[base[own] + 1 : base[own] + top + 1] += found[1:]
    light = np.repeat(~heavy, many)
    place, t = order[light], t[light]
    group = np.repeat(np.arange(len(start)), many)[light]
    at, waiting, held, shift = np.arange(len(place)), [], 0, 0
    while len(at):
        # the entry ``shift`` further on in the same word's places; beyond the text's largest lag all later are too far
        shift += 1
        at = at[at + shift < len(place)]
        lag = place[at + shift] - place[at]
        near = (group[at + shift] == group[at]) & (lag <= tops[t[at]])
        at = at[near]
        waiting.append(base[t[at]] + lag[near])
        held += len(at)
        if held > _PIECE or not len(at):
            keys, times = np.unique(np.concatenate(waiting), return_counts=True)
            out[keys] += times
            waiting, held = [], 0
    return out, base


def islands(ids: np.ndarray, lag: int, needed: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) of places whose word equals the one ``lag`` further on, of at least ``needed`` places."""
    last = len(ids) - lag
    stride = max(1, lag // 8)
    probes = np.arange(0, last, stride)
    same = np.concatenate([[False], ids[probes] == ids[probes + lag], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    out = []
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # a stretch of ``needed`` places holds at least so many probes
        if (y - x) < needed // stride:
            continue
        lo, hi = max(0, (x - 1) * stride + 1), min(last, y * stride)
        inner = np.flatnonzero(np.diff(np.concatenate([[0], (ids[lo:hi] == ids[lo + lag : hi + lag]).astype(np.int8), [0]])))
        for a, b in zip(inner[::2].tolist(), inner[1::2].tolist(), strict=True):
            if b - a >= needed:
                out.append((lo + a, lo + b))
    return out


def runs_of(ids: np.ndarray, matches: np.ndarray, p: RunParams = RunParams()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. ``matches[lag]`` counts equal words at that lag."""
    lags = np.arange(len(matches))
    bar = np.maximum(p.least, p.times * lags) - lags
    left = matches.copy()
    left[0] = -1
    found: dict[tuple[int, int], int] = {}
    at = 0
    while True:
        more = np.flatnonzero(left[at + 1 :] >= bar[at + 1 :])
        if not len(more):
            break
        at = at + 1 + int(more[0])
        for a, b in islands(ids, at, p.needed(at)):
            span = (a, b + at)
            if span not in found:  # else its smallest period is a divisor of this lag
                found[span] = at
                length = b + at - a
                multiples = np.arange(2 * at, min(length, len(matches)), at)
                left[multiples] -= length - multiples
    return sorted((a, b - a, q) for (a, b), q in found.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] > 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, keep: list[str], p: RunParams = RunParams()) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, runs (array of start, length, period, by start and period)
    and collapsed (the words that stay, joined by one space), from the column text."""
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, all_runs, collapsed = [], [], []
            for c in A.chunks(batch.column(batch.num_columns - 1)):
                texts = [c.text(i).split() for i in range(c.n)]
                first = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
                ids = word_numbers([w for x in texts for w in x])
                sizes = np.diff(first)
                # a run of period q has at least ``times`` * q words, and ``least`` at least
                tops = np.where(sizes >= p.least, sizes // p.times, 0)
                matches, base = lag_matches(ids, first, tops)
                for i, words in enumerate(texts):
                    own = runs_of(ids[first[i] : first[i + 1]], matches[base[i] : base[i + 1]], p) if tops[i] else []
                    total.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    if own:
                        gone = dropped(len(words), own)
                        words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(total, pa.int64()), pa.array(all_runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
            )

    return source.mapInArrow(run, f"{schema}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")

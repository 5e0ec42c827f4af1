"""Substring dedup: remove word spans that already occur in an earlier document.

A window is ``window`` consecutive words. Each word covered by a window whose
words also start in a document with a smaller doc_id is removed; windows are
judged on the input.

1. The least n-gram hash of a window (its anchor) is the same wherever the window
   occurs. Texts without an anchor that two documents have are passed over.
2. Runs of windows with one anchor are regions, about 1 in 20 words. Equal regions are
   one region with its first document. Where an anchor has several different
   regions, windows of one document alone are passed over too.
3. The regions of an anchor are a reference shard. They are streamed in the order of their
   first documents through a suffix automaton of the shard, which grows by each region
   that it doesn't hold yet: where the matching statistics reach the window length,
   an earlier document has the window. Hashes only choose what is streamed and where to.

Shards are dealt by a shuffle on the anchor and not by a broadcast, because all shards
together grow with the corpus. A region in a third of all documents is one region: copies
are summed before the shuffle and take what was found for it.

Defined cases: null and empty texts have no words; rows without a doc_id and rows
sharing one doc_id aren't compared with each other, and each row is cut by its own
text; a passage that a document repeats goes from all its places or from none, as earlier documents
have it or not; shorter texts than a window keep all words; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.suffix_automaton import SuffixAutomaton
from lattica.llm.tables import discard, saved

_U = np.uint64


@dataclass(frozen=True)
class SpanParams:
    window: int = 50
    gram: int = 10


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = n - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass
class Segments:
    """Runs of windows with one anchor: first window (place in the chunk's words), count, document."""

    anchor: np.ndarray
    start: np.ndarray
    n: np.ndarray
    doc: np.ndarray


def segments(chunk: A.Chunk, p: SpanParams) -> tuple[A.Words, np.ndarray, Segments]:
    w = A.words(chunk)
    h = A.word_hashes(chunk.buf, w)
    at, doc = A.windows_inside(w.first, p.window)
    if not len(at):
        none = np.empty(0, np.int64)
        return w, h, Segments(none.astype(_U), none, none, none)
    anchor = _sliding_least(A.sequence_hashes(h, p.gram), p.window - p.gram + 1)[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    return w, h, Segments(anchor[first], at[first], np.diff(np.append(first, len(at))), doc[first])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64))


def anchors(docs: DataFrame, p: SpanParams) -> DataFrame:
    """(anchor, doc_id, row): distinct anchors of each text of ``docs`` (doc_id, row, text)."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in A.chunks(batch.column(2)):
                s = segments(c, p)[2]
                order = np.lexsort((s.anchor, s.doc))
                a, d = s.anchor[order], s.doc[order]
                keep = np.ones(len(a), bool)
                keep[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                at = pa.array(c.rows.start + d[keep])
                yield pa.RecordBatch.from_arrays(
                    [_signed(a[keep]), batch.column(0).take(at), batch.column(1).take(at)], names=["anchor", "doc_id", "row"]
                )

    return docs.mapInArrow(run, "anchor long, doc_id long, row long")


def candidate_regions(docs: DataFrame, p: SpanParams) -> DataFrame:
    """(region, anchor, doc_id, row, start, n) of ``docs`` (doc_id, row, text, anchors): regions whose anchor
    is listed; ``region`` is a hash of the words."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(3)
            for c in A.chunks(batch.column(2)):
                w, h, s = segments(c, p)
                own = listed.slice(c.rows.start, c.n)
                many = np.diff(own.offsets.to_numpy())
                pairs = np.repeat(np.arange(c.n), many).astype(_U)
                known = np.sort(A.mix(own.flatten().to_numpy().view(_U) + A.mix(pairs)))
                key = A.mix(s.anchor + A.mix(s.doc.astype(_U)))
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key if len(known) else np.zeros(len(key), bool)
                start, n = s.start[hit], s.n[hit]
                up, down = A._SEQ_POW.get(len(h) + 1)
                run_ = np.zeros(len(h) + 1, _U)
                np.cumsum(h * up[:-1], out=run_[1:])
                end = start + n + p.window - 1
                digest = A.mix((run_[end] - run_[start]) * down[start] + n.astype(_U))
                rows = pa.array(c.rows.start + s.doc[hit])
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(digest), _signed(s.anchor[hit]), batch.column(0).take(rows), batch.column(1).take(rows),
                        pa.array((start - w.first[s.doc[hit]]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    names=["region", "anchor", "doc_id", "row", "start", "n"],
                )

    return docs.mapInArrow(run, "region long, anchor long, doc_id long, row long, start int, n int")


def _runs(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of a list-of-structs column, row by row, as numpy fields."""
    offsets, flat = column.offsets.to_numpy(), column.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    base = offsets[0]
    for a, b in zip(offsets[:-1] - base, offsets[1:] - base, strict=True):
        yield {k: v[a:b] for k, v in fields.items()}


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + n - 1 for each entry."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def windows_of(docs: DataFrame, p: SpanParams) -> DataFrame:
    """(hash, doc_id, row, start) for each window of the runs listed in ``docs`` (doc_id, row, text, runs)."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = list(_runs(batch.column(3)))
            for c in A.chunks(batch.column(2)):
                w = A.words(c)
                all_ = A.sequence_hashes(A.word_hashes(c.buf, w), p.window)
                at, doc = [], []
                for i in range(c.n):
                    r = runs[c.rows.start + i]
                    own = np.unique(_spread(r["start"].astype(np.int64), r["n"].astype(np.int64)))
                    at.append(own)
                    doc.append(np.full(len(own), i))
                at, doc = np.concatenate(at), np.concatenate(doc)
                rows = pa.array(c.rows.start + doc)
                yield pa.RecordBatch.from_arrays(
                    [_signed(all_[at + w.first[doc]]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32))],
                    names=["hash", "doc_id", "row", "start"],
                )

    return docs.mapInArrow(run, "hash long, doc_id long, row long, start int")


def region_words(docs: DataFrame, p: SpanParams) -> DataFrame:
    """(anchor, region, doc_id, row, at, start, words) of ``docs`` (doc_id, row, text, regions, live): whole regions that
    have copies, of others the runs of live windows. ``at`` is the region's first window, ``start`` the run's."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions, live = list(_runs(batch.column(3))), batch.column(4)
            bounds, starts = live.offsets.to_numpy(), live.flatten().to_numpy()
            bounds = bounds - bounds[0]
            for c in A.chunks(batch.column(2)):
                w = A.words(c)
                out: dict[str, list] = {k: [] for k in ("anchor", "region", "rows", "at", "start", "words")}
                for i in range(c.n):
                    row, base = c.rows.start + i, w.first[i]
                    own = np.sort(starts[bounds[row] : bounds[row + 1]])
                    r = regions[row]
                    for anchor, region, at, n, copies in zip(r["anchor"].tolist(), r["region"].tolist(), r["start"].tolist(), r["n"].tolist(), r["copies"].tolist(), strict=True):
                        if copies:
                            parts = [(at, at + n)]
                        else:
                            inside = own[np.searchsorted(own, at) : np.searchsorted(own, at + n)]
                            cut = np.flatnonzero(np.diff(inside) > 1)
                            parts = list(zip(inside[np.append(0, cut + 1)], inside[np.append(cut, len(inside) - 1)] + 1, strict=True)) if len(inside) else []
                        for lo, hi in parts:
                            out["anchor"].append(anchor)
                            out["region"].append(region)
                            out["rows"].append(row)
                            out["at"].append(at)
                            out["start"].append(lo)
                            out["words"].append(c.buf[w.start[base + lo] : w.end[base + hi + p.window - 2]].tobytes())
                rows = pa.array(out["rows"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["anchor"], pa.int64()), pa.array(out["region"], pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows),
                        pa.array(out["at"], pa.int32()), pa.array(out["start"], pa.int32()), pa.array(out["words"], pa.binary()),
                    ],
                    names=["anchor", "region", "doc_id", "row", "at", "start", "words"],
                )

    return docs.mapInArrow(run, "anchor long, region long, doc_id long, row long, at int, start int, words binary")


def stream_shards(found: DataFrame, p: SpanParams) -> DataFrame:
    """(region, early, start, end): spans of words that an automaton matches, by streaming
    ``found`` (anchor, region, doc_id, row, at, start, words) through the automaton of its anchor.

    ``start`` counts from the region. ``early`` spans are held by documents before the region's first one, so that it
    loses them wherever it holds the region; others are what later holders of the region lose."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, held, waiting = None, SuffixAutomaton(), None, []
        for batch in batches:
            out: list[tuple] = []
            for anchor, region, doc, _, at, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != anchor:
                    shard, automaton, held, waiting = anchor, SuffixAutomaton(), None, []
                if held != doc:  # regions of one document don't meet each other
                    for x in waiting:
                        automaton.extend(x)
                    held, waiting = doc, []
                query = words.split()
                reached = automaton.matching_statistics(query) >= p.window
                out += [(region, True, start - at + lo - p.window + 1, start - at + hi) for lo, hi in _blocks(reached)]
                if not reached[p.window - 1 :].all():
                    waiting.append(query)
                # now the shard holds every window of it, so later holders lose all
                out.append((region, False, start - at, start - at + len(query)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["region", "early", "start", "end"]
            )

    return found.mapInArrow(run, "region long, early boolean, start int, end int")


def row_key():
    """A private key of a row: rows that share a doc_id are told apart by their texts."""
    return F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), "text"))


def repeated_spans(docs: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """(row, start, end): spans of words to remove, end excluded; they may overlap. ``row`` is :func:`row_key`."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").where("row is not null")
    pairs = anchors(own, p)
    shared = pairs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    listed = saved(pairs.join(shared, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors")), "span-anchors")
    # of rows with one doc_id and one text, one is enough
    texts = saved(own.join(listed, "row").dropDuplicates(["row"]).select("doc_id", "row", "text", "anchors"), "span-texts")
    found = saved(candidate_regions(texts, p), "span-regions")
    first = found.groupBy("region").agg(
        F.min(F.struct("doc_id", "row", "start", "n")).alias("f"), F.max("doc_id").alias("last"), F.first("anchor").alias("anchor"))
    first = saved(first.select("region", "anchor", "f.*", (F.col("last") > F.col("f.doc_id")).alias("copies")), "span-first")
    several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    open_ = first.join(several, "anchor").groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    plain = texts.select("doc_id", "row", "text")
    windows = saved(windows_of(plain.join(open_, "row").select("doc_id", "row", "text", "runs"), p), "span-windows")
    alive = windows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash")
    # written, so that both sides of the join are plain shuffles, of which adaptive execution splits a hot one
    alive = saved(alive, "span-alive")
    live = windows.join(alive, "hash", "left_semi").groupBy("row").agg(F.collect_set("start").alias("live"))
    regions = first.groupBy("row").agg(F.collect_list(F.struct("anchor", "region", "start", "n", "copies")).alias("regions"))
    none = F.array().cast("array<int>")
    wanted = plain.join(regions, "row").join(live, "row", "left").select("doc_id", "row", "text", "regions", F.coalesce("live", none).alias("live"))
    words = saved(region_words(wanted, p), "span-words")
    discard(windows, texts, listed)
    # the shards of a partition come one after the other, each by its first documents
    streamed = saved(stream_shards(words.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start"), p), "span-streamed")
    discard(words)
    # all occurrences in the region's first document lose what earlier documents have, all others what the region has
    held = found.join(first.select("region", F.col("doc_id").alias("ref")), "region").select(
        "region", "row", F.col("start").alias("at"), (F.col("doc_id") == F.col("ref")).alias("early"))
    out = held.join(streamed, ["region", "early"]).select("row", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    out = saved(out, "span-removed")
    discard(found, first, streamed, alive)
    return out


def remove_spans(docs: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, n_removed, kept_words (joined by one
    space) and kept_text (null if nothing was removed; otherwise the text without the
    removed words and the white space after each)."""
    listed = spans.groupBy(F.col("row").alias("_id")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    source = docs.select(*keep, row_key().alias("_key"), F.col("text").alias("_text"))
    source = source.join(listed, F.col("_key") == F.col("_id"), "left").select(*keep, "_spans", "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(batch.num_columns - 2)
            offsets, flat = spans_of.offsets.to_numpy(), spans_of.flatten()
            lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            offsets = offsets - offsets[0]
            n, gone, joined, cut = [], [], [], []
            for c in A.chunks(batch.column(batch.num_columns - 1)):
                w = A.words(c)
                counts = np.diff(w.first)
                for i in range(c.n):
                    row, total = c.rows.start + i, int(counts[i])
                    n.append(total)
                    a, b = offsets[row], offsets[row + 1]
                    text = c.text(i)
                    if a == b:
                        gone.append(0)
                        joined.append(b" ".join(text.split()))
                        cut.append(None)
                        continue
                    stays = _stays(total, lo[a:b], hi[a:b])
                    gone.append(int(total - stays.sum()))
                    joined.append(b" ".join(x for x, k in zip(text.split(), stays, strict=True) if k))
                    cut.append(cut_text(text, w, i, c.offsets[i], stays))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(joined, pa.binary()).cast(pa.string()), pa.array(cut, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[:-2], "n_words", "n_removed", "kept_words", "kept_text"],
            )

    return source.mapInArrow(run, f"{schema}, n_words long, n_removed long, kept_words string, kept_text string")


def cut_text(text: bytes, w: A.Words, i: int, base: int, stays: np.ndarray) -> bytes:
    """Document ``i`` of a chunk without its removed words and the white space after each."""
    start = w.start[w.first[i] : w.first[i + 1]] - base
    stop = np.append(start[1:], len(text))
    parts, at = [], 0
    for x, y in _blocks(~stays):
        parts.append(text[at : start[x]])
        at = int(stop[y - 1])
    return b"".join([*parts, text[at:]])


def _stays(total: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    return np.cumsum(change)[:total] <= 0


def clean_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with all its columns, the spans cut out of text; a text that loses all its words is null."""
    listed = spans.groupBy(F.col("row").alias("_span_id")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))

    def run(text: pa.Array, runs: pa.Array) -> pa.Array:
        all_runs, out = list(_runs(runs)), []
        for c in A.chunks(text):
            w = A.words(c)
            for i in range(c.n):
                r, own = all_runs[c.rows.start + i], c.text(i)
                if len(r["start"]):
                    stays = _stays(int(w.first[i + 1] - w.first[i]), r["start"], r["end"])
                    out.append(cut_text(own, w, i, c.offsets[i], stays) if stays.any() else None)
                else:
                    out.append(own)
        found = pa.array(out, pa.binary()).cast(pa.string())
        del all_runs, out
        A.give_back()
        return found

    cut = F.arrow_udf(run, "string")(F.col("text"), F.col("_spans"))
    both = docs.withColumn("_span_key", row_key()).join(listed, F.col("_span_key") == F.col("_span_id"), "left").drop("_span_id", "_span_key")
    none = F.array().cast("array<struct<start:int,end:int>>")
    both = both.withColumn("_spans", F.coalesce("_spans", none))
    return both.withColumn("text", F.when(F.size("_spans") > 0, cut).otherwise(F.col("text"))).drop("_spans")


def _blocks(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def deduplicate(docs: DataFrame, keep: list[str], p: SpanParams = SpanParams()) -> DataFrame:
    """Remove from each document the words that :func:`repeated_spans` finds."""
    return remove_spans(docs, repeated_spans(docs, p), keep)

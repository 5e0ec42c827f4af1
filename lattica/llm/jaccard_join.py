"""Exact n-gram Jaccard join with token-combination prefixes.

Tokens are a document's distinct word shingles, in one global order from rare to
frequent (bucketed document counts of all shingles; any order is correct). Rare
tokens are indexed one by one. Frequent tokens fall into sub-classes, and pairs
of tokens of a sub-class are indexed instead, in a prefix that is extended until

    rare tokens + sum over sub-classes of (tokens - 1)  >  tokens that a partner may lack,

so that two linked documents always share an indexed entry: of two linked sets
take the one whose prefix ends earlier; its partner lacks too few of the prefix's
tokens to miss every rare one and to keep fewer than two of every sub-class. The
number of sub-classes depends on the size band of a pair; a document near a band's
edge is indexed for both. A set of rare tokens is indexed for ``prefix`` percent of it,
more than one shared token needs: then a link means many shared entries, and a document
with fewer than these (a passage that others hold too, say) is left out before any text moves.

Documents with equal sets are one node (64-bit hash of the sorted set). Candidates
are verified on whole texts. For classes not all pairs are needed: in a few turns each
node meets one node of a larger class with which it shares entries. Then every entry
that still holds several classes is finished: the pairs of small entries are listed,
larger ones are compared block by block (sketches first, or whole texts at once). Every pair that shares an entry has then been
compared or is in one class, so no link is lost, and no entry is ever collected.

Defined cases: texts with fewer words than a shingle are one shingle; a null text
or one without words is linked with nothing; repeated rows are equal sets; a null
doc_id joins a class but never names it; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.components import connected_components
from lattica.llm.tables import discard, saved

_U = np.uint64


@dataclass(frozen=True)
class JaccardParams:
    shingle: int = 5
    #: Linked if percent * |union| <= 100 * |intersection|.
    percent: int = 75
    #: Percentage of a set's tokens that are indexed where enough of them are rare.
    prefix: int = 40
    #: Buckets of the document counts that order tokens, and bits of the filter of shared entries: fixed sizes.
    count_bits: int = 18
    filter_bits: int = 26
    #: A bucket is frequent if its count exceeds the mean by so many and by so many standard deviations.
    frequent: int = 64
    deviations: float = 6.0
    #: Turns in which each node meets one other; nodes of an entry up to which its pairs are
    #: listed, and up to which sketches go first; rows of a block.
    turns: int = 3
    pairwise: int = 16
    sketched: int = 64
    block: int = 128
    #: Nodes up to which their numbers are broadcast to pick their texts.
    broadcast_nodes: int = 1 << 20
    bands: tuple[int, ...] = tuple(4**k for k in range(2, 16))


def shingle_sets(chunk: A.Chunk, p: JaccardParams) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    low = A.Chunk(chunk.rows, A.LOWER[chunk.buf], chunk.offsets)
    w = A.words(low)
    h = A.word_hashes(low.buf, w)
    s = A.sequence_hashes(h, p.shingle)
    out = []
    for i in range(chunk.n):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= p.shingle:
            own = np.sort(s[a : b - p.shingle + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(A.sequence_hashes(h[a:b], b - a) ^ A.mix(np.array([b - a], _U)))
        else:
            out.append(np.empty(0, _U))
    return out


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes, as a signed integer."""
    both = np.array([len(s), A.mix(s + _U(0x5851F42D4C957F2D)).sum(dtype=_U), np.bitwise_xor.reduce(A.mix(s ^ _U(0x2545F4914F6CDD1D))) if len(s) else 0], _U)
    return int(A.sequence_hashes(both, 3).view(np.int64)[0])


def least_overlap(n: int, p: JaccardParams) -> int:
    """Tokens of a set of n that a linked partner must hold."""
    return -(-p.percent * n // 100)


def signatures(s: np.ndarray, rank: np.ndarray, p: JaccardParams) -> tuple[np.ndarray, int]:
    """Index entries of a set (rare tokens of its prefix and pairs of frequent ones), and how
    many of them it shares at least with any linked partner.

    Of two linked sets one has the prefix that ends first; the other lacks at most (100 - percent)
    of 100 of its tokens, so they share at least (prefix - 100 + percent) of 100 of them, and that
    set isn't smaller than percent of 100 of the other. Where rare tokens are short, one entry is sure."""
    n = len(s)
    if n < 2:
        return np.empty(0, _U), 1  # linked with equal sets alone
    need = n - least_overlap(n, p) + 1
    q = rank[(s & _U((1 << p.count_bits) - 1)).astype(np.int64)].astype(_U)
    order = np.argsort((q << _U(56)) | (s >> _U(8)), kind="stable")
    rare = int((q == 0).sum())
    if rare >= need:
        long = -(-p.prefix * n // 100)
        least = max(1, (p.prefix - 100 + p.percent) * p.percent * n // 10000) if rare >= long >= need else 1
        return s[order[: max(need, min(rare, long))]], least
    parts, tokens = [s[order[:rare]]], s[order[rare:]]
    low = 0
    for band, high in enumerate(p.bands):
        if 100 * n > p.percent * low and n <= high:
            classes = max(1, low // 4)
            sub = ((tokens >> _U(20)) % _U(classes)).astype(np.int64)
            by = np.argsort(sub, kind="stable")
            again = np.ones(len(sub), bool)
            again[by[np.concatenate([[True], sub[by[1:]] != sub[by[:-1]]])]] = False
            end = int(np.searchsorted(rare + np.cumsum(again), need)) + 1
            by = by[by < end]
            cuts = np.flatnonzero(np.diff(sub[by])) + 1
            for group in np.split(by, cuts):
                if len(group) > 1:
                    a, b = np.triu_indices(len(group), 1)
                    t = tokens[group]
                    parts.append(A.mix(t[a] * _U(3) + A.mix(t[b]) + _U(band)))
        low = high
    return np.concatenate(parts), 1


def describe(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """One pass over the texts: a row (doc_id, n_shingles, node) for each document, and
    rows (bucket, n) with each task's document counts of hashed shingles."""
    size = 1 << p.count_bits
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n_shingles", "node", "bucket", "n"]

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(size, np.int64), None
        for batch in batches:
            n, node = [], []
            id_type = batch.column(0).type
            for c in A.chunks(batch.column(1)):
                sets = shingle_sets(c, p)
                n += [len(s) for s in sets]
                node += [set_hash(s) for s in sets]
                counts += np.bincount((np.concatenate(sets) & _U(size - 1)).astype(np.int64), minlength=size)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), none, none], names=names)
        at = np.flatnonzero(counts)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), id_type), none, none, pa.array(at), pa.array(counts[at])], names=names)

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, n_shingles long, node long, bucket long, n long")


def token_ranks(counts: DataFrame, p: JaccardParams) -> np.ndarray:
    """0 for rare buckets, higher for more frequent ones; only frequent buckets of the fixed number reach the driver."""
    size = 1 << p.count_bits
    counts = saved(counts.groupBy("bucket").agg(F.sum("n").alias("n")), "jaccard-counts")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / size
    over = mean + max(p.frequent, p.deviations * mean**0.5)
    found = counts.where(F.col("n") > over).toArrow()
    rank = np.zeros(size, np.uint8)
    excess = np.maximum(found.column("n").to_numpy() - mean, 1)
    rank[found.column("bucket").to_numpy()] = 1 + np.minimum(4 * np.log2(excess), 250).astype(np.uint8)
    return rank


def index_entries(docs: DataFrame, rank, p: JaccardParams) -> DataFrame:
    """(entry, node) rows of the index; equal sets give equal rows."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in A.chunks(batch.column(0)):
                sets = shingle_sets(c, p)
                entries = [signatures(s, rank.value, p)[0] for s in sets]
                nodes = np.array([set_hash(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(entries).view(np.int64)), pa.array(np.repeat(nodes, [len(e) for e in entries]))],
                    names=["entry", "node"],
                )

    return docs.select("text").mapInArrow(run, "entry long, node long")


def key_filter(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Two bitmaps of ``2**bits`` bits, with the low and the next bits of each key: fixed size, no misses."""
    low = F.explode(F.array(*(F.shiftrightunsigned(F.col(column), k * bits).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(k << bits) for k in (0, 1))))
    words = (
        keys.select(low.alias("low"))
        .select(F.shiftright("low", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(low & 63 as int))").alias("bits"))
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    out = np.zeros(2 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(_U).reshape(2, -1)


def _passes(bitmaps: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for k, bitmap in enumerate(bitmaps):
        low = (keys >> _U(k * bits)) & _U((1 << bits) - 1)
        ok &= (bitmap[(low >> _U(6)).astype(np.int64)] >> (low & _U(63))) & _U(1) == 1
    return ok


def candidates(docs: DataFrame, rank, bitmap, p: JaccardParams) -> DataFrame:
    """(node, n, entries, sketch, text) of the documents that have as many entries that pass the
    bitmap as a link needs. The sketch holds 16-bit hashes of a quarter of the set."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, node, n, entries, sketch = [], [], [], [], []
            for c in A.chunks(batch.column(0)):
                for i, s in enumerate(shingle_sets(c, p)):
                    own, least = signatures(s, rank.value, p)
                    own = own[_passes(bitmap.value, own, p.filter_bits)]
                    if len(own) >= least:
                        rows.append(c.rows.start + i)
                        node.append(set_hash(s))
                        n.append(len(s))
                        entries.append(own.view(np.int64))
                        sketch.append(_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(entries, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64())),
                ],
                names=["node", "n", "entries", "sketch", "text"],
            )

    found = docs.select("text").mapInArrow(run, "node long, n int, entries array<long>, sketch binary, text string")
    return found.groupBy("node").agg(F.first(F.struct("n", "entries", "sketch", "text")).alias("r")).select("node", "r.*")


def _sketch(s: np.ndarray) -> bytes:
    return np.sort((s[s & _U(3) == 0] >> _U(40)).astype(np.uint16)).tobytes()


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Entries that two sorted arrays have in common, repeats included (as many as the rarer has)."""
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    return int((z[1:] == z[:-1]).sum())


def may_link(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, p: JaccardParams) -> bool:
    """False only if the sketches prove that two sets aren't linked: tokens outside the
    quarter may all be shared, those inside at most as often as their hashes agree."""
    both = _shared(a, b) + min(n_a - len(a), n_b - len(b))
    return 100 * both >= p.percent * (n_a + n_b - both)


def plausible(pairs: DataFrame, sets: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs (a, b) that :func:`may_link` leaves."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, x, y, n, m = (c.to_pylist() for c in batch.columns)
            keep = pa.array(
                [may_link(np.frombuffer(u, np.uint16), np.frombuffer(v, np.uint16), i, j, p) for u, v, i, j in zip(x, y, n, m, strict=True)],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("n_a"))
    right = sets.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("n_b"))
    met = pairs.join(left, "a").join(right, "b").where(_sizes_fit(p, "n_a", "n_b"))
    return met.select("a", "b", "x", "y", "n_a", "n_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, by their whole shingle sets."""

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [np.empty(0, bool)]
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                left = [s for c in A.chunks(part.column(2), 1 << 40) for s in shingle_sets(c, p)]
                right = [s for c in A.chunks(part.column(3), 1 << 40) for s in shingle_sets(c, p)]
                for x, y in zip(left, right, strict=True):
                    same = _shared(x, y)
                    ok.append(np.array([100 * same >= p.percent * (len(x) + len(y) - same)]))
            keep = pa.array(np.concatenate(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    likely = saved(plausible(pairs, sets, p), "jaccard-plausible")
    nodes = saved(likely.select("a").union(likely.select("b")).distinct().select(F.col("a").alias("node")), "jaccard-wanted")
    count = nodes.limit(p.broadcast_nodes + 1).count()
    if not count:  # nothing to verify
        discard(nodes)
        return likely
    few = count <= p.broadcast_nodes
    # only texts of these nodes are shuffled
    texts = sets.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    met = likely.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    found = saved(met.mapInArrow(run, "a long, b long"), "jaccard-links")
    discard(likely, nodes)
    return found


def _sizes_fit(p: JaccardParams, x: str, y: str):
    return (F.col(x) * 100 >= F.col(y) * p.percent) & (F.col(y) * 100 >= F.col(x) * p.percent)


def _best_partners(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), at most one for each node: in each entry a node of its largest class
    is the centre, another one each turn; a node of another class meets the centre with
    which it shares most entries. Before the first turn every node is a class."""
    order = F.xxhash64("node", F.lit(turn))
    classes = members.groupBy("entry", "comp").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(order.alias("o"), F.col("node"))).alias("c"))
    center = classes.groupBy("entry").agg(F.max(F.struct("k", F.col("c.node").alias("node"), "comp")).alias("m"))
    met = members.join(center.select("entry", F.col("m.node").alias("center"), F.col("m.comp").alias("main")), "entry").where("comp <> main")
    best = met.groupBy("node", "center").count().groupBy("node").agg(F.max_by("center", F.struct("count", "center")).alias("center"))
    return best.select(F.col("center").alias("a"), F.col("node").alias("b"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the entries that hold more than one class, with the new classes."""
    rows = members.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = rows.groupBy("entry").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("entry")
    return rows.join(several, "entry")


def _blockwise(members: DataFrame, contents: DataFrame, compare, p: JaccardParams, distinct: bool = False) -> DataFrame:
    """Pairs (a, b) that ``compare`` finds between classes within entries, block by block.

    Entries with the same least node are taken together. Their nodes are dealt into
    blocks of about ``block`` rows of ``contents`` (node, n, and a sketch or text); blocks
    of nodes outside the largest class meet all blocks, as rows of blocks and not of pairs."""
    group = members.groupBy("entry").agg(F.min("node").alias("g"))
    rows = members.join(group, "entry").groupBy("g", "node").agg(F.first("comp").alias("comp"))
    groups = rows = saved(rows, "jaccard-groups")
    main = rows.groupBy("g", "comp").count().groupBy("g").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("size"))
    rows = rows.join(main.select("g", F.col("m.comp").alias("main"), "size"), "g").join(contents, "node")
    rest = F.when(F.col("comp") != F.col("main"), 1).otherwise(0)
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / F.lit(p.block)))
    own = F.struct("node", "comp", "n", F.col(contents.columns[-1]).alias("content"))
    blocks = saved(rows.groupBy("g", rest.alias("rest"), block.alias("block")).agg(F.collect_list(own).alias("rows")), "jaccard-blocks")
    left = blocks.where("rest = 1").select("g", F.col("block").alias("x"), F.col("rows").alias("left"))
    right = blocks.select("g", F.col("block").alias("y"), "rest", F.col("rows").alias("right"))
    met = left.join(right, "g").where("rest = 0 or x <= y").select("left", "right")

    @A.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                a, b = compare(batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten(), p)
                out_a += a
                out_b += b
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    found = met.mapInArrow(run, "a long, b long")
    found = saved(found.distinct() if distinct else found, "jaccard-found")
    discard(groups, blocks)
    return found


def _intersections(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by a matrix product."""
    flat = np.concatenate([*sets_a, *sets_b])
    token = np.unique(flat, return_inverse=True)[1].ravel()
    n = np.array([len(s) for s in (*sets_a, *sets_b)])
    row = np.repeat(np.arange(len(n)), n)
    # a token that only one side has adds nothing to an intersection
    first, size = row < len(sets_a), int(token.max(initial=-1)) + 1
    used = np.flatnonzero((np.bincount(token[first], minlength=size) > 0) & (np.bincount(token[~first], minlength=size) > 0))
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    at = place[token]
    same, width = np.zeros((len(sets_a), len(sets_b))), 8192
    for lo in range(0, len(used), width):
        ok = (at >= lo) & (at < lo + width)
        hot = np.zeros((len(n), min(width, len(used) - lo)), np.float32)
        np.add.at(hot, (row[ok], at[ok] - lo), 1)
        same += hot[: len(sets_a)] @ hot[len(sets_a) :].T
    return same


def _likely_pairs(left: pa.StructArray, right: pa.StructArray, p: JaccardParams) -> tuple[list[int], list[int]]:
    """Pairs between different classes that their sketches don't rule out (see :func:`may_link`;
    repeated hashes count as often as both sides allow, which only raises the bound)."""
    sides = []
    for side in (left, right):
        sketches = [np.frombuffer(x, np.uint16) for x in side.field("content").to_pylist()]
        sides.append((side.field("node").to_numpy(), side.field("comp").to_numpy(), side.field("n").to_numpy().astype(np.int64), sketches))
    (node_a, comp_a, n_a, x), (node_b, comp_b, n_b, y) = sides
    rest_a, rest_b = n_a - [len(s) for s in x], n_b - [len(s) for s in y]
    both = _intersections(x, y) + np.minimum(rest_a[:, None], rest_b[None, :])
    ok = (100 * both >= p.percent * (n_a[:, None] + n_b[None, :] - both)) & (comp_a[:, None] != comp_b[None, :])
    ok &= (100 * n_a[:, None] >= p.percent * n_b[None, :]) & (100 * n_b[None, :] >= p.percent * n_a[:, None])
    i, j = np.nonzero(ok)
    a, b = node_a[i], node_b[j]
    return np.minimum(a, b).tolist(), np.maximum(a, b).tolist()


def _forest(left: pa.StructArray, right: pa.StructArray, p: JaccardParams) -> tuple[list[int], list[int]]:
    """Links between two blocks that join different classes, each class pair at most once."""
    sides = []
    for side in (left, right):
        own = [s for c in A.chunks(side.field("content"), 1 << 40) for s in shingle_sets(c, p)]
        sides.append((side.field("node").to_numpy(), side.field("comp").to_numpy(), own))
    (node_a, comp_a, sets_a), (node_b, comp_b, sets_b) = sides
    same = _intersections(sets_a, sets_b)
    size_a, size_b = np.array([len(s) for s in sets_a])[:, None], np.array([len(s) for s in sets_b])[None, :]
    linked = (100 * same >= p.percent * (size_a + size_b - same)) & (comp_a[:, None] != comp_b[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out_a, out_b = [], []
    for i, j in zip(*np.nonzero(linked), strict=True):
        u, v = root(int(comp_a[i])), root(int(comp_b[j]))
        if u != v:
            parent[u] = v
            out_a.append(int(node_a[i]))
            out_b.append(int(node_b[j]))
    return out_a, out_b


def similarity_classes(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    described = saved(describe(docs, p), "jaccard-nodes")
    nodes = described.where("node is not null").select("doc_id", "n_shingles", "node")
    ranks = token_ranks(described.where("bucket is not null").select("bucket", "n"), p)
    rank = spark.sparkContext.broadcast(ranks)  # 2**count_bits bytes
    ends = index_entries(docs, rank, p).groupBy("entry").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = saved(ends.where("lo <> hi").select("entry"), "jaccard-shared")
    bitmap = spark.sparkContext.broadcast(key_filter(shared, "entry", p.filter_bits))  # two of 2**filter_bits bits
    sets = saved(candidates(docs, rank, bitmap, p), "jaccard-sets")
    for x in (rank, bitmap):  # the driver's heap holds its blocks
        x.destroy()
    written = saved(sets.select("node", "n", F.explode("entries").alias("entry")).join(shared, "entry"), "jaccard-members")
    discard(shared)
    members, links, labels, settled = written.withColumn("comp", F.col("node")), [], None, written.isEmpty()

    def met(found: DataFrame) -> bool:
        """Keep links; False if there are none, so that classes are as before. Each query leaves its text with the driver, so none is made for nothing."""
        if found.isEmpty():
            discard(found)
            return False
        links.append(found)
        return True

    for turn in range(p.turns):
        # each node meets the node of a larger class with which it shares most entries
        if settled or not met(verified(_best_partners(members, turn), sets, p)):
            continue
        labels = connected_components(_all(links))
        before, members = written, saved(_open(members, labels), "jaccard-open")
        discard(before)
        written, settled = members, members.isEmpty()
    done, size = len(links), members.groupBy("entry").count()
    small, large = F.col("count") <= p.pairwise, F.col("count") > p.sketched
    kinds = (small, ~small & ~large, large)
    has_few, has_some, has_many = (False,) * 3 if settled else size.agg(*(F.coalesce(F.max(k), F.lit(False)) for k in kinds)).first()
    few, some, many = (members.join(size.where(k).select("entry"), "entry") for k in kinds)
    if has_few:
        other = few.select("entry", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
        pairs = few.withColumnRenamed("node", "a").join(other, "entry").where("a < b and comp <> comp_b").where(_sizes_fit(p, "n", "n_b"))
        # one query each, so that each one's shuffle files go before the next
        met(verified(pairs.select("a", "b").distinct(), sets, p))
    if has_some:
        likely = _blockwise(some, sets.select("node", "n", "sketch"), _likely_pairs, p, distinct=True)
        met(verified(likely, sets, p))
        discard(likely)
    if has_many:
        met(_blockwise(many, sets.select("node", "n", "text"), _forest, p))
    discard(written, sets)
    if labels is None or len(links) > done:
        labels = connected_components(_all(links)) if links else nodes.select("node", F.col("node").alias("comp")).limit(0)
    discard(*links)
    own = nodes.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")).alias("comp"))
    least = own.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, "comp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _all(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, links)

"""Near duplicates by SimHash and a Gray-order hierarchical index.

Fingerprints, one row per different value, go to groups that agree on three of six blocks
of bits: of 64 bits at most three differ, so they spoil at most three blocks, and every
linked pair meets in at least one of the 20 groups. A group that many fingerprints share
is divided once more in the same way by the bits that are still free, which leaves at most
2**18 of them in any group, whatever the corpus holds, and again loses no pair. In a group
they stand in order of Gray rank; upper nodes hold the masked bit pattern that all below
them share, beyond what their parents hold, and a search prunes a node's whole range once
the differences accumulated on the way down exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import cut, id_text, slices, spread_join, table
from manyfold.llm.exact_dedup import keep_rows

RADIUS, SHINGLE, SEED = 3, 3, 42
BLOCKS = 6
#: Fingerprints of one group beyond which it is divided by its free bits.
LARGE = 4096
FANOUT, LEAF = 8, 8
SLICE_CHARS = 2_000_000


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half the hashes of the shingles, repeats included.

    Only A-Z are lowered; words are split at ASCII white space. Fewer words than a shingle
    make one shingle, no words make zero.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(size + 1) - 1
    starts = stops - size
    stops = stops[min(width, len(words)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        pairs = zip(starts[at : min(n, at + (1 << 16))].tolist(), stops[at : at + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], "<u8")
        counts += _bit_counts(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each bit: bits are spread to bytes of a word, and words added up to 255 at a time."""
    out = np.zeros(64, np.int64)
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & ones
        for at in range(0, len(lanes), 255 * 64):
            part = lanes[at : at + 255 * 64]
            rows = np.add.reduceat(part, np.arange(0, len(part), 255))
            out[bit::8] += rows.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) per row; the bits of fp are the fingerprint's. Null counts as empty, whose fingerprint is zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, SLICE_CHARS):
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _parts(bits: list[int], blocks: int) -> list[int]:
    """Masks of the bits dealt to so many runs."""
    edges = np.linspace(0, len(bits), blocks + 1).astype(int)
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def masks(bits: list[int], blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks such that two values which differ in ``radius`` of these bits at most agree under one of them."""
    return [reduce(int.__or__, m) for m in combinations(_parts(bits, blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _gray_rank(fp: Column) -> Column:
    """The place in Gray order of a code word: the prefix exclusive-or of its bits."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp


class GrayIndex:
    """Search within the radius among fingerprints in Gray order."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius = fps, radius
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # own mask, pattern, rows below; the root first
        span, both, either = LEAF, fps, fps
        starts = np.arange(0, len(fps), LEAF)
        found = []
        while True:
            both, either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
            found.append((~(both ^ either), both, span))
            if len(both) <= 1:
                break
            starts = np.arange(0, len(both), FANOUT)
            span *= FANOUT
        for k, (mask, pattern, span) in enumerate(found):  # bits that the parent has are factored out
            above = np.repeat(found[k + 1][0], FANOUT)[: len(mask)] if k + 1 < len(found) else np.uint64(0)
            self.levels.append((mask & ~above, pattern, span))
        self.leaf_mask = ~np.repeat(found[0][0], LEAF)[: len(fps)]
        self.levels.reverse()

    def pairs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), i < j, of rows i in [first, last) and rows j within the radius of them."""
        fps, n = self.fps, len(self.fps)
        query = np.arange(first, last)
        node, off = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint8)
        fan, below = 1, 0
        for depth, (mask, pattern, span) in enumerate(self.levels):
            if depth:
                query, off = np.repeat(query, fan), np.repeat(off, fan)
                node = (node[:, None] * fan + np.arange(fan)).ravel()
                inside = (node < len(mask)) & ((node + 1) * span > query + 1)
                query, node, off = query[inside], node[inside], off[inside]
            off = off + np.bitwise_count((fps[query] ^ pattern[node]) & mask[node])
            near = off <= self.radius
            query, node, off = query[near], node[near], off[near]
            fan, below = FANOUT, span
        j = (node[:, None] * below + np.arange(below)).ravel()
        i, off = np.repeat(query, below), np.repeat(off, below)
        inside = (j < n) & (j > i)
        i, j, off = i[inside], j[inside], off[inside]
        near = off + np.bitwise_count((fps[i] ^ fps[j]) & self.leaf_mask[j]) <= self.radius
        return i[near], j[near]


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of each pair; a set's root is its first row."""
    while len(i):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join exactly what links within the radius join. fps: in Gray order, each once."""
    parent = np.arange(len(fps))
    index, step = GrayIndex(fps), max(64, (1 << 21) // max(len(fps), 1))
    for at in range(0, len(fps), step):
        _merge(parent, *index.pairs(at, min(len(fps), at + step)))
    while not np.array_equal(parent[parent], parent):
        parent = parent[parent]
    members = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[members], fps[parent[members]]


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group key..., fp) sorted by key and Gray rank to links; a group may go on in the next batch."""

    def emit(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = forest(fps)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, key, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fps = fps.view(np.uint64)
        edges = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate([[0], edges, [len(t)]])
        if held and held_key != (t[0], key[0]):
            yield from emit(np.concatenate(held))
            held = []
        sizes = np.diff(bounds)
        last = len(sizes) - 1
        todo = np.flatnonzero(sizes > 1).tolist() if not held else [0, *(x for x in np.flatnonzero(sizes > 1).tolist() if x)]
        for g in todo:
            part = fps[bounds[g] : bounds[g + 1]]
            if g == 0 and held:
                held.append(part.copy())
                if g != last:
                    yield from emit(np.concatenate(held))
                    held = []
            elif g != last:
                yield from emit(part)
        if not (last == 0 and held):
            held, held_key = [fps[bounds[last] :].copy()], (t[-1], key[-1])
    if held:
        yield from emit(np.concatenate(held))


def links(values: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b) among different fingerprints ``fp``: a forest whose trees are what links within the radius connect."""
    whole = masks(list(range(64)))
    level = values.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in whole))).alias("t", "key"))
    large_groups = level.groupBy("t", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select("t", "key", F.lit(True).alias("_large"))
    level = level.join(large_groups, ["t", "key"], "left")
    finer = F.lit(None)
    for t, m in enumerate(whole):
        free = masks([b for b in range(64) if not m >> b & 1])
        finer = F.when(F.col("t") == t, F.array(*(F.lit(_signed(m | x)) for x in free))).otherwise(finer)
    split = level.where("_large").select("fp", "t", F.posexplode(finer).alias("_u", "_mask"))
    split = split.select((F.col("t") * 100 + F.col("_u") + 100).alias("t"), F.col("fp").bitwiseAND(F.col("_mask")).alias("key"), "fp")
    dealt = level.where("_large is null").select("t", "key", "fp").unionByName(split)
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = dealt.repartition(n, "t", "key").withColumn("_rank", _gray_rank(F.col("fp"))).sortWithinPartitions("t", "key", "_rank")
    return ranked.select("t", "key", "fp").mapInArrow(_linked, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links lead to, for every node of an edge, by alternating stars.

    Each round lets a node's larger neighbours, then its smaller ones, point to the least of
    them, until nothing changes; the edges never outgrow the ones given. Only two numbers a
    round come to the driver.
    """
    star = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    count = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = cut(star(edges))
    seen = count(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m")))
        large = cut(star(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(star(small))
        now = count(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, large: int = LARGE) -> DataFrame:
    """(doc_id, fp, component_id, kept) per row: the smallest id reachable by links of RADIUS differing bits at most, and whether the row is the one that stays.

    Equal fingerprints, those of empty texts among them, are linked like any other. Repeated
    rows and ids give a row each, and of a component's rows of the smallest id any one is kept; a null id never names a component unless nothing
    else is in it; an empty table gives no rows; other columns are ignored.
    """
    rows = cut(fingerprints(df, id_col, text_col, width).withColumn("nth", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nth"))
    values = cut(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    tree = cut(components(links(values.select("fp"), large)))
    # each side of a join is a table of its own, so that a hot key can be split when it is read
    grown = cut(values.join(tree, values["fp"] == tree["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    least = cut(grown.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("size")))
    named = cut(spread_join(grown.select("fp", "n", "root"), least, ["root"], "size", "inner").select("fp", "n", "head"))
    out = spread_join(rows, named, ["fp"], "n", "inner")
    return out.select("doc_id", "fp", F.col("head.doc_id").alias("component_id"), (F.col("nth") == F.col("head.nth")).alias("kept"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one per component: the one of the smallest id. Rows are told apart by id and fingerprint,
    so ids may repeat; columns may have any names."""
    found = cut(near_groups(df, id_col, text_col).select("doc_id", F.col("fp").alias("key"), "kept"))

    def key_of(rows: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fps = np.array([fingerprint(t or "") for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["row", "doc_id", "key"])

        texts = rows.select("row", "doc_id", F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("text"))
        return texts.mapInArrow(run, rows.withColumn("key", F.lit(0).cast("long")).schema)

    return keep_rows(df, found, key_of, id_col)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

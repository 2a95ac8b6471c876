"""Merkle trees as tables: one row per level and index, level 0 the leaves.

Leaves are hashed with a 0x00 prefix and nodes with 0x01; the last level is padded to a
power of two. Eight levels are folded within groups of 256 neighbours, never in a window over the table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.storage import settle

#: Prefixes of leaves and nodes, and the item that padding stands for.
LEAF, NODE, PAD = b"\x00", b"\x01", b"\x00BHC-PAD"
HASH_BYTES = 32
#: Levels that are folded after one shuffle.
FOLD = 8


def leaf_hash(item: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(LEAF), item), 256))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(NODE), left, right), 256))


def pad_hash() -> bytes:
    return hashlib.sha256(LEAF + PAD).digest()


def _halved(below: Column, places: Column, pad: Column) -> Column:
    """The hashes of pairs of neighbours."""
    return F.transform(places, lambda i: node_hash(F.get(below, i * 2), F.coalesce(F.get(below, i * 2 + 1), pad)))


def _numbered(hashes: Column, level: int, first: Column) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(F.lit(level).alias("level"), (first + i).cast("long").alias("idx"), h.alias("hash")))


def build(leaves: DataFrame, idx: str = "idx", item: str = "item") -> DataFrame:
    """(level, idx, hash) of the whole tree over items numbered 0 to n-1; ValueError without items.

    FOLD levels take one shuffle: the 2**FOLD nodes below a common ancestor come together and are folded in place.
    """
    level = settle(leaves.select(F.col(idx).cast("long").alias("idx"), leaf_hash(F.col(item)).alias("hash")))
    n = level.count()
    if n == 0:
        raise ValueError("nothing to commit to")
    depth = (n - 1).bit_length()
    pads, out, low = padding(depth), level.withColumn("level", F.lit(0)).select("level", "idx", "hash"), 0
    while low < depth:
        step = min(FOLD, depth - low)
        group = level.groupBy(F.shiftright("idx", step).alias("g")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("s")).select("g", F.col("s.hash").alias("h0"))
        rows = []
        for k in range(1, step + 1):
            # a pair without a right half is completed by the root of padding of that height; what lies wholly in padding is implied
            below, pad = F.col(f"h{k - 1}"), F.lit(pads[low + k - 1])
            half = F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1))
            group = group.withColumn(f"h{k}", _halved(below, half, pad))
            rows.append(_numbered(F.col(f"h{k}"), low + k, F.shiftleft(F.col("g"), step - k)))
        above = settle(group.select(F.explode(F.concat(*rows)).alias("r")).select("r.level", F.col("r.idx").cast("long").alias("idx"), "r.hash"))
        out, low = out.unionByName(above), low + step
        level = above.where(F.col("level") == low).select("idx", "hash")
    return settle(out)


def padding(levels: int) -> list[bytes]:
    """The hash of a subtree of padding, by level."""
    out = [pad_hash()]
    for _ in range(levels):
        out.append(hashlib.sha256(NODE + out[-1] + out[-1]).digest())
    return out


def depth_of(tree: DataFrame) -> int:
    return tree.agg(F.max("level")).first()[0]


def commit(tree: DataFrame) -> DataFrame:
    """(root) in hexadecimal."""
    return tree.groupBy().agg(F.max(F.struct("level", "hash")).alias("m")).select(F.lower(F.hex("m.hash")).alias("root"))


def _pads(levels: int) -> Column:
    return F.array(*(F.lit(p) for p in padding(levels)))


def _check(index: int, n: int) -> None:
    if not 0 <= index < n:
        raise IndexError(f"index {index} is outside 0 to {n - 1}")


def prove(tree: DataFrame, index: int) -> DataFrame:
    """(level, idx, hash) of the siblings from the leaf up; none for a single leaf. IndexError outside the items."""
    n = tree.where("level = 0").count()
    _check(index, n)
    depth = depth_of(tree)
    wanted = tree.sparkSession.createDataFrame([(k, (index >> k) ^ 1) for k in range(depth)], "level int, idx long")
    return wanted.join(tree, ["level", "idx"], "left").select("level", "idx", F.coalesce("hash", F.element_at(_pads(depth), F.col("level") + 1)).alias("hash"))


def proof_bytes(depth: int) -> int:
    return HASH_BYTES * depth + 4


def multiproof_bytes(helpers: int, indices: int) -> int:
    return 40 * helpers + 4 * indices


def verify_all(items: DataFrame, siblings: DataFrame, root: Column) -> DataFrame:
    """(idx, valid) for rows (idx, item) with their siblings (idx, level, hash): the path is folded up and compared with the root."""
    path = siblings.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("path"))
    both = items.join(path, "idx", "left").withColumn("path", F.coalesce("path", F.array().cast("array<struct<level:int,hash:binary>>")))
    start = F.struct(leaf_hash(F.col("item")).alias("h"), F.col("idx").alias("i"))
    step = lambda acc, p: F.struct(F.when(acc["i"] % 2 == 0, node_hash(acc["h"], p["hash"])).otherwise(node_hash(p["hash"], acc["h"])).alias("h"), F.shiftright(acc["i"], 1).alias("i"))
    return both.select("idx", (F.aggregate("path", start, step)["h"] == root).alias("valid"))


def prove_each(tree: DataFrame, indices: DataFrame) -> DataFrame:
    """(idx, level, sibling, hash): a single proof for every index, by one equi-join."""
    depth = depth_of(tree)
    wanted = indices.select(F.col("idx").cast("long").alias("leaf")).crossJoin(tree.sparkSession.range(depth).select(F.col("id").cast("int").alias("level")))  # depth rows
    wanted = wanted.withColumn("sibling", F.expr("shiftright(leaf, level) ^ 1"))
    found = wanted.join(tree.withColumnRenamed("idx", "sibling"), ["level", "sibling"], "left")
    return found.select(F.col("leaf").alias("idx"), "level", "sibling", F.coalesce("hash", F.element_at(_pads(depth), F.col("level") + 1)).alias("hash"))


def prove_many(tree: DataFrame, indices: list[int]) -> DataFrame:
    """(level, idx, hash) of the siblings that no path below supplies, each once."""
    n, depth = tree.where("level = 0").count(), depth_of(tree)
    for i in indices:
        _check(i, n)
    active, helpers = sorted(set(indices)), []
    for k in range(depth):
        here = set(active)
        helpers += [(k, i ^ 1) for i in active if i ^ 1 not in here]
        active = sorted({i >> 1 for i in active})
    wanted = tree.sparkSession.createDataFrame(helpers, "level int, idx long")
    return wanted.join(tree, ["level", "idx"], "left").select("level", "idx", F.coalesce("hash", F.element_at(_pads(max(depth, 1)), F.col("level") + 1)).alias("hash"))


def verify_many(items: DataFrame, helpers: DataFrame, root: bytes, depth: int, indices: list[int] | None = None) -> bool:
    """Whether items (idx, item) and helper hashes lead to the root; false for another set of indices than was proved."""
    level = items.select(F.col("idx").cast("long").alias("idx"), leaf_hash(F.col("item")).alias("hash"))
    if indices is not None:
        asked = items.sparkSession.createDataFrame([(i,) for i in set(indices)], "idx long")
        if any(same_indices(level, asked).first()):
            return False
    for k in range(depth):
        both = level.unionByName(helpers.where(F.col("level") == k).select("idx", "hash"))
        pairs = both.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))).alias("r"))
        level = settle(pairs.select("idx", node_hash(F.col("l"), F.col("r")).alias("hash")))
    top = level.collect() if level.count() == 1 else []
    return len(top) == 1 and top[0].hash is not None and bytes(top[0].hash) == root


def same_indices(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): how many different indices one table has and the other hasn't; both 0 for equal sets."""
    a, b = a.select("idx").distinct(), b.select("idx").distinct()
    return a.join(b, "idx", "left_anti").agg(F.count(F.lit(1)).alias("only_left")).crossJoin(b.join(a, "idx", "left_anti").agg(F.count(F.lit(1)).alias("only_right")))  # one row each


def locate_tamper(tree: DataFrame, other: DataFrame) -> DataFrame:
    """(idx) of the first leaf that differs between trees of equal depth; no row if none does."""
    a, b = tree.where("level = 0").select("idx", "hash"), other.where("level = 0").select("idx", F.col("hash").alias("h2"))
    return a.join(b, "idx").where("hash <> h2").agg(F.min("idx").alias("idx")).where("idx is not null")


def descend(tree: DataFrame, other: DataFrame) -> DataFrame:
    """(level, idx) of the nodes on the way down to the first difference: one comparison of two children a level."""
    both = tree.join(other.withColumnRenamed("hash", "h2"), ["level", "idx"]).where("hash <> h2").select("level", "idx")
    first = locate_tamper(tree, other).select(F.col("idx").alias("leaf"))
    return both.join(F.broadcast(first), F.expr("idx = shiftright(leaf, level)")).select("level", "idx")  # one row


def full_audit(leaves: DataFrame, root: str, idx: str = "idx", item: str = "item") -> bool:
    return commit(build(leaves, idx, item)).first().root == root

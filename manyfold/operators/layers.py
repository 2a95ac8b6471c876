"""Co-registered layers: what one shared quadtree costs against a tree for each layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.operators import raster as R
from manyfold.storage import settle


def _counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.count_if(F.col("type") == "INTERNAL").alias("internal"), F.count_if(F.col("type") != "INTERNAL").alias("leaves"))


def channels(px: DataFrame) -> DataFrame:
    return px.select("layer", "c").distinct().groupBy("layer").agg(F.count(F.lit(1)).alias("channels"))


def independent(px: DataFrame, levels: int, threshold: float) -> DataFrame:
    """(layer, internal, leaves, channels) of a tree for each layer."""
    return _counts(R.quadtree(px, levels, threshold, ["layer"]), ["layer"]).join(channels(px), "layer")


def measure(px: DataFrame, levels: int, threshold: float = 0.0, derived: list[int] = ()) -> DataFrame:
    """(shared_struct, shared_payload, own_struct, own_payload, ratio): a byte an internal node, one a channel of a leaf.

    Derived layers follow from another by a rule and pay nothing in the shared tree.
    """
    own = independent(px, levels, threshold).agg(F.sum("internal").alias("own_struct"), F.sum(F.col("leaves") * F.col("channels")).alias("own_payload"))
    paid = channels(px).where(~F.col("layer").isin(list(derived))) if derived else channels(px)
    shared = _counts(R.quadtree(px, levels, threshold), []).crossJoin(paid.agg(F.sum("channels").alias("paid")))  # one row each
    shared = shared.select(F.col("internal").alias("shared_struct"), (F.col("leaves") * F.col("paid")).alias("shared_payload"))
    out = shared.crossJoin(own)
    return out.withColumn("ratio", F.round((F.col("own_struct") + F.col("own_payload")) / (F.col("shared_struct") + F.col("shared_payload")), 6))


def measure_refined(px: DataFrame, levels: int, base: int = 0, derived: list[int] = (), threshold: float = 0.0) -> DataFrame:
    """(base_struct, refine_struct, payload, own_total, ratio): the base layer's tree, and small trees of the others within its leaves."""
    trees = settle(R.quadtree(px, levels, threshold, ["layer"]))
    own = _counts(trees, ["layer"]).join(channels(px), "layer")
    leaves = trees.where((F.col("layer") == base) & (F.col("type") != "INTERNAL")).select(F.col("level").alias("bl"), F.col("i").alias("bi"), F.col("j").alias("bj"))
    # a node of another layer belongs to the leaf above it, or it is that leaf's own square where the layer ended before
    others = trees.where((F.col("layer") != base) & ~F.col("layer").isin([-1, *derived]))
    up = others.withColumn("bl", F.explode(F.sequence(F.lit(0), F.col("level")))).withColumn("bi", F.expr("cast(i div shiftleft(1, level - bl) as int)")).withColumn("bj", F.expr("cast(j div shiftleft(1, level - bl) as int)"))
    below = up.join(leaves, ["bl", "bi", "bj"])
    inner = below.groupBy("layer", "bl", "bi", "bj").agg(F.count_if(F.col("type") == "INTERNAL").alias("internal"), F.count_if(F.col("type") != "INTERNAL").alias("leaves"))
    kinds = channels(px).where((F.col("layer") != base) & ~F.col("layer").isin([-1, *derived]))
    every = leaves.crossJoin(F.broadcast(kinds)).join(inner, ["layer", "bl", "bi", "bj"], "left")  # layers are few
    refine = every.agg(F.coalesce(F.sum("internal"), F.lit(0)).alias("refine_struct"), F.coalesce(F.sum(F.coalesce("leaves", F.lit(1)) * F.col("channels")), F.lit(0)).alias("refine_payload"))
    first = own.where(F.col("layer") == base).select(F.col("internal").alias("base_struct"), (F.col("leaves") * F.col("channels")).alias("base_payload"))
    total = own.agg(F.sum(F.col("internal") + F.col("leaves") * F.col("channels")).alias("own_total"))
    out = first.crossJoin(refine).crossJoin(total)
    paid = F.col("base_struct") + F.col("refine_struct") + F.col("base_payload") + F.col("refine_payload")
    return out.select("base_struct", "refine_struct", (F.col("base_payload") + F.col("refine_payload")).alias("payload"), "own_total", F.round(F.col("own_total") / paid, 6).alias("ratio"))


def _blocks(placed: DataFrame, threshold: float) -> DataFrame:
    """(layer, c, level, i, j, v): what each leaf's pixels become, its first without loss, else its rounded mean."""
    block = placed.groupBy("layer", "c", "level", "i", "j").agg(F.min(F.struct("y", "x", "v")).alias("m"), F.rint(F.avg("v")).cast("int").alias("mean"))
    return block.select("layer", "c", "level", "i", "j", (F.col("m.v") if threshold == 0 else F.col("mean")).cast("int").alias("v"))


def coded(px: DataFrame, levels: int, threshold: float = 0.0) -> DataFrame:
    """(layer, c, level, i, j, v) of the leaves of the shared tree: all that drawing needs."""
    nodes = R.quadtree(px, levels, threshold).where("type <> 'INTERNAL'").select("level", "i", "j")
    return _blocks(px.join(R._up(px, levels, []).join(nodes, ["level", "i", "j"]), ["y", "x"]), threshold)


def coded_refined(px: DataFrame, levels: int, base: int = 0, derived: list[int] = (), threshold: float = 0.0) -> DataFrame:
    """The same of the base's leaves and of the others' refinements in them, without the derived layers."""
    trees = settle(R.quadtree(px, levels, threshold, ["layer"]))
    ends = trees.where("type <> 'INTERNAL'")
    # within a leaf of the base a layer may not be coarser than the leaf
    leaves = ends.where(F.col("layer") == base).select("level", "i", "j")
    cells = px.where(~F.col("layer").isin([-1, *derived]))
    up = R._up(px, levels, [])
    own = up.join(ends.select("layer", "level", "i", "j"), ["level", "i", "j"]).select("layer", "y", "x", F.col("level").alias("own"))
    shared = up.join(leaves, ["level", "i", "j"]).select("y", "x", F.col("level").alias("shared"))
    placed = cells.join(own, ["layer", "y", "x"]).join(shared, ["y", "x"]).withColumn("level", F.greatest("own", "shared"))
    placed = placed.withColumn("i", F.expr(f"cast(y div shiftleft(1, {levels} - level) as int)")).withColumn("j", F.expr(f"cast(x div shiftleft(1, {levels} - level) as int)"))
    return _blocks(placed, threshold)


def drawn(leaves: DataFrame, levels: int, base: int = 0, rules: dict[int, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(layer, y, x, c, v) from coded leaves alone; ``rules`` derive a layer (y, x, c, v) from the drawn base."""
    out = R.cells_of(leaves, levels).select("layer", "y", "x", "c", "v")
    for layer, rule in (rules or {}).items():
        out = out.unionByName(rule(out.where(F.col("layer") == base).drop("layer")).select(F.lit(layer).alias("layer"), "y", "x", "c", "v"))
    return out


def reconstruct(px: DataFrame, levels: int, threshold: float = 0.0) -> DataFrame:
    """(layer, y, x, c, v): every layer through the shared tree and back."""
    return drawn(coded(px, levels, threshold), levels)


def reconstruct_refined(px: DataFrame, levels: int, base: int = 0, rules: dict[int, Callable[[DataFrame], DataFrame]] | None = None, threshold: float = 0.0) -> DataFrame:
    """The same through the base's leaves and the others' own refinements."""
    return drawn(coded_refined(px, levels, base, list(rules or ()), threshold), levels, base, rules)


def temporal_cost(diffs: DataFrame, levels: int, threshold: float, keys: list[str] = ("frame",)) -> DataFrame:
    """(keys, struct, payload) of frames given as differences ``d``: still squares end the tree and pay nothing."""
    keys = list(keys)
    still = R.pyramid(diffs.withColumn("v", F.abs("d")).drop("d"), levels, [*keys, "layer"])
    flags = still.groupBy(*keys, "level", "i", "j").agg(F.bool_and(F.col("high") <= threshold).alias("flat"))
    ends = flags.where(F.col("flat") | (F.col("level") == levels)).select(*keys, "level", "i", "j", F.when(F.col("flat"), "STILL").otherwise("LEAF").alias("type"))
    nodes = R.tree(ends, levels, keys)
    paid = diffs.select(*keys, "layer", "c").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("channels"))
    counts = nodes.groupBy(*keys).agg(F.count_if(F.col("type") == "INTERNAL").alias("struct"), F.count_if(F.col("type") == "LEAF").alias("moving"))
    return counts.join(paid, keys).select(*keys, "struct", (F.col("moving") * F.col("channels")).alias("payload"))


def union_cost(px: DataFrame, levels: int, threshold: float, keys: list[str] = ("frame",)) -> DataFrame:
    """(keys, struct, payload) of one tree over all layers of a frame."""
    keys = list(keys)
    flat = R.homogeneous(R.pyramid(px, levels, [*keys, "layer"]), threshold, keys)
    counts = _counts(R.tree(R.leaf_ends(flat, levels, keys), levels, keys), keys)
    paid = px.select(*keys, "layer", "c").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("channels"))
    return counts.join(paid, keys).select(*keys, F.col("internal").alias("struct"), (F.col("leaves") * F.col("channels")).alias("payload"))

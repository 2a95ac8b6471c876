"""Pictures as pixel tables, and quadtrees over them as node tables.

Pixels: (y, x, c, v), with further columns naming the picture, layer or frame; y and x below
2**levels. A node is (level, i, j): the square of side 2**(levels - level) at (i, j). A node
ends the tree where it is the topmost on its pixels' way down that some interpretation explains, so
types come from one minimum per pixel instead of a walk from the root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.storage import settle

#: Sides of blocks that cosines may stand for, coefficients a side, bytes of payloads.
DCT_SIDES, DCT_N = (8, 16, 32), 4
LEAF_BYTES, MEAN_BYTES, RAMP_BYTES, DCT_BYTES = 3, 3, 12, 96


def levels_of(height: int, width: int) -> int:
    """Levels of the smallest square of a power of two that holds a picture."""
    if height < 1 or width < 1:
        raise ValueError("an empty picture has no tree")
    return (max(height, width) - 1).bit_length()


def padded(px: DataFrame, height: int, width: int, keys: list[str] = ()) -> DataFrame:
    """Pixels of the whole square, with ``inside``: padding is 0 and lies outside."""
    side = 1 << levels_of(height, width)
    spark = px.sparkSession
    grid = spark.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"))
    kinds = px.select(*keys, "c").distinct()
    every = grid.crossJoin(F.broadcast(kinds))  # one row a channel of a picture
    out = every.join(px, [*keys, "y", "x", "c"], "left")
    return out.select(*keys, "y", "x", "c", F.coalesce("v", F.lit(0)).alias("v"), ((F.col("y") < height) & (F.col("x") < width)).alias("inside"))


def pyramid(px: DataFrame, levels: int, keys: list[str] = ()) -> DataFrame:
    """(level, i, j, c, low, high, mean, n, covered) of every node: each level is reduced from the one below."""
    inside = F.col("inside") if "inside" in px.columns else F.lit(True)
    level = px.select(*keys, F.col("y").alias("i"), F.col("x").alias("j"), "c", F.col("v").alias("low"), F.col("v").alias("high"), F.col("v").cast("double").alias("total"), F.lit(1).cast("long").alias("n"), inside.cast("long").alias("covered"))
    found = []
    for k in range(levels, -1, -1):
        found.append(level.withColumn("level", F.lit(k)))
        if k:
            half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
            level = level.groupBy(*keys, half("i"), half("j"), "c").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("covered").alias("covered"))
            if k % 4 == 0:
                level = settle(level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*keys, "level", "i", "j", "c", "low", "high", (F.col("total") / F.col("n")).alias("mean"), "n", "covered")


def homogeneous(nodes: DataFrame, threshold: float, keys: list[str] = ()) -> DataFrame:
    """(level, i, j, flat, covered, n): flat if no channel spreads over more than ``threshold``; without keys, over all layers together."""
    return nodes.groupBy(*keys, "level", "i", "j").agg(F.bool_and(F.col("high") - F.col("low") <= threshold).alias("flat"), F.max("covered").alias("covered"), F.max("n").alias("n"))


def _up(px: DataFrame, levels: int, keys: list[str]) -> DataFrame:
    """(y, x, level, i, j): the nodes above each pixel."""
    at = px.select(*keys, "y", "x").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    shift = lambda c: F.expr(f"cast({c} div shiftleft(1, {levels} - level) as int)")
    return at.withColumn("i", shift("y")).withColumn("j", shift("x"))


def tree(ends: DataFrame, levels: int, keys: list[str] = ()) -> DataFrame:
    """(level, i, j, type) of a tree from (level, i, j, type) of nodes that could end it; nodes of the last level always can.

    The topmost end above a pixel is a node of the tree, and all above that are INTERNAL.
    """
    keys = list(keys)
    # (level, i, j) ends the tree unless a node above it does: one row per end and ancestor
    above = ends.select(*keys, "level", "i", "j", "type", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("a"))
    above = above.withColumn("ai", F.expr("cast(i div shiftleft(1, level - a) as int)")).withColumn("aj", F.expr("cast(j div shiftleft(1, level - a) as int)"))
    tops = ends.select(*keys, F.col("level").alias("a"), F.col("i").alias("ai"), F.col("j").alias("aj"))
    first = above.join(tops, [*keys, "a", "ai", "aj"]).groupBy(*keys, "level", "i", "j", "type").agg(F.min("a").alias("top"))
    kept = settle(first.where(F.col("top") == F.col("level")).drop("top"))
    inner = kept.where("level > 0").select(*keys, "level", "i", "j", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("a"))
    inner = inner.select(*keys, F.col("a").alias("level"), F.expr("cast(i div shiftleft(1, level - a) as int)").alias("i"), F.expr("cast(j div shiftleft(1, level - a) as int)").alias("j")).distinct()
    return kept.unionByName(inner.withColumn("type", F.lit("INTERNAL")))


def leaf_ends(flat: DataFrame, levels: int, keys: list[str] = ()) -> DataFrame:
    """Nodes that are flat, wholly outside, or single pixels."""
    kind = F.when(F.col("covered") == 0, "EMPTY").otherwise("LEAF")
    return flat.where(F.col("flat") | (F.col("covered") == 0) | (F.col("level") == levels)).select(*keys, "level", "i", "j", kind.alias("type"))


def quadtree(px: DataFrame, levels: int, threshold: float = 0.0, keys: list[str] = ()) -> DataFrame:
    """(level, i, j, type) with LEAF, EMPTY and INTERNAL. Without keys, layers share one tree: a node is a leaf if it is one in all of them."""
    keys = list(keys)
    apart = keys if keys or "layer" not in px.columns else ["layer"]
    return tree(leaf_ends(homogeneous(pyramid(px, levels, apart), threshold, keys), levels, keys), levels, keys)


# ---- interpretations


def ramp_error(px: DataFrame, nodes: DataFrame, levels: int, keys: list[str] = ()) -> DataFrame:
    """(level, i, j, error): how far the bilinear surface between a node's corners is from its pixels at most."""
    keys = list(keys)
    side = F.expr(f"shiftleft(1, {levels} - level)")
    wanted = nodes.where(F.col("level") < levels).select(*keys, "level", "i", "j", side.alias("s"))
    corner = lambda name, dy, dx: px.select(*keys, F.col("y").alias(f"{name}y"), F.col("x").alias(f"{name}x"), "c", F.col("v").alias(name))
    out = wanted
    first = True
    for name, dy, dx in (("tl", 0, 0), ("tr", 0, 1), ("bl", 1, 0), ("br", 1, 1)):
        out = out.withColumn(f"{name}y", (F.col("i") * F.col("s") + dy * (F.col("s") - 1)).cast("int")).withColumn(f"{name}x", (F.col("j") * F.col("s") + dx * (F.col("s") - 1)).cast("int"))
        out = out.join(corner(name, dy, dx), [*keys, f"{name}y", f"{name}x"] + ([] if first else ["c"]))
        first = False
    up = _up(px, levels, keys)
    cells = px.join(up, [*keys, "y", "x"]).select(*keys, "y", "x", "c", "v", "level", "i", "j")
    both = cells.join(out.select(*keys, "level", "i", "j", "s", "c", "tl", "tr", "bl", "br"), [*keys, "level", "i", "j", "c"])
    error = F.abs(ramp_value("tl", "tr", "bl", "br", F.col("y") - F.col("i") * F.col("s"), F.col("x") - F.col("j") * F.col("s"), F.col("s")) - F.col("v"))
    return both.groupBy(*keys, "level", "i", "j").agg(F.max(error).alias("error"))


def ramp_value(tl: str, tr: str, bl: str, br: str, dy: Column, dx: Column, s: Column) -> Column:
    """Rounded half to even, as whole numbers allow it: the weights are taken over (s - 1) squared at once."""
    n = s - 1
    total = F.col(tl) * (n - dy) * (n - dx) + F.col(tr) * (n - dy) * dx + F.col(bl) * dy * (n - dx) + F.col(br) * dy * dx
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(total / (n * n)).cast("int")))


def dct_basis(spark, side: int, n: int = DCT_N) -> DataFrame:
    """(u, p, b): the first n cosines over ``side`` points."""
    rows = [(u, p, math.cos(math.pi * (2 * p + 1) * u / (2 * side)) * math.sqrt((1 if u == 0 else 2) / side)) for u in range(n) for p in range(side)]
    return spark.createDataFrame(rows, "u int, p int, b double")


def dct_coefficients(blocks: DataFrame, side: int, keys: list[str], n: int = DCT_N) -> DataFrame:
    """(keys, u, w, coef) of square blocks (keys, dy, dx, v): two joins with the basis, which has n * side rows."""
    if side < n:
        raise ValueError(f"blocks must be {n} pixels wide at least, not {side}")
    basis = F.broadcast(dct_basis(blocks.sparkSession, side, n))
    rows = blocks.join(basis.select(F.col("u"), F.col("p").alias("dy"), F.col("b").alias("bu")), "dy").groupBy(*keys, "u", "dx").agg(F.sum((F.col("v") - 128.0) * F.col("bu")).alias("h"))
    out = rows.join(basis.select(F.col("u").alias("w"), F.col("p").alias("dx"), F.col("b").alias("bw")), "dx").groupBy(*keys, "u", "w").agg(F.sum(F.col("h") * F.col("bw")).alias("coef"))
    return out.withColumn("coef", F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(F.round("coef", 9)))).cast("int"))


def dct_pixels(coefs: DataFrame, side: int, keys: list[str], n: int = DCT_N) -> DataFrame:
    """(keys, dy, dx, v) from coefficients."""
    basis = F.broadcast(dct_basis(coefs.sparkSession, side, n))
    rows = coefs.join(basis.select("u", F.col("p").alias("dy"), F.col("b").alias("bu")), "u").groupBy(*keys, "w", "dy").agg(F.sum(F.col("coef") * F.col("bu")).alias("h"))
    out = rows.join(basis.select(F.col("u").alias("w"), F.col("p").alias("dx"), F.col("b").alias("bw")), "w").groupBy(*keys, "dy", "dx").agg(F.sum(F.col("h") * F.col("bw")).alias("r"))
    return out.select(*keys, "dy", "dx", F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.round(F.col("r") + 128, 9)).cast("int"))).alias("v"))


def block_error(cells: DataFrame, side: int, keys: list[str], channels: list[str] = (), criterion: str = "max") -> DataFrame:
    """(keys, error) of square blocks (keys, channels, dy, dx, v) against what their cosines give back: the largest error, or the root of the mean squared one ("rms")."""
    if criterion not in ("max", "rms"):
        raise ValueError(f"criterion must be max or rms, not {criterion!r}")
    every = [*keys, *channels]
    back = dct_pixels(dct_coefficients(cells, side, every), side, every).withColumnRenamed("v", "r")
    off = (F.col("v") - F.col("r")).cast("double")
    error = F.max(F.abs(off)) if criterion == "max" else F.sqrt(F.avg(off * off))
    return cells.join(back, [*every, "dy", "dx"]).groupBy(*keys).agg(error.alias("error"))


def _squares(px: DataFrame, side: int) -> DataFrame:
    """Pixels by square block: (i, j, c, dy, dx, v)."""
    return px.select(F.floor(F.col("y") / side).cast("int").alias("i"), F.floor(F.col("x") / side).cast("int").alias("j"), "c", (F.col("y") % side).alias("dy"), (F.col("x") % side).alias("dx"), "v")


def _dct_levels(levels: int) -> list[tuple[int, int]]:
    """(side, level) of the nodes that cosines may stand for."""
    return [(side, levels - side.bit_length() + 1) for side in DCT_SIDES if levels - side.bit_length() + 1 >= 0]


def dct_error(px: DataFrame, nodes: DataFrame, levels: int, criterion: str = "max") -> DataFrame:
    """(level, i, j, error) of nodes 8 to 32 pixels wide, over all channels."""
    found = nodes.select("level", "i", "j").limit(0).withColumn("error", F.lit(0.0))
    if criterion not in ("max", "rms"):
        raise ValueError(f"criterion must be max or rms, not {criterion!r}")
    for side, k in _dct_levels(levels):
        cells = _squares(px, side).join(nodes.where(F.col("level") == k).select("i", "j"), ["i", "j"], "left_semi")
        found = found.unionByName(block_error(cells, side, ["i", "j"], ["c"], criterion).withColumn("level", F.lit(k)))
    return found


def payload_bytes(means: bool = True) -> Column:
    """Bytes of a node's data by its type."""
    kind = F.col("type")
    return F.when(kind == "LEAF", LEAF_BYTES).when(kind == "RAMP", RAMP_BYTES).when(kind == "DCT", DCT_BYTES).when((kind == "INTERNAL") & F.lit(means), MEAN_BYTES).otherwise(0)


def encode(px: DataFrame, levels: int, lossy: bool = False, threshold: float = 0.0, means: bool = True, criterion: str = "max") -> DataFrame:
    """(level, i, j, type) under LEAF, RAMP and, if lossy, DCT where it is cheaper than the subtree it replaces.

    Without loss a node must be reproduced exactly. Cosines are kept only if the whole tree gets smaller
    even with a byte per type instead of two bits.
    """
    limit = float(threshold) if lossy else 0.0
    flat = settle(homogeneous(pyramid(px, levels), limit))
    ends = leaf_ends(flat, levels)
    rough = flat.where(~F.col("flat") & (F.col("covered") > 0) & (F.col("level") < levels))
    ramps = ramp_error(px, rough, levels).where(F.col("error") <= limit).select("level", "i", "j", F.lit("RAMP").alias("type"))
    plain = settle(tree(ends.unionByName(ramps), levels))
    if not lossy:
        return plain
    fits = dct_error(px, plain.where("type = 'INTERNAL'"), levels, criterion).where(F.col("error") <= limit).select("level", "i", "j", F.lit(True).alias("fits"))
    cost, chosen = None, []
    for k in range(levels, -1, -1):
        here = plain.where(F.col("level") == k).withColumn("own", payload_bytes(means))
        if cost is not None:
            below = cost.groupBy(F.floor(F.col("i") / 2).cast("int").alias("i"), F.floor(F.col("j") / 2).cast("int").alias("j")).agg(F.sum("cost").alias("below"))
            here = here.join(below, ["i", "j"], "left").withColumn("own", F.col("own") + F.when(F.col("type") == "INTERNAL", 1 + F.coalesce("below", F.lit(0))).otherwise(0))
        here = here.join(fits, ["level", "i", "j"], "left")
        swap = F.coalesce("fits", F.lit(False)) & (F.col("own") > DCT_BYTES)
        here = settle(here.select("level", "i", "j", swap.alias("swap"), F.when(swap, DCT_BYTES).otherwise(F.col("own")).alias("cost")))
        chosen.append(here.where("swap").select("level", "i", "j", F.lit("DCT").alias("type")))
        cost = here
    swaps = chosen[0]
    for more in chosen[1:]:
        swaps = swaps.unionByName(more)
    swaps = settle(swaps)
    if swaps.isEmpty():
        return plain
    kept = plain.where("type <> 'INTERNAL'").join(swaps.select("level", "i", "j"), ["level", "i", "j"], "left_anti").unionByName(swaps)
    wide = settle(tree(kept, levels))
    return wide if total_bytes(wide, 4, means) < total_bytes(plain, 1, means) else plain


def total_bytes(nodes: DataFrame, per_parent: int, means: bool = True) -> int:
    """Structure, so many bytes an internal node, and payload."""
    row = nodes.agg(F.count_if(F.col("type") == "INTERNAL").alias("n"), F.coalesce(F.sum(payload_bytes(means)), F.lit(0)).alias("data")).first()
    return row.n * per_parent + row.data


# ---- readings


def roi(px: DataFrame, y: int, x: int, h: int, w: int, height: int, width: int) -> DataFrame:
    """Pixels of a rectangle; ValueError if it isn't wholly in the picture."""
    if y < 0 or x < 0 or h < 1 or w < 1 or y + h > height or x + w > width:
        raise ValueError(f"{h} x {w} at ({y}, {x}) isn't within {height} x {width}")
    return px.where(F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1))


def nodes_in(nodes: DataFrame, levels: int, y: int, x: int, h: int, w: int) -> DataFrame:
    """Nodes whose square meets a rectangle."""
    s = F.expr(f"shiftleft(1, {levels} - level)")
    ny, nx = F.col("i") * s, F.col("j") * s
    return nodes.where((nx < x + w) & (nx + s > x) & (ny < y + h) & (ny + s > y))


def colors(nodes: DataFrame, stats: DataFrame, lossy: bool = False) -> DataFrame:
    """(level, i, j, type, c, color): a leaf's minimum, or its rounded mean if lossy; the mean of internal nodes."""
    mean = F.rint("mean").cast("int")
    both = nodes.join(stats, ["level", "i", "j"])
    return both.select("level", "i", "j", "type", "c", F.when(F.col("type") == "INTERNAL", mean).when(F.col("type") == "EMPTY", F.lit(0)).otherwise(mean if lossy else F.col("low").cast("int")).alias("color"))


CODED = "level int, i int, j int, type string, c int, color int, corners struct<tl:int,tr:int,bl:int,br:int>, coefs array<struct<u:int,w:int,coef:int>>"


def coded(nodes: DataFrame, px: DataFrame, levels: int, stats: DataFrame | None = None, lossy: bool = False) -> DataFrame:
    """Nodes with all that decoding needs, a row a channel: (level, i, j, type, c, color, corners, coefs).

    color: see colors(); corners of ramps, coefs of cosines, null elsewhere. From here on the picture itself isn't needed.
    """
    base = colors(nodes, pyramid(px, levels) if stats is None else stats, lossy)
    ramps = nodes.where("type = 'RAMP'").select("level", "i", "j", F.expr(f"shiftleft(1, {levels} - level)").alias("s"))
    for name, dy, dx in (("tl", 0, 0), ("tr", 0, 1), ("bl", 1, 0), ("br", 1, 1)):
        at = px.select(F.col("y").alias("cy"), F.col("x").alias("cx"), "c", F.col("v").cast("int").alias(name))
        ramps = ramps.withColumn("cy", (F.col("i") * F.col("s") + dy * (F.col("s") - 1)).cast("int")).withColumn("cx", (F.col("j") * F.col("s") + dx * (F.col("s") - 1)).cast("int"))
        ramps = ramps.join(at, ["cy", "cx"] + (["c"] if name != "tl" else [])).drop("cy", "cx")
    out = base.join(ramps.select("level", "i", "j", "c", F.struct("tl", "tr", "bl", "br").alias("corners")), ["level", "i", "j", "c"], "left")
    coefs = None
    for side, k in _dct_levels(levels):
        cells = _squares(px, side).join(nodes.where((F.col("type") == "DCT") & (F.col("level") == k)).select("i", "j"), ["i", "j"], "left_semi")
        own = dct_coefficients(cells, side, ["i", "j", "c"]).groupBy("i", "j", "c").agg(F.array_sort(F.collect_list(F.struct("u", "w", "coef"))).alias("coefs")).withColumn("level", F.lit(k))
        coefs = own if coefs is None else coefs.unionByName(own)
    out = out.withColumn("coefs", F.lit(None)) if coefs is None else out.join(coefs, ["level", "i", "j", "c"], "left")
    kinds = dict(x.split(" ", 1) for x in CODED.split(", "))
    return out.select(*(F.col(n).cast(kinds[n]).alias(n) for n in kinds))


def cells_of(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` a row for each of their pixels: y and x in the picture, dy and dx in the node, and its side s."""
    wide = nodes.withColumn("s", F.expr(f"shiftleft(1, {levels} - level)"))
    every = wide.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("s") * F.col("s") - 1)))
    every = every.withColumn("dy", F.expr("_at div s").cast("int")).withColumn("dx", (F.col("_at") % F.col("s")).cast("int")).drop("_at")
    return every.withColumn("y", F.col("i") * F.col("s") + F.col("dy")).withColumn("x", F.col("j") * F.col("s") + F.col("dx"))


def decode(tree: DataFrame, levels: int) -> DataFrame:
    """(y, x, c, v) of the whole square from coded nodes alone; INTERNAL ones give nothing."""
    flat = cells_of(tree.where("type in ('LEAF', 'EMPTY')"), levels).select("y", "x", "c", F.col("color").alias("v"))
    ramps = cells_of(tree.where("type = 'RAMP'"), levels)
    out = flat.unionByName(ramps.select("y", "x", "c", ramp_value("corners.tl", "corners.tr", "corners.bl", "corners.br", F.col("dy"), F.col("dx"), F.col("s")).alias("v")))
    for side, k in _dct_levels(levels):
        own = tree.where((F.col("type") == "DCT") & (F.col("level") == k)).select("i", "j", "c", F.explode("coefs").alias("r")).select("i", "j", "c", "r.*")
        back = dct_pixels(own, side, ["i", "j", "c"])
        out = out.unionByName(back.select((F.col("i") * side + F.col("dy")).alias("y"), (F.col("j") * side + F.col("dx")).alias("x"), "c", "v"))
    return out


def preview(tree: DataFrame, levels: int, cut: int) -> DataFrame:
    """(y, x, c, v) from coded nodes down to level ``cut``: what ends there as it decodes, and the means of nodes that are still open."""
    ends = decode(tree.where(F.col("level") <= cut), levels)
    open_ = cells_of(tree.where((F.col("level") == cut) & (F.col("type") == "INTERNAL")), levels)
    return ends.unionByName(open_.select("y", "x", "c", F.col("color").alias("v")))


def structure_map(nodes: DataFrame, px: DataFrame, levels: int, deepest: int | None = None) -> DataFrame:
    """(i, j, depth) on the grid of level ``deepest``: the last INTERNAL level above each cell, as a share of 255."""
    k = levels if deepest is None else min(deepest, levels)
    cells = px.select(F.expr(f"cast(y div {1 << (levels - k)} as int)").alias("ci"), F.expr(f"cast(x div {1 << (levels - k)} as int)").alias("cj")).distinct()
    above = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("i", F.expr(f"cast(ci div shiftleft(1, {k} - level) as int)")).withColumn("j", F.expr(f"cast(cj div shiftleft(1, {k} - level) as int)"))
    inner = nodes.where("type = 'INTERNAL' and level > 0").select("level", "i", "j", F.lit(1).alias("open"))
    depth = above.join(inner, ["level", "i", "j"], "left").groupBy("ci", "cj").agg(F.coalesce(F.max(F.when(F.col("open") == 1, F.col("level"))), F.lit(0)).alias("d"))
    return depth.select(F.col("ci").alias("i"), F.col("cj").alias("j"), F.floor(F.col("d") * 255.0 / max(k, 1)).cast("int").alias("depth"))


def psnr(a: DataFrame, b: DataFrame, on: list[str] = ("y", "x", "c")) -> DataFrame:
    """(psnr) in decibels, infinite for equal pictures; ValueError if they don't have the same pixels."""
    both = a.join(b.withColumnRenamed("v", "w"), list(on), "full")
    row = both.agg(F.count_if(F.col("v").isNull() | F.col("w").isNull()).alias("alone"), F.avg(F.pow((F.col("v") - F.col("w")).cast("double"), F.lit(2.0))).alias("mse")).first()
    if row.alone:
        raise ValueError(f"{row.alone} pixels are in one of the pictures only")
    value = float("inf") if not row.mse else 10 * math.log10(255**2 / row.mse)
    return a.sparkSession.createDataFrame([(value,)], "psnr double")


def delta(px: DataFrame, frame: str = "frame", keys: list[str] = ("layer", "y", "x", "c")) -> DataFrame:
    """Each pixel less the one a frame before; the first frame has none."""
    from pyspark.sql import Window

    before = F.lag("v").over(Window.partitionBy(*keys).orderBy(frame))
    return px.withColumn("d", F.col("v") - before).where("d is not null")


def luminance(px: DataFrame) -> DataFrame:
    """One channel from three, rounded half to even."""
    parts = px.groupBy("y", "x").agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).alias(n) for c, n in enumerate("rgb")))
    return parts.select("y", "x", F.lit(0).alias("c"), F.rint(F.round(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114, 9)).cast("int").alias("v"))

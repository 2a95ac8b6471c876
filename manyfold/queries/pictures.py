"""Procedural pictures of 64 x 64 and embeddings read as 8 x 8 tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyfold.operators import layers as L
from manyfold.operators import raster as R
from manyfold.queries.registry import query, table
from manyfold.sources import generate as G
from manyfold.sources import trees as T
from manyfold.storage import scratch

N, SIDE = 6, 64

KINDS = {
    "flat": "90",
    "gradient": f"floor(255.0 * (x + y) / {2 * SIDE - 2})",
    "shapes": "CASE WHEN x >= 16 AND x < 32 AND y >= 16 AND y < 32 THEN 200 WHEN (x - 48) * (x - 48) + (y - 32) * (y - 32) < 4096 / 36.0 THEN 140 ELSE 30 END",
    "noise": G.SCATTER_SQL.format(x=f"(y * {SIDE} + x)", seed=3) + " % 256",
    "checker": "CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 220 ELSE 20 END",
    "rings": f"floor(127 + 120 * sin(sqrt((x - {SIDE // 2}) * (x - {SIDE // 2}) + (y - {SIDE // 2}) * (y - {SIDE // 2})) / 3.0::DOUBLE))",
}


def one(spark, kind, c=0):
    return G.image(spark, kind, SIDE, SIDE).withColumn("c", F.lit(c))


def px_sql(kind):
    return f"p AS MATERIALIZED (SELECT (range // {SIDE})::INT AS y, (range % {SIDE})::INT AS x, 0 AS c FROM range({SIDE * SIDE})), px AS MATERIALIZED (SELECT y, x, c, ({KINDS[kind]})::INT AS v FROM p)"


LEV = f"lev AS (SELECT range::INT AS level FROM range({N + 1}))"
UP = f"up AS MATERIALIZED (SELECT y, x, c, v, level, (y // (1 << ({N} - level)))::INT AS i, (x // (1 << ({N} - level)))::INT AS j FROM px CROSS JOIN lev)"
PYR = "pyr AS MATERIALIZED (SELECT level, i, j, c, min(v) AS low, max(v) AS high, avg(v) AS mean, count(*) AS n FROM up GROUP BY ALL)"


def ends_sql(t, ramps=False):
    """Square ends of a tree: spread of t at most, single pixels, and ramps that miss by t at most."""
    flat = f"fl AS MATERIALIZED (SELECT level, i, j, bool_and(high - low <= {t}) AS flat FROM pyr GROUP BY ALL)"
    corner = lambda n, dy, dx: f"JOIN px {n} ON {n}.y = u.i * (1 << ({N} - u.level)) + {dy} * ((1 << ({N} - u.level)) - 1) AND {n}.x = u.j * (1 << ({N} - u.level)) + {dx} * ((1 << ({N} - u.level)) - 1) AND {n}.c = u.c"
    s = f"((1 << ({N} - u.level)) - 1)"
    dy, dx = f"(u.y - u.i * (1 << ({N} - u.level)))", f"(u.x - u.j * (1 << ({N} - u.level)))"
    value = f"greatest(0, least(255, round_even((tl.v * ({s} - {dy}) * ({s} - {dx}) + tr.v * ({s} - {dy}) * {dx} + bl.v * {dy} * ({s} - {dx}) + br.v * {dy} * {dx})::DOUBLE / ({s} * {s}), 0)))"
    ramp = f", ra AS MATERIALIZED (SELECT u.level, u.i, u.j, max(abs({value} - u.v)) AS error FROM up u JOIN fl ON fl.level = u.level AND fl.i = u.i AND fl.j = u.j AND NOT fl.flat {corner('tl', 0, 0)} {corner('tr', 0, 1)} {corner('bl', 1, 0)} {corner('br', 1, 1)} WHERE u.level < {N} GROUP BY ALL)" if ramps else ""
    more = f" UNION ALL SELECT level, i, j, 'RAMP' FROM ra WHERE error <= {t}" if ramps else ""
    return f"{flat}{ramp}, en AS MATERIALIZED (SELECT level, i, j, 'LEAF' AS type FROM fl WHERE flat OR level = {N}{more})"


#: The topmost end above each pixel, and what is above those.
TREE = f"""top AS (SELECT u.y, u.x, min(e.level) AS level FROM (SELECT DISTINCT y, x, level, i, j FROM up) u JOIN en e ON e.level = u.level AND e.i = u.i AND e.j = u.j GROUP BY u.y, u.x),
kept AS MATERIALIZED (SELECT DISTINCT e.* FROM top t JOIN en e ON e.level = t.level AND e.i = t.y // (1 << ({N} - t.level)) AND e.j = t.x // (1 << ({N} - t.level))),
tree AS MATERIALIZED (SELECT * FROM kept UNION ALL SELECT DISTINCT a.level, (k.i // (1 << (k.level - a.level)))::INT, (k.j // (1 << (k.level - a.level)))::INT, 'INTERNAL' FROM kept k JOIN lev a ON a.level < k.level)"""


def head(kind, t=0, ramps=False):
    return "WITH " + ", ".join((px_sql(kind), LEV, UP, PYR, ends_sql(t, ramps), TREE)) + " "


@query("S15_images", " UNION ALL ".join(f"SELECT '{k}' AS kind, y, x, ({v})::INT AS v FROM (SELECT (range // {SIDE})::INT AS y, (range % {SIDE})::INT AS x FROM range({SIDE * SIDE}))" for k, v in KINDS.items()))
def _(spark, sf):
    out = None
    for kind in KINDS:
        px = G.image(spark, kind, SIDE, SIDE).select(F.lit(kind).alias("kind"), "y", "x", "v")
        out = px if out is None else out.unionByName(px)
    return out


BOXES = [(4, 4, 20, 40, 180), (10, 30, 30, 20, 90), (40, 8, 8, 50, 230), (12, 12, 6, 6, 10)]


@query("S16_screen", "WITH b(nth, top, lft, bh, bw, bv) AS (VALUES " + ", ".join(str((i, *b)) for i, b in enumerate(BOXES)) + f"), p AS (SELECT (range // {SIDE})::INT AS y, (range % {SIDE})::INT AS x FROM range({SIDE * SIDE})) SELECT y, x, coalesce(arg_max(bv, nth), 0) AS v FROM p LEFT JOIN b ON y >= top AND y < top + bh AND x >= lft AND x < lft + bw GROUP BY y, x")
def _(spark, sf):
    return G.rectangles(spark, SIDE, SIDE, BOXES)


@query("A23_pyramid", "WITH " + ", ".join((px_sql("shapes"), LEV, UP, PYR)) + " SELECT level, i, j, low, high, round(mean, 6) AS mean FROM pyr")
def _(spark, sf):
    return R.pyramid(one(spark, "shapes"), N).select("level", "i", "j", "low", "high", F.round("mean", 6).alias("mean"))


@query("F20_homogeneous", "WITH " + ", ".join((px_sql("shapes"), LEV, UP, PYR)) + " SELECT level, i, j, bool_and(high - low <= 60) AS flat FROM pyr GROUP BY ALL")
def _(spark, sf):
    return R.homogeneous(R.pyramid(one(spark, "shapes"), N), 60).select("level", "i", "j", "flat")


@query("O9_quadtree", head("shapes") + "SELECT level, i, j, type FROM tree")
def _(spark, sf):
    return R.quadtree(one(spark, "shapes"), N)


@query("O9_encode_lossless", head("shapes", 0, True) + "SELECT level, i, j, type FROM tree")
def _(spark, sf):
    return R.encode(one(spark, "shapes"), N)


@query("O10_ramps", head("gradient", 2, True) + "SELECT level, i, j, type FROM tree")
def _(spark, sf):
    flat = R.homogeneous(R.pyramid(one(spark, "gradient"), N), 2)
    ramps = R.ramp_error(one(spark, "gradient"), flat.where("not flat"), N).where("error <= 2").select("level", "i", "j", F.lit("RAMP").alias("type"))
    return R.tree(R.leaf_ends(flat, N).unionByName(ramps), N)


RAMP_SQL = "greatest(0, least(255, round_even((tl.v * (s - dy) * (s - dx) + tr.v * (s - dy) * dx + bl.v * dy * (s - dx) + br.v * dy * dx)::DOUBLE / (s * s), 0)))::INT"


def lossy_sql(kind, t, criterion="max"):
    """fin: the cheaper tree of the one without cosines and the one with them; back: the pixels that cosines give."""
    error = "max(abs(v - r))" if criterion == "max" else "sqrt(avg(pow(v - r, 2)))"
    own = "CASE type WHEN 'LEAF' THEN 3 WHEN 'RAMP' THEN 12 WHEN 'DCT' THEN 96 WHEN 'INTERNAL' THEN 3 ELSE 0 END"
    parts = [px_sql(kind), LEV, UP, PYR, ends_sql(t, True), TREE]
    parts.append("bs AS MATERIALIZED (SELECT side, u.range::INT AS u, p.range::INT AS p, cos(pi() * (2 * p.range + 1) * u.range / (2 * side)) * sqrt((CASE WHEN u.range = 0 THEN 1 ELSE 2 END) / side::DOUBLE) AS b FROM (VALUES (8), (16), (32)) s(side) CROSS JOIN range(4) u CROSS JOIN range(32) p WHERE p.range < side)")
    parts.append(f"cells AS MATERIALIZED (SELECT n.level, n.i, n.j, p.c, s.side, p.y - n.i * s.side AS dy, p.x - n.j * s.side AS dx, p.v FROM tree n JOIN (VALUES (8), (16), (32)) s(side) ON s.side = 1 << ({N} - n.level) JOIN px p ON p.y // s.side = n.i AND p.x // s.side = n.j WHERE n.type = 'INTERNAL')")
    parts.append("co AS MATERIALIZED (SELECT level, i, j, c, cells.side, y.u, x.u AS w, greatest(-32768, least(32767, round_even(round(sum((v - 128.0::DOUBLE) * y.b * x.b), 9), 0)))::INT AS coef FROM cells JOIN bs y ON y.side = cells.side AND y.p = dy JOIN bs x ON x.side = cells.side AND x.p = dx GROUP BY level, i, j, c, cells.side, y.u, x.u)")
    parts.append("back AS MATERIALIZED (SELECT level, i, j, c, y.p AS dy, x.p AS dx, greatest(0, least(255, round_even(round(sum(coef * y.b * x.b) + 128, 9), 0)))::INT AS r FROM co JOIN bs y ON y.side = co.side AND y.u = co.u JOIN bs x ON x.side = co.side AND x.u = co.w GROUP BY level, i, j, c, y.p, x.p)")
    parts.append(f"fit AS MATERIALIZED (SELECT level, i, j FROM cells JOIN back USING (level, i, j, c, dy, dx) GROUP BY level, i, j HAVING {error} <= {t})")
    for k in range(N, -1, -1):
        below = f"LEFT JOIN (SELECT i // 2 AS i, j // 2 AS j, sum(cost) AS below FROM c{k + 1} GROUP BY ALL) b ON b.i = n.i AND b.j = n.j" if k < N else ""
        more = " + CASE WHEN type = 'INTERNAL' THEN 1 + coalesce(below, 0) ELSE 0 END" if k < N else ""
        parts.append(f"c{k} AS MATERIALIZED (SELECT i, j, swap, CASE WHEN swap THEN 96 ELSE own END AS cost FROM (SELECT n.i, n.j, {own}{more} AS own, f.level IS NOT NULL AND ({own}{more}) > 96 AS swap FROM tree n {below} LEFT JOIN fit f ON f.level = n.level AND f.i = n.i AND f.j = n.j WHERE n.level = {k}))")
    swaps = " UNION ALL ".join(f"SELECT {k} AS level, i, j FROM c{k} WHERE swap" for k in range(N + 1))
    parts.append(f"swaps AS MATERIALIZED ({swaps})")
    parts.append("en2 AS MATERIALIZED (SELECT k.level, k.i, k.j, k.type FROM kept k ANTI JOIN swaps s ON s.level = k.level AND s.i = k.i AND s.j = k.j UNION ALL SELECT level, i, j, 'DCT' FROM swaps)")
    again = TREE.replace("top AS", "top2 AS").replace("FROM top t", "FROM top2 t").replace("en e", "en2 e").replace("kept AS", "kept2 AS").replace("FROM kept", "FROM kept2").replace("tree AS", "tree2 AS")
    parts.append(again)
    size = lambda name, per: f"(SELECT count(*) FILTER (type = 'INTERNAL') * {per} + sum({own}) FROM {name})"
    parts.append(f"fin AS MATERIALIZED (SELECT * FROM tree2 WHERE {size('tree2', 4)} < {size('tree', 1)} UNION ALL SELECT * FROM tree WHERE {size('tree2', 4)} >= {size('tree', 1)})")
    return "WITH " + ", ".join(parts) + " "


@query("O12_rate_distortion", lossy_sql("rings", 48) + "SELECT level, type, count(*) AS n FROM fin GROUP BY ALL")
def _(spark, sf):
    return R.encode(one(spark, "rings"), N, lossy=True, threshold=48.0).groupBy("level", "type").agg(F.count(F.lit(1)).alias("n"))


@query("O11b_dct_rms_criterion", lossy_sql("rings", 24, "rms") + "SELECT level, type, count(*) AS n FROM fin GROUP BY ALL")
def _(spark, sf):
    return R.encode(one(spark, "rings"), N, lossy=True, threshold=24.0, criterion="rms").groupBy("level", "type").agg(F.count(F.lit(1)).alias("n"))


@query("A24_node_counts", head("checker") + "SELECT level, type, count(*) AS n FROM tree GROUP BY ALL")
def _(spark, sf):
    return R.quadtree(one(spark, "checker"), N).groupBy("level", "type").agg(F.count(F.lit(1)).alias("n"))


@query("F16_roi", "WITH " + px_sql("noise") + " SELECT y, x, v FROM px WHERE y BETWEEN 10 AND 19 AND x BETWEEN 5 AND 24")
def _(spark, sf):
    return R.roi(one(spark, "noise"), 10, 5, 10, 20, SIDE, SIDE).select("y", "x", "v")


@query("F19_nodes_in_window", head("shapes") + f"SELECT level, i, j FROM tree WHERE type = 'LEAF' AND j * (1 << ({N} - level)) < 40 AND (j + 1) * (1 << ({N} - level)) > 20 AND i * (1 << ({N} - level)) < 30 AND (i + 1) * (1 << ({N} - level)) > 10")
def _(spark, sf):
    return R.nodes_in(R.quadtree(one(spark, "shapes"), N).where("type = 'LEAF'"), N, 10, 20, 20, 20).select("level", "i", "j")


def stored(spark, tree, **head):
    """Coded nodes written to a folder, and read from there."""
    path = scratch(spark)
    T.write(tree, T.Head(SIDE, SIDE, N, **head), path)
    return path


@query("O7_preview", head("shapes") + "SELECT u.y, u.x, CASE WHEN t.type = 'INTERNAL' THEN round_even(p.mean, 0)::INT ELSE p.low END AS v FROM up u JOIN tree t ON t.level = u.level AND t.i = u.i AND t.j = u.j JOIN pyr p ON p.level = t.level AND p.i = t.i AND p.j = t.j WHERE t.level <= 3 AND (t.type <> 'INTERNAL' OR t.level = 3)")
def _(spark, sf):
    px = one(spark, "shapes")
    path = stored(spark, R.coded(R.quadtree(px, N), px, N))
    return R.preview(T.read(spark, path, 3)[1], N, 3).select("y", "x", "v")


for _kind in ("shapes", "gradient", "noise"):

    @query(f"O8_decode_{_kind}", "WITH " + px_sql(_kind) + " SELECT y, x, v FROM px")
    def _(spark, sf, kind=_kind):
        px = one(spark, kind)
        path = stored(spark, R.coded(R.encode(px, N), px, N))
        return R.decode(T.read(spark, path)[1], N).select("y", "x", "v")


@query("O8_decode_lossy", lossy_sql("rings", 48) + f""", placed AS MATERIALIZED (SELECT u.y, u.x, u.c, f.level, f.i, f.j, f.type, (1 << ({N} - f.level)) - 1 AS s, u.y - f.i * (1 << ({N} - f.level)) AS dy, u.x - f.j * (1 << ({N} - f.level)) AS dx FROM up u JOIN fin f ON f.level = u.level AND f.i = u.i AND f.j = u.j WHERE f.type <> 'INTERNAL')
SELECT a.y, a.x, round_even(p.mean, 0)::INT AS v FROM placed a JOIN pyr p ON p.level = a.level AND p.i = a.i AND p.j = a.j WHERE a.type = 'LEAF'
UNION ALL SELECT a.y, a.x, {RAMP_SQL} FROM placed a JOIN px tl ON tl.y = a.i * (s + 1) AND tl.x = a.j * (s + 1) JOIN px tr ON tr.y = a.i * (s + 1) AND tr.x = a.j * (s + 1) + s JOIN px bl ON bl.y = a.i * (s + 1) + s AND bl.x = a.j * (s + 1) JOIN px br ON br.y = a.i * (s + 1) + s AND br.x = a.j * (s + 1) + s WHERE a.type = 'RAMP'
UNION ALL SELECT a.y, a.x, b.r FROM placed a JOIN back b ON b.level = a.level AND b.i = a.i AND b.j = a.j AND b.dy = a.dy AND b.dx = a.dx WHERE a.type = 'DCT'""")
def _(spark, sf):
    px = one(spark, "rings")
    path = stored(spark, R.coded(R.encode(px, N, lossy=True, threshold=48.0), px, N, lossy=True), lossy=True, threshold=48.0)
    return R.decode(T.read(spark, path)[1], N).select("y", "x", "v")


@query("J10_pixels_in_leaves", head("shapes") + "SELECT u.level, u.i, u.j, count(*) AS n FROM up u JOIN tree t ON t.level = u.level AND t.i = u.i AND t.j = u.j WHERE t.type = 'LEAF' GROUP BY ALL")
def _(spark, sf):
    px = one(spark, "shapes")
    leaves = R.quadtree(px, N).where("type = 'LEAF'").select("level", "i", "j")
    return R._up(px, N, []).join(leaves, ["level", "i", "j"]).groupBy("level", "i", "j").agg(F.count(F.lit(1)).alias("n"))


@query("O13_structure_map", head("shapes") + f"SELECT y AS i, x AS j, floor(coalesce(max(t.level), 0) * 255.0 / {N})::INT AS depth FROM up u LEFT JOIN tree t ON t.level = u.level AND t.i = u.i AND t.j = u.j AND t.type = 'INTERNAL' AND t.level > 0 GROUP BY y, x")
def _(spark, sf):
    px = one(spark, "shapes")
    return R.structure_map(R.quadtree(px, N), px, N)


@query("O14_payload_layout", head("shapes", 0, True) + "SELECT level, i, j, coalesce(sum(size) OVER (PARTITION BY level ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT *, CASE type WHEN 'LEAF' THEN 3 WHEN 'RAMP' THEN 12 ELSE 3 END AS size FROM tree)")
def _(spark, sf):
    from manyfold.sources import stores

    sized = R.encode(one(spark, "shapes"), N).withColumn("size", R.payload_bytes()).withColumn("nth", F.struct("i", "j"))
    return stores.offsets(sized, "level", "nth", "size").select("level", "i", "j", "offset")


@query("W7_seeks", """WITH b AS (SELECT event_id AS nth, event_type, strlen(props) AS size, sum(strlen(props)) OVER (ORDER BY event_id) - strlen(props) AS off FROM events), r AS (SELECT * FROM b WHERE event_type = 'error'),
x AS (SELECT *, lag(off + size) OVER (ORDER BY off) AS before FROM r) SELECT count(*) FILTER (before IS NULL OR before <> off) AS seeks, sum(size)::BIGINT AS bytes FROM x""")
def _(spark, sf):
    from manyfold.operators import ranges_read as Q

    blocks = table(spark, sf, "events").select(F.col("event_id").alias("nth"), "event_type", F.octet_length("props").alias("size"))
    return Q.seeks(Q.placed(blocks, "nth", "size", 4096).where("event_type = 'error'"))


@query("A28_psnr", "WITH " + px_sql("noise") + " SELECT round(10 * log10(65025 / avg(pow(v - least(255, v + y % 5), 2))), 6) AS psnr FROM px")
def _(spark, sf):
    px = one(spark, "noise")
    off = px.withColumn("v", F.least(F.lit(255), F.col("v") + F.col("y") % 5))
    return R.psnr(px, off).select(F.round("psnr", 6).alias("psnr"))


@query("T6_nearest_quality", "WITH " + px_sql("noise") + ", q AS (SELECT range AS step, avg(pow(v - floor(v / range) * range, 2)) AS mse FROM px CROSS JOIN range(2, 17) GROUP BY range) SELECT arg_min(step, (abs(10 * log10(65025 / mse) - 35), step)) AS step FROM q")
def _(spark, sf):
    steps = spark.range(2, 17).withColumnRenamed("id", "step")
    px = one(spark, "noise").crossJoin(F.broadcast(steps))  # 15 rows
    q = px.groupBy("step").agg(F.avg(F.pow(F.col("v") - F.floor(F.col("v") / F.col("step")) * F.col("step"), F.lit(2.0))).alias("mse"))
    near = F.abs(10 * F.log10(65025 / F.col("mse")) - 35)
    return q.agg(F.min_by("step", F.struct(near, "step")).alias("step"))


@query("X1_luminance", f"SELECT (range // {SIDE})::INT AS y, (range % {SIDE})::INT AS x, round_even(round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 9), 0)::INT AS v FROM (SELECT range, ({KINDS['noise'].replace('y *', '(range // 64) *').replace('+ x)', '+ range % 64)')})::INT AS r, (range % 64) * 4 AS g, (range // 64) * 4 AS b FROM range({SIDE * SIDE}))")
def _(spark, sf):
    r = one(spark, "noise", 0)
    g = r.withColumn("v", F.col("x") * 4).withColumn("c", F.lit(1))
    return R.luminance(r.unionByName(g).unionByName(r.withColumn("v", F.col("y") * 4).withColumn("c", F.lit(2)))).select("y", "x", "v")


# ---- tiles from embeddings

TILE = "WITH t AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS e FROM embeddings), px AS (SELECT vec_id, (k // 8)::INT AS dy, (k % 8)::INT AS dx, greatest(0, least(255, floor(128 + 128 * e::DOUBLE)))::INT AS v FROM t)"
BASIS = "b AS (SELECT u.range::INT AS u, p.range::INT AS p, cos(pi() * (2 * p.range + 1) * u.range / 16) * sqrt((CASE WHEN u.range = 0 THEN 1 ELSE 2 END) / 8.0::DOUBLE) AS b FROM range(4) u CROSS JOIN range(8) p)"


def tiles(spark, sf):
    t = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 128 * F.col("e").cast("double")))).cast("int")
    return t.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("dy"), (F.col("k") % 8).alias("dx"), v.alias("v"))


@query("O11_dct_coefficients", f"{TILE}, {BASIS} SELECT vec_id, y.u, x.u AS w, round_even(round(sum((v - 128.0::DOUBLE) * y.b * x.b), 9), 0)::INT AS coef FROM px JOIN b y ON y.p = dy JOIN b x ON x.p = dx GROUP BY vec_id, y.u, x.u")
def _(spark, sf):
    return R.dct_coefficients(tiles(spark, sf), 8, ["vec_id"])


TILE_BACK = f"{TILE}, {BASIS}, co AS MATERIALIZED (SELECT vec_id, y.u, x.u AS w, round_even(round(sum((v - 128.0::DOUBLE) * y.b * x.b), 9), 0)::INT AS coef FROM px JOIN b y ON y.p = dy JOIN b x ON x.p = dx GROUP BY vec_id, y.u, x.u), back AS (SELECT vec_id, y.p AS dy, x.p AS dx, greatest(0, least(255, round_even(round(sum(coef * y.b * x.b) + 128, 9), 0)))::INT AS r FROM co JOIN b y ON y.u = co.u JOIN b x ON x.u = co.w GROUP BY vec_id, y.p, x.p), er AS (SELECT vec_id, max(abs(v - r)) AS worst, sqrt(avg(pow(v - r, 2))) AS rms FROM px JOIN back USING (vec_id, dy, dx) GROUP BY vec_id)"


@query("O11_dct_error", TILE_BACK + " SELECT vec_id, worst::DOUBLE AS error FROM er")
def _(spark, sf):
    return R.block_error(tiles(spark, sf), 8, ["vec_id"])


@query("X2_fit_criterion", TILE_BACK + " SELECT vec_id, worst <= 24 AS by_worst, round(rms, 6) <= 8 AS by_rms FROM er")
def _(spark, sf):
    """Which tiles cosines may stand for, by either criterion."""
    px = tiles(spark, sf)
    worst, rms = (R.block_error(px, 8, ["vec_id"], criterion=c).withColumnRenamed("error", c) for c in ("max", "rms"))
    return worst.join(rms, "vec_id").select("vec_id", (F.col("max") <= 24).alias("by_worst"), (F.round("rms", 6) <= 8).alias("by_rms"))


# ---- layers and film

LAYER_SQL = "CASE layer WHEN 0 THEN " + KINDS["shapes"] + " WHEN 1 THEN CASE WHEN x >= 16 AND x < 32 AND y >= 16 AND y < 32 THEN 3 ELSE 1 END ELSE " + KINDS["checker"] + " END"


def stack(spark):
    first, third = one(spark, "shapes"), one(spark, "checker")
    box = F.when(F.col("x").between(16, 31) & F.col("y").between(16, 31), 3).otherwise(1)
    return first.withColumn("layer", F.lit(0)).unionByName(first.withColumn("v", box).withColumn("layer", F.lit(1))).unionByName(third.withColumn("layer", F.lit(2)))


def layers_sql(shared):
    """Trees by layer, or one for all, as counts."""
    key = "" if shared else "layer, "
    on = "" if shared else " AND e.layer = u.layer"
    return f"""WITH px AS MATERIALIZED (SELECT layer, y, x, ({LAYER_SQL})::INT AS v FROM (SELECT (range // {SIDE})::INT AS y, (range % {SIDE})::INT AS x FROM range({SIDE * SIDE})) CROSS JOIN (SELECT range::INT AS layer FROM range(3))), {LEV},
up AS MATERIALIZED (SELECT layer, y, x, v, level, (y // (1 << ({N} - level)))::INT AS i, (x // (1 << ({N} - level)))::INT AS j FROM px CROSS JOIN lev),
one AS (SELECT layer, level, i, j, max(v) - min(v) = 0 AS flat FROM up GROUP BY ALL), fl AS (SELECT {key}level, i, j, bool_and(flat) AS flat FROM one GROUP BY ALL),
en AS MATERIALIZED (SELECT * FROM fl WHERE flat OR level = {N}),
top AS (SELECT {key.replace('layer', 'u.layer')}u.y, u.x, min(e.level) AS level FROM up u JOIN en e ON e.level = u.level AND e.i = u.i AND e.j = u.j{on} GROUP BY {key.replace('layer', 'u.layer')}u.y, u.x),
kept AS MATERIALIZED (SELECT DISTINCT {key}level, y // (1 << ({N} - level)) AS i, x // (1 << ({N} - level)) AS j FROM top),
inner_nodes AS (SELECT DISTINCT {key}a.level, k.i // (1 << (k.level - a.level)) AS i, k.j // (1 << (k.level - a.level)) AS j FROM kept k JOIN lev a ON a.level < k.level)
"""


@query("O15_own_trees", layers_sql(False) + "SELECT k.layer, i.n AS internal, k.n AS leaves FROM (SELECT layer, count(*) AS n FROM kept GROUP BY layer) k JOIN (SELECT layer, count(*) AS n FROM inner_nodes GROUP BY layer) i ON i.layer = k.layer")
def _(spark, sf):
    return L.independent(stack(spark), N, 0.0).select("layer", "internal", "leaves")


@query("U2_shared_tree", layers_sql(True) + "SELECT (SELECT count(*) FROM inner_nodes) AS shared_struct, (SELECT count(*) * 3 FROM kept) AS shared_payload")
def _(spark, sf):
    return L.measure(stack(spark), N).select("shared_struct", "shared_payload")


@query("O16_derived_layers", layers_sql(True) + "SELECT (SELECT count(*) FROM inner_nodes) AS shared_struct, (SELECT count(*) * 2 FROM kept) AS shared_payload")
def _(spark, sf):
    return L.measure(stack(spark), N, derived=[1]).select("shared_struct", "shared_payload")


_REFINED = layers_sql(False) + """, nodes AS (SELECT layer, level, i, j, 0 AS inner_n, 1 AS leaf_n FROM kept UNION ALL SELECT layer, level, i, j, 1, 0 FROM inner_nodes),
base AS (SELECT level, i, j FROM kept WHERE layer = 0), own AS (SELECT b.level, b.i, b.j, o.layer FROM base b CROSS JOIN (SELECT DISTINCT layer FROM nodes WHERE layer <> 0) o),
got AS (SELECT n.layer, b.level, b.i, b.j, sum(inner_n) AS inner_n, sum(leaf_n) AS leaf_n FROM base b JOIN nodes n ON n.layer <> 0 AND n.level >= b.level AND n.i // (1 << (n.level - b.level)) = b.i AND n.j // (1 << (n.level - b.level)) = b.j GROUP BY ALL),
r AS (SELECT coalesce(sum(g.inner_n), 0) AS struct, sum(coalesce(g.leaf_n, 1)) AS payload FROM own o LEFT JOIN got g ON g.layer = o.layer AND g.level = o.level AND g.i = o.i AND g.j = o.j),
s AS (SELECT (SELECT count(*) FROM inner_nodes WHERE layer = 0) AS base_struct, (SELECT count(*) FROM base) AS base_payload, (SELECT count(*) FROM nodes) AS own_total, r.* FROM r)
SELECT base_struct, struct::BIGINT AS refine_struct, (base_payload + payload)::BIGINT AS payload, own_total, round(own_total / (base_struct + struct + base_payload + payload)::DOUBLE, 6) AS ratio FROM s"""


@query("O17_refinements", _REFINED)
def _(spark, sf):
    return L.measure_refined(stack(spark), N)


@query("O18_reconstruct", layers_sql(True) + "SELECT layer, y, x, v FROM px")
def _(spark, sf):
    return L.reconstruct(stack(spark), N).select("layer", "y", "x", "v")


@query("O18_reconstruct_refined", layers_sql(True) + "SELECT layer, y, x, v FROM px WHERE layer < 2 UNION ALL SELECT 2, y, x, 255 - v FROM px WHERE layer = 0")
def _(spark, sf):
    return L.reconstruct_refined(stack(spark), N, 0, {2: lambda base: base.withColumn("v", 255 - F.col("v"))}).select("layer", "y", "x", "v")


FRAMES, FSIDE, FN = 6, 32, 5
SCENE = f"CASE WHEN layer = 0 AND x >= (3 + 2 * frame) % 22 AND x < (3 + 2 * frame) % 22 + 10 AND y >= 5 AND y < 15 THEN 200 WHEN layer = 1 AND x >= (3 + 2 * frame) % 22 AND x < (3 + 2 * frame) % 22 + 10 AND y >= 5 AND y < 15 THEN 60 WHEN layer = 0 THEN 30 ELSE 0 END"
FILM = f"WITH px AS MATERIALIZED (SELECT frame, layer, y, x, ({SCENE})::INT AS v FROM (SELECT (range // {FSIDE})::INT AS y, (range % {FSIDE})::INT AS x FROM range({FSIDE * FSIDE})) CROSS JOIN (SELECT range::INT AS frame FROM range({FRAMES})) CROSS JOIN (SELECT range::INT AS layer FROM range(2)))"


def film(spark):
    px = G.grid(spark, FSIDE, FSIDE).crossJoin(F.broadcast(spark.range(FRAMES).select(F.col("id").cast("int").alias("frame")))).crossJoin(F.broadcast(spark.range(2).select(F.col("id").cast("int").alias("layer"))))  # a scene's frames and layers
    return px.select("frame", "layer", "y", "x", F.lit(0).alias("c"), F.expr(SCENE).cast("int").alias("v"))


@query("W5_frame_delta", FILM + " SELECT frame, layer, y, x, v - lag(v) OVER (PARTITION BY layer, y, x ORDER BY frame) AS d FROM px QUALIFY d IS NOT NULL")
def _(spark, sf):
    return R.delta(film(spark)).select("frame", "layer", "y", "x", "d")


@query("J8_frame_join", FILM + " SELECT a.frame, count(*) FILTER (a.v <> b.v) AS changed FROM px a JOIN px b ON b.layer = a.layer AND b.y = a.y AND b.x = a.x AND b.frame = a.frame - 1 GROUP BY a.frame")
def _(spark, sf):
    a = film(spark)
    b = a.select((F.col("frame") + 1).alias("frame"), "layer", "y", "x", F.col("v").alias("w"))
    return a.join(b, ["frame", "layer", "y", "x"]).groupBy("frame").agg(F.count_if(F.col("v") != F.col("w")).alias("changed"))


_TEMP = FILM + f""", d AS MATERIALIZED (SELECT frame, layer, y, x, abs(v - lag(v) OVER (PARTITION BY layer, y, x ORDER BY frame)) AS d FROM px QUALIFY d IS NOT NULL),
lev AS (SELECT range::INT AS level FROM range({FN + 1})), up AS MATERIALIZED (SELECT frame, y, x, level, y // (1 << ({FN} - level)) AS i, x // (1 << ({FN} - level)) AS j, max(d) AS d FROM d CROSS JOIN lev GROUP BY ALL),
fl AS (SELECT frame, level, i, j, max(d) <= 6 AS still FROM up GROUP BY ALL), en AS MATERIALIZED (SELECT * FROM fl WHERE still OR level = {FN}),
top AS (SELECT u.frame, u.y, u.x, min(e.level) AS level FROM up u JOIN en e ON e.frame = u.frame AND e.level = u.level AND e.i = u.i AND e.j = u.j GROUP BY u.frame, u.y, u.x),
kept AS MATERIALIZED (SELECT DISTINCT t.frame, t.level, t.y // (1 << ({FN} - t.level)) AS i, t.x // (1 << ({FN} - t.level)) AS j FROM top t),
inner_nodes AS (SELECT DISTINCT k.frame, a.level, k.i // (1 << (k.level - a.level)) AS i, k.j // (1 << (k.level - a.level)) AS j FROM kept k JOIN lev a ON a.level < k.level)
SELECT s.frame, s.n AS struct, m.n * 2 AS payload FROM (SELECT frame, count(*) AS n FROM inner_nodes GROUP BY frame) s JOIN (SELECT k.frame, count(*) FILTER (NOT e.still) AS n FROM kept k JOIN en e ON e.frame = k.frame AND e.level = k.level AND e.i = k.i AND e.j = k.j GROUP BY k.frame) m ON m.frame = s.frame"""


@query("O19_temporal_cost", _TEMP)
def _(spark, sf):
    return L.temporal_cost(R.delta(film(spark)).select("frame", "layer", "y", "x", "c", "d"), FN, 6.0)


_UNION = FILM + f""", lev AS (SELECT range::INT AS level FROM range({FN + 1})), up AS MATERIALIZED (SELECT frame, layer, y, x, v, level, y // (1 << ({FN} - level)) AS i, x // (1 << ({FN} - level)) AS j FROM px CROSS JOIN lev),
one AS (SELECT frame, layer, level, i, j, max(v) - min(v) <= 6 AS flat FROM up GROUP BY ALL), fl AS (SELECT frame, level, i, j, bool_and(flat) AS flat FROM one GROUP BY ALL), en AS MATERIALIZED (SELECT * FROM fl WHERE flat OR level = {FN}),
top AS (SELECT u.frame, u.y, u.x, min(e.level) AS level FROM up u JOIN en e ON e.frame = u.frame AND e.level = u.level AND e.i = u.i AND e.j = u.j GROUP BY u.frame, u.y, u.x),
kept AS MATERIALIZED (SELECT DISTINCT frame, level, y // (1 << ({FN} - level)) AS i, x // (1 << ({FN} - level)) AS j FROM top),
inner_nodes AS (SELECT DISTINCT k.frame, a.level, k.i // (1 << (k.level - a.level)) AS i, k.j // (1 << (k.level - a.level)) AS j FROM kept k JOIN lev a ON a.level < k.level)
SELECT s.frame, s.n AS struct, m.n * 2 AS payload FROM (SELECT frame, count(*) AS n FROM inner_nodes GROUP BY frame) s JOIN (SELECT frame, count(*) AS n FROM kept GROUP BY frame) m ON m.frame = s.frame"""


@query("R3_union_cost", _UNION)
def _(spark, sf):
    return L.union_cost(film(spark), FN, 6.0)


@query("S14_level_table", head("shapes", 0, True) + "SELECT level, count(*) FILTER (type = 'INTERNAL') AS structure, sum(CASE type WHEN 'LEAF' THEN 3 WHEN 'RAMP' THEN 12 ELSE 3 END)::BIGINT AS data FROM tree GROUP BY level")
def _(spark, sf):
    """The level table as the head of a written picture holds it."""
    px = one(spark, "shapes")
    _, sizes = T.head_of(spark, stored(spark, R.coded(R.encode(px, N), px, N)))
    return spark.createDataFrame(sizes, "level int, structure long, data long")


@query("S14_heads", "SELECT * FROM (VALUES ('a picture', false), ('another table', true), ('other colours', true), ('another format', true)) v(what, refused)")
def _(spark, sf):
    px = one(spark, "flat")
    good = stored(spark, R.coded(R.encode(px, N), px, N))
    head = spark.read.parquet(f"{good}/head")
    cases = {"a picture": head, "another table": table(spark, sf, "region"), "other colours": head.withColumn("colors", F.lit("cmyk")), "another format": head.withColumn("format", F.lit("x"))}
    out = []
    for what, df in cases.items():
        path = scratch(spark)
        df.write.mode("overwrite").parquet(f"{path}/head")
        try:
            T.head_of(spark, path)
            out.append((what, False))
        except ValueError:
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")


def _codec_sql(kind):
    return f"SELECT * FROM ({head(kind, 0, True)} SELECT '{kind}' AS kind, count(*) AS nodes, (count(*) FILTER (type = 'INTERNAL') + sum(CASE type WHEN 'LEAF' THEN 3 WHEN 'RAMP' THEN 12 ELSE 3 END))::BIGINT AS bytes, {SIDE * SIDE} AS raw FROM tree)"


CODEC_KINDS = ("flat", "gradient", "shapes", "checker", "noise")


@query("O24_codec_tasks", " UNION ALL ".join(_codec_sql(k) for k in CODEC_KINDS))
def _(spark, sf):
    """Nodes and bytes of each picture's tree beside its raw bytes."""
    out = None
    for kind in CODEC_KINDS:
        tree = R.encode(one(spark, kind), N)
        row = tree.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("nodes"), (F.count_if(F.col("type") == "INTERNAL") + F.sum(R.payload_bytes())).alias("bytes"), F.lit(SIDE * SIDE).alias("raw"))
        out = row if out is None else out.unionByName(row)
    return out

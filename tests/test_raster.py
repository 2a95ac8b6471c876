import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyfold.operators import layers as L
from manyfold.operators import raster as R
from manyfold.sources import generate as G
from manyfold.sources import trees as T
from manyfold.storage import settle


def px_of(spark, a, **extra):
    rows = [(y, x, 0, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "y int, x int, c int, v int")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def as_array(df, side):
    out = np.full((side, side), -1)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def even(a, t=0):
    """By level, which squares of a picture spread over t at most; the last level's always do."""
    side, out = len(a), []
    for k in range(side.bit_length()):
        s = side >> k
        tiles = a.reshape(side // s, s, side // s, s)
        out.append(tiles.max((1, 3)) - tiles.min((1, 3)) <= t)
    return out


def ends_of(pictures, t=0):
    """(level, i, j) of the leaves of the tree that all pictures share, and the number of inner nodes, level by level over whole grids."""
    flat = [np.logical_and.reduce(x) for x in zip(*(even(a, t) for a in pictures), strict=True)]
    open_, leaves, inner = np.ones((1, 1), bool), set(), 0
    for k, here in enumerate(flat):
        leaves |= {(k, int(i), int(j)) for i, j in zip(*np.nonzero(open_ & here), strict=True)}
        inner += int((open_ & ~here).sum())
        open_ = np.kron(open_ & ~here, np.ones((2, 2), bool))
    return leaves, inner


def picture(seed, side=16):
    rng = np.random.default_rng(seed)
    a = np.full((side, side), 40)
    for _ in range(3):
        y, x, s = rng.integers(0, side - 4), rng.integers(0, side - 4), rng.integers(2, 6)
        a[y : y + s, x : x + s] = rng.integers(0, 255)
    return a


def test_quadtree_and_lossless_decode(spark):
    a = picture(1)
    px = settle(px_of(spark, a))
    leaves, inner = ends_of([a])
    nodes = R.quadtree(px, 4).collect()
    assert sum(r.type == "INTERNAL" for r in nodes) == inner
    assert {(r.level, r.i, r.j) for r in nodes if r.type == "LEAF"} == leaves
    tree = settle(R.coded(R.encode(px, 4), px, 4))
    assert (as_array(R.decode(tree, 4), 16) == a).all()


def test_pictures_come_back_from_disk(spark, tmp_path):
    """Only what was written is read again: the picture itself is gone."""
    path = f"{tmp_path}/tree"
    for seed, (height, width) in enumerate([(16, 16), (5, 11), (1, 1), (9, 2)]):
        a = np.random.default_rng(seed).integers(0, 3, (height, width)) * 100
        levels = R.levels_of(height, width)
        px = settle(R.padded(px_of(spark, a), height, width))
        T.write(R.coded(R.encode(px, levels), px, levels), T.Head(width, height, levels), path)
        head, tree = T.read(spark, path)
        assert head == T.Head(width, height, levels)
        back = as_array(R.decode(tree, levels), 1 << levels)
        assert (back[:height, :width] == a).all() and (back[height:] == 0).all() and (back[:, width:] == 0).all()
        for cut in range(levels + 1):
            some = as_array(R.preview(T.read(spark, path, cut)[1], levels, cut), 1 << levels)
            assert (some >= 0).all()  # every pixel once
    with pytest.raises(ValueError):
        T.write(tree, T.Head(9, 9, 1), path)
    with pytest.raises(ValueError):
        T.write(tree, T.Head(2, 9, 4, colors="cmyk"), path)


def test_heads_are_checked(spark, tmp_path):
    px = px_of(spark, picture(3))
    T.write(R.coded(R.encode(px, 4), px, 4), T.Head(16, 16, 4), f"{tmp_path}/a")
    head, sizes = T.head_of(spark, f"{tmp_path}/a")
    nodes = R.encode(px, 4).collect()
    assert sum(s for _, s, _ in sizes) == sum(r.type == "INTERNAL" for r in nodes)
    assert [k for k, _, _ in sizes] == sorted({r.level for r in nodes})
    for n, wrong in enumerate((F.lit("other").alias("format"), F.lit("cmyk").alias("colors"))):
        df = spark.read.parquet(f"{tmp_path}/a/head")
        df.withColumn(["format", "colors"][n], wrong).write.parquet(f"{tmp_path}/b{n}/head")
        with pytest.raises(ValueError):
            T.head_of(spark, f"{tmp_path}/b{n}")


def test_lossy_pictures_stay_within_the_threshold(spark):
    px = settle(G.image(spark, "rings", 32, 32).withColumn("c", F.lit(0)))
    a = as_array(px, 32)
    types = set()
    for t in (6, 30, 60):
        nodes = settle(R.encode(px, 5, lossy=True, threshold=float(t)))
        types |= {r.type for r in nodes.select("type").distinct().collect()}
        assert np.abs(as_array(R.decode(R.coded(nodes, px, 5, lossy=True), 5), 32) - a).max() <= t
    assert {"LEAF", "DCT"} <= types


def test_gradient_is_one_ramp(spark):
    a = np.add.outer(np.arange(16), np.arange(16)) * 7
    px = px_of(spark, a)
    assert [(r.level, r.type) for r in R.encode(px, 4).collect()] == [(0, "RAMP")]


def test_padding(spark):
    a = np.full((5, 3), 9)
    px = R.padded(px_of(spark, a), 5, 3)
    assert px.count() == 64
    kinds = {(r.level, r.i, r.j): r.type for r in R.quadtree(px, 3).collect()}
    assert kinds[(1, 0, 0)] == "INTERNAL" and kinds[(1, 1, 1)] == "EMPTY"
    assert R.levels_of(1, 1) == 0
    with pytest.raises(ValueError):
        R.levels_of(0, 4)


def test_roi_and_psnr(spark):
    px = px_of(spark, picture(2))
    assert R.roi(px, 3, 4, 1, 1, 16, 16).count() == 1
    for bad in ((-1, 0, 2, 2), (0, 0, 17, 1), (0, 15, 1, 2), (0, 0, 0, 1)):
        with pytest.raises(ValueError):
            R.roi(px, *bad, 16, 16)
    assert R.psnr(px, px).first().psnr == math.inf
    assert R.psnr(px, px.withColumn("v", F.col("v") + 1)).first().psnr == pytest.approx(10 * math.log10(255**2))
    with pytest.raises(ValueError):
        R.psnr(px, px.where("y > 0"))


def test_cosines_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (8, 8))
    x = np.arange(8)
    b = np.cos(np.pi * (2 * x + 1) * np.arange(4)[:, None] / 16) * np.where(np.arange(4)[:, None] == 0, math.sqrt(1 / 8), math.sqrt(2 / 8))
    want = np.rint(b @ (a - 128.0) @ b.T)
    cells = spark.createDataFrame([(0, i, j, int(a[i, j])) for i in range(8) for j in range(8)], "k int, dy int, dx int, v int")
    coefs = settle(R.dct_coefficients(cells, 8, ["k"]))
    got = np.zeros((4, 4))
    for r in coefs.collect():
        got[r.u, r.w] = r.coef
    assert (got == want).all()
    back = np.zeros((8, 8))
    for r in R.dct_pixels(coefs, 8, ["k"]).collect():
        back[r.dy, r.dx] = r.v
    assert (back == np.clip(np.rint(b.T @ want @ b + 128), 0, 255)).all()
    with pytest.raises(ValueError):
        R.dct_coefficients(cells, 2, ["k"])


def test_cosines_only_if_smaller(spark):
    px = settle(G.image(spark, "smooth", 16, 16).withColumn("c", F.lit(0)))
    lossless = settle(R.encode(px, 4))
    assert {r.type for r in lossless.select("type").distinct().collect()} <= {"LEAF", "RAMP", "INTERNAL"}
    lossy = settle(R.encode(px, 4, True, 12.0))
    plain = settle(R.tree(R.leaf_ends(R.homogeneous(R.pyramid(px, 4), 12.0), 4), 4))
    assert R.total_bytes(lossy, 4 if lossy.where("type = 'DCT'").count() else 1) <= R.total_bytes(plain, 1)


def test_layers_against_whole_grids(spark):
    a, b = picture(4), picture(5)
    px = settle(px_of(spark, a, layer=0).unionByName(px_of(spark, b, layer=1)))
    union, one, two = ends_of([a, b]), ends_of([a]), ends_of([b])
    m = L.measure(px, 4).first()
    assert (m.shared_struct, m.shared_payload, m.own_struct, m.own_payload) == (union[1], len(union[0]) * 2, one[1] + two[1], len(one[0]) + len(two[0]))
    struct = payload = 0
    for k, i, j in one[0]:  # the other layer within each leaf of the base
        s = 16 >> k
        leaves, inner = ends_of([b[i * s : (i + 1) * s, j * s : (j + 1) * s]])
        struct, payload = struct + inner, payload + len(leaves)
    r = L.measure_refined(px, 4).first()
    assert (r.base_struct, r.refine_struct, r.payload) == (one[1], struct, len(one[0]) + payload)
    rebuilt = settle(L.reconstruct(px, 4))
    assert (as_array(rebuilt.where("layer = 1"), 16) == b).all()
    refined = settle(L.reconstruct_refined(px, 4))
    assert (as_array(refined.where("layer = 0"), 16) == a).all() and (as_array(refined.where("layer = 1"), 16) == b).all()


def test_still_frames_are_free(spark):
    a = picture(6)
    px = px_of(spark, a, layer=0, frame=0).unionByName(px_of(spark, a, layer=0, frame=1))
    r = L.temporal_cost(R.delta(px).select("frame", "layer", "y", "x", "c", "d"), 4, 0.0).first()
    assert (r.struct, r.payload) == (0, 0)


def test_generators(spark):
    with pytest.raises(ValueError):
        G.image(spark, "portrait", 4, 4)
    log = G.event_log(spark, 10_000).orderBy("key").collect()
    gaps = [b.key - a.key for a, b in zip(log, log[1:], strict=False)]
    assert min(gaps) >= 1 and max(gaps) <= 19 and {r.region for r in log} == set(range(8))

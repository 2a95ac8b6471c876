import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from manyfold import learn
from manyfold.functions import measures as M
from manyfold.queries import QUERIES, studies
from manyfold.sources import generate as G
from manyfold.streaming import detect

SF = "/root/testdata/sf0.001"


def test_divergence_and_entropy(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>")
    got = df.select(M.jensen_shannon(F.col("p"), F.col("q")).alias("d"), M.entropy(F.col("p")).alias("h")).collect()
    assert [r.d for r in got] == [pytest.approx(1.0), pytest.approx(0.0)]
    assert [r.h for r in got] == [0.0, 1.0]


def folded(series, keep=0.9, limit=0.25):
    base, out = None, []
    for t, x in series:
        base = x if base is None else base
        out.append((t, base, abs(x - base) > limit))
        base = keep * base + (1 - keep) * x
    return out


def test_baseline_batch_and_stream(spark, tmp_path):
    rows = G.sensor_grid(spark, 40, 3)
    want = {}
    for r in rows.orderBy("w").collect():
        want.setdefault(r.node, []).append((r.w, r.energy))
    want = {(k, t): (b, f) for k, s in want.items() for t, b, f in folded(s)}
    batch = {(r.node, r.w): (r.baseline, r.flag) for r in M.ewma_flags(rows, "node", "w", "energy").collect()}
    assert batch.keys() == want.keys() and all(math.isclose(batch[k][0], want[k][0]) and batch[k][1] == want[k][1] for k in want)
    for part in range(2):  # the state lives on between runs
        rows.where(f"w {'<' if part == 0 else '>='} 20").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        out = detect.run_once(detect.running_baseline(stream, "node", "w", "energy"), f"{tmp_path}/out")
    got = {(r.node, r.w): (r.baseline, r.flag) for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k][0]) for k in want)
    assert not any(f for (_, t), (_, f) in got.items() if t == 0)


def test_signed_ranks(spark):
    d = [1.0, -2.0, 3.0, 3.0, 0.0, -3.0, 5.0]
    r = M.signed_ranks(spark.createDataFrame([(x,) for x in d], "d double"), "d").first()
    assert (r.n, r.w_plus, r.w_minus) == (6, 1 + 4 + 4 + 6, 2 + 4)


def test_quartiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert {r.quartile: r["count"] for r in M.quartile_of(df, "v").groupBy("quartile").count().collect()} == {0: 25, 1: 25, 2: 25, 3: 26}


def test_soft_targets(spark):
    df = spark.createDataFrame([([0.7, 0.3],), ([0.2, 0.8],)], "dist array<double>")
    weights = lambda t: sorted((r.label, round(r.weight, 3)) for r in learn.expanded(df, "dist", t, 2).collect())
    assert weights("hard") == [(0.0, 1.0), (1.0, 1.0)]
    assert weights("smooth") == [(0.0, 0.05), (0.0, 0.95), (1.0, 0.05), (1.0, 0.95)]
    assert weights("soft") == [(0.0, 0.2), (0.0, 0.7), (1.0, 0.3), (1.0, 0.8)]
    with pytest.raises(ValueError):
        learn.expanded(df, "dist", "firm", 2)
    assert learn.dimensions([0.5, 0.85, 0.96, 1.0]) == {0.8: 2, 0.9: 3, 0.95: 3, 0.99: 4}


def test_scores(spark):
    df = spark.createDataFrame([(3, 3, 3), (1, 3, 3), (2, 1, 3)], "dis int, col int, gap int")
    assert [r.v for r in df.select(M.stance("dis", "col", "gap").alias("v")).collect()] == ["BUILD", "N/A", "STANCE"]
    assert df.select(M.weighted_score({"dis": 0.5, "col": 0.5}).alias("s")).first().s == 100.0


def test_every_row_is_scored_out_of_fold(spark):
    rows = [(i, [i % 7 / 7.0, i % 3 / 3.0], [0.6, 0.3, 0.1] if i % 2 else [0.1, 0.2, 0.7]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x array<double>, dist array<double>").coalesce(1).cache()
    got = learn.out_of_fold(df, "id", "x", "dist", 3, ("hard", "soft"), seeds=2).collect()
    assert sorted((r.id, r.seed, r.target) for r in got) == sorted((i, s, t) for i in range(80) for s in range(2) for t in ("hard", "soft"))
    data = learn.fold(df, "id", 1)
    want = {r.id: r.p for r in learn.predict(data.where("fold <> 3"), data.where("fold = 3"), "x", "dist", "soft", 3).collect()}
    assert want == {r.id: pytest.approx(r.p) for r in got if (r.seed, r.fold, r.target) == (1, 3, "soft")}


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
def test_soft_labels_score_every_fact(spark):
    facts = studies.distributions(spark, SF).count()
    rows = QUERIES["X5_soft_labels"](spark, SF).collect()
    assert {r.target: r.n for r in rows} == dict.fromkeys(learn.TARGETS, facts) and all(0 < r.jsd < 1 for r in rows)


def test_baseline_of_long_and_hot_keys(spark):
    """Keys that go over many ranges, over many blocks, ties in time and a null key."""
    rows = [("hot", t // 2, float((t * 37) % 101)) for t in range(5000)] + [(f"k{t % 40}", t, float(t % 13)) for t in range(900)] + [(None, t, 1.0 + t) for t in range(70)]
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((t, x) for k, t, x in rows if k == key)
        want[key] = [(t, x, b, f) for (t, x), (_, b, f) in zip(own, folded(own), strict=True)]
    df = spark.createDataFrame(rows, "key string, t long, x double").repartition(7)
    got = {}
    for r in M.ewma_flags(df, "key", "t", "x").collect():
        got.setdefault(r.key, []).append((r.t, r.x, r.baseline, r.flag))
    assert got.keys() == want.keys()
    for key, series in want.items():
        mine = sorted(got[key], key=lambda r: r[:2])
        for a, b in zip(mine, series, strict=True):
            if series.count(b) == 1 and sum(x[:2] == b[:2] for x in series) == 1:
                assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9)
    assert M.ewma_flags(df.limit(0), "key", "t", "x").count() == 0


def test_explained_variance(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * [9, 5, 3, 1, 0.5, 0.1] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = learn.explained(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v", 6)
    assert np.allclose(got, np.cumsum(values) / values.sum())
    dims = learn.dimensions(got)
    assert dims == {s: int(np.searchsorted(np.cumsum(values) / values.sum(), s) + 1) for s in dims}

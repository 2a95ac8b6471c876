import pytest
from pyspark.sql import functions as F

from manyfold.functions import running
from manyfold.operators import rollup as R
from manyfold.report import collect_with_report
from manyfold.sources import generate as G
from manyfold.storage import settle

N = 20_000


@pytest.fixture(scope="module")
def log(spark):
    return settle(G.event_log(spark, N))


@pytest.fixture(scope="module")
def built(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollup"))
    R.RangeRollup.build(log, "key", "val_trend", 256, "region").write(path)
    return R.RangeRollup.read(spark, path, "key", "val_trend", "region")


def flat(log, lo, hi):
    return log.where(F.col("key").between(lo, hi)).agg(F.coalesce(F.sum("val_trend"), F.lit(0.0)), F.count(F.lit(1)), F.min("val_trend"), F.max("val_trend")).first()


@pytest.mark.parametrize("ends", [(0.0, 0.001), (0.2, 0.25), (0.1, 0.6), (0.0, 1.0), (0.5, 0.5)])
def test_ranges_equal_full_scans(built, log, ends):
    top = log.agg(F.max("key")).first()[0]
    lo, hi = int(ends[0] * top), int(ends[1] * top)
    got, want = built.aggregate_range(lo, hi).first(), flat(log, lo, hi)
    assert got.n == want[1] and got.low == want[2] and got.high == want[3]
    assert got.total == pytest.approx(want[0], rel=1e-9)
    assert built.range_count(lo, hi).first().n == want[1]
    assert built.edges(lo, hi).count() <= 2


def test_empty_range(built):
    assert tuple(built.aggregate_range(-10, -5).first()) == (0.0, 0, None, None)
    assert built.range_count(-10, -5).first().n == 0


@pytest.mark.parametrize("op", ["gt", "lt"])
@pytest.mark.parametrize("p", [0.01, 0.5, 0.99])
def test_filters(built, log, op, p):
    value = log.agg(F.expr(f"percentile(val_trend, {p})")).first()[0]
    assert built.filter_count(op, value).first().n == R.filter_count(log, "val_trend", op, value).first().n


def test_categories(built, log):
    assert built.category_count(3).first().n == R.equal_count(log, "region", 3).first().n
    assert built.category_count(99).first().n == 0
    assert built.category_count_range(3, 500, 90_000).first().n == log.where("region = 3 and key between 500 and 90000").count()


def test_operator_is_checked(built):
    with pytest.raises(ValueError):
        built.filter_count("ge", 1.0)


def test_reads_are_bounded(built, log):
    """Pages of 1,024 rows and the rollup bound what a range reads; nothing helps off the axis."""
    _, whole = collect_with_report(built.aggregate_global())
    assert whole.rows <= 400
    top = log.agg(F.max("key")).first()[0]
    _, some = collect_with_report(built._edge_rows(int(top * 0.4), int(top * 0.5)))
    assert some.rows <= 4 * 1024
    _, off = collect_with_report(R.equal_count(built.base, "region", 3))
    assert off.rows == N


def test_duplicate_keys_across_blocks(spark):
    df = spark.createDataFrame([(k // 3, float(k)) for k in range(100)], "key long, v double")
    r = R.RangeRollup.build(df, "key", "v", 8)
    for lo, hi in ((0, 33), (2, 2), (3, 9), (7, 20)):
        want = [float(k) for k in range(100) if lo <= k // 3 <= hi]
        got = r.aggregate_range(lo, hi).first()
        assert (got.total, got.n, got.low, got.high) == (sum(want), len(want), min(want), max(want))


def test_empty_table(spark):
    r = R.RangeRollup.build(spark.createDataFrame([], "key long, v double"), "key", "v", 8, block_id=F.lit(0))
    assert tuple(r.aggregate_range(0, 9).first()) == (0.0, 0, None, None)
    assert tuple(r.aggregate_global().first()) == (None, 0, None, None)


def test_prefix_sums_and_batches(spark, log):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    q = spark.createDataFrame([(0, 0, 10), (1, 3, 4), (2, 5, 32)], "query int, lo long, hi long")
    got = {r.query: r.total for r in R.batch_range_sums(df, q, "id", "v", 32).collect()}
    assert got == {i: float(sum(x % 7 for x in range(lo * 32, min(hi * 32, 1000)))) for i, lo, hi in ((0, 0, 10), (1, 3, 4), (2, 5, 32))}


def test_batches_over_gaps_and_past_the_end(spark):
    ids = [x for x in range(1000) if not 200 <= x < 600]
    df = spark.createDataFrame([(x, float(x % 7)) for x in ids], "id long, v double")
    asked = [(0, 0, 10), (1, 8, 17), (2, 10, 12), (3, 12, 100), (4, 40, 90), (5, -3, 2)]
    got = {r.query: r.total for r in R.batch_range_sums(df, spark.createDataFrame(asked, "query int, lo long, hi long"), "id", "v", 32).collect()}
    assert got == {i: float(sum(x % 7 for x in ids if lo * 32 <= x < hi * 32)) for i, lo, hi in asked}


def test_nulls_are_on_neither_side(spark):
    df = spark.createDataFrame([(k, None if k % 2 else 100.0 if k < 60 else float(k)) for k in range(100)] + [(100 + k, None) for k in range(20)], "key long, v double")
    r = R.RangeRollup.build(df, "key", "v", 10)
    for op, value in (("gt", 50.0), ("gt", 70.0), ("lt", 200.0), ("lt", 90.0), ("gt", 1000.0)):
        assert r.filter_count(op, value).first().n == R.filter_count(df, "v", op, value).first().n
    assert r.aggregate_global().first().n == 120 and r.range_count(0, 9).first().n == 10


def test_a_key_of_many_rows_is_divided(spark):
    df = spark.createDataFrame([(7 if k % 3 else k, float(k)) for k in range(900)], "key long, v double")
    rows = R.numbered(df, "key", 64).collect()
    assert sorted(r.block_id for r in rows) == sorted(k // 64 for k in range(900))
    ends = {}
    for r in rows:
        low, high = ends.get(r.block_id, (r.key, r.key))
        ends[r.block_id] = (min(low, r.key), max(high, r.key))
    order = [ends[b] for b in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(order, order[1:], strict=False))


def test_unsorted_keys_have_many_edges(spark, monkeypatch):
    monkeypatch.setattr(R, "EDGES", 3)
    df = spark.createDataFrame([(k * 37 % 400, float(k)) for k in range(400)], "key long, v double").withColumn("at", F.monotonically_increasing_id())
    r = R.RangeRollup.build(df, "key", "v", 16, block_id=F.floor(F.col("v") / 16))
    assert r.edges(50, 90).count() > 3
    got = r.aggregate_range(50, 90).first()
    want = [float(k) for k in range(400) if 50 <= k * 37 % 400 <= 90]
    assert (got.n, got.total, got.low, got.high) == (len(want), sum(want), min(want), max(want))


@pytest.mark.parametrize("width", [2, 5, 4096])
def test_running_sums_by_runs(spark, width):
    places = [3 * i + (i % 5 == 0) - 40 for i in range(230)]
    df = spark.createDataFrame([(p, i % 11) for i, p in enumerate(places)], "place long, v long")
    total, want = 0, {}
    for i, p in enumerate(places):
        want[p] = total
        total += i % 11
    assert {r.place: r.upto for r in running.before(df, "place", "v", "upto", width).collect()} == want
    assert running.before(df.limit(0), "place", "v", "upto", width).count() == 0
    texts = df.withColumn("place", F.format_string("%06d", F.col("place") + 100))
    assert {int(r.place) - 100: r.upto for r in running.before_sorted(texts, "place", "v", "upto").collect()} == want

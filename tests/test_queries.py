"""Some queries against their SQL, on the smallest tables; the driver runs all of them on larger ones."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["A1_build_rollup", "A3_aggregate_range", "F15_prune_range_count", "A12_adjudicate", "A11_agent_reliability", "A9_annotation_summary", "A7_topic_summary", "F9_since", "O2_subtree", "O4_merkle_commit", "O9_quadtree", "W4_running_baseline", "T7_scoped_top_k"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a)))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in want), key=str)
    assert len(got) == len(want) and all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
def test_every_leaf_is_verified(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = {r.idx: r.valid for r in entry.queries()["O5_merkle_verify"](spark, SF).collect()}
    assert got == {i: i != 123 for i in docs}
    test_query_equals_sql(spark, "O5_merkle_verify")


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
def test_every_event_is_looked_up(spark):
    got = entry.queries()["J5_id_index_join"](spark, SF).agg({"n": "sum"}).first()[0]
    assert got == spark.read.parquet(f"{SF}/events.parquet").count()
    test_query_equals_sql(spark, "J5_id_index_join")


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
def test_batch_ranges_equal_sql(spark):
    test_query_equals_sql(spark, "J9_batch_range_sums")


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
def test_seeks_of_all_errors(spark):
    from pyspark.sql import functions as F

    errors = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'error'")
    assert entry.queries()["W7_seeks"](spark, SF).first().bytes == errors.agg(F.sum(F.octet_length("props"))).first()[0] > 0
    test_query_equals_sql(spark, "W7_seeks")


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the sample tables")
def test_layouts_are_pruned(spark):
    """Readings of written layouts push their filters down and open a part of the rows only."""
    from manyfold.queries import ranges, stores
    from manyfold.report import collect_with_report

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(topic,user7)" in plan(entry.queries()["F8_recall"](spark, SF))
    assert "StringStartsWith(name,model.layers.1.)" in plan(entry.queries()["F13_prefix"](spark, SF))
    assert "EqualTo(id,77)" in plan(stores.memory_places(spark, SF).where("id = '77'"))
    built = ranges.rollup(spark, SF)
    rows, whole = collect_with_report(built._edge_rows(1, 700))[1], built.base.count()
    assert rows.rows <= min(whole, 2048)  # the edge blocks' pages at most
    _, report = collect_with_report(built.aggregate_global())
    assert report.rows < built.base.count() / 10

"""Scans, range aggregates and pruning over ``events``, by event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyfold.operators import rollup as R
from manyfold.queries.registry import query, table
from manyfold.sources import generate as G
from manyfold.storage import written

LO, HI, BLOCK = 1500, 7300, 1024
r4 = lambda c, name: F.round(c, 4).alias(name)


def events(spark, sf):
    return table(spark, sf, "events").withColumn("trend", F.col("event_id") * 0.1 + F.col("value"))


def rollup(spark, sf, column="value", block=BLOCK, fanout=2):
    """The rollup of a column as it lies on disk, written by the first who asks."""

    def write(path):
        R.RangeRollup.build(events(spark, sf), "event_id", column, block, "event_type", F.floor(F.col("event_id") / block), fanout=fanout).write(path)

    return written(spark, f"rollup-{column}-{block}-{fanout}", sf, write, lambda path: R.RangeRollup.read(spark, path, "event_id", column, "event_type", fanout))


S = lambda inner: f"SELECT * FROM ({inner}) t"


def _log_sql(n):
    x = lambda seed: G.SCATTER_SQL.format(x="id", seed=seed)
    return f"""WITH r AS (SELECT range AS id FROM range({n})), k AS (SELECT id, sum({x(0)} % 19 + 1) OVER (ORDER BY id)::BIGINT AS key FROM r)
SELECT key, ({x(5)} % 8)::INT AS region, round(key * 0.1 + ({x(77)} % 601 / 10.0 - 30), 4) AS val_trend, round({x(9)} / 1000.0, 4) AS val_rand FROM k"""


@query("S1_event_log", _log_sql(20000))
def _(spark, sf):
    return G.event_log(spark, 20000).select("key", F.col("region").cast("int").alias("region"), r4(F.col("val_trend"), "val_trend"), r4(F.col("val_rand"), "val_rand"))


@query("S2_full_scan_sum", "SELECT round(sum(value), 4) AS total FROM events")
def _(spark, sf):
    return R.full_sum(events(spark, sf), "value").select(r4(F.col("total"), "total"))


@query("S3_range_scan_sum", f"SELECT round(coalesce(sum(value), 0), 4) AS total FROM events WHERE event_id BETWEEN {LO} AND {HI}")
def _(spark, sf):
    return R.range_sum(events(spark, sf), "event_id", "value", LO, HI).select(r4(F.col("total"), "total"))


@query("S4_filter_scan_count", "SELECT count(*) FILTER (value > 50) AS n_gt, count(*) FILTER (value < 50) AS n_lt FROM events")
def _(spark, sf):
    e = events(spark, sf)
    return e.agg(F.count_if(R.threshold("value", "gt", 50)).alias("n_gt"), F.count_if(R.threshold("value", "lt", 50)).alias("n_lt"))


@query("S5_filter_scan_eq_count", "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def _(spark, sf):
    return R.equal_count(events(spark, sf), "event_type", "error")


@query("S6_block_scan_sum", f"SELECT event_id // {BLOCK} AS block, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    return events(spark, sf).groupBy(F.floor(F.col("event_id") / BLOCK).alias("block")).agg(r4(F.sum("value"), "total"))


_LEVELS = "UNION ALL ".join(f"SELECT {k} AS level, event_id // {BLOCK << k} AS node, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, count(*) AS n, count(value) AS filled, min(event_id) AS kmin, max(event_id) AS kmax FROM events GROUP BY ALL " for k in range(5))


@query("A1_build_rollup", _LEVELS)
def _(spark, sf):
    built = R.RangeRollup.build(events(spark, sf), "event_id", "value", BLOCK, None, F.floor(F.col("event_id") / BLOCK), levels=4)
    return built.nodes.withColumn("total", F.round("total", 4))


@query("A1_region_counts", f"SELECT event_id // {BLOCK} AS node, event_type AS category, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return rollup(spark, sf).categories


@query("A2_aggregate_global", "SELECT round(sum(value), 4) AS total, count(*) AS n, min(value) AS low, max(value) AS high FROM events")
def _(spark, sf):
    return rollup(spark, sf).aggregate_global().withColumn("total", F.round("total", 4))


def _range_sql(column, lo, hi):
    return f"SELECT round(coalesce(sum({column}), 0), 4)::DOUBLE AS total, count(*) AS n, min({column}) AS low, max({column}) AS high FROM events WHERE event_id BETWEEN {lo} AND {hi}"


@query("A3_aggregate_range", _range_sql("value", LO, HI))
def _(spark, sf):
    return rollup(spark, sf).aggregate_range(LO, HI).withColumn("total", F.round("total", 4))


@query("A3_one_block", _range_sql("value", 300, 310))
def _(spark, sf):
    return rollup(spark, sf).aggregate_range(300, 310).withColumn("total", F.round("total", 4))


@query("A3_empty_range", _range_sql("value", -5, -1))
def _(spark, sf):
    return rollup(spark, sf).aggregate_range(-5, -1).withColumn("total", F.round("total", 4))


@query("A4_region_count", "SELECT 'error' AS category, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'absent', count(*) FROM events WHERE event_type = 'absent'")
def _(spark, sf):
    r = rollup(spark, sf)
    one = lambda v: r.category_count(v).select(F.lit(v).alias("category"), "n")
    return one("error").unionByName(one("absent"))


@query("A5_region_count_range", f"SELECT count(*) AS n FROM events WHERE event_type = 'click' AND event_id BETWEEN {LO} AND {HI}")
def _(spark, sf):
    return rollup(spark, sf).category_count_range("click", LO, HI)


@query("A6_off_axis_count", "SELECT count(*) AS n FROM events WHERE user_id = 7")
def _(spark, sf):
    return R.equal_count(events(spark, sf), "user_id", 7)


@query("F14_prune_correlated", "SELECT count(*) AS n FROM events WHERE event_id * 0.1 + value > 400")
def _(spark, sf):
    return rollup(spark, sf, "trend").filter_count("gt", 400.0)


@query("F14_prune_independent", "SELECT count(*) AS n FROM events WHERE value < 20")
def _(spark, sf):
    return rollup(spark, sf).filter_count("lt", 20.0)


@query("F14_prune_with_nulls", "SELECT count(*) AS n FROM events WHERE CASE WHEN event_id % 5000 < 2000 THEN event_id * 0.1 + value WHEN event_id % 2 = 0 THEN event_id * 0.1 + value END > 400")
def _(spark, sf):
    some = F.when((F.col("event_id") % 5000 < 2000) | (F.col("event_id") % 2 == 0), F.col("trend"))
    gaps = events(spark, sf).withColumn("some", some)
    return R.RangeRollup.build(gaps, "event_id", "some", BLOCK, None, F.floor(F.col("event_id") / BLOCK)).filter_count("gt", 400.0)


@query("F15_prune_range_count", f"SELECT count(*) AS n FROM events WHERE event_id BETWEEN {LO} AND {HI}")
def _(spark, sf):
    return rollup(spark, sf).range_count(LO, HI)


@query("A25_range_sum_half_open", "SELECT round(coalesce(sum(value), 0), 4)::DOUBLE AS total FROM events WHERE event_id >= 123 AND event_id < 5678")
def _(spark, sf):
    b = rollup(spark, sf, "value", 32, 32)
    return b.aggregate_range(123, 5677).select(r4(F.col("total"), "total"))


@query("A26_filter_pruned_bytes", f"""WITH b AS (SELECT event_id // 32 AS node, max(value) AS high, count(*) AS n FROM events GROUP BY ALL)
SELECT (SELECT count(*) FROM events WHERE value > 90) AS n, sum(CASE WHEN high > 90 THEN ceil(n * 4 / 128.0) * 128 ELSE 0 END)::BIGINT AS bytes_read, (count(*) * 4)::BIGINT AS bytes_index FROM b""")
def _(spark, sf):
    from manyfold.plans import movement as M

    b = rollup(spark, sf, "value", 32, 32)
    cost = b.nodes.where("level = 0").agg(F.sum(F.when(F.col("high") > 90, M.lines(F.col("n") * 4)).otherwise(0)).cast("long").alias("bytes_read"), (F.count(F.lit(1)) * 4).alias("bytes_index"))
    return b.filter_count("gt", 90.0).crossJoin(cost)  # one row each


@query("A27_prefix_sums", f"SELECT event_id // {BLOCK} AS block, round(coalesce(sum(sum(value)) OVER (ORDER BY event_id // {BLOCK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4)::DOUBLE AS upto, round(sum(value), 4) AS total FROM events GROUP BY event_id // {BLOCK}")
def _(spark, sf):
    return R.prefix_sums(events(spark, sf), "event_id", "value", BLOCK).select("block", r4(F.col("upto"), "upto"), r4(F.col("total"), "total"))


@query("W3_running_total", "SELECT event_type, event_id // 4096 AS block, round(sum(sum(value)) OVER (PARTITION BY event_type ORDER BY event_id // 4096), 4) AS running FROM events GROUP BY event_type, event_id // 4096")
def _(spark, sf):
    from pyspark.sql import Window

    sums = events(spark, sf).groupBy("event_type", F.floor(F.col("event_id") / 4096).alias("block")).agg(F.sum("value").alias("s"))
    return sums.select("event_type", "block", r4(F.sum("s").over(Window.partitionBy("event_type").orderBy("block")), "running"))


@query("J9_batch_range_sums", """WITH q AS (SELECT range AS query, range % 300 AS lo, range % 300 + 1 + range % 7 AS hi FROM range(600)), m AS (SELECT max(event_id) // 32 + 1 AS blocks FROM events)
SELECT query, round(coalesce(sum(value), 0), 3)::DOUBLE AS total FROM q CROSS JOIN m LEFT JOIN events ON event_id >= lo * 32 AND event_id < hi * 32 WHERE lo <= blocks AND hi <= blocks GROUP BY query""")
def _(spark, sf):
    q = spark.range(600).select(F.col("id").alias("query"), (F.col("id") % 300).alias("lo"), (F.col("id") % 300 + 1 + F.col("id") % 7).alias("hi"))
    e = events(spark, sf)
    blocks = F.broadcast(e.agg((F.floor(F.max("event_id") / 32) + 1).alias("blocks")))  # one row
    q = q.join(blocks, (F.col("lo") <= F.col("blocks")) & (F.col("hi") <= F.col("blocks"))).drop("blocks")  # as the SQL asks
    return R.batch_range_sums(e, q, "event_id", "value", 32).select("query", F.round("total", 3).alias("total"))


@query("A34_percentiles", "SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99 FROM events")
def _(spark, sf):
    return events(spark, sf).agg(*(F.expr(f"percentile(value, {p})").alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))))


@query("E1_cube", f"SELECT event_id // 4096 AS block, event_type, count(*) AS n, grouping_id(event_id // 4096, event_type)::BIGINT AS gid FROM events GROUP BY CUBE (event_id // 4096, event_type)")
def _(spark, sf):
    e = events(spark, sf).withColumn("block", F.floor(F.col("event_id") / 4096))
    return e.cube("block", "event_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("gid"))

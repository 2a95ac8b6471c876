"""Trees of timed spans: by service, by self time, along the critical path, under a span.

spans: (span_id, parent_id, service, dur_us, status, seq), one row a span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.storage import settle


def root(spans: DataFrame) -> DataFrame:
    """The first span without a parent."""
    return spans.where(F.col("parent_id").isNull()).groupBy().agg(F.min(F.struct("seq", "span_id")).alias("m")).select(F.col("m.span_id").alias("span_id")).where("span_id is not null")


def children_time(spans: DataFrame) -> DataFrame:
    """(parent, children, child_us): spans with the same parent, summed."""
    return spans.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("parent")).agg(F.count(F.lit(1)).alias("children"), F.sum("dur_us").alias("child_us"))


def self_time(spans: DataFrame) -> DataFrame:
    """``spans`` with self_us: the duration less that of the direct children; negative where they overlap."""
    kids = children_time(spans).select("parent", "child_us")
    return spans.join(kids, spans["span_id"] == kids["parent"], "left").withColumn("self_us", F.col("dur_us") - F.coalesce("child_us", F.lit(0))).drop("parent", "child_us")


def by_service(spans: DataFrame) -> DataFrame:
    return spans.groupBy("service").agg(F.count(F.lit(1)).alias("spans"), F.sum("dur_us").alias("total_us"), F.count_if(F.col("status") == "error").alias("errors"))


def slowest(spans: DataFrame, k: int = 5) -> DataFrame:
    return self_time(spans).orderBy(F.desc("self_us"), "seq").limit(k)


def longest_child(spans: DataFrame) -> DataFrame:
    """(parent, child): the longest child of each span, the first of equal ones."""
    best = spans.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("parent")).agg(F.max(F.struct("dur_us", (-F.col("seq")).alias("s"), F.col("span_id").alias("id"))).alias("m"))
    return best.select("parent", F.col("m.id").alias("child"))


def _rounds(spans: DataFrame) -> int:
    """Doublings after which any way without a cycle has ended."""
    return max(1, spans.count()).bit_length() + 1


def critical_path(spans: DataFrame) -> DataFrame:
    """(span_id, depth) from the root down, always to the longest child.

    Each round doubles what is known of the way and the reach of the jumps along it, so a path of any depth takes
    as many rounds as its length has bits. ValueError if span ids repeat so that the way runs in a circle.
    """
    jump = settle(longest_child(spans).toDF("from", "to"))
    way = settle(root(spans).withColumn("depth", F.lit(0)))
    for k in range(_rounds(spans)):
        reach = 1 << k
        found = settle(way.join(jump, way["span_id"] == jump["from"]).select(F.col("to").alias("span_id"), (F.col("depth") + reach).cast("int").alias("depth")))
        if found.isEmpty():
            return way
        way = settle(way.unionByName(found))
        twice = jump.select(F.col("from").alias("mid"), F.col("to").alias("end"))
        jump = settle(jump.join(twice, jump["to"] == twice["mid"]).select("from", F.col("end").alias("to")))
    raise ValueError("the way down runs in a circle")


def subtree(spans: DataFrame, span_id) -> DataFrame:
    """(span_id, depth) of a span and all below it, at any depth; nothing for an unknown one. A cycle ends where it meets the span again.

    Every span points to an ancestor, twice as far up each round, until the wanted one lies within reach; spans whose
    ancestors end before drop out.
    """
    known = F.when(F.col("span_id") == span_id, 0).when(F.col("parent_id") == span_id, 1).cast("int")
    state = settle(spans.select("span_id", F.col("parent_id").alias("up"), known.alias("depth")).where("depth is not null or up is not null"))
    for k in range(_rounds(spans)):
        reach = 1 << k
        above = state.select(F.col("span_id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        open_ = state.where("depth is null").join(above, F.col("up") == F.col("_id")).select("span_id", F.col("_up").alias("up"), (F.col("_depth") + reach).cast("int").alias("depth"))
        done = state.where("depth is not null")
        after = settle(done.unionByName(open_.where("depth is not null or up is not null")))
        if after.where("depth is not null").count() == done.count():
            break
        state = after
    return state.where("depth is not null").select("span_id", "depth").distinct()


def with_payload(found: DataFrame, payloads: DataFrame) -> DataFrame:
    """Found spans with their payload: the small side decides what is read."""
    return found.join(payloads, "span_id")

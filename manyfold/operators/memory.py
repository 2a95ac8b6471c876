"""Topic memories: summaries, recall, what is new, and where a memory comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topic_summary(memories: DataFrame) -> DataFrame:
    """(topic, n, kinds, tmin, tmax, latest): kinds counts each kind; latest is 80 characters of the newest text, the last written of equal times."""
    kinds = memories.groupBy("topic", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("tmin"), F.max("ts").alias("tmax"), F.max(F.struct("ts", "seq", F.substring("text", 1, 80).alias("text"))).alias("last"))
    out = kinds.groupBy("topic").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"), F.min("tmin").alias("tmin"), F.max("tmax").alias("tmax"), F.max("last").alias("last"))
    return out.select("topic", "n", "kinds", "tmin", "tmax", F.col("last.text").alias("latest"))


def recall(memories: DataFrame, topic) -> DataFrame:
    """Rows of one topic: the files of the store that hold it; none if nobody has heard of it."""
    return memories.where(F.col("topic") == topic)


def since(memories: DataFrame, t, summary: DataFrame | None = None) -> DataFrame:
    """Rows at t or later by time; with the topics' summary, topics that ended before are not opened."""
    if summary is not None:
        memories = memories.join(summary.where(F.col("tmax") >= t).select("topic"), "topic", "left_semi")
    return memories.where(F.col("ts") >= t).orderBy("ts", "topic", "seq")


def id_index(memories: DataFrame) -> DataFrame:
    """(id, topic): the last topic that an id was written under."""
    return memories.groupBy("id").agg(F.max(F.struct("seq", "topic")).alias("m")).select("id", F.col("m.topic").alias("topic"))


def provenance(memories: DataFrame, index: DataFrame, memory_id) -> DataFrame:
    """(id, topic, source, ts, kind) of the first row of that id in its topic; no row if unknown. The topic found in the index then bounds what is read."""
    hit = index.where(F.col("id") == memory_id).first()
    rows = memories.where((F.col("id") == memory_id) & (F.col("topic") == hit.topic) if hit else F.lit(False))
    return rows.groupBy("id", "topic").agg(F.min(F.struct("seq", "source", "ts", "kind")).alias("m")).select("id", "topic", "m.source", "m.ts", "m.kind")

"""Measures over arrays and votes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.functions import running
from manyfold.storage import settle


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    """Shares of the sum; a zero sum gives nulls."""
    s = total(a)
    return F.transform(a, lambda x: F.try_divide(x, s))


def entropy(p: Column) -> Column:
    """In bits; zero shares count nothing."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits, the square of the distance of that name."""
    part = lambda a, b: F.when(a > 0, a * F.log2(a / ((a + b) / 2))).otherwise(0.0)
    return total(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pair_features(u: Column, v: Column) -> Column:
    """u, v, their distance and their product, one after another."""
    return F.concat(u, v, F.zip_with(u, v, lambda x, y: F.abs(x - y)), F.zip_with(u, v, lambda x, y: x * y))


def ewma_flags(readings: DataFrame, key: str, time: str, value: str, keep: float = 0.9, limit: float = 0.25) -> DataFrame:
    """(key, time, value, baseline, flag): each key's readings in order against a running mean that every reading then moves.

    The first reading is its own baseline and never flagged; readings of one time are taken by value. Readings are ranged by key and time, so a key of any length is
    dealt to many tasks. What a range does to the baseline that enters it is linear, so one pass sums each range up,
    two rows a range come to the driver, and a second pass begins each range with the baseline it inherits.
    """
    rows = readings.select(F.col(key).alias("k"), F.col(time).cast("bigint").alias("t"), F.col(value).cast("double").alias("x"))
    ranged = settle(rows.repartitionByRange("k", "t", "x").sortWithinPartitions("k", "t", "x").withColumn("part", F.spark_partition_id()))
    kind = ranged.schema["k"].dataType.simpleString()
    # what a baseline and the readings before each of width places count there, and after the last
    width = 64
    gap = np.arange(width + 1)[:, None] - 1 - np.arange(width)[None, :]
    own, others = keep ** np.arange(width + 1), np.where(gap >= 0, (1 - keep) * keep ** np.maximum(gap, 0), 0.0)

    def baselines(x: np.ndarray, base: float) -> tuple[np.ndarray, float]:
        """The baseline that each reading meets, and the one it leaves behind: some places at a time, by their closed form."""
        out = np.empty(len(x))
        for at in range(0, len(x), width):
            part = x[at : at + width]
            n = len(part)
            b = base * own[: n + 1] + others[: n + 1, :n] @ part
            out[at : at + n], base = b[:n], float(b[n])
        return out, base

    def runs(batch: pa.RecordBatch):
        """(key, readings) of neighbours of one key."""
        k, x = batch.column("k"), batch.column("x").to_numpy(zero_copy_only=False)
        codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield k[a].as_py(), x[a:b]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = [], None  # (key, its first reading, readings, baseline out of 0) of the first and the last key
        for batch in batches:
            for k, x in runs(batch):
                part = batch.column("part")[0].as_py()
                if not found or found[-1][0] != k:
                    found = found[:1] + [[k, float(x[0]), 0, 0.0]]
                found[-1][2] += len(x)
                found[-1][3] = baselines(x, found[-1][3])[1]
        for nth, (k, first, n, out) in enumerate(found):
            yield pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "k": k, "first": first, "n": n, "out": out}], pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("k", ranged_type), ("first", pa.float64()), ("n", pa.int64()), ("out", pa.float64())]))

    from pyspark.sql.pandas.types import to_arrow_type

    ranged_type = to_arrow_type(ranged.schema["k"].dataType)
    entry, carried = {}, None
    for r in sorted(ranged.mapInArrow(sums, f"part int, nth int, k {kind}, first double, n long, out double").collect(), key=lambda r: (r["part"], r["nth"])):
        base = carried[1] if carried is not None and r["nth"] == 0 and carried[0] == r["k"] else r["first"]
        if r["nth"] == 0:
            entry[r["part"]] = base
        carried = (r["k"], keep ** r["n"] * base + r["out"])

    def flags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, None
        for batch in batches:
            out = []
            for k, x in runs(batch):
                if base is None:
                    now, base = k, entry[batch.column("part")[0].as_py()]
                elif now != k:
                    now, base = k, float(x[0])
                found, base = baselines(x, base)
                out.append(found)
            b = np.concatenate(out) if out else np.zeros(0)
            x = batch.column("x").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), batch.column("x"), pa.array(b), pa.array(np.abs(x - b) > limit)], ["k", "t", "x", "baseline", "flag"])

    out = ranged.mapInArrow(flags, f"k {kind}, t bigint, x double, baseline double, flag boolean")
    return out.select(F.col("k").alias(key), F.col("t").alias(time), F.col("x").alias(value), "baseline", "flag")


def quartile_of(df: DataFrame, value: str, edges: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``df`` with quartile: how many of the exact percentile edges a value reaches."""
    cuts = F.broadcast(df.agg(*(F.expr(f"percentile({value}, {e})").alias(f"_e{i}") for i, e in enumerate(edges))))  # one row
    reached = sum(((F.col(value) >= F.col(f"_e{i}")).cast("int") for i in range(len(edges))), F.lit(0))
    return df.crossJoin(cuts).withColumn("quartile", reached).drop(*(f"_e{i}" for i in range(len(edges))))


def signed_ranks(df: DataFrame, d: str) -> DataFrame:
    """(n, w_plus, w_minus, z) of a paired signed-rank test: zero differences are left out, ties share their mean rank.

    Ranks come from counts of equal sizes summed in order, over the table of different sizes only.
    """
    sizes = df.where(F.col(d) != 0).select(F.abs(F.col(d)).alias("a"), (F.col(d) > 0).cast("int").alias("up"))
    ties = sizes.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("up"))
    ranked = running.before_sorted(ties, "a", "n", "before").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    t = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return t.select("n", "w_plus", "w_minus", ((F.col("w_plus") - n * (n + 1) / 4) / spread).alias("z"))


def weighted_score(weights: dict[str, float], top: float = 3.0) -> Column:
    """Weighted mean of columns from 0 to ``top`` as a share of 100, to one place."""
    return F.round(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / top * 100, 1)


def stance(disagreement: str, collapsed: str, gap: str) -> Column:
    """BUILD, STANCE, or N/A where hardly anyone disagrees."""
    return F.when(F.col(disagreement) <= 1, "N/A").when((F.col(gap) >= 2) & (F.col(collapsed) >= 2), "BUILD").otherwise("STANCE")


def inverted(df: DataFrame, key: str, items: str) -> DataFrame:
    """(item, key) of every item that a row is composed of, once."""
    return df.select(F.explode(items).alias("item"), key).distinct()

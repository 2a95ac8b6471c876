"""Inputs made from arithmetic, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyfold.functions import running


def scatter(x: Column, seed: int = 0) -> Column:
    """An even-looking number from 0 to 999,999 for a whole number below two billion."""
    return ((x + 1 + seed) * 7919 + ((x + 1 + seed) % 1009) * 104729 + ((x + 1 + seed) % 9973) * 15485863) % 1000003 % 1000000


SCATTER_SQL = "((({x}::BIGINT + 1 + {seed}) * 7919 + (({x}::BIGINT + 1 + {seed}) % 1009) * 104729 + (({x}::BIGINT + 1 + {seed}) % 9973) * 15485863) % 1000003 % 1000000)"


def event_log(spark: SparkSession, n: int, regions: int = 8, block: int = 4096) -> DataFrame:
    """(key, region, val_trend, val_rand) sorted by key: gaps of 1 to 19, a value that rises with the key, one that doesn't.

    Keys are running sums of the gaps: summed per block first, so that no window spans the table.
    """
    rows = spark.range(n).select("id", (scatter(F.col("id")) % 19 + 1).alias("gap"), F.floor(F.col("id") / block).alias("block"))
    sums = rows.groupBy("block").agg(F.sum("gap").alias("s"))
    before = running.before(sums, "block", "s", "before", block, (0, max(0, n - 1) // block)).select("block", "before")
    within = F.sum("gap").over(Window.partitionBy("block").orderBy("id"))
    keyed = rows.withColumn("within", within).join(before, "block").withColumn("key", F.col("before") + F.col("within"))
    noise = scatter(F.col("id"), 77) % 601 / 10.0 - 30
    return keyed.select("key", (scatter(F.col("id"), 5) % regions).cast("byte").alias("region"), (F.col("key") * 0.1 + noise).alias("val_trend"), (scatter(F.col("id"), 9) / 1000.0).alias("val_rand"))


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(y, x) of every pixel."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def image(spark: SparkSession, kind: str, height: int, width: int) -> DataFrame:
    """(y, x, v) of a procedural picture, v from 0 to 255."""
    px = grid(spark, height, width)
    y, x = F.col("y"), F.col("x")
    kinds = {
        "flat": F.lit(90),
        "gradient": F.floor(255 * (x + y) / max(1, height + width - 2)),
        "shapes": F.when((x >= width / 4) & (x < width / 2) & (y >= height / 4) & (y < height / 2), 200).when((x - 3 * width / 4) * (x - 3 * width / 4) + (y - height / 2) * (y - height / 2) < F.lit(height * height / 36), 140).otherwise(30),
        "noise": scatter(y.cast("long") * width + x, 3) % 256,
        "smooth": F.floor(128 + 60 * F.sin(x / 9.0) + 50 * F.cos(y / 13.0)),
        "checker": F.when((F.floor(x / 8) + F.floor(y / 8)) % 2 == 0, 220).otherwise(20),
        "rings": F.floor(127 + 120 * F.sin(F.sqrt((x - width / 2) * (x - width / 2) + (y - height / 2) * (y - height / 2)) / 3.0)),
    }
    if kind not in kinds:
        raise ValueError(f"no picture called {kind!r}; there are {sorted(kinds)}")
    return px.select("y", "x", kinds[kind].cast("int").alias("v"))


def rectangles(spark: SparkSession, height: int, width: int, boxes: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(y, x, v): boxes (y, x, h, w, v) painted in order on 0; a later box covers an earlier one."""
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "nth int, by int, bx int, bh int, bw int, bv int")
    px = grid(spark, height, width)
    hits = px.join(F.broadcast(table), (px["y"] >= F.col("by")) & (px["y"] < F.col("by") + F.col("bh")) & (px["x"] >= F.col("bx")) & (px["x"] < F.col("bx") + F.col("bw")), "left")  # boxes are the caller's list
    return hits.groupBy("y", "x").agg(F.coalesce(F.max_by("bv", "nth"), F.lit(0)).alias("v"))


def sensor_grid(spark: SparkSession, windows: int, nodes: int) -> DataFrame:
    """(w, node, energy, is_anom): about 1, now and then half as much again."""
    px = spark.range(windows * nodes).select(F.floor(F.col("id") / nodes).cast("int").alias("w"), (F.col("id") % nodes).cast("int").alias("node"), F.col("id"))
    odd = scatter(F.col("id"), 11) % 50 == 0
    energy = F.lit(1.0) + (scatter(F.col("id"), 4) % 100 - 50) / 1000.0 + F.when(odd, 0.5).otherwise(0.0)
    return px.select("w", "node", energy.alias("energy"), odd.alias("is_anom"))

"""Coded pictures on disk: a head that says how to read them, and the nodes in a folder for each level.

A reader checks the head before it trusts the nodes, and opens only the levels that it is asked for.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyfold.operators import raster as R

FORMAT, COLORS = "manyfold tree 1", ("gray", "rgb")
HEAD = "format string, colors string, width int, height int, levels int, lossy boolean, means boolean, wide boolean, threshold double, root string, sizes array<struct<level:int,structure:bigint,data:bigint>>"


@dataclass(frozen=True)
class Head:
    """What holds for a whole picture. wide: types take a byte an internal node's child instead of two bits."""

    width: int
    height: int
    levels: int
    lossy: bool = False
    means: bool = True
    wide: bool = False
    threshold: float = 0.0
    colors: str = "gray"
    root: str = "INTERNAL"


def level_table(tree: DataFrame, head: Head) -> DataFrame:
    """(level, structure, data): bytes of structure and of payload by level; every node counts once, whatever its channels."""
    nodes = tree.select("level", "i", "j", "type").distinct()
    return nodes.groupBy("level").agg((F.count_if(F.col("type") == "INTERNAL") * (4 if head.wide else 1)).alias("structure"), F.sum(R.payload_bytes(head.means)).cast("long").alias("data"))


def write(tree: DataFrame, head: Head, path: str) -> None:
    """Saves coded nodes (see raster.coded) anew; ValueError for colours or levels that don't fit."""
    if head.colors not in COLORS:
        raise ValueError(f"colours must be one of {COLORS}, not {head.colors!r}")
    if head.levels != R.levels_of(head.height, head.width):
        raise ValueError(f"{head.height} x {head.width} pixels have {R.levels_of(head.height, head.width)} levels, not {head.levels}")
    tree.write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")
    sizes = [(r.level, r.structure, r.data) for r in level_table(tree, head).orderBy("level").collect()]  # a row a level
    spark = tree.sparkSession
    spark.createDataFrame([(FORMAT, head.colors, head.width, head.height, head.levels, head.lossy, head.means, head.wide, head.threshold, head.root, sizes)], HEAD).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def head_of(spark: SparkSession, path: str) -> tuple[Head, list[tuple[int, int, int]]]:
    """The head and the level table, without a look at the nodes; ValueError if what lies there isn't one."""
    found = spark.read.parquet(f"{path}/head")
    wanted = HEAD.split(",")[0].split()[0]
    rows = found.limit(2).collect() if wanted in found.columns else []
    if len(rows) != 1 or rows[0]["format"] != FORMAT:
        raise ValueError(f"{path} is no picture of this format")
    row = rows[0].asDict()
    if row["colors"] not in COLORS:
        raise ValueError(f"unknown colours: {row['colors']!r}")
    sizes = [(x["level"], x["structure"], x["data"]) for x in row["sizes"]]
    return Head(**{k: row[k] for k in asdict(Head(1, 1, 0))}), sizes


def read(spark: SparkSession, path: str, deepest: int | None = None) -> tuple[Head, DataFrame]:
    """The head and the coded nodes, down to level ``deepest``: folders below it are not opened."""
    head, _ = head_of(spark, path)
    nodes = spark.read.schema(R.CODED).parquet(f"{path}/nodes")
    return head, nodes if deepest is None else nodes.where(F.col("level") <= deepest)

"""Where blocks lie in a file, and how often a reader must jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.functions import running


def placed(blocks: DataFrame, order: str, size: str, group: int) -> DataFrame:
    """``blocks`` with off, the bytes before each: summed by runs of ``group`` places, so that no window spans the table."""
    return running.before(blocks, order, size, "off", group)


def seeks(chosen: DataFrame, size: str = "size") -> DataFrame:
    """(seeks, bytes) of reading chosen blocks in order: a jump wherever one doesn't begin where another ends."""
    ends = chosen.select((F.col("off") + F.col(size)).alias("off"))
    jumps = chosen.join(ends, "off", "left_anti").agg(F.count(F.lit(1)).alias("seeks"))
    return jumps.crossJoin(chosen.agg(F.sum(size).alias("bytes")))  # one row each

"""Running sums in an order of the whole table, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyfold.storage import settle

#: Rows that a window has at most.
WIDTH = 4096


def before(df: DataFrame, place: str, value: str, name: str, width: int = WIDTH, ends: tuple[int, int] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``place``, a whole number that no two rows share; 0 for the first.

    Places are summed up by runs of ``width``, runs by runs of runs, until one run holds all. ends: the least and greatest place, if known.
    """
    if ends is None:
        df = settle(df)
        ends = df.agg(F.min(place), F.max(place)).first()
    lo, hi = ends
    if lo is None or hi - lo < width:
        window = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)  # width rows
        return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))
    run, own, rest = (f"_{name}_{x}" for x in ("run", "sum", "within"))
    rows = df.withColumn(run, F.expr(f"(`{place}` - {lo}) div {width}"))
    runs = rows.groupBy(run).agg(F.sum(value).alias(own))
    above = before(runs, run, own, f"_{name}_above", width, (0, (hi - lo) // width)).select(run, f"_{name}_above")
    window = Window.partitionBy(run).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn(rest, F.coalesce(F.sum(value).over(window), F.lit(0)))
    return within.join(above, run).withColumn(name, F.col(f"_{name}_above") + F.col(rest)).drop(run, rest, f"_{name}_above")


def before_sorted(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The same for rows with different values of any sortable column: ranged by it, summed within each range, and shifted by what the ranges before hold."""
    ranged = settle(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    shift = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))  # one row a partition
    window = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_within", F.coalesce(F.sum(value).over(window), F.lit(0))).join(F.broadcast(shift), "_part").withColumn(name, F.col("_shift") + F.col("_within")).drop("_part", "_within", "_shift")

"""Range aggregates from a positional rollup: blocks of rows in key order, folded two by two.

``nodes`` holds one row per level and node with sum, min, max, count and the key bounds of
everything below it; ``categories`` the counts of each category. A range is answered by the
coarsest nodes that lie in it, and by raw rows of the blocks at its edges only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyfold.functions import running
from manyfold.storage import settle

#: Levels that are folded together, and edge blocks that are named in a filter; sorted keys have two at most.
STEP, EDGES = 8, 64

OPERATORS = {"gt": lambda c, t: c > t, "lt": lambda c, t: c < t}


def threshold(column: str, op: str, value) -> Column:
    """column > value or column < value, by name of the operator."""
    if op not in OPERATORS:
        raise ValueError(f"operator must be one of {sorted(OPERATORS)}, not {op!r}")
    return OPERATORS[op](F.col(column), value)


def full_sum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(column).alias("total"))


def range_sum(df: DataFrame, key: str, column: str, lo, hi) -> DataFrame:
    """Sum over keys from lo to hi, both included; 0 for an empty range."""
    return df.where(F.col(key).between(lo, hi)).agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("total"))


def filter_count(df: DataFrame, column: str, op: str, value) -> DataFrame:
    return df.where(threshold(column, op, value)).agg(F.count(F.lit(1)).alias("n"))


def equal_count(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value).agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, key: str, block: int) -> DataFrame:
    """``df`` with block_id, the place in key order divided by ``block``.

    Rows are ranged by key, counted within each range, and shifted by what the ranges before hold:
    no window ever spans the table. A key of many rows is dealt to many ranges by a number of each row.
    """
    rows = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    ranged = settle(rows.repartitionByRange(key, "_row").sortWithinPartitions(key, "_row").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key, "_row")) - 1
    out = ranged.withColumn("_at", within).join(F.broadcast(before.select("_part", "_before")), "_part")
    return out.withColumn("block_id", F.floor((F.col("_at") + F.coalesce("_before", F.lit(0))) / block).cast("long")).drop("_part", "_before", "_at", "_row")


def _folded(df: DataFrame, by: list[Column], raw: bool, key: str, column: str) -> DataFrame:
    if raw:
        aggs = [F.sum(column).alias("total"), F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("n"), F.count(column).alias("filled"), F.min(key).alias("kmin"), F.max(key).alias("kmax")]
    else:
        aggs = [F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.min("kmin").alias("kmin"), F.max("kmax").alias("kmax")]
    return df.groupBy(*by).agg(*aggs)


@dataclass
class RangeRollup:
    """Reads of one value column over one key. ``base`` carries block_id; nodes and categories are small."""

    base: DataFrame
    key: str
    column: str
    nodes: DataFrame
    categories: DataFrame | None = None
    category: str | None = None

    @classmethod
    def build(cls, df: DataFrame, key: str, column: str, block: int = 1024, category: str | None = None, block_id: Column | None = None, fanout: int = 2, levels: int | None = None) -> RangeRollup:
        """block_id: a column that numbers the blocks by itself, where the key is dense; else rows are numbered by key."""
        base = df.withColumn("block_id", block_id.cast("long")) if block_id is not None else numbered(df, key, block)
        level = settle(_folded(base, [F.col("block_id").alias("node")], True, key, column).withColumn("level", F.lit(0)))
        if levels is None:
            last = level.agg(F.max("node")).first()[0] or 0
            levels, width = 0, last + 1
            while width > 1:
                width = -(-width // fanout)
                levels += 1
        # some levels at once from the lowest of them: one shuffle a step, each of a table that the step before has shrunk
        nodes, lowest = level, 0
        while lowest < levels:
            highest = min(levels, lowest + STEP)
            up = level.withColumn("_up", F.explode(F.sequence(F.lit(1), F.lit(highest - lowest))))
            above = _folded(up, [(F.lit(lowest) + F.col("_up")).alias("level"), F.expr(f"node div cast(pow({fanout}, _up) as bigint)").alias("node")], False, key, column)
            above = settle(above)
            nodes, level, lowest = nodes.unionByName(above), above.where(F.col("level") == highest), highest
        counts = None
        if category is not None:
            counts = base.groupBy(F.col("block_id").alias("node"), F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
        self = cls(base, key, column, nodes.select("level", "node", "total", "low", "high", "n", "filled", "kmin", "kmax"), counts, category)
        self.fanout = fanout
        return self

    fanout = 2

    def write(self, path: str) -> None:
        """Base sorted by key in small row groups, so that a reader can skip; the rollup beside it."""
        rows = self.base.repartitionByRange("block_id").sortWithinPartitions(self.key)
        rows.write.mode("overwrite").option("parquet.block.row.count.limit", "16384").option("parquet.page.row.count.limit", "1024").parquet(f"{path}/base")
        self.nodes.repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.mode("overwrite").parquet(f"{path}/nodes")
        if self.categories is not None:
            self.categories.repartitionByRange("category", "node").sortWithinPartitions("category", "node").write.mode("overwrite").parquet(f"{path}/categories")

    @classmethod
    def read(cls, spark, path: str, key: str, column: str, category: str | None = None, fanout: int = 2) -> RangeRollup:
        load = lambda name: spark.read.parquet(f"{path}/{name}")
        self = cls(load("base"), key, column, load("nodes"), load("categories") if category else None, category)
        self.fanout = fanout
        return self

    def _inside(self, lo, hi) -> Column:
        return (F.col("kmin") >= lo) & (F.col("kmax") <= hi)

    def cover(self, lo, hi) -> DataFrame:
        """The coarsest nodes that lie in the range: inside, under a parent that isn't."""
        inside = self.nodes.where(self._inside(lo, hi))
        parent = inside.select((F.col("level") - 1).alias("level"), F.col("node").alias("_parent"))
        held = inside.withColumn("_parent", F.floor(F.col("node") / self.fanout))
        return held.join(parent, ["level", "_parent"], "left_anti").drop("_parent")

    def edges(self, lo, hi) -> DataFrame:
        """(block_id) of blocks that reach into the range without lying in it: two at most where keys are sorted."""
        reach = (F.col("kmax") >= lo) & (F.col("kmin") <= hi) & ~self._inside(lo, hi)
        return self.nodes.where((F.col("level") == 0) & reach).select(F.col("node").alias("block_id"))

    def _edge_rows(self, lo, hi) -> DataFrame:
        """Rows of the edge blocks within the range: a filter on their numbers, or a join if keys are so unsorted that there are many."""
        edges = self.edges(lo, hi)
        blocks = [r.block_id for r in edges.limit(EDGES + 1).collect()]
        rows = self.base.where(F.col(self.key).between(lo, hi))
        if len(blocks) > EDGES:
            return rows.join(edges, "block_id", "left_semi")
        return rows.where(F.col("block_id").isin(blocks)) if blocks else rows.where(F.lit(False))

    def aggregate_range(self, lo, hi) -> DataFrame:
        """(total, n, low, high) of the column over keys lo to hi, both included; an empty range has 0, 0, null, null."""
        inner = self.cover(lo, hi).select("total", "low", "high", "n")
        outer = self._edge_rows(lo, hi).agg(F.sum(self.column).alias("total"), F.min(self.column).alias("low"), F.max(self.column).alias("high"), F.count(F.lit(1)).alias("n"))
        both = inner.unionByName(outer)
        return both.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def aggregate_global(self) -> DataFrame:
        """From the nodes alone; all null and 0 for an empty table."""
        top = self.nodes.where(F.col("level") == 0)
        return top.agg(F.sum("total").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def range_count(self, lo, hi) -> DataFrame:
        """Rows with keys from lo to hi: counts of covered nodes, and of the edge rows."""
        both = self.cover(lo, hi).select("n").unionByName(self._edge_rows(lo, hi).agg(F.count(F.lit(1)).alias("n")))
        return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def filter_count(self, op: str, value) -> DataFrame:
        """Rows above or below a value: blocks entirely on one side are counted or skipped, the rest are read. A null is on neither side."""
        threshold(self.column, op, value)
        whole, none = ((F.col("low") > value), (F.col("high") <= value)) if op == "gt" else ((F.col("high") < value), (F.col("low") >= value))
        blocks = self.nodes.where(F.col("level") == 0)
        counted = blocks.where(whole).agg(F.coalesce(F.sum("filled"), F.lit(0)).alias("n"))
        mixed = blocks.where(~whole & ~none).select(F.col("node").alias("block_id"))
        read = self.base.join(mixed, "block_id", "left_semi").where(threshold(self.column, op, value)).agg(F.count(F.lit(1)).alias("n"))
        return counted.unionByName(read).agg(F.sum("n").alias("n"))

    def category_count(self, value) -> DataFrame:
        """From the counts alone; 0 outside the domain."""
        return self.categories.where(F.col("category") == value).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def category_count_range(self, value, lo, hi) -> DataFrame:
        inside = self.nodes.where((F.col("level") == 0) & self._inside(lo, hi)).select("node")
        inner = self.categories.where(F.col("category") == value).join(inside, "node", "left_semi").select("n")
        outer = self._edge_rows(lo, hi).where(F.col(self.category) == value).agg(F.count(F.lit(1)).alias("n"))
        return inner.unionByName(outer).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def prefix_sums(df: DataFrame, order: str, value: str, block: int, also: DataFrame | None = None) -> DataFrame:
    """(block, upto, total): sums of blocks of ``order`` and of all blocks before, ordered run by run.

    Blocks in ``also`` (block) that hold no rows get a row too, of total 0.
    """
    sums = df.groupBy(F.floor(F.col(order) / block).alias("block")).agg(F.sum(value).alias("total"))
    if also is not None:
        sums = sums.unionByName(also.select("block").distinct().join(sums, "block", "left_anti").withColumn("total", F.lit(0)))
    return running.before(sums, "block", "total", "upto").select("block", "upto", "total")


def batch_range_sums(df: DataFrame, ranges: DataFrame, order: str, value: str, block: int) -> DataFrame:
    """(query, total) of half-open block-aligned ranges (query, lo, hi): two equi-joins with the prefix sums, of which every bound has one."""
    bounds = ranges.select(F.explode(F.array("lo", "hi")).alias("block")).where("block is not null")
    prefix = prefix_sums(df, order, value, block, bounds)
    out = ranges.join(prefix.select(F.col("block").alias("lo"), F.col("upto").alias("u_lo")), "lo").join(prefix.select(F.col("block").alias("hi"), F.col("upto").alias("u_hi")), "hi")
    return out.select("query", (F.col("u_hi") - F.col("u_lo")).alias("total"))

"""Tables whose hierarchy is a dotted name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tensor(tensors: DataFrame, name: str) -> DataFrame:
    return tensors.where(F.col("name") == name)


def prefix(tensors: DataFrame, path: str) -> DataFrame:
    """Everything under a path: whole parts of the name only, so layers.1 isn't layers.10."""
    return tensors.where(F.col("name").startswith(path if path.endswith(".") else path + "."))


def layer(tensors: DataFrame, i: int, root: str = "model") -> DataFrame:
    return prefix(tensors, f"{root}.layers.{i}")


def expert(tensors: DataFrame, i: int, e: int, root: str = "model") -> DataFrame:
    return prefix(tensors, f"{root}.layers.{i}.mlp.experts.{e}")


def summary(tensors: DataFrame) -> DataFrame:
    """(name, dtype, nbytes, mb) without reading any data."""
    return tensors.select("name", "dtype", "nbytes", F.round(F.col("nbytes") / 1e6, 2).alias("mb"))


def total(tensors: DataFrame) -> DataFrame:
    return tensors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("nbytes"), F.lit(0)).alias("nbytes"), F.round(F.coalesce(F.sum("nbytes"), F.lit(0)) / 1e6, 1).alias("mb"))

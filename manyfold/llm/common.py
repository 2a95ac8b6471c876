"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of every row; a null text counts as empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def ready_to_checkpoint(spark: SparkSession) -> None:
    """checkpoint() writes where spark.checkpoint.dir says; a folder of our own serves only where none is set and driver and executors are one machine."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="manyfold-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared checkpoint folder."""
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def nested(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with all its columns in one struct, row, beside ``columns``: so no name of its own can clash with one of ours."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *columns)


def spread_join(rows: DataFrame, groups: DataFrame, key: list[str], size: str, how: str = "left", share: int = 1024) -> DataFrame:
    """``rows`` joined with ``groups``, one row per key, whose column ``size`` says how many rows have the key.

    Keys of more than one in ``share`` rows are fewer than ``share``, so they are broadcast; the others are dealt by key,
    and none of them is hot. Both tables should be cut, since both are read more than once.
    """
    total = rows.count()
    hot = groups.where(F.col(size) * share > total)
    left = F.broadcast(hot.select(*(F.col(k).alias(f"_hot{i}") for i, k in enumerate(key))))
    rest = rows.join(left, [rows[k] == left[f"_hot{i}"] for i, k in enumerate(key)], "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(groups.where(F.col(size) * share <= total), key, how))


def slices(batches: Iterable[pa.RecordBatch], chars: int, text_at: int = 1) -> Iterator[tuple[list, list]]:
    """(ids, texts) of runs of rows; a run ends once its texts pass ``chars`` bytes, so a very long text stands almost alone."""
    ids: list = []
    texts: list = []
    held = 0
    for batch in batches:
        i_col, t_col = batch.column(0), batch.column(text_at)
        for i in range(batch.num_rows):
            text = t_col[i].as_py()
            ids.append(i_col[i].as_py())
            texts.append(text or "")
            held += len(texts[-1])
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
    trim()


def trim() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can: workers live on between tasks."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)

"""Write-once stores as Parquet: a light table to look things up in, heavy rows beside it.

Every reader names its schema, so a folder that holds something else is an error and not a guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "items": "item_id string, substrate binary",
    "labels": "item_id string, label struct<class:int,confidence:double,bbox:array<int>>, seq bigint, annotator string",
    "beliefs": "agent string, fact string, value string, confidence double, ts bigint, seq bigint",
    "memories": "id string, ts double, kind string, text string, source string, meta map<string,string>, seq bigint, topic string",
    "spans": "span_id string, parent_id string, service string, operation string, start_us bigint, dur_us bigint, status string, seq bigint",
    "payloads": "span_id string, attributes map<string,string>, events array<struct<ts_us:bigint,name:string,level:string,message:string>>",
    "places": "id string, topic string",
    "tensors": "name string, shape array<int>, dtype string, codec string, nbytes bigint, data binary",
}
#: The column that a store's folders are named by.
FOLDERS = {"labels": "annotator"}
#: What the other stores are ranged and sorted by, so that readers skip the files and row groups that they don't ask for.
SORTED = {"tensors": ["name"], "spans": ["service", "start_us"], "items": ["item_id"], "payloads": ["span_id"], "beliefs": ["fact", "agent", "seq"], "memories": ["topic", "seq"], "places": ["id"]}


def schema_of(store: str) -> StructType:
    if store not in SCHEMAS:
        raise ValueError(f"no store called {store!r}; there are {sorted(SCHEMAS)}")
    return StructType.fromDDL(SCHEMAS[store])


def write(df: DataFrame, store: str, path: str) -> None:
    """Saves a whole store anew; columns must be the store's."""
    wanted = schema_of(store)
    if set(df.columns) != set(wanted.names):
        raise ValueError(f"{store} has columns {wanted.names}, not {df.columns}")
    df = df.select(*(F.col(f.name).cast(f.dataType) for f in wanted))
    if store in FOLDERS:
        df.repartitionByRange(FOLDERS[store], "seq").sortWithinPartitions(FOLDERS[store], "seq").write.mode("overwrite").partitionBy(FOLDERS[store]).parquet(path)
    else:
        df.repartitionByRange(*SORTED[store]).sortWithinPartitions(*SORTED[store]).write.mode("overwrite").option("parquet.block.row.count.limit", "8192").parquet(path)


def read(spark: SparkSession, store: str, path: str) -> DataFrame:
    """The store at ``path``; ValueError if what lies there isn't one."""
    wanted = schema_of(store)
    found = spark.read.parquet(path)
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    for f in wanted:
        if f.name not in kinds or (f.name != FOLDERS.get(store) and kinds[f.name] != f.dataType.simpleString()):
            raise ValueError(f"{path} is no {store} store: {f.name} is {kinds.get(f.name)}, not {f.dataType.simpleString()}")
    return spark.read.schema(wanted).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def offsets(sizes: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """``sizes`` with offset, the bytes before each block of a group in order."""
    from pyspark.sql import Window

    before = F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("offset", F.coalesce(before, F.lit(0)))

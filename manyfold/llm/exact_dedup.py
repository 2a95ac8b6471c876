"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at rows that the level before left in a group of two or more.
Which keys repeat is handed back to the scan as a bitmap of a fixed number of bits, so
no text is ever shuffled and what is broadcast is at most ``bits / 8`` bytes whatever the
corpus holds. A bit that two keys share lets a row through needlessly; the last
level compares SHA-256 digests, so that costs a hash and never a wrong group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import cut, nested, spread_join, table

BITS = 1 << 23
PREFIX = 256


def _bit_of(*key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits)) + 1


def bitmap_of(keys: DataFrame, names: list[str], bits: int = BITS) -> DataFrame:
    """(bucket, bitmap) of keys: bits / 32768 rows of 4 KB at most."""
    bit = keys.select(_bit_of(*(F.col(n) for n in names), bits=bits).alias("_bit"))
    return bit.groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bitmap"))


def _repeated(keys: DataFrame, names: list[str], bits: int) -> DataFrame:
    """The bitmap of the keys that more than one row has."""
    return bitmap_of(keys.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), names, bits)


def in_bitmap(rows: DataFrame, key: list[Column], seen: DataFrame, bits: int = BITS, name: str = "_found") -> DataFrame:
    """``rows`` with a boolean: the key's bit is set, as it is for every key in the bitmap and for few others."""
    bit = _bit_of(*key, bits=bits)
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    out = rows.withColumn("_probe", F.bitmap_bucket_number(bit)).withColumn("_at", F.bitmap_bit_position(bit))
    out = out.join(F.broadcast(seen), out["_probe"] == seen["_bucket"], "left")
    hit = F.call_function("getbit", byte, F.expr("cast(_at % 8 as int)")) == 1
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_probe", "_at", "_bucket", "_bitmap")


def _survives(rows: DataFrame, key: list[Column], seen: DataFrame, bits: int, alive: Column, name: str) -> DataFrame:
    """``rows`` with a boolean: the row is alive and its key's bit is set."""
    return in_bitmap(rows, key, seen, bits, name).withColumn(name, alive & F.col(name))


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS, digest_all: bool = False) -> DataFrame:
    """(doc_id, nth, n_bytes, prefix_hash, survivor, sha256) per row, null where an earlier level already told the row apart.

    nth is a number of the row's own, so that rows alike in everything can be told apart; read it from a cut table only.

    A null text counts as empty. With ``digest_all`` every row has its SHA-256, for callers
    that report it; the levels are the same.
    """
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    sized = base.withColumn("n_bytes", F.octet_length("_text"))
    seen = cut(_repeated(sized.select("n_bytes"), ["n_bytes"], bits))
    alike = _survives(sized, [F.col("n_bytes")], seen, bits, F.lit(True), "_same_size")
    headed = alike.withColumn("prefix_hash", F.when(F.col("_same_size"), F.xxhash64(F.substring("_text", 1, prefix))))
    seen = cut(_repeated(headed.where("_same_size").select("n_bytes", "prefix_hash"), ["n_bytes", "prefix_hash"], bits))
    left = _survives(headed, [F.col("n_bytes"), F.col("prefix_hash")], seen, bits, F.col("_same_size"), "survivor")
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    return left.select("doc_id", F.monotonically_increasing_id().alias("nth"), "n_bytes", "prefix_hash", "survivor", (digest if digest_all else F.when(F.col("survivor"), digest)).alias("sha256"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, sha256.

    Texts are equal when their code points are; null counts as empty. The largest id of
    a group stays; of rows that repeat both id and text any one is kept, and all count in
    group_size. A null id stays only in a group without any other id.
    An empty table gives no rows. Other columns of ``df`` are ignored.
    """
    rows = cut(signatures(df, id_col, text_col, prefix, bits, digest_all))
    key = ["n_bytes", "prefix_hash", "sha256"]
    stays = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "nth"))
    alike = rows.where("survivor")
    groups = cut(alike.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), stays.alias("_keep")).where("_n > 1"))
    out = rows.where("not survivor").unionByName(spread_join(alike, groups, key, "_n"), allowMissingColumns=True)
    alone = F.col("_n").isNull()
    kept = alone | (F.col("nth") == F.col("_keep.nth"))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "sha256")


def keep_rows(df: DataFrame, decided: DataFrame, key_of, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with their columns.

    decided: (doc_id, key, kept) for every row of ``df``. key_of gives, of a table with the columns row (``df``'s, in a struct) and
    doc_id, the same with the column key. An id that a single row has decides by itself. Of rows that share an id those
    stay whose key is kept, and of rows with the same id and key one: that of the least hash of all its columns, as JSON.
    Rows that a bitmap of the ids in question clears pass straight through; only the others are shuffled for
    the join that decides. Should the bitmap fill up, all of them are.
    """
    ids = cut(decided.groupBy(F.col("doc_id").alias("_id")).agg((F.count(F.lit(1)) > 1).alias("_again"), F.max("kept").alias("_kept")).where("_again or not _kept").drop("_kept"))
    seen = cut(bitmap_of(ids, ["_id"]))
    marked = in_bitmap(nested(df, F.col(f"`{id_col}`").cast("long").alias("doc_id")), [F.col("doc_id")], seen)
    doubtful = marked.where("_found").select("row", "doc_id").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    out = marked.where("not _found").select("row.*").unionByName(doubtful.where("_again is null").select("row.*"))
    again = cut(ids.where("_again"))
    if not again.take(1):
        return out
    lost = decided.join(again, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").groupBy("doc_id", "key").agg(F.max("kept").alias("_kept")).where("not _kept")
    lost = cut(lost.select(F.col("doc_id").alias("_lost"), F.col("key").alias("_key")))
    rivals = key_of(doubtful.where("_again").select("row", "doc_id"))
    rivals = rivals.join(lost, F.col("doc_id").eqNullSafe(F.col("_lost")) & (F.col("key") == F.col("_key")), "left_anti")
    return out.unionByName(rivals.groupBy("doc_id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns: one of each text, by the rules of exact_groups.

    Rows are told apart by id and text, so ids may repeat: of (5, a), (5, b) and (9, a), (5, b) and (9, a) stay. Of rows that repeat
    id and text one stays. Columns may have any names.
    """
    groups = cut(exact_groups(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sha256").alias("key"), "kept"))
    return keep_rows(df, groups, lambda rows: rows.withColumn("key", F.sha2(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).cast("binary"), 256)), id_col)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("sha256", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

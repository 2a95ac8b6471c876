"""Exact top-k inner products by a three-phase uniform threshold.

A vector's score is the sum of local scores, one from each of a few runs of components
("lists"). Queries go in waves of a bounded size, which are broadcast; candidates stay where they are. Phase one gathers
from every list of every partition of candidates its best local entries and takes, per query, a cutoff that k full
scores are known to reach. Phase two broadcasts the cutoffs: an entry can only reach one if in some list
it falls behind that list's best by no more than an equal share of the slack, and those
entries are collected. Phase three adds up just their scores, exactly. A partition returns k rows a query at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import cut, table

LISTS = 4
#: Queries of a wave and bytes of their components, candidates that are worked on together, and queries.
WAVE_ROWS, WAVE_BYTES, CANDIDATE_ROWS, STEP = 16_384, 32_000_000, 8192, 128
LONG = (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vector: Column) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part: no null or non-finite component, no null vector or id."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; what a shorter vector lacks counts as zero."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type in which every sum of products is exact: float32, float64, or Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 1 << 24:
        return q.astype(np.float32), c.astype(np.float32)
    if most < 1 << 53:
        return q, c
    as_int = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return as_int(q), as_int(c)


def _local(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """Local scores per list, queries by candidates."""
    edges = np.linspace(0, q.shape[1], min(lists, max(1, q.shape[1])) + 1).astype(int)
    return [q[:, i:j] @ c[:, i:j].T for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _order(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], int)


def _in_range(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long become the nearest long; only Python's integers can be."""
    return np.array([max(-LONG - 1, min(LONG, x)) for x in scores.tolist()], object) if scores.dtype == object else scores


def gather(q_ids, q, c_ids, c, k: int, lists: int):
    """Phase one: per query, the full scores, k at most, of entries that are best in some list of this block."""
    for at in range(0, len(q_ids), STEP):
        parts = _local(q[at : at + STEP], c, lists)
        for row, own in enumerate(q_ids[at : at + STEP].tolist()):
            found = set()
            for part in parts:
                best = part[row] if part.dtype != object else part[row].astype(float)
                found.update(np.argpartition(-best, k)[: k + 1].tolist() if len(best) > k + 1 else range(len(best)))
            places = np.array([i for i in found if c_ids[i] != own], int)
            yield at + row, heapq.nlargest(k, (int(x) for x in sum(part[row][places] for part in parts)))


def resolve(q_ids, q, cutoffs, c_ids, c, k: int, lists: int):
    """Phases two and three: (query, candidate, score) of what may be among the k best, k at most."""
    for at in range(0, len(q_ids), STEP):
        parts = _local(q[at : at + STEP], c, lists)
        tops = [part.max(axis=1) for part in parts]
        for row, own in enumerate(q_ids[at : at + STEP].tolist()):
            low = cutoffs[at + row]
            if low is None or low <= -LONG - 1:
                low = None
                places = np.arange(len(c_ids))
            else:
                slack = sum(int(t[row]) for t in tops) - low
                if slack < 0:
                    continue
                share = slack // len(parts)  # local scores are whole numbers
                near = parts[0][row] >= int(tops[0][row]) - share
                for part, top in zip(parts[1:], tops[1:], strict=True):
                    near |= part[row] >= int(top[row]) - share
                places = np.flatnonzero(near)
            total = sum(part[row][places] for part in parts)
            if low is not None:
                places, total = places[total >= low], total[total >= low]
            other = c_ids[places] != own
            places, total = places[other], _in_range(total[other])
            for i in _order(total, c_ids[places], k).tolist():
                yield own, int(c_ids[places[i]]), int(total[i])


def _blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(ids, vectors) of so many candidates at a time."""
    held, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            count += held[-1].num_rows
            if count >= rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield whole["vec_id"].to_numpy(), whole["vector"].combine_chunks()
                held, count = [], 0
    if count:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole["vec_id"].to_numpy(), whole["vector"].combine_chunks()


def _meet(q_vectors: pa.Array, c_vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    width = max(int(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for x in (q_vectors, c_vectors))
    return _exact(_matrix(q_vectors, width), _matrix(c_vectors, width))


def _clipped(x: int) -> int:
    return max(-LONG - 1, min(LONG, x))


def _wave(rows: DataFrame, q_ids: np.ndarray, q_vectors: pa.Array, k: int, lists: int, candidate_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of what may be among the k best of each query of the wave."""
    sc = rows.sparkSession.sparkContext
    wave = sc.broadcast((q_ids, q_vectors))

    def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = wave.value
        best: dict[int, list[int]] = {}
        for c_ids, cv in _blocks(batches, candidate_rows):
            q, c = _meet(vectors, cv)
            for at, scores in gather(ids, q, c_ids, c, k, lists):
                best[at] = heapq.nlargest(k, best.get(at, []) + scores)
        got = [(at, scores[-1]) for at, scores in best.items() if len(scores) == k]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int32()), pa.array([_clipped(x[1]) for x in got], pa.int64())], ["at", "low"])

    # as many rows as the wave has come to the driver, and go back as the cutoffs
    lows: list[int | None] = [None] * len(q_ids)
    for r in rows.mapInArrow(one, "at int, low long").groupBy("at").agg(F.max("low").alias("low")).collect():
        lows[r["at"]] = r["low"]
    cutoffs = sc.broadcast(lows)

    def two(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = wave.value
        best: dict[int, list[tuple[int, int]]] = {}
        for c_ids, cv in _blocks(batches, candidate_rows):
            q, c = _meet(vectors, cv)
            fresh: dict[int, list[tuple[int, int]]] = {}
            for own, vec_id, score in resolve(ids, q, cutoffs.value, c_ids, c, k, lists):
                fresh.setdefault(own, []).append((score, -vec_id))
            for own, found in fresh.items():
                best[own] = heapq.nlargest(k, best.get(own, []) + found)
        got = [(own, -i, score) for own, found in best.items() for score, i in found]
        for at in range(0, len(got), 100_000):
            part = got[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(two, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int, lists: int = LISTS, wave_rows: int = WAVE_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): per query its k best rows, fewer if there are fewer, ties to the smaller id.

    rows, queries: (vec_id, vector of whole numbers as doubles), from whole_vectors. A row with the
    query's own id is no candidate. Repeated rows are candidates each; of queries that share an id one, of the least vector, answers. Vectors of
    unequal length are taken as filled up with zeros, so an empty one takes part with score 0; a score beyond a
    long is cut to a long's range. No queries or no rows give no result. Each wave reads the candidates twice and
    shuffles k rows a query and partition at most.
    """
    queries, rows = cut(queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))), cut(rows)
    count, longest = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = max(1, min(wave_rows, WAVE_BYTES // max(8, 8 * longest)))
    waves = -(-count // size)
    dealt = cut(queries.withColumn("wave", F.pmod(F.monotonically_increasing_id(), F.lit(waves)).cast("int")))
    found = None
    for w in range(waves):
        own = dealt.where(F.col("wave") == w).select("vec_id", "vector").toArrow().combine_chunks()
        if own.num_rows:
            part = _wave(rows, own["vec_id"].to_numpy(), own["vector"].combine_chunks(), k, lists, candidate_rows)
            part = part if waves == 1 else cut(_ranked(part, k))
            found = part if found is None else found.unionByName(part)
    return _ranked(found, k) if waves == 1 else found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark, sf_dir: str) -> DataFrame:
    vector = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 64).cast("double"))
    scaled = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = whole_vectors(table(spark, sf_dir, "embeddings").where(F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))), "vec_id", vector)
    return top_k(rows, rows.where("vec_id % 20 = 0"), 20)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""

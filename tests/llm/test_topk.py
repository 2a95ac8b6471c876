import random

import numpy as np
from pyspark.sql import functions as F

from manyfold.llm import topk as X


def brute(rows, queries, k):
    out = set()
    for qid, q in queries:
        scored = []
        for cid, c in rows:
            if cid != qid:
                score = sum(int(a) * int(b) for a, b in zip(q, c, strict=False))
                scored.append((-max(-(1 << 63), min((1 << 63) - 1, score)), cid))
        for rank, (s, cid) in enumerate(sorted(scored)[:k], 1):
            out.add((qid, rank, cid, -s))
    return out


def run(spark, rows, queries, k, **sizes):
    schema = "vec_id long, vector array<double>"
    got = X.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), k, **sizes)
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}


def test_against_all_scores(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-64, 65)) for _ in range(10)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties by the dozen
    queries = [r for r in rows if r[0] % 20 == 0]
    for sizes in ({}, {"wave_rows": 7, "candidate_rows": 50}):
        assert run(spark, rows, queries, 20, **sizes) == brute(rows, queries, 20)


def test_few_uneven_and_huge(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [2.0**53, -(2.0**60)]), (5, [2.0**62, 2.0**62]), (20, [float(2**60), 7.0])]
    assert run(spark, rows, [rows[-1], rows[3]], 3) == brute(rows, [rows[-1], rows[3]], 3)
    assert run(spark, rows[:1], rows[:1], 3) == set()
    assert run(spark, [], rows[:1], 3) == set() == run(spark, rows, [], 3)


def test_waves_are_bounded_by_bytes_too(spark, monkeypatch):
    monkeypatch.setattr(X, "WAVE_BYTES", 8 * 10 * 4)
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-9, 10)) for _ in range(10)]) for i in range(60)]
    queries = rows[::6]
    assert run(spark, rows, queries + queries[:2], 3) == brute(rows, queries, 3)


def test_phases(spark):
    """Cutoffs are reached by k full scores, and no entry that reaches one is lost."""
    rng = np.random.default_rng(3)
    q, c = rng.integers(-9, 10, (5, 12)).astype(float), rng.integers(-9, 10, (40, 12)).astype(float)
    ids, full = np.arange(100, 140), q @ c.T
    for at, scores in X.gather(np.arange(5), q, ids, c, 4, 3):
        assert len(scores) == 4 and sorted(full[at])[-4:] >= sorted(scores)
        found = {(i, s) for own, i, s in X.resolve(np.arange(5), q, [int(scores[-1])] * 5, ids, c, 40, 3) if own == at}
        assert {(100 + i, int(s)) for i, s in enumerate(full[at]) if s >= scores[-1]} == found


def test_rows_that_take_no_part(spark):
    rows = [(1, [1.0]), (2, None), (3, [None]), (4, [float("nan")]), (5, [float("inf")]), (None, [1.0]), (6, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, vector int")
    assert {r.vec_id for r in X.whole_vectors(df, "vec_id", F.col("embedding")).collect()} == {1, 6}

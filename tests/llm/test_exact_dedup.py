from hashlib import sha256

from manyfold.llm import exact_dedup as X


def test_groups(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "x" * 300 + "1"), (7, "x" * 300 + "2"), (8, "x" * 300 + "1"), (9, "A"), (None, "zz"), (10, "zz"), (11, "é"), (12, "é")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, n_bytes int, sha256 int")
    got = {r.doc_id: r for r in X.exact_groups(df, digest_all=True).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        same = groups[t or ""]
        keep = max(x for x in same if x is not None)
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(same), i == keep)
        assert got[i].sha256 == sha256((t or "").encode()).hexdigest()
    assert {r.doc_id for r in X.exact_dedup(df).collect()} == {2, 4, 5, 7, 8, 9, 10, 11, 12}


def test_saturated_bitmap_changes_nothing(spark):
    df = spark.createDataFrame([(i, "t%d" % (i % 7) + "y" * (i % 3)) for i in range(200)], "doc_id long, text string")
    as_set = lambda d: {tuple(r) for r in d.collect()}
    assert as_set(X.exact_groups(df, bits=32768).drop("sha256")) == as_set(X.exact_groups(df).drop("sha256"))
    few = X.exact_groups(df, bits=1).drop("sha256")
    assert as_set(few) == as_set(X.exact_groups(df).drop("sha256"))


def test_full_hash_only_for_survivors(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "long one"), (4, "abc")], "doc_id long, text string")
    got = {r.doc_id: r.sha256 is not None for r in X.signatures(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_groups(df).count() == 0
    assert X.exact_dedup(df).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    schema = "doc_id long, text string, row string, _id long, _again boolean, _found string, key int, `_bitmap` string, nth long"
    given = [(5, "a"), (5, "b"), (9, "a"), (7, "c"), (7, "c"), (7, "d"), (None, "e"), (None, "e"), (None, "f"), (3, None), (4, ""), (1, "z" * 300)]
    df = spark.createDataFrame([(i, t, f"r{n}", n, None, "f", n, "b", -n) for n, (i, t) in enumerate(given)], schema)
    out = X.exact_dedup(df)
    assert out.dtypes == df.dtypes
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(5, "b"), (9, "a"), (7, "c"), (7, "d"), (None, "e"), (None, "f"), (4, ""), (1, "z" * 300)], key=str)
    full = {tuple(r) for r in df.collect()}
    assert all(tuple(r) in full for r in out.collect())  # whole rows, other columns as they were
    groups = X.exact_groups(df).collect()
    assert sum(r.kept for r in groups) == len({t or "" for _, t in given})
    assert sorted(r.kept for r in groups if r.doc_id == 7) == [False, True, True]
    assert X.exact_dedup(df.limit(0)).count() == 0


def test_hot_group_is_joined_whole(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i // 6}") for i in range(3000)], "doc_id long, text string")
    got = X.exact_groups(df).collect()
    assert len(got) == 3000 and sum(r.kept for r in got) == 1 + 500
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(2999, 2000)}

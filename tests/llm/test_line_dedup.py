import random
from hashlib import sha256

import pytest

from manyfold.llm import line_dedup as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def mutate(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line) + 1)
        line[at : at + rng.randrange(2)] = rng.choice(["", "x", "é"])
    return "".join(line)


def brute(rows):
    """(doc, line) that go."""
    lines = [(i is None, i or 0, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x]
    lines.sort()
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][3], lines[j][3]
            if a == b or distance(a, b) <= X.edits(min(len(a), len(b))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(None if lines[i][0] else lines[i][1], lines[i][2]) for i in range(len(lines)) if find(i) != i}


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(mutate(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(5)))))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, base[0]), (103, "x" * 5000 + "1"), (104, "x" * 5000 + "2"), (105, "ab\nab\nac")]


@pytest.mark.parametrize("large", [X.LARGE, 1])
def test_against_all_pairs(spark, large):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, sig int")
    gone = brute(rows)
    for r in X.dedup_lines(df, large=large).collect():
        text = dict(rows)[r.doc_id] or ""
        lines = text.split("\n")
        mine = sorted(n for i, n in gone if i == r.doc_id)
        assert list(r.dropped) == mine
        assert (r.n_lines, r.n_dropped) == (len(lines), len(mine))
        assert r.text == "\n".join(x for n, x in enumerate(lines) if n not in mine)
    if large == 1:
        assert X.dedup_lines(df.limit(0)).count() == 0


def test_within():
    rng = random.Random(3)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        b = mutate(rng, a, rng.randrange(5))
        for t in range(4):
            assert X.within(a, b, t) == (distance(a, b) <= t)


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "one line here\nother"), (2, "one line hera\nmore")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in X.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert (rows[1].dropped, rows[2].dropped, rows[2].n_dropped) == ("", "0", 1)
    assert rows[2].text_sha256 == sha256(b"more").hexdigest()


def test_sketches_in_blocks(monkeypatch):
    rng = random.Random(21)
    lines = ["".join(rng.choice("abé🙂 z") for _ in range(rng.choice([0, 1, 23, 90, 300]))) for _ in range(80)]

    def plain(line):
        kinds = [min((ord(x) * 2654435761 & 0xFFFFFFFF) >> 26, X.PROBE - 1) for x in line]
        return sum((kinds.count(b) & 1) << b for b in range(63))

    for block in (X.BLOCK, 64):
        monkeypatch.setattr(X, "BLOCK", block)
        assert X.sketches(lines).tolist() == [plain(x) for x in lines]
    assert len(X.sketches([])) == 0


def test_crowded_signatures_meet_in_chunks(spark):
    """Lines that agree in all but two places share signatures and most of the sketch; in chunks each two still meet."""
    from pyspark.sql import functions as F

    rows = [(1, h, 0) for h in range(50)] + [(2, 7, 0), (2, 8, 0), (3, 9, 0)]
    df = spark.createDataFrame(rows, "key long, h long, sk long")
    dealt = X._split(df, 6).collect()
    by = {}
    for r in dealt:
        by.setdefault(r.key, set()).add(r.h)
    assert max(map(len, by.values())) < 40
    met = {frozenset((a, b)) for own in by.values() for a in own for b in own if a != b}
    assert met >= {frozenset((a, b)) for a in range(50) for b in range(a)}
    assert df.groupBy("key").agg(F.count("h").alias("n")).where("n > 6").count() == 1

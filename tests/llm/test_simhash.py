import random
import re

import numpy as np
import xxhash

from manyfold.llm import simhash as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute_groups(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def clustered(n, seed):
    rng = random.Random(seed)
    base, out = [rng.getrandbits(64) for _ in range(max(1, n // 40))], set()
    for _ in range(n):
        v = rng.choice(base)
        for _ in range(rng.randrange(8)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return list(out)


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \t\n", "A", "A b", "a B c", "É É É É", "x\x1cy z\x85w v u", "漢 字 🙂 A"]
    texts += [" ".join(rng.choice("ab cd ef Gh ÉÉ".split()) for _ in range(rng.randrange(400))) for _ in range(30)]
    for t in texts:
        assert S.fingerprint(t) == brute_fingerprint(t), t


def test_forest_against_all_pairs():
    for n in (1, 2, 9, 70, 700):
        values = clustered(n, n)
        order = np.array(sorted(values, key=lambda x: [x := x ^ x >> s for s in (1, 2, 4, 8, 16, 32)][-1]), np.uint64)
        roots = dict(zip(*(x.tolist() for x in S.forest(order)), strict=True))
        true = brute_groups(values)
        same = {}
        for v in values:
            assert same.setdefault(true[v], roots.get(v, v)) == roots.get(v, v)
        assert len(set(same.values())) == len(same)


def test_links_lose_nothing_when_groups_are_divided(spark):
    values = clustered(500, 5)
    true = brute_groups(values)
    df = spark.createDataFrame([(S._signed(v),) for v in values], "fp long")
    for large in (2, 4096):
        got = {r.node: r.root for r in S.components(S.links(df, large)).collect()}
        same = {}
        for v in values:
            root = got.get(S._signed(v), S._signed(v))
            assert same.setdefault(true[v], root) == root
        assert len(set(same.values())) == len(same)


def test_masks_meet():
    rng = random.Random(2)
    for bits in (list(range(64)), [b for b in range(64) if b % 2]):
        found = S.masks(bits)
        for _ in range(200):
            off = sum(1 << b for b in rng.sample(bits, 3))
            assert any(off & m == 0 for m in found)


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long + " w400"), (9, "q r s t u v w"), (2, None), (7, " \n"), (8, "Q R s T u v w"), (None, "lone one here now"), (11, long)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, root int")
    got = {r.doc_id: (r.fp, r.component_id) for r in S.near_groups(df).collect()}
    values = [brute_fingerprint(t or "") for _, t in rows]
    true = brute_groups(sorted(set(values)))
    for (i, _), v in zip(rows, values, strict=True):
        ids = [j for (j, _), w in zip(rows, values, strict=True) if true[w] == true[v] and j is not None]
        assert got[i] == (S._signed(v), min(ids, default=None))
    kept = {r.doc_id for r in S.near_dedup(df).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}
    assert S.near_groups(df.limit(0)).count() == 0


def test_rows_are_told_apart_by_id_and_fingerprint(spark):
    one, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    given = [(5, one), (5, other), (9, one), (7, "c d e f"), (7, "c d e f"), (2, other), (None, "q r s"), (8, None), (8, "")]
    df = spark.createDataFrame([(i, t, n, None, n) for n, (i, t) in enumerate(given)], "doc_id long, text string, row int, _id long, key int")
    out = S.near_dedup(df)
    assert out.dtypes == df.dtypes
    got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str)
    assert got == sorted([(5, one), (2, other), (7, "c d e f"), (None, "q r s"), (8, "")], key=str)
    assert sum(r.kept for r in S.near_groups(df).collect()) == 5
    assert S.near_dedup(df.limit(0)).count() == 0

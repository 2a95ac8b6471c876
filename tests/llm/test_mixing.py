import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyfold.llm import mixing as X

SCHEMA = "doc_id long, text string, lang string, source string, _tokens int, row int, _rate string, g int"


def docs(spark, sources=("hot", "b", "c"), n=500, seed=3, styled=True):
    rng, rows = random.Random(seed), []
    for i in range(n):
        source = sources[0] if i % 3 else rng.choice(sources[1:])
        k = sources.index(source) if styled else rng.randrange(len(sources))
        words = [["wo", "longer", "É" * 7, "AB"][(k + rng.randrange(2)) % 4] for _ in range(1 + rng.randrange(40))]
        rows.append((i, " ".join(words), ["en", "de"][k % 2], source, 1, i, "r", 2))
    rows += [(1000, None, None, sources[1], 1, 1, "r", 2), (1001, "", "en", None, 1, 1, "r", 2), (1002, "a B C D E", "xx", None, 1, 1, "r", 2), (None, "a b", "en", sources[2], 1, 1, "r", 2)]
    rows += [(1003, "", "en", "no tokens", 1, 1, "r", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def cell(text, lang):
    text = text or ""
    n = len(re.findall(r"[^ \t\n\r]+", text))
    size, raw = max(1, len(text)), len(text.encode())
    flags = [int(len(re.findall(p, text)) * 4 > n) for p in ("[A-Z][A-Z]+", "[*#$%&!|]")]
    return n, (lang or "", len(f"{n:b}"), min(12, len(text) // max(1, n)), (raw - len(text)) * 20 // size, *flags)


def brute(rows, targets, steps):
    """Rates by document and expected tokens by source, densely and without groups."""
    n, cells = zip(*(cell(r.text, r.lang) for r in rows), strict=True)
    half = [int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[-1], 16) % 2 for r in rows]
    tokens = Counter()
    for r, t in zip(rows, n, strict=True):
        if r.source is not None:
            tokens[r.source] += t
    sources = sorted(s for s, t in tokens.items() if t)
    label = [r.source if r.source in sources else None for r in rows]
    prior = {s: label.count(s) / sum(x is not None for x in label) for s in sources}
    seen = Counter((c, 1 - h, s) for c, h, s in zip(cells, half, label, strict=True) if s)
    held = Counter((c, 1 - h) for c, h, s in zip(cells, half, label, strict=True) if s)
    q = np.array([[(seen[c, h, s] + X.SMOOTHING * prior[s]) / (held[c, h] + X.SMOOTHING) for s in sources] for c, h in zip(cells, half, strict=True)])
    lift = [q[i][sources.index(s)] / prior[s] if s else None for i, s in enumerate(label)]
    e = X.DOUBT
    for _ in range(X.DOUBT_STEPS):
        e = float(np.mean([e / (e + (1 - e) * x) for x in lift if x is not None]))
    w = np.array([0.0 if x is None else (1 - e) * x / (e + (1 - e) * x) for x in lift])
    p = (1 - w)[:, None] * q + w[:, None] * np.array([[s == t for t in sources] for s in label])
    weight = np.array([float(targets.get(s, 0)) if targets else tokens[s] ** X.TEMPER for s in sources])
    size = np.array(n, float)
    want = weight / weight.sum() * size.sum()
    r, start = np.ones(len(rows)), size @ p
    for _ in range(steps):
        r = np.where(size > 0, np.maximum(0, r - p @ (((size * r) @ p - want) / start)), 1.0)
    return r, dict(zip(sources, want, strict=True)), dict(zip(sources, (size * r) @ p, strict=True)), e


@pytest.mark.filterwarnings("ignore:rates have not settled")
@pytest.mark.parametrize("few", [X.FEW, 1])
@pytest.mark.parametrize("targets", [None, {"hot": 1.0, "b": 10.0, "c": 5.0, "absent": 5.0}, {"b": 1.0}])
def test_rates_against_dense_steps(spark, targets, few):
    df = docs(spark)
    rows = df.collect()
    steps = 12 if few > 1 else 3
    rates, want, reached, _ = brute(rows, targets, steps)
    marked = X.features(df)
    found, totals = X.group_rates(X.grouped(marked), targets, few=few, most_steps=steps)
    by = {tuple(r)[:3]: r.rate for r in found.collect()}
    got = {r.doc_id: by[r["_source"], r["_cell"], r["_half"]] for r in marked.collect()}
    assert all(abs(got[r.doc_id] - x) < 2e-5 for r, x in zip(rows, rates, strict=True))
    total = sum(want.values())
    for r in totals.collect():
        assert abs(r.target - want[r.source]) < 1e-6 * total and abs(r.reached - reached[r.source]) < 1e-6 * total
        if targets is None and few > 1:
            assert abs(r.reached / r.target - 1) < 0.01


@pytest.mark.filterwarnings("ignore:rates have not settled")
def test_many_sources_in_both_forms(spark):
    names = [f"s{i}" for i in range(30)]
    df = docs(spark, names, 900, styled=False)
    targets = {n: 1.0 + i % 5 for i, n in enumerate(names)}
    a, b = ({r.doc_id: (r.rate, r.copies) for r in X.mix(df, targets, few=few, most_steps=3).collect()} for few in (X.FEW, 1))
    assert a.keys() == b.keys() and all(abs(a[k][0] - b[k][0]) < 2e-6 for k in a)


def test_doubt_follows_the_evidence(spark):
    """Text that tells sources apart lowers the doubt, and then a label that the text contradicts is believed less."""
    rows = docs(spark).where("source in ('hot', 'b', 'c')").collect()
    wrong = [r for r in rows if r.source == "hot"][:60]
    flipped = [r._replace(source="b") if hasattr(r, "_replace") else type(r)(**{**r.asDict(), "source": "b"}) if r in wrong else r for r in rows]
    *_, clean = brute(rows, None, 1)
    *_, noisy = brute(flipped, None, 1)
    assert clean < X.DOUBT and clean < noisy


def test_unsettled_rates_say_so(spark):
    with pytest.warns(UserWarning, match="not settled"):
        X.totals(docs(spark), {"b": 1.0}, most_steps=1)


def test_copies_follow_rates(spark):
    df = docs(spark)
    rows = X.mix(df).collect()
    assert len(rows) == df.count() and all(r["rate"] >= 0 for r in rows)
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in rows)
    out = X.apply_mix(df)  # with columns named like ours
    assert out.dtypes == df.dtypes and out.count() == sum(r["copies"] for r in rows)
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}


def test_odd_tables(spark):
    df = docs(spark)
    assert X.mix(df.limit(0)).count() == 0 == X.apply_mix(df.limit(0)).count()
    for few in (X.FEW, 1):
        assert {r["rate"] for r in X.mix(df.withColumn("source", F.lit(None).cast("string")), few=few).collect()} == {1.0}
        assert {r["rate"] for r in X.mix(df.withColumn("text", F.lit("")), few=few).collect()} == {1.0}
        assert {r["rate"] for r in X.mix(df, {"absent": 1.0}, few=few).collect()} == {1.0}
    with pytest.raises(ValueError):
        X.mix(df, {"b": 0.0})

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from manyfold.operators import claims as C

SCHEMA = "agent string, fact string, value string, confidence double, ord int, seq int"
AGENTS = ["iris", "juno", "kilo", "lima", "mike"]


def beliefs(spark, rows):
    return spark.createDataFrame([(a, f, v, c, AGENTS.index(a), i) for i, (a, f, v, c) in enumerate(rows)], SCHEMA)


def generated(seed, facts=40):
    """Random beliefs, each agent once about a fact at most; weights are eighths, so that sums are exact."""
    rng = random.Random(seed)
    rows = [(a, f"fact{f}", rng.choice(["up", "down", "flat"][: 1 + f % 3]), rng.randrange(1, 9) / 8) for f in range(facts) for a in AGENTS if rng.random() < 0.8]
    rng.shuffle(rows)
    return rows


def tallied(rows, weight=lambda a, c: 1):
    """Per fact, (value, votes, weight, first agent) of every value."""
    out = {}
    for a, f, v, c in rows:
        n, w, first = out.setdefault(f, {}).get(v, (0, 0, 99))
        out[f][v] = (n + 1, w + weight(a, c), min(first, AGENTS.index(a)))
    return out


@pytest.fixture(scope="module")
def told(spark):
    rows = generated(17)
    return rows, beliefs(spark, rows).cache()


def test_verdicts(told):
    rows, df = told
    got = {r.fact: r for r in C.verdicts(df, "fact", "value", "ord", "confidence").collect()}
    want = tallied(rows, lambda a, c: c)
    assert got.keys() == want.keys()
    kinds = set()
    for fact, votes in want.items():
        total = sum(n for n, _, _ in votes.values())
        most = min(votes, key=lambda v: (-votes[v][0], votes[v][2]))  # a tie goes to the first who spoke
        heavy = min(votes, key=lambda v: (-votes[v][1], votes[v][2]))
        strict = most if votes[most][0] * 2 > total else None
        r = got[fact]
        assert (r.plurality, r.majority, r.weighted, r.unanimous) == (most, strict, heavy, most if len(votes) == 1 else None)
        assert (r.top, r.total, r.n_values) == (votes[most][0], total, len(votes))
        kinds |= {("undecided", strict is None), ("weight matters", heavy != most), ("alone", len(votes) == 1)}
    assert len(kinds) == 6  # every case occurs, both ways


def test_policies_are_views(told):
    rows, df = told
    trust = {"kilo": 5.0, "iris": 1.0, "mike": 2.0}
    before = sorted(map(tuple, df.collect()))
    got = {p: {r.fact: r.verdict for r in C.adjudicate(df, p, "fact", "value", "ord", "confidence", "seq", trust, "agent").collect()} for p in C.POLICIES}
    by = {}
    for seq, (a, f, v, _) in enumerate(rows):
        by.setdefault(f, []).append((AGENTS.index(a), seq, v))
    trusted = tallied(rows, lambda a, _: trust.get(a, 0.0))
    for fact, said in by.items():
        assert got["priority"][fact] == min(said)[2]
        assert got["latest"][fact] == max(said, key=lambda x: x[1])[2]
        assert got["trust"][fact] == min(trusted[fact], key=lambda v: (-trusted[fact][v][1], trusted[fact][v][2]))
    assert sorted(map(tuple, df.collect())) == before
    with pytest.raises(ValueError):
        C.adjudicate(df, "loudest", "fact", "value", "ord")


def test_reliability(spark, told):
    rows, df = told
    most = {f: min(v, key=lambda x: (-v[x][0], v[x][2])) for f, v in tallied(rows).items()}
    agents = spark.createDataFrame([(a,) for a in [*AGENTS, "silent"]], "agent string")
    want = {a: sum(v != most[f] for b, f, v, _ in rows if a == b) for a in [*AGENTS, "silent"]}
    assert {r.agent: r.dissents for r in C.reliability(df, agents, "fact", "value", "ord", "agent").collect()} == want


def test_summary_counts_items_without_votes(spark, told):
    rows, df = told
    votes = tallied(rows)
    facts = spark.createDataFrame([(f,) for f in [*votes, "unheard of"]], "fact string")
    one = sum(len(v) == 1 for v in votes.values())
    r = C.summary(df, facts, "fact", "value", "ord").first()
    assert (r.items, r.unanimous, r.contested, r.agreement_rate) == (len(votes) + 1, one, len(votes) - one, round(one / len(votes), 3))


def test_union_of_equal_seq_is_commutative(spark):
    schema = "interp string, addr int, value string, seq int"
    rng = random.Random(3)
    parts = [spark.createDataFrame([(rng.choice("ij"), rng.randrange(4), rng.choice("xyz"), rng.randrange(3)) for _ in range(25)], schema) for _ in range(3)]
    rows = lambda d: sorted(map(tuple, d.collect()))
    a, b, c = parts
    assert rows(C.coexist(a, b)) == rows(C.coexist(b, a)) == rows(C.coexist(b.select("seq", "value", "addr", "interp"), a).select(*a.columns))
    assert rows(C.coexist(C.coexist(a, b), c)) == rows(C.coexist(a, C.coexist(b, c))) == rows(C.coexist(c, a, b, a))
    last = {}
    for r in sorted([tuple(x) for d in parts for x in d.collect()], key=lambda r: (r[3], r[2])):
        last[r[:2]] = r
    assert rows(C.coexist(*parts)) == sorted(last.values())


def test_last_wins_and_union(spark):
    c = spark.createDataFrame([("i", 1, "x", 1), ("i", 1, "y", 2), ("j", 1, "z", 1)], "interp string, addr int, value string, seq int")
    one = C.coexist(c, c)
    assert sorted((r.interp, r.value) for r in one.collect()) == [("i", "y"), ("j", "z")]
    a, b = c.where("interp = 'i'"), c.where("interp = 'j'")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(C.coexist(a, b)) == rows(C.coexist(b, a))
    assert [tuple(r) for r in C.conflicts(C.coexist(a), b).collect()] == [(1, "y", "z")]
    assert rows(C.override(a.where("seq = 2"), b)) == [(1, "y")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(AGENTS), st.sampled_from(["f0", "f1"]), st.sampled_from("xyz"), st.just(1.0)), min_size=1, max_size=12, unique_by=lambda r: r[:2]))
def test_more_voices_never_remove_a_conflict(spark, rows):
    df = beliefs(spark, rows)
    part = df.where("seq < 6")
    conflict = lambda d: {(r.fact, r.a, r.b) for r in C.all_conflicts(d, "agent", "fact").collect()}
    assert conflict(part) <= conflict(df)


def test_storage(spark):
    items = spark.createDataFrame([("x" * 100,), ("y" * 100,)], "payload string")
    c = spark.createDataFrame([("a", "1"), ("b", "22")], "who string, v string")
    r = C.storage(items, "payload", c, "who", "v").first()
    assert (r.substrate_bytes, r.claim_bytes, r.layers, r.copies_bytes, r.shared_bytes) == (200, 3, 2, 403, 203)


def test_entropy(told):
    rows, df = told
    got = {r.fact: r.entropy for r in C.entropy(df, "fact", "value").collect()}
    for fact, votes in tallied(rows).items():
        n = [v[0] for v in votes.values()]
        assert got[fact] == pytest.approx(-sum(x / sum(n) * math.log2(x / sum(n)) for x in n), abs=1e-12)

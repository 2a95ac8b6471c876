"""Rival claims over one substrate, kept uncollapsed and adjudicated when read.

A claim table has one row per (interpretation, address): who says what about which thing.
Nothing here rewrites it; a verdict is a view. A thing that nobody speaks of has no verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("plurality", "majority", "weighted", "unanimous", "priority", "latest", "trust")


def last_wins(claims: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last claim of each key; of equal ``seq`` the one whose columns, as JSON, sort last, whatever order claims come in."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq), F.desc(F.to_json(F.struct(*claims.columns)))))
    return claims.withColumn("_nth", rank).where("_nth = 1").drop("_nth")


def coexist(*claims: DataFrame, interp: str = "interp", addr: str = "addr", seq: str = "seq") -> DataFrame:
    """Union of claim sets: commutative, associative, and each interpretation speaks once of an address, the latest time."""
    columns = sorted(claims[0].columns)
    out = claims[0].select(*columns)
    for more in claims[1:]:
        out = out.unionByName(more)
    return last_wins(out, [interp, addr], seq).select(*claims[0].columns)


def lens(claims: DataFrame, keep: Column) -> DataFrame:
    """A read-only view of the claims that satisfy a predicate over id, source or time."""
    return claims.where(keep)


def restrict(claims: DataFrame, addresses: DataFrame, addr: str = "addr") -> DataFrame:
    """Claims about a set of addresses."""
    return claims.join(addresses.select(addr), addr, "left_semi")


def common_domain(a: DataFrame, b: DataFrame, addr: str = "addr") -> DataFrame:
    return a.select(addr).intersect(b.select(addr))


def conflicts(a: DataFrame, b: DataFrame, addr: str = "addr", value: str = "value") -> DataFrame:
    """(addr, left, right) where both speak and differ."""
    return a.select(addr, F.col(value).alias("left")).join(b.select(addr, F.col(value).alias("right")), addr).where(F.col("left") != F.col("right"))


def all_conflicts(claims: DataFrame, interp: str = "interp", addr: str = "addr", value: str = "value") -> DataFrame:
    """(addr, a, b, left, right) for every pair of interpretations a < b that differ on an address."""
    l, r = claims.select(addr, F.col(interp).alias("a"), F.col(value).alias("left")), claims.select(addr, F.col(interp).alias("b"), F.col(value).alias("right"))
    return l.join(r, addr).where((F.col("a") < F.col("b")) & (F.col("left") != F.col("right")))


def override(first: DataFrame, second: DataFrame, addr: str = "addr", value: str = "value") -> DataFrame:
    """(addr, value): the first interpretation where it speaks, else the second."""
    l, r = first.select(addr, F.col(value).alias("_l")), second.select(addr, F.col(value).alias("_r"))
    return l.join(r, addr, "full").select(addr, F.coalesce("_l", "_r").alias(value))


def stack(claims: DataFrame, meta: DataFrame, interp: str = "interp", addr: str = "addr") -> DataFrame:
    """Claims joined with claims about them: ``meta`` speaks of (target_interp, addr) with its own verdict."""
    return claims.join(meta.withColumnRenamed("target_interp", interp), [interp, addr])


def tally(claims: DataFrame, addr: str, value: str, order: str, weight: str | None = None) -> DataFrame:
    """(addr, value, n, weight, first): votes, summed weight, and the place of the first who said it."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min(order).alias("first")]
    aggs.append(F.sum(weight).alias("weight") if weight else F.count(F.lit(1)).alias("weight"))
    return claims.where(F.col(value).isNotNull()).groupBy(addr, value).agg(*aggs)


def verdicts(claims: DataFrame, addr: str, value: str, order: str, weight: str | None = None) -> DataFrame:
    """Per address: plurality (ties to the first said), strict majority or null, weighted, distinct values, top and total votes."""
    votes = tally(claims, addr, value, order, weight)
    most = F.max(F.struct("n", (-F.col("first")).alias("f"), value))
    heavy = F.max(F.struct("weight", (-F.col("first")).alias("f"), value))
    out = votes.groupBy(addr).agg(most.alias("m"), heavy.alias("h"), F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("total"))
    return out.select(
        addr,
        F.col(f"m.{value}").alias("plurality"),
        F.when(F.col("m.n") * 2 > F.col("total"), F.col(f"m.{value}")).alias("majority"),
        F.col(f"h.{value}").alias("weighted"),
        F.when(F.col("n_values") == 1, F.col(f"m.{value}")).alias("unanimous"),
        F.col("m.n").alias("top"),
        "total",
        "n_values",
    )


def adjudicate(claims: DataFrame, policy: str, addr: str, value: str, order: str, weight: str | None = None, time: str | None = None, trust: dict[str, float] | None = None, agent: str | None = None) -> DataFrame:
    """(addr, verdict) under a policy.

    plurality and weighted break ties to the value first said in ``order``; majority is strict, unanimous needs one value;
    priority takes the first speaker in ``order``, latest the last in ``time``; trust sums the trust in each agent, 0 if unnamed.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    spoken = claims.where(F.col(value).isNotNull())
    if policy == "priority":
        return spoken.groupBy(addr).agg(F.min(F.struct(order, value)).alias("m")).select(addr, F.col(f"m.{value}").alias("verdict"))
    if policy == "latest":
        return spoken.groupBy(addr).agg(F.max(F.struct(time, value)).alias("m")).select(addr, F.col(f"m.{value}").alias("verdict"))
    if policy == "trust":
        weights = F.create_map(*(F.lit(x) for kv in (trust or {}).items() for x in kv)) if trust else F.create_map().cast("map<string,double>")
        spoken, weight = spoken.withColumn("_trust", F.coalesce(F.try_element_at(weights, F.col(agent)), F.lit(0.0))), "_trust"
    column = {"trust": "weighted"}.get(policy, policy)
    return verdicts(spoken, addr, value, order, weight).select(addr, F.col(column).alias("verdict"))


def disagreements(claims: DataFrame, addr: str, value: str, order: str, places: int | None = None) -> DataFrame:
    """(addr, n_values, majority, agreement) of contested addresses; agreement is the top value's share of those who voted."""
    share = F.col("top") / F.col("total")
    out = verdicts(claims, addr, value, order).where("n_values > 1")
    return out.select(addr, "n_values", "majority", (F.round(share, places) if places is not None else share).alias("agreement"))


def summary(claims: DataFrame, substrate: DataFrame, addr: str, value: str, order: str) -> DataFrame:
    """(items, unanimous, contested, agreement_rate) over the substrate; items without votes count in items only."""
    v = verdicts(claims, addr, value, order)
    both = substrate.select(addr).join(v, addr, "left")
    return both.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("n_values") == 1).alias("unanimous"),
        F.count_if(F.col("n_values") > 1).alias("contested"),
        F.round(F.count_if(F.col("n_values") == 1) / F.count("n_values"), 3).alias("agreement_rate"),
    )


def reliability(claims: DataFrame, agents: DataFrame, addr: str, value: str, order: str, agent: str) -> DataFrame:
    """(agent, dissents) from the plurality value of each address; agents who never dissent have 0."""
    winner = verdicts(claims, addr, value, order).select(addr, "plurality")
    off = claims.join(winner, addr).where(F.col(value) != F.col("plurality")).groupBy(agent).agg(F.count(F.lit(1)).alias("dissents"))
    return agents.select(agent).join(off, agent, "left").select(agent, F.coalesce("dissents", F.lit(0)).alias("dissents"))


def entropy(claims: DataFrame, addr: str, value: str) -> DataFrame:
    """(addr, entropy) of votes in bits."""
    votes = claims.where(F.col(value).isNotNull()).groupBy(addr, value).agg(F.count(F.lit(1)).alias("n"))
    total = votes.groupBy(addr).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return total.select(addr, (F.log2(F.col("total").cast("double")) - F.col("s") / F.col("total")).alias("entropy"))


def storage(substrate: DataFrame, payload: str, claims: DataFrame, interp: str, value: str) -> DataFrame:
    """(substrate_bytes, claim_bytes, layers, copies_bytes, shared_bytes, saving): one substrate with layers against a copy per layer."""
    s = substrate.agg(F.sum(F.octet_length(payload)).alias("substrate_bytes"))
    c = claims.agg(F.sum(F.octet_length(F.col(value).cast("string"))).alias("claim_bytes"), F.count_distinct(interp).alias("layers"))
    both = s.crossJoin(c)  # one row each
    copies, shared = F.col("substrate_bytes") * F.col("layers") + F.col("claim_bytes"), F.col("substrate_bytes") + F.col("claim_bytes")
    return both.select("*", copies.alias("copies_bytes"), shared.alias("shared_bytes"), F.round(copies / shared, 3).alias("saving"))

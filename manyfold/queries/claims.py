"""Rival beliefs over customers (from ``orders``) and rival annotations over documents (from ``labels``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyfold.operators import claims as C
from manyfold.queries.registry import query, table
from manyfold.sources import stores
from manyfold.storage import scratch

#: fact, agent, value, confidence, place of the agent, time: the last order of a customer and priority is what that agent believes.
B = """WITH b AS (SELECT fact, agent, value, confidence, ord, seq FROM (
  SELECT o_custkey AS fact, o_orderpriority AS agent, o_orderstatus AS value, CAST(o_totalprice AS DECIMAL(18,2)) AS confidence,
         CAST(substr(o_orderpriority, 1, 1) AS INT) AS ord, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS nth FROM orders) WHERE nth = 1),
t AS (SELECT fact, value, count(*) AS n, sum(confidence) AS w, min(ord) AS f FROM b GROUP BY fact, value),
v AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY n DESC, f) AS rn, row_number() OVER (PARTITION BY fact ORDER BY w DESC, f) AS rw,
             sum(n) OVER (PARTITION BY fact) AS total, count(*) OVER (PARTITION BY fact) AS k FROM t),
x AS (SELECT fact, max(value) FILTER (rn = 1) AS plurality, max(CASE WHEN rn = 1 AND n * 2 > total THEN value END) AS majority, max(value) FILTER (rw = 1) AS weighted,
             max(CASE WHEN k = 1 THEN value END) AS unanimous, max(n) AS top, max(total)::BIGINT AS total, max(k) AS n_values FROM v GROUP BY fact)
"""
V = ("fact", "value", "ord")


def orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("fact"), F.col("o_orderpriority").alias("agent"), F.col("o_orderstatus").alias("value"), F.col("o_totalprice").cast("decimal(18,2)").alias("confidence"), F.substring("o_orderpriority", 1, 1).cast("int").alias("ord"), F.col("o_orderkey").alias("seq"))


def beliefs(spark, sf):
    return C.last_wins(orders(spark, sf), ["fact", "agent"], "seq")


def annotations(spark, sf):
    """(annotator, ord, doc_id, label): two columns of labels and a rule on length."""
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    two = labels.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("annotator"), F.lit(1).alias("ord"), F.col("quality").alias("label")), F.struct(F.lit("safety").alias("annotator"), F.lit(2).alias("ord"), (1 - F.col("toxic")).alias("label")))).alias("x")).select("x.*", "doc_id")
    rule = docs.join(labels, "doc_id", "left_semi").select(F.lit("size").alias("annotator"), F.lit(3).alias("ord"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("label"), "doc_id")
    return two.unionByName(rule)


A = """WITH a AS (SELECT 'quality' AS annotator, 1 AS ord, doc_id, quality AS label FROM labels UNION ALL SELECT 'safety', 2, doc_id, 1 - toxic FROM labels
  UNION ALL SELECT 'size', 3, d.doc_id, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT doc_id, label, count(*) AS n, min(ord) AS f FROM a GROUP BY doc_id, label),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rn, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS k FROM t)
"""


@query("S8_last_wins_beliefs", B + "SELECT fact, agent, value, confidence::DOUBLE AS confidence FROM b")
def _(spark, sf):
    """Everything that was ever said goes to the store; what is read last wins."""
    said = orders(spark, sf).select(F.col("agent"), F.col("fact").cast("string").alias("fact"), "value", F.col("confidence").cast("double").alias("confidence"), F.col("seq").alias("ts"), "seq")
    path = scratch(spark)
    stores.write(said, "beliefs", path)
    last = C.last_wins(stores.read(spark, "beliefs", path), ["fact", "agent"], "seq")
    return last.select(F.col("fact").cast("long").alias("fact"), "agent", "value", "confidence")


@query("W1_last_wins", B + "SELECT count(*) AS n, sum(seq)::BIGINT AS seqs FROM b")
def _(spark, sf):
    return beliefs(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@query("U1_coexist", "SELECT interp, count(*) AS n FROM (SELECT DISTINCT o_orderpriority AS interp, o_custkey AS addr FROM orders) GROUP BY interp")
def _(spark, sf):
    c = orders(spark, sf).select(F.col("agent").alias("interp"), F.col("fact").alias("addr"), "value", "seq")
    return C.coexist(c.where("seq % 2 = 0"), c.where("seq % 2 = 1"), c).groupBy("interp").agg(F.count(F.lit(1)).alias("n"))


@query("U4_common_domain", B + "SELECT fact AS addr FROM b WHERE ord = 1 INTERSECT SELECT fact FROM b WHERE ord = 2")
def _(spark, sf):
    b = beliefs(spark, sf).withColumnRenamed("fact", "addr")
    return C.common_domain(b.where("ord = 1"), b.where("ord = 2"))


@query("F1_lens", B + "SELECT fact, agent, value FROM b WHERE agent IN ('1-URGENT', '2-HIGH') AND seq >= 1000")
def _(spark, sf):
    return C.lens(beliefs(spark, sf), F.col("agent").isin("1-URGENT", "2-HIGH") & (F.col("seq") >= 1000)).select("fact", "agent", "value")


@query("F2_restriction", B + "SELECT fact, agent, value FROM b WHERE fact IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    kept = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("fact"))
    return C.restrict(beliefs(spark, sf), kept, "fact").select("fact", "agent", "value")


@query("F6_fact_views", B + "SELECT agent, value FROM b WHERE fact = 42")
def _(spark, sf):
    return beliefs(spark, sf).where("fact = 42").select("agent", "value")


@query("F7_belief", B + "SELECT value FROM b WHERE fact = 42 AND agent = '1-URGENT'")
def _(spark, sf):
    return beliefs(spark, sf).where("fact = 42 and agent = '1-URGENT'").select("value")


@query("A10_belief_disagreements", B + "SELECT fact, n_values, majority, round(top * 1.0::DOUBLE / total, 2) AS agreement FROM x WHERE n_values > 1")
def _(spark, sf):
    return C.disagreements(beliefs(spark, sf), *V, places=2)


@query("A11_agent_reliability", B + "SELECT a.agent, coalesce(d.n, 0)::BIGINT AS dissents FROM (SELECT DISTINCT agent FROM b) a LEFT JOIN (SELECT agent, count(*) AS n FROM b JOIN x ON x.fact = b.fact WHERE value <> plurality GROUP BY agent) d ON d.agent = a.agent")
def _(spark, sf):
    b = beliefs(spark, sf)
    return C.reliability(b, b.select("agent").distinct(), *V, "agent")


@query("T3_reliability_order", B + "SELECT agent, count(*) AS dissents, row_number() OVER (ORDER BY count(*) DESC, min(ord))::INT AS place FROM b JOIN x ON x.fact = b.fact WHERE value <> plurality GROUP BY agent")
def _(spark, sf):
    from pyspark.sql import Window

    b = beliefs(spark, sf)
    found = C.reliability(b, b.select("agent").distinct(), *V, "agent").where("dissents > 0")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("dissents"), "agent")))  # one row an agent


@query("A12_adjudicate", B + "SELECT fact, plurality, majority, weighted FROM x")
def _(spark, sf):
    return C.verdicts(beliefs(spark, sf), *V, "confidence").select("fact", "plurality", "majority", "weighted")


for _policy, _sql in {
    "priority": "SELECT fact, value AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY ord) AS r FROM b) WHERE r = 1",
    "latest": "SELECT fact, value AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY seq DESC) AS r FROM b) WHERE r = 1",
    "unanimous": "SELECT fact, unanimous AS verdict FROM x",
    "plurality": "SELECT fact, plurality AS verdict FROM x",
    "majority": "SELECT fact, majority AS verdict FROM x",
    "weighted": "SELECT fact, weighted AS verdict FROM x",
    "trust": "SELECT fact, value AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY w DESC, f) AS r FROM (SELECT fact, value, min(ord) AS f, sum(CASE agent WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END) AS w FROM b GROUP BY fact, value)) WHERE r = 1",
}.items():

    @query(f"A13_{_policy}", B + _sql)
    def _(spark, sf, policy=_policy):
        return C.adjudicate(beliefs(spark, sf), policy, *V, weight="confidence", time="seq", trust={"1-URGENT": 3.0, "2-HIGH": 2.0, "5-LOW": 1.0}, agent="agent")


@query("A14_override", B + "SELECT coalesce(l.fact, r.fact) AS fact, coalesce(l.value, r.value) AS value FROM (SELECT * FROM b WHERE ord = 1) l FULL JOIN (SELECT * FROM b WHERE ord = 2) r ON l.fact = r.fact")
def _(spark, sf):
    b = beliefs(spark, sf)
    return C.override(b.where("ord = 1"), b.where("ord = 2"), "fact")


@query("A15_contested", B + "SELECT fact FROM x WHERE n_values > 1")
def _(spark, sf):
    return C.verdicts(beliefs(spark, sf), *V).where("n_values > 1").select("fact")


@query("J6_pairwise_conflicts", B + "SELECT l.fact, l.agent AS a, r.agent AS b, l.value AS \"left\", r.value AS \"right\" FROM b l JOIN b r ON l.fact = r.fact AND l.agent < r.agent AND l.value <> r.value")
def _(spark, sf):
    return C.all_conflicts(beliefs(spark, sf), "agent", "fact")


@query("J12_review_of_claims", B + "SELECT b.fact, b.agent, b.value, m.verdict FROM b JOIN (SELECT fact, agent, CASE WHEN confidence > 100000 THEN 'trusted' ELSE 'doubted' END AS verdict FROM b WHERE value <> 'P') m ON m.fact = b.fact AND m.agent = b.agent")
def _(spark, sf):
    b = beliefs(spark, sf)
    meta = b.where("value <> 'P'").select(F.col("agent").alias("target_interp"), "fact", F.when(F.col("confidence") > 100000, "trusted").otherwise("doubted").alias("verdict"))
    return C.stack(b, meta, "agent", "fact").select("fact", "agent", "value", "verdict")


@query("A16_low_agreement", B + "SELECT fact, round(top * 1.0::DOUBLE / total, 4) AS agreement FROM x WHERE top * 1.0 / total < 0.6 AND plurality = 'O'")
def _(spark, sf):
    v = C.verdicts(beliefs(spark, sf), *V).withColumn("agreement", F.round(F.col("top") / F.col("total"), 4))
    return v.where("top / total < 0.6 and plurality = 'O'").select("fact", "agreement")


@query("A17_most_dissenting", B + "SELECT agent, count(*) AS dissents FROM b JOIN x ON x.fact = b.fact WHERE value <> plurality GROUP BY agent ORDER BY dissents DESC, min(ord) LIMIT 1")
def _(spark, sf):
    b = beliefs(spark, sf)
    return C.reliability(b, b.select("agent").distinct(), *V, "agent").orderBy(F.desc("dissents"), "agent").limit(1)


@query("A18_changed_verdicts", B + "SELECT count(*) FILTER (weighted <> plurality) AS n FROM x")
def _(spark, sf):
    return C.verdicts(beliefs(spark, sf), *V, "confidence").agg(F.count_if(F.col("weighted") != F.col("plurality")).alias("n"))


@query("A19_mean_entropy", B + "SELECT round(avg(e), 6) AS mean_entropy FROM (SELECT fact, sum(-n * 1.0::DOUBLE / total * log2(n * 1.0::DOUBLE / total)) AS e FROM v GROUP BY fact)")
def _(spark, sf):
    return C.entropy(beliefs(spark, sf), "fact", "value").agg(F.round(F.avg("entropy"), 6).alias("mean_entropy"))


@query("A22_storage", "SELECT s.substrate_bytes, c.claim_bytes, c.layers, s.substrate_bytes * c.layers + c.claim_bytes AS copies_bytes, s.substrate_bytes + c.claim_bytes AS shared_bytes, round((s.substrate_bytes * c.layers + c.claim_bytes)::DOUBLE / (s.substrate_bytes + c.claim_bytes), 3) AS saving FROM (SELECT sum(strlen(text))::BIGINT AS substrate_bytes FROM documents) s, (" + A + "SELECT sum(strlen(label::VARCHAR))::BIGINT AS claim_bytes, count(DISTINCT annotator) AS layers FROM a) c")
def _(spark, sf):
    return C.storage(table(spark, sf, "documents"), "text", annotations(spark, sf), "annotator", "label")


@query("F3_item", "SELECT doc_id, text FROM documents WHERE doc_id = 17")
def _(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 17").select("doc_id", "text")


@query("F4_layer", A + "SELECT doc_id, label FROM a WHERE annotator = 'safety'")
def _(spark, sf):
    return annotations(spark, sf).where("annotator = 'safety'").select("doc_id", "label")


@query("F5_item_views", A + "SELECT doc_id, max(label) FILTER (annotator = 'quality') AS quality, max(label) FILTER (annotator = 'safety') AS safety, max(label) FILTER (annotator = 'size') AS size FROM a GROUP BY doc_id")
def _(spark, sf):
    return annotations(spark, sf).groupBy("doc_id").pivot("annotator", ["quality", "safety", "size"]).agg(F.max("label"))


@query("J1_items_with_labels", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")


@query("A8_annotation_disagreements", A + "SELECT doc_id, max(k) AS n_values, max(CASE WHEN rn = 1 AND n * 2 > total THEN label END) AS majority, round(max(n) * 1.0::DOUBLE / max(total), 6) AS agreement FROM v GROUP BY doc_id HAVING max(k) > 1")
def _(spark, sf):
    return C.disagreements(annotations(spark, sf), "doc_id", "label", "ord", places=6)


@query("A9_annotation_summary", A + "SELECT count(*) AS items, count(*) FILTER (k = 1) AS unanimous, count(*) FILTER (k > 1) AS contested, round(count(*) FILTER (k = 1)::DOUBLE / count(k), 3) AS agreement_rate FROM documents d LEFT JOIN (SELECT doc_id, max(k) AS k FROM v GROUP BY doc_id) x ON x.doc_id = d.doc_id")
def _(spark, sf):
    return C.summary(annotations(spark, sf), table(spark, sf, "documents"), "doc_id", "label", "ord")


@query("W6_first_seen_ties", B + "SELECT x.fact, x.plurality FROM x WHERE (SELECT count(*) FROM t WHERE t.fact = x.fact AND t.n = x.top) > 1")
def _(spark, sf):
    b = beliefs(spark, sf)
    top = C.verdicts(b, *V)
    ties = C.tally(b, *V).join(top, "fact").where("n = top").groupBy("fact").agg(F.count(F.lit(1)).alias("k"), F.first("plurality").alias("plurality"))
    return ties.where("k > 1").select("fact", "plurality")


@query("X3_policy_and_field", A + "SELECT doc_id, CASE WHEN max(k) = 1 THEN max(label) END AS verdict FROM v GROUP BY doc_id")
def _(spark, sf):
    return C.adjudicate(annotations(spark, sf), "unanimous", "doc_id", "label", "ord")

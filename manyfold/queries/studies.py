"""Scoped search, disagreement, detection, scores and cost models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from manyfold import learn
from manyfold.functions import measures as M
from manyfold.operators import claims as C
from manyfold.plans import movement as V
from manyfold.queries.claims import B, beliefs
from manyfold.queries.registry import query, table
from manyfold.sources import generate as G
from manyfold.storage import scratch, settle, written
from manyfold.streaming import detect

X = lambda x, seed: G.SCATTER_SQL.format(x=x, seed=seed)


# ---- search, composition, selective columns

_VEC = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, q.e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE))) AS sim FROM embeddings CROSS JOIN q)"


def near(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).withColumn("sim", M.cosine(F.col("embedding"), F.col("q")))  # one row


@query("J11_window_candidates", _VEC + " SELECT vec_id, round(sim, 6) AS sim FROM s WHERE label = 3")
def _(spark, sf):
    return near(spark, sf).where("label = 3").select("vec_id", F.round("sim", 6).alias("sim"))


@query("T7_scoped_top_k", _VEC + " SELECT vec_id, round(sim, 6) AS sim FROM s WHERE label = 3 ORDER BY sim DESC, vec_id LIMIT 10")
def _(spark, sf):
    return near(spark, sf).where("label = 3").orderBy(F.desc("sim"), "vec_id").limit(10).select("vec_id", F.round("sim", 6).alias("sim"))


_CON = f"WITH c AS (SELECT range AS id, [{X('range', 1)} % 256, {X('range', 2)} % 256, {X('range', 3)} % 256] AS prims FROM range(20000))"


def concepts(spark):
    i = F.col("id")
    return spark.range(20000).select("id", F.array(*(G.scatter(i, s) % 256 for s in (1, 2, 3))).alias("prims"))


@query("F21_contains_primitive", _CON + " SELECT id FROM c WHERE list_contains(prims, 42)")
def _(spark, sf):
    return concepts(spark).where(F.array_contains("prims", 42)).select("id")


@query("F21_inverted_index", _CON + " SELECT item, count(*) AS n FROM (SELECT DISTINCT unnest(prims) AS item, id FROM c) GROUP BY item")
def _(spark, sf):
    return M.inverted(concepts(spark), "id", "prims").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


WIDTHS = {"geometry": 2048, "thermal": 120, "cost": 80, "structural": 150}


def building(spark, sf):
    """Elements with four layers of fixed widths, one for each part."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), *(F.rpad(F.concat(F.lit(n), "p_name"), w, "-").alias(n) for n, w in WIDTHS.items()))


def element_store(spark, sf):
    return written(spark, "elements", sf, lambda path: building(spark, sf).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path), spark.read.parquet)


_WIDE = lambda n: f"rpad('{n}' || p_name, {WIDTHS[n]}, '-')"


@query("S17_element_store", f"SELECT count(*) AS n, sum(strlen({_WIDE('thermal')}))::BIGINT AS thermal_bytes, min({_WIDE('thermal')}) AS first FROM part")
def _(spark, sf):
    return element_store(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("thermal")).alias("thermal_bytes"), F.min("thermal").alias("first"))


@query("F17_selected_layers", f"SELECT p_partkey AS id, {_WIDE('cost')} AS cost, {_WIDE('structural')} AS structural FROM part")
def _(spark, sf):
    return element_store(spark, sf).select("id", "cost", "structural")


@query("F18_scoped_section", "SELECT conv_id, turn, text FROM conversations WHERE conv_id = (SELECT conv_id FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) ORDER BY n DESC, conv_id LIMIT 1)")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    summary = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "conv_id").limit(1)
    return c.join(F.broadcast(summary.select("conv_id")), "conv_id", "left_semi").select("conv_id", "turn", "text")


# ---- disagreement

_DIST = B + ", d AS (SELECT fact, [coalesce(max(n) FILTER (value = 'F'), 0)::DOUBLE, coalesce(max(n) FILTER (value = 'O'), 0)::DOUBLE, coalesce(max(n) FILTER (value = 'P'), 0)::DOUBLE] AS votes FROM t GROUP BY fact), e AS (SELECT fact, list_transform(votes, lambda x: x / list_sum(votes)) AS dist FROM d)"
CLASSES = ("F", "O", "P")


def distributions(spark, sf):
    votes = C.tally(beliefs(spark, sf), "fact", "value", "ord").groupBy("fact").agg(*(F.coalesce(F.max(F.when(F.col("value") == c, F.col("n"))), F.lit(0)).cast("double").alias(c) for c in CLASSES))
    return votes.select("fact", M.normalized(F.array(*CLASSES)).alias("dist"))


@query("S18_distributions", _DIST + " SELECT fact, round(dist[1], 6) AS f, round(dist[2], 6) AS o, round(dist[3], 6) AS p FROM e")
def _(spark, sf):
    path = scratch(spark) + "/json"
    distributions(spark, sf).write.mode("overwrite").json(path)
    back = spark.read.schema("fact bigint, dist array<double>").json(path)
    return back.select("fact", *(F.round(F.col("dist")[i], 6).alias(c.lower()) for i, c in enumerate(CLASSES)))


@query("A29_divergence", _DIST + ", u AS (SELECT fact, list_transform(dist, lambda x: [x, 1.0::DOUBLE / 3]) AS z FROM e) SELECT round(avg(list_sum(list_transform(z, lambda p: (CASE WHEN p[1] > 0 THEN p[1] * log2(p[1] / ((p[1] + p[2]) / 2)) ELSE 0 END + p[2] * log2(p[2] / ((p[1] + p[2]) / 2))) / 2))), 6) AS jsd FROM u")
def _(spark, sf):
    even = F.array(*[F.lit(1.0 / 3)] * 3)
    return distributions(spark, sf).agg(F.round(F.avg(M.jensen_shannon(F.col("dist"), even)), 6).alias("jsd"))


_ENT = _DIST + ", h AS (SELECT fact, round(list_sum(list_transform(dist, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)), 9) AS h FROM e), g AS (SELECT quantile_cont(h, 0.25) AS a, quantile_cont(h, 0.5) AS b, quantile_cont(h, 0.75) AS c FROM h)"


@query("A35_entropy_quartiles", _ENT + " SELECT (h >= a)::INT + (h >= b)::INT + (h >= c)::INT AS quartile, count(*) AS n FROM h CROSS JOIN g GROUP BY ALL")
def _(spark, sf):
    h = distributions(spark, sf).select("fact", F.round(M.entropy(F.col("dist")), 9).alias("h"))
    return M.quartile_of(h, "h").groupBy("quartile").agg(F.count(F.lit(1)).alias("n"))


@query("W8_signed_ranks", """WITH d AS (SELECT abs(round(value) - 50) AS a, (round(value) > 50)::INT AS up FROM events WHERE round(value) <> 50), t AS (SELECT a, count(*) AS n, sum(up) AS up FROM d GROUP BY a),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rank FROM t)
SELECT sum(n)::BIGINT AS n, sum(rank * up)::DOUBLE AS w_plus, sum(rank * (n - up))::DOUBLE AS w_minus FROM r""")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.round("value") - 50).alias("d"))
    return M.signed_ranks(e, "d").select("n", "w_plus", "w_minus")


@query("X5_soft_labels")
def _(spark, sf):
    rows = distributions(spark, sf)
    info = table(spark, sf, "customer").select(F.col("c_custkey").alias("fact"), F.array(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25.0).alias("x"))
    scored = learn.out_of_fold(settle(rows.join(info, "fact")), "fact", "x", "dist", 3)
    each = scored.groupBy("target", "fact").agg(F.avg(M.jensen_shannon(F.col("p"), F.col("dist"))).alias("jsd"))  # over the seeds
    return each.groupBy("target").agg(F.round(F.avg("jsd"), 4).alias("jsd"), F.count(F.lit(1)).alias("n"))


@query("X6_pair_features", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 4) AS distance, len(a.embedding) * 4 AS width FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v"))
    both = e.join(nxt, "vec_id").withColumn("f", M.pair_features(F.col("u"), F.col("v")))
    return both.select("vec_id", F.round(M.total(F.slice("f", F.size("u") * 2 + 1, F.size("u"))), 4).alias("distance"), F.size("f").alias("width"))


@query("X4_embedding_norms", "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm FROM embeddings GROUP BY label")
def _(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.sqrt(M.dot(v, v))), 6).alias("norm"))


@query("A33_explained_variance")
def _(spark, sf):
    found = learn.dimensions(learn.explained(table(spark, sf, "embeddings"), "embedding", 64))
    return spark.createDataFrame([(float(s), d) for s, d in found.items()], "share double, dims int")


# ---- detection

_GRID = f"WITH r AS (SELECT range AS id, (range // 16)::INT AS w, (range % 16)::INT AS node, {X('range', 11)} % 50 = 0 AS is_anom FROM range(4800)), g AS (SELECT *, 1.0::DOUBLE + ({X('id', 4)} % 100 - 50) / 1000.0::DOUBLE + CASE WHEN is_anom THEN 0.5::DOUBLE ELSE 0 END AS energy FROM r)"
_EWMA = _GRID.replace("WITH r", "WITH RECURSIVE r") + ", f AS (SELECT node, w, energy, is_anom, energy AS baseline FROM g WHERE w = 0 UNION ALL SELECT g.node, g.w, g.energy, g.is_anom, f.baseline * 0.9::DOUBLE + f.energy * (1 - 0.9::DOUBLE) FROM g JOIN f ON g.node = f.node AND g.w = f.w + 1)"


def readings(spark):
    return G.sensor_grid(spark, 300, 16)


@query("F22_fixed_threshold", _GRID + " SELECT w, node FROM g WHERE energy > 1.3")
def _(spark, sf):
    return readings(spark).where("energy > 1.3").select("w", "node")


@query("W4_running_baseline", _EWMA + " SELECT node, w, round(baseline, 6) AS baseline, abs(energy - baseline) > 0.25 AS flag FROM f")
def _(spark, sf):
    return M.ewma_flags(readings(spark), "node", "w", "energy").select("node", F.col("w").cast("int").alias("w"), F.round("baseline", 6).alias("baseline"), "flag")


@query("A30_transmission", _EWMA + " SELECT count(*) * 1024 AS full_bytes, count(*) FILTER (energy > 1.3) * 1024 AS fixed_bytes, count(*) * 16 + count(*) FILTER (abs(energy - baseline) > 0.25) * 1024 AS flagged_bytes, round(count(*) FILTER (energy > 1.3 AND is_anom)::DOUBLE / count(*) FILTER (is_anom), 4) AS fixed_recall, round(count(*) FILTER (abs(energy - baseline) > 0.25 AND is_anom)::DOUBLE / count(*) FILTER (is_anom), 4) AS flagged_recall FROM f")
def _(spark, sf):
    r = readings(spark)
    f = M.ewma_flags(r, "node", "w", "energy").drop("energy").join(r, ["node", "w"])
    bytes_of = lambda c: F.count_if(c) * 1024
    recall = lambda c: F.round(F.count_if(c & F.col("is_anom")) / F.count_if("is_anom"), 4)
    fixed = F.col("energy") > 1.3
    return f.agg((F.count(F.lit(1)) * 1024).alias("full_bytes"), bytes_of(fixed).alias("fixed_bytes"), (F.count(F.lit(1)) * 16 + bytes_of(F.col("flag"))).alias("flagged_bytes"), recall(fixed).alias("fixed_recall"), recall(F.col("flag")).alias("flagged_recall"))


@query("R1_streaming_baseline", _EWMA + " SELECT node, w, round(baseline, 6) AS baseline, abs(energy - baseline) > 0.25 AS flag FROM f")
def _(spark, sf):
    path = scratch(spark)
    readings(spark).coalesce(2).write.mode("overwrite").parquet(f"{path}/in")
    stream = spark.readStream.schema("w int, node int, energy double, is_anom boolean").parquet(f"{path}/in")
    out = detect.run_once(detect.running_baseline(stream, "node", "w", "energy"), f"{path}/out")
    return out.select("node", F.col("w").cast("int").alias("w"), F.round("baseline", 6).alias("baseline"), "flag")


@query("R2_residuals", _EWMA + " SELECT w, node, round(energy, 6) AS energy FROM f WHERE abs(energy - baseline) > 0.25")
def _(spark, sf):
    r = readings(spark)
    flagged = M.ewma_flags(r, "node", "w", "energy").where("flag")
    return detect.residuals(r, flagged.withColumn("w", F.col("w").cast("int")), ["w", "node"]).select("w", "node", F.round("energy", 6).alias("energy"))


@query("R4_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY ALL")
def _(spark, sf):
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    out = detect.run_once(detect.daily_counts(stream), scratch(spark))
    return out.select(F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n")


# ---- scores and cost models

_AREA = "WITH a AS (SELECT p_partkey AS area, p_size % 4 AS sd, p_partkey % 4 AS mult, length(p_name) % 4 AS sr, p_size % 3 AS sa, p_partkey % 3 AS adv FROM part)"


def areas(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("area"), (F.col("p_size") % 4).alias("sd"), (F.col("p_partkey") % 4).alias("mult"), (F.length("p_name") % 4).alias("sr"), (F.col("p_size") % 3).alias("sa"), (F.col("p_partkey") % 3).alias("adv"))


@query("A32_scores", _AREA + " SELECT area, round((sd * 0.3::DOUBLE + mult * 0.2::DOUBLE + sr * 0.2::DOUBLE + sa * 0.15::DOUBLE + adv * 0.15::DOUBLE) / 3 * 100, 1) AS score, CASE WHEN sd <= 1 THEN 'N/A' WHEN sr >= 2 AND mult >= 2 THEN 'BUILD' ELSE 'STANCE' END AS verdict FROM a")
def _(spark, sf):
    return areas(spark, sf).select("area", M.weighted_score({"sd": 0.3, "mult": 0.2, "sr": 0.2, "sa": 0.15, "adv": 0.15}).alias("score"), M.stance("sd", "mult", "sr").alias("verdict"))


@query("T5_score_ranking", _AREA + " SELECT sd, sum(mult)::BIGINT AS mult, (rank() OVER (ORDER BY sum(mult) DESC))::INT AS place FROM a GROUP BY sd")
def _(spark, sf):
    sums = areas(spark, sf).groupBy("sd").agg(F.sum("mult").alias("mult"))
    return sums.withColumn("place", F.rank().over(Window.orderBy(F.desc("mult"))))  # four rows


@query("A31_duplicated_share", """WITH c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(strlen(text)) FROM documents) AS text, (SELECT max(len(embedding)) FROM embeddings) * 4 AS emb),
p AS (SELECT s.scenario, unnest([text, n * emb, n * 256, n * 200, n * 50]) AS needed, unnest([CASE WHEN s.scenario = 'with' THEN n * emb ELSE 0 END, text, n * emb // 20, n * 100, 0]) AS spare FROM c CROSS JOIN (VALUES ('with'), ('without')) s(scenario))
SELECT scenario, sum(needed + spare)::BIGINT AS total, sum(spare)::BIGINT AS copies FROM p GROUP BY scenario""")
def _(spark, sf):
    """Bytes of a retrieval service over the documents, and those that only repeat others: with and without vectors stored twice."""
    docs = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("text"))
    size = docs.crossJoin(table(spark, sf, "embeddings").agg((F.max(F.size("embedding")) * 4).alias("emb")))  # one row each
    n, emb, part = F.col("n"), F.col("emb"), lambda b, needed: F.struct(b.cast("long").alias("bytes"), F.lit(needed).alias("needed"))
    every = size.withColumn("scenario", F.explode(F.array(F.lit("with"), F.lit("without"))))
    copied = F.when(F.col("scenario") == "with", n * emb).otherwise(0)
    held = [part(F.col("text"), True), part(n * emb, True), part(n * 256, True), part(n * 200, True), part(n * 50, True), part(copied, False), part(F.col("text"), False), part(F.floor(n * emb / 20), False), part(n * 100, False)]
    rows = every.select("scenario", F.explode(F.array(*held)).alias("p")).select("scenario", "p.*")
    return rows.groupBy("scenario").agg(F.sum("bytes").alias("total"), F.sum(F.when(~F.col("needed"), F.col("bytes")).otherwise(0)).alias("copies"))


@query("A36_routed_sizes", "SELECT event_type, sum(least(strlen(props), 40, CASE WHEN value < 10 THEN 3 ELSE 1000 END))::BIGINT + 13 * count(*) + 32 AS bytes FROM events GROUP BY event_type")
def _(spark, sf):
    e = table(spark, sf, "events")
    own = F.least(F.octet_length("props"), F.lit(40), F.when(F.col("value") < 10, 3).otherwise(1000))
    return e.groupBy("event_type").agg((F.sum(own) + 13 * F.count(F.lit(1)) + 32).alias("bytes"))


@query("O20_movement", "SELECT range AS rows, (ceil(range * 4 / 128.0) * 128)::BIGINT AS flat, (range * 256)::BIGINT AS apart, (ceil(range / 32.0) * 128)::BIGINT AS beside, (ceil((pow(2, range % 12) - 1) * 32 / 128.0) * 128)::BIGINT AS lod FROM range(1, 3001)")
def _(spark, sf):
    n = F.col("id")
    apart, beside = V.coupled_bytes(n)
    return spark.range(1, 3001).select(n.alias("rows"), V.flat_bytes(n).cast("long").alias("flat"), apart.cast("long").alias("apart"), beside.cast("long").alias("beside"), V.lod_bytes(n % 12).cast("long").alias("lod"))


@query("O21_hardware", "SELECT range AS gb, round(range * 1e9 / 342e9, 9) AS flat_s, round(2e9 / 342e9 + 2.8e-6, 9) AS software_s, round(6000 * 0.3e-6, 9) AS native_s, round(range * 1e9 * 5e-12, 9) AS flat_j FROM range(1, 101)")
def _(spark, sf):
    m = V.batch_query(F.col("id") * 1e9, F.lit(2e9), F.lit(6000))
    return spark.range(1, 101).select(F.col("id").alias("gb"), *(F.round(m[c], 9).alias(c) for c in ("flat_s", "software_s", "native_s", "flat_j")))


@query("O22_storage_by_dimension", "SELECT d.range AS dims, (900 + 3000 + 577 * d.range * 4 + 577 * 128 + 3072 + 577 * 20)::BIGINT AS stitched, (192 + 577 * 5 + 577 * d.range * 4 + 192 * least(64, d.range) * 4)::BIGINT AS unified FROM range(8, 1025, 8) d")
def _(spark, sf):
    d = F.col("id")
    return spark.range(8, 1025, 8).select(d.alias("dims"), V.stitched_bytes(F.lit(900), F.lit(3000), F.lit(577), d, 256).cast("long").alias("stitched"), V.unified_bytes(F.lit(192), F.lit(577), d, F.least(F.lit(64), d)).cast("long").alias("unified"))


@query("O22_prefix", "SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS energy FROM embeddings")
def _(spark, sf):
    p = F.slice("embedding", 1, 16)
    return table(spark, sf, "embeddings").select("vec_id", F.round(M.dot(p, p), 6).alias("energy"))


@query("O23_access", "SELECT range AS \"window\", range * 6 AS roi_shared, range * 8 + 200 AS roi_apart, range * 3072 AS scoped_shared, 64 * (3072 + 128)::BIGINT AS scoped_graph, 72 AS sum_shared, range * 5 AS sum_apart FROM range(1, 200)")
def _(spark, sf):
    return spark.range(1, 200).select(F.col("id").alias("window"), *(c.cast("long").alias(n) for n, c in V.access_bytes(F.col("id"), F.lit(768)).items()))


@query("O25_composition", "SELECT range AS terms, 1000000 * 768::BIGINT * 4 AS dense, 2048 + 1000000 * (range * 3 - 1) AS equations FROM range(1, 9)")
def _(spark, sf):
    m = V.composition_bytes(F.lit(1000000).cast("long"), F.col("id"), F.lit(768), F.lit(256))
    return spark.range(1, 9).select(F.col("id").alias("terms"), *(c.cast("long").alias(n) for n, c in m.items()))


@query("O26_scaling_agents", "WITH r AS (SELECT k, a.range AS agent, f.range AS fact, CASE WHEN f.range % 3 = 0 AND a.range % 2 = 1 THEN 'false' ELSE 'true' END AS value FROM (VALUES (3), (10), (25), (50), (100)) v(k) JOIN range(100) a ON a.range < k CROSS JOIN range(200) f), t AS (SELECT k, fact, value, count(*) AS n FROM r GROUP BY ALL) SELECT k, count(*) FILTER (c > 1) AS contested, count(*) FILTER (top * 2 > total) AS decided FROM (SELECT k, fact, count(*) AS c, max(n) AS top, sum(n) AS total FROM t GROUP BY k, fact) GROUP BY k")
def _(spark, sf):
    ks = F.explode(F.array(*(F.lit(k) for k in (3, 10, 25, 50, 100)))).alias("k")
    agents = spark.range(100).select(F.col("id").alias("agent"), ks).where("agent < k")
    every = agents.withColumn("fact", F.explode(F.sequence(F.lit(0), F.lit(199))))
    said = every.withColumn("value", F.when((F.col("fact") % 3 == 0) & (F.col("agent") % 2 == 1), "false").otherwise("true")).withColumn("at", F.struct("k", "fact"))
    v = C.verdicts(said, "at", "value", "agent")
    return v.groupBy(F.col("at.k").alias("k")).agg(F.count_if(F.col("n_values") > 1).alias("contested"), F.count_if(F.col("majority").isNotNull()).alias("decided"))

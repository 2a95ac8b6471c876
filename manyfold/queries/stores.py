"""Memories over ``events``, tensors over ``part``, spans over ``events``, Merkle trees over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyfold.operators import memory as M
from manyfold.operators import merkle as K
from manyfold.operators import paths as P
from manyfold.operators import trace as T
from manyfold.queries.registry import query, table
from manyfold.sources import stores
from manyfold.storage import scratch, settle, written


def memories(spark, sf):
    e = table(spark, sf, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("event_id").cast("string").alias("id"), ts.alias("ts"), F.col("event_type").alias("kind"), F.col("props").alias("text"), F.concat(F.lit("src"), (F.col("event_id") % 13).cast("string")).alias("source"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("meta"), F.col("event_id").alias("seq"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("topic"))


def memory_store(spark, sf):
    """The memories as they lie in their store, sorted by topic."""
    return written(spark, "memories", sf, lambda path: stores.write(memories(spark, sf), "memories", path), lambda path: stores.read(spark, "memories", path))


def memory_places(spark, sf):
    """The topic of each id, sorted by id."""
    return written(spark, "places", sf, lambda path: stores.write(M.id_index(memory_store(spark, sf)), "places", path), lambda path: stores.read(spark, "places", path))


MEM = "WITH m AS (SELECT event_id::VARCHAR AS id, epoch_us(ts) / 1e6 AS ts, event_type AS kind, props AS text, 'src' || (event_id % 13) AS source, event_id AS seq, 'user' || user_id AS topic FROM events)\n"


@query("A7_topic_summary", MEM + "SELECT topic, count(*) AS n, count(*) FILTER (kind = 'click') AS clicks, round(min(ts), 3) AS tmin, round(max(ts), 3) AS tmax, substr(arg_max(text, (ts, seq)), 1, 80) AS latest FROM m GROUP BY topic")
def _(spark, sf):
    s = M.topic_summary(memories(spark, sf))
    return s.select("topic", "n", F.coalesce(F.try_element_at("kinds", F.lit("click")), F.lit(0)).alias("clicks"), F.round("tmin", 3).alias("tmin"), F.round("tmax", 3).alias("tmax"), "latest")


@query("S9_memory_store", MEM + "SELECT topic, count(*) AS n FROM m GROUP BY topic")
def _(spark, sf):
    path = scratch(spark)
    stores.write(memories(spark, sf), "memories", path)
    return stores.read(spark, "memories", path).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("F8_recall", MEM + "SELECT id, kind, text FROM m WHERE topic = 'user7'")
def _(spark, sf):
    return M.recall(memory_store(spark, sf), "user7").select("id", "kind", "text")


@query("F9_since", MEM + "SELECT id, topic, kind FROM m WHERE ts >= 1704844800")
def _(spark, sf):
    m = memory_store(spark, sf)
    return M.since(m, 1704844800.0, M.topic_summary(m)).select("id", "topic", "kind")


@query("T1_stable_by_time", MEM + "SELECT id, row_number() OVER (ORDER BY ts, topic, seq)::INT AS place FROM m WHERE topic = 'user7'")
def _(spark, sf):
    from pyspark.sql import Window

    return M.recall(memory_store(spark, sf), "user7").select("id", F.row_number().over(Window.partitionBy("topic").orderBy("ts", "seq")).alias("place"))


@query("F10_provenance", MEM + "SELECT id, topic, source, round(ts, 3) AS ts, kind FROM m WHERE id = '77'")
def _(spark, sf):
    return M.provenance(memory_store(spark, sf), memory_places(spark, sf), "77").withColumn("ts", F.round("ts", 3))


@query("J5_id_index_join", MEM + "SELECT m.topic, count(*) AS n FROM m GROUP BY m.topic")
def _(spark, sf):
    return memory_store(spark, sf).join(memory_places(spark, sf), ["id", "topic"]).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("S19_json_lines", MEM + "SELECT kind, count(*) AS n FROM m GROUP BY kind")
def _(spark, sf):
    path = scratch(spark) + "/json"
    stores.write_json(memories(spark, sf), path)
    return spark.read.schema("kind string").json(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("W2_running_offset", MEM + "SELECT topic, seq, coalesce(sum(strlen(text)) OVER (PARTITION BY topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM m")
def _(spark, sf):
    sizes = memories(spark, sf).select("topic", "seq", F.octet_length("text").alias("size"))
    return stores.offsets(sizes, "topic", "seq", "size").select("topic", "seq", "offset")


@query("S7_annotation_store", "SELECT 'items' AS part, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels")
def _(spark, sf):
    base = scratch(spark)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    stores.write(docs.select(F.col("doc_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("substrate")), "items", f"{base}/items")
    label = F.struct(F.col("quality").alias("class"), F.lit(1.0).alias("confidence"), F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("bbox"))
    stores.write(labels.select(F.col("doc_id").cast("string").alias("item_id"), label.alias("label"), F.col("doc_id").alias("seq"), F.lit("quality").alias("annotator")), "labels", f"{base}/labels")
    count = lambda s: stores.read(spark, s, f"{base}/{s}").agg(F.lit(s).alias("part"), F.count(F.lit(1)).alias("n"))
    return count("items").unionByName(count("labels"))


# ---- tensors

TEN = """WITH t AS (SELECT 'model.layers.' || p_size || '.mlp.experts.' || right(p_brand, 1) || '.p' || p_partkey AS name, 'float16' AS dtype, strlen(p_name) * 2 AS nbytes, p_name FROM part)
"""


def tensors(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.lit("model.layers."), F.col("p_size").cast("string"), F.lit(".mlp.experts."), F.substring("p_brand", -1, 1), F.lit(".p"), F.col("p_partkey").cast("string"))
    data = F.concat(F.col("p_name"), F.col("p_name")).cast("binary")
    return p.select(name.alias("name"), F.array(F.octet_length("p_name")).alias("shape"), F.lit("float16").alias("dtype"), F.lit("raw").alias("codec"), (F.octet_length("p_name") * 2).cast("long").alias("nbytes"), data.alias("data"))


def tensor_store(spark, sf):
    return written(spark, "tensors", sf, lambda path: stores.write(tensors(spark, sf), "tensors", path), lambda path: stores.read(spark, "tensors", path))


@query("S11_tensor_store", TEN + "SELECT count(*) AS n, sum(nbytes)::BIGINT AS nbytes FROM t")
def _(spark, sf):
    path = scratch(spark)
    stores.write(tensors(spark, sf), "tensors", path)
    return stores.read(spark, "tensors", path).agg(F.count(F.lit(1)).alias("n"), F.sum("nbytes").alias("nbytes"))


@query("S12_reader_checks_schema", """WITH want(store, name) AS (VALUES ('tensors', 'name'), ('tensors', 'shape'), ('tensors', 'dtype'), ('tensors', 'codec'), ('tensors', 'nbytes'), ('tensors', 'data'), ('places', 'id'), ('places', 'topic')),
have AS (SELECT 'region' AS source, unnest(['r_regionkey', 'r_name']) AS name UNION ALL SELECT 'nation', unnest(['n_nationkey', 'n_name', 'n_regionkey']) UNION ALL SELECT 'part', unnest(['id', 'topic', 'p_size']))
SELECT s.source, w.store, count(*) FILTER (h.name IS NULL) > 0 AS refused FROM (SELECT DISTINCT source FROM have) s CROSS JOIN want w LEFT JOIN have h ON h.source = s.source AND h.name = w.name GROUP BY ALL""")
def _(spark, sf):
    """Folders that are and aren't the store that they are asked for."""
    text = lambda c: F.col(c).cast("string")
    sources = {"region": table(spark, sf, "region"), "nation": table(spark, sf, "nation"), "part": table(spark, sf, "part").select(text("p_partkey").alias("id"), text("p_brand").alias("topic"), "p_size")}
    out = []
    for source, df in sources.items():
        path = scratch(spark)
        df.write.mode("overwrite").parquet(path)
        for store in ("tensors", "places"):
            try:
                stores.read(spark, store, path)
                out.append((source, store, False))
            except ValueError:
                out.append((source, store, True))
    return spark.createDataFrame(out, "source string, store string, refused boolean")


@query("S13_full_read", TEN + "SELECT name, nbytes FROM t")
def _(spark, sf):
    return tensor_store(spark, sf).select("name", F.octet_length("data").cast("long").alias("nbytes"))


@query("F12_tensor", TEN + "SELECT name, nbytes FROM t WHERE name = (SELECT min(name) FROM t)")
def _(spark, sf):
    t = tensor_store(spark, sf)
    return P.tensor(t, t.agg(F.min("name")).first()[0] or "").select("name", "nbytes")


@query("F13_prefix", TEN + "SELECT 'layer' AS what, name FROM t WHERE starts_with(name, 'model.layers.1.') UNION ALL SELECT 'expert', name FROM t WHERE starts_with(name, 'model.layers.10.mlp.experts.3.')")
def _(spark, sf):
    t = tensor_store(spark, sf)
    return P.layer(t, 1).select(F.lit("layer").alias("what"), "name").unionByName(P.expert(t, 10, 3).select(F.lit("expert").alias("what"), "name"))


@query("A21_tensor_summary", TEN + "SELECT name, dtype, nbytes::BIGINT AS nbytes, round(nbytes / 1e6, 2) AS mb FROM t")
def _(spark, sf):
    return P.summary(tensor_store(spark, sf))


@query("A21_tensor_total", TEN + "SELECT count(*) AS n, sum(nbytes)::BIGINT AS nbytes, round(sum(nbytes) / 1e6, 1) AS mb FROM t")
def _(spark, sf):
    return P.total(tensor_store(spark, sf))


# ---- spans

SP = """WITH RECURSIVE s AS (SELECT event_id AS span_id, CASE WHEN event_id > 0 THEN (event_id - 1) // 2 END AS parent_id, event_type AS service, CAST(value * 1000 AS BIGINT) AS dur_us,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_id AS seq, props FROM events),
k AS (SELECT parent_id AS parent, sum(dur_us) AS child_us FROM s WHERE parent_id IS NOT NULL GROUP BY parent_id),
z AS (SELECT s.*, dur_us - coalesce(child_us, 0) AS self_us FROM s LEFT JOIN k ON k.parent = s.span_id)
"""


def spans(spark, sf):
    e = table(spark, sf, "events")
    parent = F.when(F.col("event_id") > 0, F.floor((F.col("event_id") - 1) / 2))
    return e.select(F.col("event_id").alias("span_id"), parent.alias("parent_id"), F.col("event_type").alias("service"), F.round(F.col("value") * 1000).cast("long").alias("dur_us"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("event_id").alias("seq"))


def payloads(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("span_id"), "props")


@query("S10_trace_store", SP + "SELECT status, count(*) AS n, sum(dur_us)::BIGINT AS total_us FROM s GROUP BY status")
def _(spark, sf):
    path = scratch(spark)
    s = spans(spark, sf)
    text = s.select(*(F.col(c).cast("string").alias(c) for c in ("span_id", "parent_id", "service")), F.lit("op").alias("operation"), F.col("seq").alias("start_us"), "dur_us", "status", "seq")
    stores.write(text, "spans", path)
    return stores.read(spark, "spans", path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("dur_us").alias("total_us"))


@query("A20_trace_summary", SP + "SELECT service, count(*) AS spans, sum(dur_us)::BIGINT AS total_us, count(*) FILTER (status = 'error') AS errors FROM s GROUP BY service")
def _(spark, sf):
    return T.by_service(spans(spark, sf))


@query("T2_slowest", SP + "SELECT span_id, self_us::BIGINT AS self_us FROM z ORDER BY self_us DESC, seq LIMIT 5")
def _(spark, sf):
    return T.slowest(spans(spark, sf)).select("span_id", "self_us")


@query("O3_self_time", SP + "SELECT span_id, self_us::BIGINT AS self_us FROM z")
def _(spark, sf):
    return T.self_time(spans(spark, sf)).select("span_id", "self_us")


@query("J3_children", SP + "SELECT parent_id AS parent, count(*) AS children, sum(dur_us)::BIGINT AS child_us FROM s WHERE parent_id IS NOT NULL GROUP BY parent_id")
def _(spark, sf):
    return T.children_time(spans(spark, sf))


@query("T4_longest_child", SP + "SELECT parent_id AS parent, arg_max(span_id, (dur_us, -seq)) AS child FROM s WHERE parent_id IS NOT NULL GROUP BY parent_id")
def _(spark, sf):
    return T.longest_child(spans(spark, sf))


@query("W9_root", SP + "SELECT span_id FROM s WHERE parent_id IS NULL ORDER BY seq LIMIT 1")
def _(spark, sf):
    return T.root(spans(spark, sf))


@query("O1_critical_path", SP + ", b AS (SELECT parent_id AS parent, arg_max(span_id, (dur_us, -seq)) AS child FROM s WHERE parent_id IS NOT NULL GROUP BY parent_id), p AS (SELECT 0::BIGINT AS span_id, 0 AS depth UNION ALL SELECT b.child, p.depth + 1 FROM b JOIN p ON b.parent = p.span_id) SELECT span_id, depth FROM p")
def _(spark, sf):
    return T.critical_path(spans(spark, sf))


_SUB = SP + ", d AS (SELECT 5::BIGINT AS span_id, 0 AS depth UNION ALL SELECT s.span_id, d.depth + 1 FROM s JOIN d ON s.parent_id = d.span_id) "


@query("O2_subtree", _SUB + "SELECT d.span_id, d.depth, s.props FROM d JOIN s ON s.span_id = d.span_id")
def _(spark, sf):
    return T.with_payload(T.subtree(spans(spark, sf), 5), payloads(spark, sf))


@query("J4_subtree_recursive", _SUB + "SELECT span_id, depth FROM d")
def _(spark, sf):
    return T.subtree(spans(spark, sf), 5)


@query("F11_service", SP + "SELECT span_id, props FROM s WHERE service = 'error'")
def _(spark, sf):
    return T.with_payload(spans(spark, sf).where("service = 'error'").select("span_id"), payloads(spark, sf))


@query("J2_structure_with_payload", SP + "SELECT service, sum(strlen(props))::BIGINT AS bytes FROM s GROUP BY service")
def _(spark, sf):
    return T.with_payload(spans(spark, sf), payloads(spark, sf)).groupBy("service").agg(F.sum(F.octet_length("props")).alias("bytes"))


# ---- Merkle trees over the texts, padded to 2**14 leaves at most in SQL


def _merkle_sql(tampered: bool = False) -> str:
    """The same levels as a chain of joins; padding subtrees are literals."""
    text = "CASE WHEN doc_id = 123 THEN text || '!' ELSE text END" if tampered else "text"
    pads, n = K.padding(20), 18
    blob = lambda b: "unhex('" + b.hex() + "')"
    pre = "x" if tampered else "l"
    parts = [f"{pre}0 AS MATERIALIZED (SELECT doc_id AS idx, unhex(sha256(unhex('00') || encode({text}))) AS hash FROM documents)"]
    for k in range(n):
        parts.append(f"{pre}{k + 1} AS MATERIALIZED (SELECT a.idx // 2 AS idx, unhex(sha256(unhex('01') || a.hash || coalesce(b.hash, {blob(pads[k])}))) AS hash FROM {pre}{k} a LEFT JOIN {pre}{k} b ON b.idx = a.idx + 1 WHERE a.idx % 2 = 0)")
    union = " UNION ALL ".join(f"SELECT {k} AS level, idx, hash FROM {pre}{k}" for k in range(n + 1))
    parts.append(f"d{pre} AS (SELECT ceil(log2(count(*)))::INT AS depth FROM documents)")
    parts.append(f"t{pre} AS MATERIALIZED (SELECT level, idx, hash FROM ({union}) CROSS JOIN d{pre} WHERE level <= depth)")
    return ", ".join(parts)


MK = "WITH " + _merkle_sql() + " "
MK2 = "WITH " + _merkle_sql() + ", " + _merkle_sql(True) + " "


def leaves(spark, sf, tampered: bool = False):
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") == 123, F.concat("text", F.lit("!"))).otherwise(F.col("text")) if tampered else F.col("text")
    return d.select(F.col("doc_id").alias("idx"), text.cast("binary").alias("item"))


def merkle(spark, sf, tampered: bool = False):
    """(tree, root) over the texts, built by the first who asks."""

    def opened(path):
        tree = spark.read.schema("level int, idx long, hash binary").parquet(path)
        return tree, bytes.fromhex(K.commit(tree).first().root)

    return written(spark, f"merkle-{tampered}", sf, lambda path: K.build(leaves(spark, sf, tampered)).write.mode("overwrite").parquet(path), opened)


def _hex(df):
    return df.withColumn("hash", F.lower(F.hex("hash")))


@query("O4_merkle_commit", MK + "SELECT lower(hex(hash)) AS root FROM tl ORDER BY level DESC LIMIT 1")
def _(spark, sf):
    return K.commit(K.build(leaves(spark, sf)))


@query("O4_merkle_tree", MK + "SELECT level, idx, lower(hex(hash)) AS hash FROM tl")
def _(spark, sf):
    return _hex(K.build(leaves(spark, sf)))


_PADS = "CASE w.level " + " ".join(f"WHEN {i} THEN '{p.hex()}'" for i, p in enumerate(K.padding(20))) + " END"


@query("O5_merkle_proof", MK + f", w AS (SELECT range::INT AS level, xor(17 >> range::INT, 1)::BIGINT AS idx FROM range(20) CROSS JOIN dl WHERE range < depth) SELECT w.level, w.idx, coalesce(lower(hex(t.hash)), {_PADS}) AS hash FROM w LEFT JOIN tl t ON t.level = w.level AND t.idx = w.idx")
def _(spark, sf):
    return _hex(K.prove(merkle(spark, sf)[0], 17))


@query("O5_merkle_verify", "SELECT doc_id AS idx, doc_id <> 123 AS valid FROM documents")
def _(spark, sf):
    tree, root = merkle(spark, sf)
    every = leaves(spark, sf, True)
    return K.verify_all(every, K.prove_each(tree, every), F.lit(root))


@query("O6_merkle_multiproof", MK2 + """, w AS (SELECT l0.idx, l0.hash <> x0.hash AS changed FROM l0 JOIN x0 ON x0.idx = l0.idx WHERE l0.idx BETWEEN 100 AND 136)
SELECT count(*) = 37 AS whole, NOT bool_or(changed) AS forged, count(*) AS indices FROM w""")
def _(spark, sf):
    wanted = list(range(100, 137))
    tree, root = merkle(spark, sf)
    depth, helpers = K.depth_of(tree), settle(K.prove_many(tree, wanted))
    ok = [K.verify_many(leaves(spark, sf, t).where(F.col("idx").isin(wanted)), helpers, root, depth, wanted) for t in (False, True)]
    return spark.createDataFrame([(ok[0], ok[1], len(wanted))], "whole boolean, forged boolean, indices long")


@query("U3_same_indices", """SELECT 'labels' AS other, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right
UNION ALL SELECT 'embeddings', (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id + 7 FROM embeddings)), (SELECT count(*) FROM (SELECT vec_id + 7 FROM embeddings EXCEPT SELECT doc_id FROM documents))
UNION ALL SELECT 'itself', (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM documents)), 0""")
def _(spark, sf):
    a = leaves(spark, sf)
    others = {"labels": table(spark, sf, "labels").select(F.col("doc_id").alias("idx")), "embeddings": table(spark, sf, "embeddings").select((F.col("vec_id") + 7).alias("idx")), "itself": a}
    out = None
    for name, b in others.items():
        one = K.same_indices(a, b).select(F.lit(name).alias("other"), "only_left", "only_right")
        out = one if out is None else out.unionByName(one)
    return out


@query("O6b_locate_tamper", MK2 + "SELECT min(l0.idx) AS idx FROM l0 JOIN x0 ON x0.idx = l0.idx WHERE l0.hash <> x0.hash")
def _(spark, sf):
    return K.locate_tamper(merkle(spark, sf)[0], merkle(spark, sf, True)[0])


@query("J7_differing_nodes", MK2 + "SELECT a.level, a.idx FROM tl a JOIN tx b ON b.level = a.level AND b.idx = a.idx AND b.hash <> a.hash")
def _(spark, sf):
    return K.descend(merkle(spark, sf)[0], merkle(spark, sf, True)[0])


@query("O6c_full_audit", MK2 + "SELECT (SELECT count(*) = 0 FROM l0 a JOIN l0 b ON b.idx = a.idx WHERE a.hash <> b.hash) AS whole, (SELECT count(*) = 0 FROM l0 JOIN x0 ON x0.idx = l0.idx WHERE l0.hash <> x0.hash) AS tampered")
def _(spark, sf):
    root = merkle(spark, sf)[1].hex()
    return spark.createDataFrame([(K.full_audit(leaves(spark, sf), root), K.full_audit(leaves(spark, sf, True), root))], "whole boolean, tampered boolean")

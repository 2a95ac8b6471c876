"""Mixing sources to target weights by soft membership.

Rows with a source are the labelled table. A classifier over it, counts of cells of
text features, learnt on one half of the rows for the other, gives every document a posterior over the
sources. How far a row's own label is to be believed is learnt as well, by expectation
maximisation: a label is either the row's domain or drawn at random, and the less the classifier expects it the likelier it is
the latter. Projected-gradient least squares then finds nonnegative rates whose expected
tokens per source come as near the targets as they can. Documents of the same source, cell and half have
the same posterior and so the same gradient and rate, so the steps run over that small grouped table and never
over documents.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import cut, nested, table

#: Share of labels drawn at random that learning starts from, and its steps.
DOUBT, DOUBT_STEPS = 0.1, 10
#: Default targets: shares of tokens raised to this power.
TEMPER = 0.7
#: Steps end when none moves a source's tokens by more than this share of the corpus, or after so many.
TOLERANCE, MOST_STEPS = 1e-11, 100
#: Rates, one a group, that may be broadcast.
SMALL_TABLE = 50_000
#: Sources whose totals may come to the driver at each step.
FEW = 64
#: Documents that the prior counts for in every cell: enough that a source that few rows of a cell happen to have isn't taken for unlikely.
SMOOTHING = 100.0

WORD, SHOUT, SIGN = "[^ \\t\\n\\r]+", "[A-Z][A-Z]+", "[*#$%&!|]"
KEY = ["_source", "_cell", "_half"]


def features(df: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """row (``df``'s columns), doc_id, _tokens (words between white space), _source, _half and _cell: language, size in powers of two, characters a
    word, share of bytes beyond ASCII, and whether the text shouts or is full of signs."""
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    out = nested(df).withColumn("_tokens", F.regexp_count(text, F.lit(WORD)).cast("long"))
    more = lambda pattern: (F.regexp_count(text, F.lit(pattern)) * 4 > F.col("_tokens")).cast("int").cast("string")
    chars = F.length(text).cast("long")
    width = F.least(F.lit(12), F.floor(chars / F.greatest(F.lit(1), F.col("_tokens")))).cast("string")
    beyond = F.floor((F.octet_length(text) - chars) * 20 / F.greatest(F.lit(1), chars)).cast("string")
    lang = F.coalesce(F.col(f"row.`{lang_col}`").cast("string"), F.lit(""))
    cell = F.concat_ws(":", lang, F.length(F.bin(F.col("_tokens"))).cast("string"), width, beyond, more(SHOUT), more(SIGN))
    doc_id = F.col(f"row.`{id_col}`")
    half = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 32, 1), 16, 10).cast("int") % 2).cast("int")
    return out.select("row", doc_id.alias("doc_id"), "_tokens", F.col(f"row.`{source_col}`").cast("string").alias("_source"), half.alias("_half"), cell.alias("_cell"))


def grouped(marked: DataFrame) -> DataFrame:
    return marked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.sum("_tokens").alias("tokens"))


def _learnt_doubt(groups: DataFrame, steps: int = DOUBT_STEPS) -> float:
    """The share of labels drawn at random. groups: docs of labelled rows, and lift: how much likelier than by chance the classifier thinks the label."""
    doubt = DOUBT
    labelled = groups.where("_source is not null")
    for _ in range(steps):
        e = F.lit(doubt)
        found = labelled.agg(F.sum(F.col("docs") * e / (e + (1 - e) * F.col("lift"))) / F.sum("docs")).first()[0]
        doubt = float(found if found is not None else doubt)
    return doubt


def _belief(doubt: float) -> Column:
    """How far a group's label is believed; nothing without one."""
    sure = (1 - doubt) * F.col("lift")
    return F.when(F.col("_source").isNull(), F.lit(0.0)).otherwise(sure / (doubt + sure))


def group_rates(groups: DataFrame, targets: dict[str, float] | None = None, temper: float = TEMPER, few: int = FEW, most_steps: int = MOST_STEPS) -> tuple[DataFrame, DataFrame]:
    """((_source, _cell, _half, rate) for a table with docs and tokens per group, (source, tokens, target, reached) per source).

    targets: weights per source, of which those for sources without tokens ask for nothing; without
    them the sources' shares of labelled tokens to the power ``temper``. The expected total stays that of the corpus. reached: the
    expected tokens under the rates; a warning says so if the steps ended before they settled.
    A step scales a source's pull by its expected tokens at rate 1, under which steps can't diverge: what the sources share then sums up to one.
    Up to ``few`` sources stand in arrays, and a step is one global sum; more stand in rows, and a step is joins. Both
    are the same numbers.
    """
    if targets is not None and not sum(targets.values()) > 0:
        raise ValueError("targets must weigh something")
    groups = cut(groups)
    sources = groups.where("_source is not null").groupBy("_source").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("tokens > 0")
    first = sources.limit(few + 1).collect()
    weight = [float(targets.get(s, 0.0)) if targets is not None else t**temper for s, _, t in first]
    if not first or (len(first) <= few and not sum(weight) > 0):
        nothing = groups.sparkSession.createDataFrame([], "source string, tokens long, target double, reached double")
        return groups.select(*KEY, F.lit(1.0).alias("rate")), nothing
    if len(first) <= few:
        return _by_arrays(groups, sorted(zip(first, weight, strict=True)), most_steps)
    return _by_joins(groups, cut(sources), targets, temper, most_steps)


def _unsettled(moved: float, tokens: float) -> None:
    warnings.warn(f"rates have not settled: the last step moved a source by {moved / tokens:.2g} of all tokens", stacklevel=4)


def _by_arrays(groups: DataFrame, sources: list, most_steps: int) -> tuple[DataFrame, DataFrame]:
    names = [s for (s, _, _), _ in sources]
    k = range(len(names))
    docs, tokens = sum(d for (_, d, _), _ in sources), groups.agg(F.sum("tokens")).first()[0]
    prior = [d / docs for (_, d, _), _ in sources]
    target = [w / sum(w for _, w in sources) * tokens for _, w in sources]
    # P(source | cell) for one half from the counts of the other, smoothed by the prior
    fine = F.col("_source").isin(names)
    here = [F.sum(F.when(F.col("_source") == s, F.col("docs")).otherwise(0)) for s in names]
    seen = F.sum(F.when(fine, F.col("docs")).otherwise(0))
    cells = groups.groupBy(F.col("_cell").alias("c"), (1 - F.col("_half")).alias("h")).agg(F.array(*((n + SMOOTHING * q) / (seen + SMOOTHING) for n, q in zip(here, prior, strict=True))).alias("q"))
    q = F.coalesce("q", F.array(*(F.lit(x) for x in prior)))
    own = F.greatest(F.lit(0), F.array_position(F.array(*(F.lit(s) for s in names)), F.col("_source")).cast("int") - 1)
    at = F.array(*(F.lit(x) for x in prior))
    source = F.when(fine, F.col("_source"))
    both = groups.join(cut(cells), (F.col("_cell") == F.col("c")) & (F.col("_half") == F.col("h")), "left")
    both = cut(both.select(F.col("_source").alias("_given"), source.alias("_source"), "_cell", "_half", "docs", F.col("tokens").cast("double").alias("tokens"), q.alias("q"), (q[own] / at[own]).alias("lift")).coalesce(16))
    doubt = _learnt_doubt(both)
    ones = F.array(*(F.when(F.col("_source") == s, 1.0).otherwise(0.0) for s in names))
    p = F.zip_with("q", ones, lambda x, o: (1 - F.col("w")) * x + F.col("w") * o)
    member = cut(both.withColumn("w", _belief(doubt)).select(F.col("_given").alias("_source"), "_cell", "_half", "tokens", p.alias("p"), F.lit(1.0).alias("rate")))
    total = lambda m: list(m.withColumn("m", F.col("tokens") * F.col("rate")).agg(*(F.sum(F.col("m") * F.col("p")[i]) for i in k)).first())
    start = now = total(member)
    for step_no in range(most_steps):
        pull = F.array(*(F.lit((now[i] - target[i]) / start[i]) for i in k))
        step = F.aggregate(F.zip_with("p", pull, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        member = member.withColumn("rate", F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), F.col("rate") - step)).otherwise(F.lit(1.0)))
        member = cut(member) if step_no % 4 == 3 else member
        before, now = now, total(member)
        moved = max(abs(a - b) for a, b in zip(before, now, strict=True))
        if moved <= TOLERANCE * tokens:
            break
    else:
        _unsettled(moved, tokens)
    rows = [(s, int(t), target[i], now[i]) for i, ((s, _, t), _) in enumerate(sources)]
    return member.select(*KEY, "rate"), groups.sparkSession.createDataFrame(rows, "source string, tokens long, target double, reached double")


def _by_joins(groups: DataFrame, sources: DataFrame, targets: dict[str, float] | None, temper: float, most_steps: int) -> tuple[DataFrame, DataFrame]:
    """The steps for any number of sources. A posterior is what the label says, what the cell's other half has seen, and what the prior leaves;
    these stay apart, so no table is larger than the groups are."""
    if targets is not None:
        given = groups.sparkSession.createDataFrame([(a, float(b)) for a, b in targets.items()], "s string, weight double")
        sources = sources.join(given, sources["_source"] == given["s"], "left").select("_source", "docs", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sources = sources.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(float(temper))))
    docs, weight = sources.agg(F.sum("docs"), F.sum("weight")).first()
    tokens = groups.agg(F.sum("tokens")).first()[0]
    if not weight > 0:
        nothing = groups.sparkSession.createDataFrame([], "source string, tokens long, target double, reached double")
        return groups.select(*KEY, F.lit(1.0).alias("rate")), nothing
    sources = cut(sources.select(F.col("_source").alias("s"), F.col("tokens").alias("labelled"), (F.col("docs") / F.lit(docs)).alias("prior"), (F.col("weight") / F.lit(weight) * F.lit(tokens)).alias("target")))
    groups = groups.join(sources.select("s", "prior"), groups["_source"] == sources["s"], "left").withColumnRenamed("_source", "_given").withColumnRenamed("s", "_source")
    other = groups.where("_source is not null").select(F.col("_cell").alias("c"), (1 - F.col("_half")).alias("h"), F.col("_source").alias("s"), F.col("docs").alias("n"))
    other = cut(other.groupBy("c", "h", "s").agg(F.sum("n").alias("n")))
    held = other.groupBy("c", "h").agg(F.sum("n").alias("all"))
    groups = groups.join(held, (F.col("_cell") == F.col("c")) & (F.col("_half") == F.col("h")), "left").drop("c", "h").withColumn("all", F.coalesce("all", F.lit(0)))
    seen = other.join(held.withColumnsRenamed({"c": "c2", "h": "h2"}), (F.col("c") == F.col("c2")) & (F.col("h") == F.col("h2"))).select("c", "h", "s", "n", (F.col("n") / (F.col("all") + SMOOTHING)).alias("share"))
    seen = cut(seen)
    own = seen.select(F.col("c").alias("c2"), F.col("h").alias("h2"), F.col("s").alias("s2"), F.col("n").alias("own"))
    groups = groups.join(own, (F.col("_cell") == F.col("c2")) & (F.col("_half") == F.col("h2")) & (F.col("_source") == F.col("s2")), "left")
    rest = SMOOTHING / (F.col("all") + SMOOTHING)
    lift = (F.coalesce("own", F.lit(0)) / (F.col("all") + SMOOTHING) + rest * F.col("prior")) / F.col("prior")
    groups = cut(groups.select("_given", "_source", "_cell", "_half", "docs", F.col("tokens").cast("double").alias("tokens"), rest.alias("rest"), lift.alias("lift")))
    doubt = _learnt_doubt(groups)
    member = cut(groups.withColumn("w", _belief(doubt)).withColumn("rate", F.lit(1.0)).drop("docs", "lift"))

    def totals(member: DataFrame) -> DataFrame:
        here = member.withColumn("m", F.col("tokens") * F.col("rate"))
        cells = here.groupBy("_cell", "_half").agg(F.sum(F.col("m") * (1 - F.col("w"))).alias("m"), F.first("rest").alias("rest"))
        spread = F.broadcast(cells.agg(F.sum(F.col("m") * F.col("rest")).alias("spread")))  # one row
        soft = seen.join(cells, (F.col("c") == F.col("_cell")) & (F.col("h") == F.col("_half"))).select("s", (F.col("share") * F.col("m")).alias("t"))
        sure = here.where("_source is not null").select(F.col("_source").alias("s"), (F.col("m") * F.col("w")).alias("t"))
        both = soft.unionByName(sure).groupBy("s").agg(F.sum("t").alias("t"))
        out = sources.join(both.withColumnRenamed("s", "s2"), F.col("s") == F.col("s2"), "left").crossJoin(spread)
        return cut(out.select("s", "labelled", "prior", "target", (F.coalesce("t", F.lit(0.0)) + F.col("prior") * F.col("spread")).alias("total")))

    now = totals(member)
    start = now.select(F.col("s").alias("s3"), F.col("total").alias("start"))
    for _ in range(most_steps):
        pull = cut(now.join(start, F.col("s") == F.col("s3")).select("s", "prior", ((F.col("total") - F.col("target")) / F.col("start")).alias("pull")))
        mean = F.broadcast(pull.agg(F.sum(F.col("prior") * F.col("pull")).alias("mean")))  # one row
        cells = seen.join(pull.select(F.col("s").alias("s2"), "pull"), F.col("s") == F.col("s2")).groupBy("c", "h").agg(F.sum(F.col("share") * F.col("pull")).alias("soft"))
        step = member.join(cells, (F.col("_cell") == F.col("c")) & (F.col("_half") == F.col("h")), "left").join(pull.select("s", "pull"), F.col("_source") == F.col("s"), "left").crossJoin(mean)
        moves = F.col("w") * F.coalesce("pull", F.lit(0.0)) + (1 - F.col("w")) * (F.coalesce("soft", F.lit(0.0)) + F.col("rest") * F.col("mean"))
        member = cut(step.select("_given", "_source", "_cell", "_half", "tokens", "rest", "w", F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), F.col("rate") - moves)).otherwise(F.lit(1.0)).alias("rate")))
        before, now = now, totals(member)
        moved = now.join(before.select(F.col("s").alias("s2"), F.col("total").alias("was")), F.col("s") == F.col("s2")).agg(F.max(F.abs(F.col("total") - F.col("was")))).first()[0]
        if moved <= TOLERANCE * tokens:
            break
    else:
        _unsettled(moved, tokens)
    return member.select(F.col("_given").alias("_source"), "_cell", "_half", "rate"), now.select(F.col("s").alias("source"), F.col("labelled").alias("tokens"), "target", F.col("total").alias("reached"))


def _chance(doc_id: Column) -> Column:
    """A number in [0, 1) that only depends on the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _mixed(df: DataFrame, targets: dict[str, float] | None, text_col: str, source_col: str, lang_col: str, id_col: str, options: dict) -> DataFrame:
    """features() with rate and copies: the rate's whole part, and one more by a chance that hangs on the id."""
    marked = features(df, text_col, source_col, lang_col, id_col)
    rates = cut(group_rates(grouped(marked), targets, **options)[0].toDF("g", "c", "h", "r"))
    if rates.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:  # else the documents are dealt to it by group
        rates = F.broadcast(rates)
    out = marked.join(rates, F.col("_source").eqNullSafe(F.col("g")) & (F.col("_cell") == F.col("c")) & (F.col("_half") == F.col("h")), "left")
    rate = F.round(F.col("r"), 6)
    copies = F.floor(rate) + (_chance(F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return out.select("row", "doc_id", "_source", "_tokens", rate.alias("_rate"), copies.cast("long").alias("_copies"))


def mix(df: DataFrame, targets: dict[str, float] | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) per row.

    Documents without tokens have no pull on any total and keep rate 1. A null source is a row without label:
    its cell alone says where it belongs; so is a source without tokens. Without a single labelled token every rate is 1. Null texts
    and languages count as empty; repeated rows have the same rate; other columns are ignored. An empty table gives no rows.
    """
    out = _mixed(df, targets, text_col, source_col, lang_col, id_col, options)
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def totals(df: DataFrame, targets: dict[str, float] | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id", **options) -> DataFrame:
    """(source, tokens, target, reached) per source: what its rows hold, what is asked for and what the rates are expected to bring."""
    return group_rates(grouped(features(df, text_col, source_col, lang_col, id_col)), targets, **options)[1]


def apply_mix(df: DataFrame, targets: dict[str, float] | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df``, each as often as its copies say, with its columns, whatever their names."""
    out = _mixed(df, targets, text_col, source_col, lang_col, id_col, options).where("_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle(iterations: int = 30) -> str:
    """The same in SQL, where memberships are rows (group, source) and the steps are so many that they have settled."""
    doubts, steps = [f"e0 AS (SELECT {DOUBT}::DOUBLE AS e)"], []
    for i in range(DOUBT_STEPS):
        doubts.append(f"e{i + 1} AS MATERIALIZED (SELECT sum(l.docs * e / (e + (1 - e) * l.lift)) / sum(l.docs) AS e FROM lifts l CROSS JOIN e{i})")
    for i in range(iterations):
        steps.append(f"""
t{i} AS MATERIALIZED (SELECT m.s, (sum(m.tokens * r.rate * m.p) - any_value(w.target)) / any_value(w.start) AS pull
       FROM member m JOIN r{i} r ON m.g = r.g JOIN w ON w.s = m.s GROUP BY m.s),
r{i + 1} AS MATERIALIZED (SELECT m.g, CASE WHEN max(m.tokens) > 0 THEN greatest(0.0, max(r.rate) - sum(m.p * t.pull)) ELSE 1.0 END AS rate
       FROM member m JOIN r{i} r ON m.g = r.g JOIN t{i} t ON t.s = m.s GROUP BY m.g)""")
    return f"""
WITH n AS MATERIALIZED (SELECT doc_id, source, coalesce(lang, '') AS lang, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, tokens, ('0x' || substr(md5(doc_id::VARCHAR), 32, 1))::INT % 2 AS half, concat_ws(':', lang, length(bin(tokens))::VARCHAR,
       least(12, floor(length(text) / greatest(1, tokens)))::BIGINT::VARCHAR, floor((strlen(text) - length(text)) * 20 / greatest(1, length(text)))::BIGINT::VARCHAR,
       (len(regexp_extract_all(text, '[A-Z][A-Z]+')) * 4 > tokens)::INT::VARCHAR, (len(regexp_extract_all(text, '[*#$%&!|]')) * 4 > tokens)::INT::VARCHAR) AS cell FROM n),
g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source, cell, half) AS g, * FROM (SELECT source, cell, half, count(*) AS docs, sum(tokens) AS tokens FROM d GROUP BY ALL)),
s0 AS (SELECT source AS s, sum(docs) AS docs, sum(tokens) AS tokens, pow(sum(tokens)::DOUBLE, {TEMPER}) AS weight FROM g GROUP BY source),
s AS MATERIALIZED (SELECT s, docs / sum(docs) OVER () AS prior, weight / sum(weight) OVER () * (SELECT sum(tokens)::DOUBLE FROM g) AS target FROM s0),
held AS (SELECT cell, 1 - half AS half, sum(docs) AS docs FROM g GROUP BY ALL),
seen AS (SELECT cell, 1 - half AS half, source, sum(docs) AS docs FROM g GROUP BY ALL),
q AS MATERIALIZED (SELECT g.g, s.s, (coalesce(seen.docs, 0) + {SMOOTHING} * s.prior) / (coalesce(held.docs, 0) + {SMOOTHING}) AS q, s.prior
      FROM g CROSS JOIN s LEFT JOIN held ON held.cell = g.cell AND held.half = g.half LEFT JOIN seen ON seen.cell = g.cell AND seen.half = g.half AND seen.source = s.s),
lifts AS MATERIALIZED (SELECT g.g, g.docs, q.q / q.prior AS lift FROM g JOIN q ON q.g = g.g AND q.s = g.source),
{",".join(doubts)},
trust AS MATERIALIZED (SELECT l.g, (1 - e) * l.lift / (e + (1 - e) * l.lift) AS w FROM lifts l CROSS JOIN e{DOUBT_STEPS}),
member AS MATERIALIZED (SELECT g.g, g.tokens, q.s, (1 - w) * q.q + CASE WHEN g.source = q.s THEN w ELSE 0 END AS p FROM g JOIN q ON q.g = g.g JOIN trust ON trust.g = g.g),
w AS MATERIALIZED (SELECT s, sum(tokens * p) AS start, any_value(target) AS target FROM member JOIN s USING (s) GROUP BY s),
r0 AS MATERIALIZED (SELECT g, 1.0::DOUBLE AS rate FROM g),{",".join(steps)},
x AS (SELECT d.doc_id, d.source, d.tokens AS n_tokens, round(r.rate, 6) AS rate FROM d JOIN g ON g.source = d.source AND g.cell = d.cell AND g.half = d.half JOIN r{iterations} r ON r.g = g.g)
SELECT *, floor(rate)::BIGINT + (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate))::BIGINT AS copies FROM x
"""


ORACLE = _oracle()

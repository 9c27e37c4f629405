"""Queries over text views, lines, blocks, sentences and document metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import spread, table
from lectern.functions.text import WORD
from lectern.operators import graph, metrics, reader, study
from lectern.operators import views as V
from lectern.plans import oracle as O
from lectern.sources.catalogue import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return deco


def docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", *cols))


def views(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return V.with_views(docs(spark, d, *cols)).withColumn("text", F.coalesce("text", F.lit("")))


@query(f"WITH {O.views()} SELECT doc_id, length(masked) AS n, md5(masked) AS masked, md5(prose) AS prose FROM v")
def text_views(spark, d):
    return views(spark, d).select("doc_id", F.length("masked").cast("bigint").alias("n"), F.md5("masked").alias("masked"), F.md5("prose").alias("prose"))


def _count(p: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), {O.q(p)}))"


_PASSES = {"code": V.INLINE_CODE, "comments": V.COMMENT, "tags": V.TAG, "containers": V.CONTAINER, "labels": V.LABEL, "targets": V.TARGET, "urls": V.URL, "table_lines": V.TABLE, "fences": V.FENCE, "front": V.FRONT}


@query("SELECT doc_id, " + ", ".join(f"{_count(p)} AS {n}" for n, p in _PASSES.items()) + " FROM documents")
def mask_passes(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs(spark, d).select("doc_id", *(F.regexp_count(t, F.lit(V.unix(p))).cast("bigint").alias(n) for n, p in _PASSES.items()))


@query(f"WITH {O.views()}, {O.lines()} SELECT doc_id, line_no, span_start, span_end, kind, continued FROM l")
def text_lines(spark, d):
    return V.lines(views(spark, d)).drop("line")


@query(f"WITH {O.views()}, {O.lines()}, {O.blocks()} SELECT * FROM b")
def text_blocks(spark, d):
    return V.blocks(V.lines(views(spark, d))).drop("t")


@query(f"WITH {O.views()}, {O.lines()}, {O.blocks()}, {O.sentences()} SELECT doc_id, block_id, kind, sent_no, span_start, span_end, md5(sentence) AS sentence FROM s")
def text_sentences(spark, d):
    v = views(spark, d)
    return V.sentences(V.blocks(V.lines(v))).withColumn("sentence", F.md5("sentence"))


@query(f"WITH {O.views()} SELECT doc_id, {O.words('prose')} AS n_words FROM v")
def word_counts(spark, d):
    return views(spark, d).select("doc_id", F.regexp_count("prose", F.lit(WORD)).cast("bigint").alias("n_words"))


@query(
    f"WITH {O.views()}, {O.lines()}, {O.blocks()} SELECT b.doc_id, b.block_id, len(string_split(left(text, b.span_start::BIGINT), chr(10))) AS line, "
    "length(string_split(left(text, b.span_start::BIGINT), chr(10))[-1]) + 1 AS col FROM b JOIN v USING (doc_id)"
)
def line_columns(spark, d):
    v = views(spark, d)
    b = V.blocks(V.lines(v)).join(v.select("doc_id", "text"), "doc_id")
    return b.select("doc_id", "block_id", V.line_and_column(F.col("text"), F.col("span_start")).alias("p")).select("doc_id", "block_id", "p.line", "p.col")


@query(
    f"WITH {O.views()}, {O.lines()}, {O.blocks()}, {O.sentences('s', 'b', 'true')} SELECT b.doc_id, b.block_id, count(s.sent_no) AS sentences, coalesce(min(s.span_start) = any_value(b.span_start), false) AS starts_at_block "
    "FROM b LEFT JOIN s ON s.doc_id = b.doc_id AND s.span_start >= b.span_start AND s.span_start < b.span_end GROUP BY b.doc_id, b.block_id"
)
def sentence_containment(spark, d):
    v = views(spark, d)
    b = V.blocks(V.lines(v))
    s = V.sentences(b, (*V.TEXT_KINDS, "heading")).select(F.col("doc_id").alias("k"), F.col("span_start").alias("a"), "sent_no")
    got = b.join(s, (F.col("doc_id") == F.col("k")) & (F.col("a") >= F.col("span_start")) & (F.col("a") < F.col("span_end")), "left")
    return got.groupBy("doc_id", "block_id").agg(F.count("sent_no").alias("sentences"), F.coalesce(F.min("a") == F.first("span_start"), F.lit(False)).alias("starts_at_block"))


@query(f"WITH {O.views(extra='source,')} SELECT source, sum((masked <> text)::BIGINT)::BIGINT AS changed, sum((length(masked) = length(text) AND length(prose) = length(text))::BIGINT)::BIGINT AS kept_length, count(*) AS n FROM v GROUP BY source")
def view_invariants(spark, d):
    v = views(spark, d, "source")
    return v.groupBy("source").agg(
        F.count(F.when(F.col("masked") != F.col("text"), 1)).alias("changed"), F.count(F.when((F.length("masked") == F.length("text")) & (F.length("prose") == F.length("text")), 1)).alias("kept_length"), F.count(F.lit(1)).alias("n")
    )


def _metric(name: str):
    def run(spark, d):
        return metrics.metric(metrics.Prose.of(views(spark, d)), name).withColumn("value", F.round("value", 6))

    run.__name__ = f"metric_{name}"
    return run


for _n, _sql in O.metric_sql().items():
    query(_sql)(_metric(_n))


def _fired_sql() -> str:
    """Rules as VALUES over the metrics' own subqueries."""
    parts, ctes = [], []
    for r in load():
        if r.metric not in metrics.METRICS:
            continue
        body = O.metric_sql()[r.metric].split(f"{O.prose()}\n", 1)[1]
        ctes.append(f"q_{r.metric} AS ({body})")
        op = ">=" if metrics.METRICS[r.metric] else "<="
        parts.append(f"SELECT doc_id, {O.q(r.id)} AS rule_id, {O.q(r.severity)} AS severity, value, {r.min_sentences} AS ms, {r.min_paragraphs} AS mp FROM q_{r.metric} WHERE value {op} {r.threshold}")
    size = "SELECT v.doc_id, (SELECT count(*) FROM s WHERE s.doc_id = v.doc_id) AS ns, (SELECT count(*) FROM p WHERE p.doc_id = v.doc_id) AS np FROM v"
    return f"WITH {O.prose()},\n" + ",\n".join(ctes) + f"\nSELECT f.doc_id, rule_id, severity, value FROM ({' UNION ALL '.join(parts)}) f JOIN ({size}) z USING (doc_id) WHERE ns >= ms AND np >= mp"


@query(_fired_sql())
def doc_rule_findings(spark, d):
    v = views(spark, d)
    return metrics.fired(metrics.Prose.of(v), load()).select("doc_id", "rule_id", "severity", F.round("value", 6).alias("value"))


_TRIPLE = "regexp_split_to_array(sentence, '[,;]')"
_PIECES = f"list_transform({_TRIPLE}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"


@query(
    f"""WITH {O.prose()}, c0 AS (SELECT doc_id, span_start, {_PIECES} AS r FROM s), c1 AS (SELECT doc_id, span_start, r[1] AS a, r[2] AS b, regexp_replace(r[3], '(?i)^and\\s+', '') AS c FROM c0 WHERE len(r) = 3 AND regexp_matches(r[3], '(?i)^and\\s+')),
    c2 AS (SELECT *, {O.words('a')} AS na, {O.words('b')} AS nb, {O.words('c')} AS nc FROM c1)
    SELECT doc_id, span_start, na, nb, nc FROM c2 WHERE na BETWEEN 3 AND 12 AND nb BETWEEN 3 AND 12 AND nc BETWEEN 3 AND 40 AND greatest(na, nb) <= 2 * least(na, nb)
    AND (greatest(na, nb, nc) <= 2 * least(na, nb, nc) OR (greatest(na, nb) <= 8 AND nc >= greatest(7, 1.5 * greatest(na, nb))))"""
)
def clause_triples(spark, d):
    p = metrics.Prose.of(views(spark, d))
    s = p.sentences.select("doc_id", "span_start", study.clause_parts(F.col("sentence")).alias("x")).where("x is not null")
    return s.select("doc_id", "span_start", *(F.regexp_count(F.col("x")[i], F.lit(WORD)).cast("bigint").alias(n) for i, n in enumerate(("na", "nb", "nc"))))


@query(
    f"""WITH {O.prose()}, h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY span_start, span_end) AS pos, contains(lower(sentence), ', and ') AS hit FROM s), n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM h WHERE hit)
    SELECT doc_id, max(n) AS value, arg_max(pos, (n, -pos)) AS at FROM n GROUP BY doc_id"""
)
def densest_window(spark, d):
    from pyspark.sql import Window

    p = metrics.Prose.of(views(spark, d))
    s = p.sentences.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("span_start", "span_end")).alias("sent_no"), F.lower("sentence").contains(", and ").alias("hit")).where("hit")
    return graph.densest(s, 50).select("doc_id", F.col("value").cast("bigint").alias("value"), F.col("at").cast("bigint").alias("at"))


@query(
    f"""WITH {O.prose()}, g AS (SELECT doc_id, count(*) AS n, sum({O.words('sentence')})::BIGINT AS w FROM s GROUP BY doc_id)
    SELECT coalesce(d.project, '') AS grp, count(*) AS documents, sum(coalesce(n, 0))::BIGINT AS sentences, sum(coalesce(w, 0))::BIGINT AS words FROM documents d LEFT JOIN g USING (doc_id) GROUP BY 1"""
)
def group_statistics(spark, d):
    v = views(spark, d)
    groups = table(spark, d, "documents").select("doc_id", F.coalesce("project", F.lit("")).alias("grp"))
    return study.group_statistics(metrics.Prose.of(v).sentences, groups).select("grp", "documents", "sentences", "words")


_DETACH = "(?i)^\\s*(.+?)\\s*([,;:]|—|–)\\s+(\\w+)[.!]?\\s*$"


@query(
    f"""SELECT eval_no, reason FROM (SELECT eval_no, CASE WHEN p = '' THEN 'no_ending' WHEN w NOT IN ({', '.join(O.q(x) for x in study.OUTCOMES)}) THEN 'other_word' WHEN {O.words('p')} < 2 THEN 'short_prefix'
    WHEN regexp_matches(p, '[.!?;]\\s') THEN 'several_sentences' ELSE 'candidate' END AS reason FROM (SELECT eval_no, regexp_extract(coalesce(sentence, ''), {O.q(_DETACH)}, 1) AS p, lower(regexp_extract(coalesce(sentence, ''), {O.q(_DETACH)}, 3)) AS w FROM evaluation))"""
)
def detached_outcomes(spark, d):
    return spread(table(spark, d, "evaluation").select("eval_no", F.coalesce("sentence", F.lit("")).alias("s"))).select("eval_no", study.detached(F.col("s"))["reason"].alias("reason"))


@query()
def reader_views(spark, d):
    r = reader.with_reader_view(docs(spark, d))
    return r.select("doc_id", F.length("visible").cast("bigint").alias("n"), F.md5("visible").alias("visible"), "incomplete")


@query()
def visible_parts(spark, d):
    return study.with_parts(spread(table(spark, d, "documents").select("doc_id", "text", "path"))).select("doc_id", "part_no", F.length("part").cast("bigint").alias("n"))


_PAR = "regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(
    f"""WITH a AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n[ \\t\\r]*\\n')) AS x FROM documents), b AS (SELECT doc_id, {_PAR} AS paragraph FROM a),
    c AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(paragraph, {O.q(r)}) THEN {O.q(n)} END" for n, r in sorted(study.FAMILIES.items()))}], lambda z: z IS NOT NULL), ',') AS families FROM b)
    SELECT left(sha256(paragraph), 12) AS id, any_value(families) AS families, count(DISTINCT doc_id) AS documents FROM c WHERE families <> '' GROUP BY paragraph"""
)
def family_paragraphs(spark, d):
    return study.family_paragraphs(docs(spark, d))

"""Queries over findings: regex layers, gates, reductions, graph matching, judgments, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.runtime import spread, table
from lectern.functions.text import WORD, spans
from lectern.operators import graph, judgments, reduce, regex_rules, report, scanner
from lectern.operators import views as V
from lectern.plans import oracle as O
from lectern.plans.lint import lint, words_of
from lectern.plans.queries_text import docs, views
from lectern.sources import catalogue

QUERIES: dict = {}
SQL: dict[str, str] = {}
RULES = catalogue.select(catalogue.load())


def query(sql: str | None = None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return deco


def _plain(p: str | None) -> bool:
    """Patterns that RE2 can state: no look-around and no back-reference."""
    return p is not None and not any(x in p for x in ("(?=", "(?!", "(?<=", "(?<!", "(?P=", "\\1", "\\2"))


def _re2(p: str) -> str:
    return re.sub(r"\\[uU]([0-9A-Fa-f]{8}|[0-9A-Fa-f]{4})", lambda m: "\\x{" + m[1].lstrip("0") + "}", p)


def _relational(category: str) -> list:
    return [r for r in RULES if r.category == category and _plain(r.pattern) and (r.unless is None or _plain(r.unless)) and not (r.opening_reference or r.nominal_prefix)]


_HEADER = f"WITH {O.views()}, {O.lines()}, {O.blocks()}, {O.sentences('s', 'b', 'true')}"


def _gated_sql(category: str) -> str:
    rules = _relational(category)
    view = "masked" if category == "punct" else "prose"
    ms = " UNION ALL ".join(f"SELECT doc_id, {O.q(r.id)} AS rule_id, unnest({O.spans(view, '(?im)' + _re2(r.pattern))}) AS x FROM v WHERE regexp_matches({view}, {O.q('(?im)' + _re2(r.pattern))})" for r in rules)
    table_ = ", ".join(f"({O.q(r.id)}, {O.q('(?i)' + _re2(r.unless)) if r.unless else 'NULL'}, {str(r.headings).lower()}, {str(r.heading_only).lower()}, {str(r.sentence_start).lower()})" for r in rules)
    block = "" if category != "template" else "AND EXISTS (SELECT 1 FROM b WHERE b.doc_id = m.doc_id AND b.span_start <= m.x.s AND m.x.e <= b.span_end)"
    return f"""{_HEADER}, m AS ({ms}), r(rule_id, unl, headings, heading_only, sentence_start) AS (VALUES {table_}),
    g AS (SELECT m.doc_id, m.rule_id, m.x.s AS span_start, m.x.e AS span_end, r.*, s.span_start AS ss, s.span_end AS se, coalesce(bb.kind = 'heading', false) AS hd FROM m JOIN r ON m.rule_id = r.rule_id
    LEFT JOIN s ON s.doc_id = m.doc_id AND s.span_start <= m.x.s AND m.x.s < s.span_end LEFT JOIN b bb ON bb.doc_id = m.doc_id AND bb.span_start <= m.x.s AND m.x.s < bb.span_end WHERE true {block})
    SELECT DISTINCT g.doc_id, g.rule_id, g.span_start, g.span_end FROM g JOIN v ON v.doc_id = g.doc_id WHERE (NOT sentence_start OR coalesce(ss, -1) = g.span_start) AND (headings OR NOT hd) AND (NOT heading_only OR hd)
    AND (unl IS NULL OR NOT regexp_matches(substring({view}, (coalesce(ss, g.span_start) + 1)::BIGINT, (coalesce(se, g.span_end) - coalesce(ss, g.span_start))::BIGINT), unl))"""


def _gated(category: str):
    def run(spark, d):
        rules = _relational(category)
        return regex_rules.regex_findings(views(spark, d), rules).select("doc_id", "rule_id", "span_start", "span_end")

    run.__name__ = f"{category}_findings"
    return run


for _c in ("phrase", "template", "punct"):
    query(_gated_sql(_c))(_gated(_c))


@query()
def regex_findings(spark, d):
    """All regex rules, those included whose patterns RE2 cannot state."""
    return regex_rules.regex_findings(views(spark, d), RULES).select("doc_id", "rule_id", "severity", "span_start", "span_end")


@query()
def contrast_findings(spark, d):
    v = views(spark, d)
    return scanner.contrasts(V.sentences(V.blocks(V.lines(v))))


@query(
    f"""WITH {O.views()}, t AS (SELECT doc_id, {O.rewrite(O.rewrite('text', V.FRONT), V.COMMENT)} AS shown, prose, regexp_extract(prose, '[A-Za-z]', 0) AS first FROM v)
    SELECT doc_id, NOT regexp_matches(left(shown, coalesce(nullif(strpos(prose, first) - 1, -1), 0)::BIGINT), {O.q(regex_rules._RENDERED)}) AS opening FROM t"""
)
def opening_reference(spark, d):
    """Whether the first letter of a document's prose opens it: nothing that a reader sees stands before."""
    v = views(spark, d)
    first = F.regexp_extract("prose", "[A-Za-z]", 0)
    at = F.when(first == "", F.lit(0)).otherwise(F.length(F.regexp_extract("prose", r"\A[^A-Za-z]*", 0)))
    shown = V.rewrite(V.rewrite(F.col("text"), V.unix(V.FRONT)), V.unix(V.COMMENT))
    return v.select("doc_id", (~F.substring(shown, F.lit(1), at.cast("int")).rlike(V.unix(regex_rules._RENDERED))).alias("opening"))


# findings of a few plain patterns: the input of the reductions on both sides
_SEED = (
    ("x.pair", "x", "bark", 1, r"[a-z]+ and [a-z]+"), ("x.run", "x", "sniff", 2, r"(?:the|a) [a-z]+ [a-z]+ [a-z]+"), ("x.the", "x", "bite", 0, r"the [a-z]+"),
    ("y.number", "y", "bark", 1, r"[0-9]+ [a-z]+"), ("y.clause", "y", "sniff", 2, r"[a-z]+ [0-9]+ [a-z]+, [a-z]+"), ("z.of", "z", "sniff", 2, r"[a-z]+ of [A-Z][a-z]+"), ("x.name", "x", "bark", 1, r"[a-z]+ [A-Z][a-z]+"),
)


def seeded(v: DataFrame) -> DataFrame:
    arrays = [F.transform(spans(F.col("prose"), p), _seed(i, c, s, k)) for i, c, s, k, p in _SEED]
    return v.select("doc_id", F.explode(F.flatten(F.array(*arrays))).alias("m")).select("doc_id", "m.*")


def _seed(i: str, c: str, s: str, k: int):
    return lambda x: F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(k).alias("rank"), x["s"].cast("bigint").alias("span_start"), x["e"].cast("bigint").alias("span_end"))


_F = "f AS MATERIALIZED (SELECT doc_id, rule_id, category, severity, rank, x.s AS span_start, x.e AS span_end FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, {O.q(i)} AS rule_id, {O.q(c)} AS category, {O.q(s)} AS severity, {k} AS rank, unnest({O.spans('prose', p)}) AS x FROM v" for i, c, s, k, p in _SEED
) + "))"
_COLS = ("doc_id", "rule_id", "span_start", "span_end")


@query(
    f"""WITH {O.views()}, {_F}, a AS (SELECT *, CASE WHEN span_start <= max(span_end) OVER (PARTITION BY doc_id, rule_id ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f),
    c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, rule_id ORDER BY span_start, span_end ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT doc_id, rule_id, min(span_start) AS span_start, max(span_end) AS span_end FROM c GROUP BY doc_id, rule_id, run"""
)
def merge_overlaps(spark, d):
    return reduce.merge_overlaps(seeded(views(spark, d))).select(*_COLS)


_FREE = "NOT EXISTS (SELECT 1 FROM {} k WHERE k.doc_id = f.doc_id AND k.category = f.category AND k.rule_id <> f.rule_id AND k.span_start < f.span_end AND f.span_start < k.span_end{})"


@query(
    f"""WITH {O.views()}, {_F}, k1 AS (SELECT * FROM f WHERE rank = 0 UNION ALL SELECT * FROM f WHERE rank = 1 AND {_FREE.format('f', ' AND k.rank = 0')}),
    k2 AS (SELECT * FROM k1 UNION ALL SELECT * FROM f WHERE rank = 2 AND {_FREE.format('k1', '')}) SELECT doc_id, rule_id, span_start, span_end FROM k2"""
)
def shadow_weaker(spark, d):
    return reduce.shadow_weaker(seeded(views(spark, d))).select(*_COLS)


_INSIDE = "EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.span_start <= f.span_start AND f.span_end <= o.span_end AND o.span_end - o.span_start > f.span_end - f.span_start AND o.rank <= f.rank)"


@query(f"WITH {O.views()}, {_F} SELECT doc_id, rule_id, span_start, span_end FROM f WHERE NOT {_INSIDE}")
def dedupe_findings(spark, d):
    return reduce.dedupe(seeded(views(spark, d))).select(*_COLS)


@query(f"WITH {O.views()}, {_F} SELECT doc_id, rule_id, span_start, span_end, row_number() OVER (PARTITION BY doc_id ORDER BY span_start, rank, rule_id, span_end) AS finding_no FROM f")
def report_order(spark, d):
    return reduce.report_order(seeded(views(spark, d))).select(*_COLS, "finding_no")


@query(
    f"WITH {O.views()}, {_F} SELECT doc_id, rule_id, span_start, span_end, CASE WHEN row_number() OVER (PARTITION BY rule_id ORDER BY doc_id, span_start, span_end) = 1 THEN 'long ' || rule_id ELSE 'short' END AS shown FROM f"
)
def repeat_message(spark, d):
    texts = spark.createDataFrame([(i, "long " + i, "short") for i, *_ in _SEED], "rule_id string, message string, repeat_message string")
    return reduce.first_or_repeat(seeded(views(spark, d)), texts).select(*_COLS, "shown")


_SUMMARY = f"""WITH {O.views(extra='source,')}, {_F}, w AS (SELECT doc_id, source, {O.words('prose')} AS n FROM v), c AS (SELECT doc_id, count(*) FILTER (severity = 'bite') AS bite, count(*) FILTER (severity = 'bark') AS bark, count(*) FILTER (severity = 'sniff') AS sniff FROM f GROUP BY doc_id)
    SELECT source, count(*) AS documents, sum(n)::BIGINT AS words, sum(coalesce(bite, 0))::BIGINT AS bite, sum(coalesce(bark, 0))::BIGINT AS bark, sum(coalesce(sniff, 0))::BIGINT AS sniff, round((sum(coalesce(bite, 0)) + sum(coalesce(bark, 0)) + sum(coalesce(sniff, 0))) * 100.0 / sum(n), 6) AS per_100_words
    FROM w LEFT JOIN c USING (doc_id) GROUP BY source"""


@query(_SUMMARY)
def severity_summary(spark, d):
    v = views(spark, d, "source")
    return reduce.severity_summary(seeded(v), v.select("doc_id", "source", F.regexp_count("prose", F.lit(WORD)).cast("bigint").alias("n_words")), by="source")


@query(f"WITH {O.views()}, {_F} SELECT coalesce(max(CASE WHEN severity = 'bite' THEN 1 ELSE 0 END), 0)::BIGINT AS exit_status FROM f")
def exit_status(spark, d):
    return reduce.exit_status(seeded(views(spark, d)))


@query(f"WITH {O.views()}, {_F} SELECT doc_id, rule_id, span_start, span_end FROM f EXCEPT ALL SELECT doc_id, rule_id, span_start, span_end FROM f WHERE rank = 0")
def finding_difference(spark, d):
    """Multiset difference of two sets of findings: all against those of the strongest severity."""
    f = seeded(views(spark, d))
    return f.select(*_COLS).exceptAll(f.where("rank = 0").select(*_COLS))


# --- token graphs: sentence words as heaps (the head of word i is word i div 2), tags by shape -----------------------

_TOK = f"""t0 AS (SELECT eval_no AS doc_id, regexp_extract_all(coalesce(sentence, ''), {O.q(WORD)}) AS w FROM evaluation), t1 AS (SELECT doc_id, unnest(range(1, len(w) + 1))::BIGINT AS i, w FROM t0),
t AS MATERIALIZED (SELECT doc_id, i, greatest(i // 2, 1) AS head_i, lower(w[i]) AS lower, CASE WHEN i = 1 THEN 'ROOT' WHEN i % 2 = 0 THEN 'nsubj' ELSE 'dobj' END AS dep, CASE WHEN regexp_matches(w[i], '^[A-Z]') THEN 'PROPN' WHEN regexp_matches(w[i], '^[0-9]') THEN 'NUM' ELSE 'NOUN' END AS pos FROM t1)"""


def heap_tokens(spark, d) -> DataFrame:
    w = F.regexp_extract_all(F.coalesce("sentence", F.lit("")), F.lit(WORD), F.lit(0))
    x = spread(table(spark, d, "evaluation").select("eval_no", "sentence")).select(F.col("eval_no").alias("doc_id"), F.posexplode(w).alias("p", "text")).withColumn("i", F.col("p") + 1)
    pos = F.when(F.col("text").rlike("^[A-Z]"), "PROPN").when(F.col("text").rlike("^[0-9]"), "NUM").otherwise("NOUN")
    dep = F.when(F.col("i") == 1, "ROOT").when(F.col("i") % 2 == 0, "nsubj").otherwise("dobj")
    return x.select("doc_id", F.lit(1).cast("bigint").alias("block_id"), "i", F.lit(0).alias("idx"), "text", F.lower("text").alias("lower"), F.lower("text").alias("lemma"), pos.alias("pos"), F.lit("X").alias("tag"), dep.alias("dep"), F.greatest(F.floor(F.col("i") / 2), F.lit(1)).cast("int").alias("head_i"))


def _node(name: str, attrs: dict, left: str | None = None, op: str | None = None) -> dict:
    return {"RIGHT_ID": name, "RIGHT_ATTRS": attrs} | ({"LEFT_ID": left, "REL_OP": op} if left else {})


_P = {"POS": "PROPN"}
PATTERNS = {
    "child": (_node("a", _P), _node("b", {"POS": "NOUN", "DEP": "dobj"}, "a", ">")),
    "left_child": (_node("a", {"POS": {"NOT_IN": ["NUM"]}}), _node("b", {"LOWER": {"REGEX": "^the$"}}, "a", ">--")),
    "ancestor": (_node("a", {"DEP": {"IN": ["ROOT", "nsubj"]}, "POS": "PROPN"}), _node("b", {"POS": "NUM"}, "a", ">>")),
    "next_sibling": (_node("a", {"POS": "NOUN"}), _node("b", _P, "a", "$+")),
    "right_sibling": (_node("a", {}), _node("b", {"POS": "NUM"}, "a", "$++")),
    "left_sibling": (_node("a", {"POS": "NUM"}), _node("b", {}, "a", "$--")),
    "cluster": (_node("a", {"POS": "NOUN"}), _node("b", {"POS": "NOUN"}, "a", ">"), _node("c", {"POS": "NOUN"}, "b", ">")),
}
_SIB = "a.doc_id = b.doc_id AND a.head_i = b.head_i AND b.i <> b.head_i AND a.i <> b.i"
_GRAPH_SQL = {
    "child": "FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.head_i = a.i AND a.i <> b.i WHERE a.pos = 'PROPN' AND b.pos = 'NOUN' AND b.dep = 'dobj'",
    "left_child": "FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.head_i = a.i AND b.i < a.i WHERE a.pos <> 'NUM' AND b.lower = 'the'",
    "ancestor": "FROM t a JOIN u ON u.doc_id = a.doc_id AND u.above = a.i JOIN t b ON b.doc_id = u.doc_id AND b.i = u.i WHERE a.pos = 'PROPN' AND a.dep IN ('ROOT', 'nsubj') AND b.pos = 'NUM'",
    "next_sibling": f"FROM t a JOIN t b ON {_SIB} AND b.i = a.i + 1 WHERE a.pos = 'NOUN' AND b.pos = 'PROPN'",
    "right_sibling": f"FROM t a JOIN t b ON {_SIB} AND b.i > a.i WHERE b.pos = 'NUM'",
    "left_sibling": f"FROM t a JOIN t b ON {_SIB} AND b.i < a.i WHERE a.pos = 'NUM'",
}


@query(
    "WITH RECURSIVE " + _TOK + ", u AS (SELECT doc_id, i, head_i AS above FROM t WHERE head_i <> i UNION ALL SELECT u.doc_id, u.i, t.head_i FROM u JOIN t ON t.doc_id = u.doc_id AND t.i = u.above WHERE t.head_i <> t.i) "
    + " UNION ALL ".join(f"SELECT '{k}' AS pattern, a.doc_id, a.i AS a, b.i AS b {s}" for k, s in _GRAPH_SQL.items())
)
def graph_matches(spark, d):
    """Two-node patterns of every relation kind over the token trees of the sentences."""
    t = heap_tokens(spark, d)
    out = None
    for k in _GRAPH_SQL:
        m = graph.match(t, PATTERNS[k]).select(F.lit(k).alias("pattern"), "doc_id", F.col("nodes")[0].cast("bigint").alias("a"), F.col("nodes")[1].cast("bigint").alias("b"))
        out = m if out is None else out.unionByName(m)
    return out


@query(f"WITH {_TOK} SELECT a.doc_id, a.i AS a, b.i AS b, c.i AS c FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.head_i = a.i AND a.i <> b.i JOIN t c ON c.doc_id = b.doc_id AND c.head_i = b.i AND c.i <> b.i WHERE a.pos = 'NOUN' AND b.pos = 'NOUN' AND c.pos = 'NOUN'")
def noun_clusters(spark, d):
    m = graph.match(heap_tokens(spark, d), PATTERNS["cluster"])
    return m.select("doc_id", *(F.col("nodes")[k].cast("bigint").alias(n) for k, n in enumerate("abc")))


# --- judgments: probabilities from a digest, so that both sides know them --------------------------------------------

_PROB = "(('0x' || left(md5({}), 4))::INT % 1001) / 1000.0"


def prob(c: Column) -> Column:
    return (F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int") % 1001) / 1000.0


_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_start, rank, rule_id, span_end) AS finding_no FROM f)"


@query(
    f"""WITH {O.views()}, {O.lines()}, {O.blocks()}, {O.sentences()}, {_F}, {_NUMBERED},
    a AS (SELECT n.doc_id, finding_no, b.block_id, min(s.span_start) AS context_start, max(s.span_end) AS context_end FROM n JOIN b ON b.doc_id = n.doc_id AND n.span_start >= b.span_start AND n.span_end <= b.span_end
    JOIN s ON s.doc_id = n.doc_id AND s.span_start < n.span_end AND s.span_end > n.span_start WHERE n.rank < 2 GROUP BY ALL HAVING max(s.span_end) - min(s.span_start) <= 2000)
    SELECT doc_id, finding_no, block_id, (row_number() OVER (PARTITION BY doc_id, block_id ORDER BY finding_no) - 1) // 6 AS batch_no, context_start, context_end FROM a"""
)
def judgment_batches(spark, d):
    v = views(spark, d)
    b = V.blocks(V.lines(v))
    f = reduce.report_order(seeded(v)).where("rank < 2")
    return judgments.batches(f, b, V.sentences(b))


@query(
    f"""WITH {O.views()}, {_F}, {_NUMBERED}, j AS (SELECT doc_id, finding_no, {_PROB.format("doc_id || '/' || finding_no")} AS p, finding_no % 50 = 49 AS failed FROM n WHERE finding_no % 4 > 0), k AS (SELECT doc_id, bool_or(failed) AS broken FROM j GROUP BY doc_id)
    SELECT n.doc_id, n.finding_no, n.rule_id FROM n LEFT JOIN j ON j.doc_id = n.doc_id AND j.finding_no = n.finding_no LEFT JOIN k ON k.doc_id = n.doc_id
    WHERE NOT CASE n.rule_id WHEN 'x.pair' THEN coalesce(CASE WHEN NOT broken THEN p END >= 0.7, false) WHEN 'y.number' THEN coalesce(CASE WHEN NOT broken THEN p END >= 0.6, true) ELSE false END"""
)
def judgment_settle(spark, d):
    f = reduce.report_order(seeded(views(spark, d)))
    j = f.where("finding_no % 4 > 0").select("doc_id", "finding_no", prob(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("finding_no").cast("string"))).alias("probability"), (F.col("finding_no") % 50 == 49).alias("failed"))
    r = spark.createDataFrame([("x.pair", 0.7, False), ("y.number", 0.6, True)], "rule_id string, veto_threshold double, veto_required boolean")
    return judgments.settle(f, r, j).select("doc_id", "finding_no", "rule_id")


@query(
    f"""WITH a AS (SELECT doc_id, {_PROB.format("'c' || doc_id")} AS c, {_PROB.format("'p' || doc_id")} AS p FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'missing_answer' WHEN p < 0.5 THEN 'invalid_answer' WHEN c < 0.8 THEN 'low_confidence' ELSE 'unclear' END AS status FROM a"""
)
def reference_status(spark, d):
    x = table(spark, d, "documents").select("doc_id", prob(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("c"), prob(F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("p"))
    given = F.col("doc_id") % 17 != 0
    rest = (1 - F.col("p")) / 2
    a = x.select(
        "doc_id", F.when(given, "choice").alias("type"), F.when(given, "unclear").alias("label"), "c",
        F.when(given, F.create_map(F.lit("unclear"), F.col("p"), F.lit("clear"), F.col("p") * 0 + F.when(F.col("p") < 0.5, F.lit(1.0) - F.col("p")).otherwise(rest), F.lit("uncertain"), F.when(F.col("p") < 0.5, F.lit(0.0)).otherwise(rest))).alias("probabilities"),
    ).withColumnRenamed("c", "confidence")
    return judgments.choice_status(a, 0.8).select("doc_id", "status")


@query()
def report_blocks(spark, d):
    """The printed entry of every finding of the punctuation rules."""
    rules = [r for r in RULES if r.category == "punct"]
    f = reduce.with_marks(regex_rules.regex_findings(views(spark, d), rules))
    f = reduce.first_or_repeat(f, catalogue.rules_df(spark, rules))
    out = report.rendered(f, table(spark, d, "documents").select("doc_id", "path", "text"))
    return out.select("doc_id", "rule_id", "line", "col", "block")


@query()
def lint_findings(spark, d):
    """All findings after all reductions, without judgments."""
    return lint(docs(spark, d)).select("doc_id", "finding_no", "rule_id", "severity", "span_start", "span_end")


@query()
def lint_summary(spark, d):
    x = table(spark, d, "documents")
    return reduce.severity_summary(lint(x), words_of(x, "source"), by="source")

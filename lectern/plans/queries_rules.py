"""Queries over dependency rules, conversation records, review and study relations."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.runtime import spread, table, written
from lectern.operators import graph, metrics, reduce, screening, structural, study
from lectern.plans import oracle as O
from lectern.plans.queries_corpus import _GRAMS, turns
from lectern.plans.queries_findings import _COLS, _F, _PROB, prob, seeded
from lectern.plans.queries_text import views
from lectern.sources import catalogue

QUERIES: dict = {}
SQL: dict[str, str] = {}
RULES = [r for r in catalogue.load() if r.dependency]


def query(sql: str | None = None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return deco


# --- the dependency rules on trees made from their own patterns ---------------------------------------------------------

_COLUMN = {"DEP": "dep", "POS": "pos", "LEMMA": "lemma", "TAG": "tag", "LOWER": "lower", "ORTH": "text"}


def _fitting(v) -> str:
    """A value that a node's condition takes."""
    if not isinstance(v, dict):
        return v
    if "IN" in v:
        return v["IN"][0]
    return re.sub(r"^\(\?i\)|[\^$()?:\\b]", "", v["REGEX"]).split("|")[0] if "REGEX" in v else "zz"


def _tree(alt, without: tuple[str, ...]) -> list[dict]:
    """Tokens in which the alternative of a rule matches, and a child of its anchor that forbids it (``extra``)."""
    nodes: list[dict] = []
    order: list[int] = []
    for k, n in enumerate(alt):
        t = {c: "zz" for c in _COLUMN.values()} | {_COLUMN[a]: _fitting(v) for a, v in n.get("RIGHT_ATTRS", {}).items()} | {"extra": False, "name": n["RIGHT_ID"], "own": k}
        if t["text"] != "zz" and t["lower"] == "zz":
            t["lower"] = t["text"].lower()
        op, left = n.get("REL_OP"), next((x for x in nodes if x["name"] == n.get("LEFT_ID")), None)
        if op is None:
            t["up"] = -1
        elif op in (">", ">--"):
            t["up"] = left["own"]
        elif op == ">>":  # one token between
            nodes.append({c: "zz" for c in _COLUMN.values()} | {"extra": False, "name": f"between{k}", "own": 100 + k, "up": left["own"]})
            order.append(100 + k)
            t["up"] = 100 + k
        else:
            t["up"] = left["up"]
        nodes.append(t)
        at = len(order) if op in (None, ">", ">>", "$++") else order.index(left["own"]) + (op == "$+")
        order.insert(at, k)
    for label in without[:1]:
        dep, _, lower = label.partition(":")
        nodes.append({c: "zz" for c in _COLUMN.values()} | {"dep": dep, "lower": lower or "zz", "extra": True, "name": "extra", "own": 99, "up": 0})
        order.append(99)
    place = {own: i + 1 for i, own in enumerate(order)} | {-1: 0}
    root = {c: "zz" for c in _COLUMN.values()} | {"extra": False, "i": 0, "head_i": 0}
    return [root] + [{k: v for k, v in t.items() if k not in ("name", "own", "up")} | {"i": place[t["own"]], "head_i": place[t["up"]]} for t in nodes]


_ALTS = [(r, alt) for r in RULES for alt in r.dependency]
_TOKENS = [t | {"block_id": b} for b, (r, alt) in enumerate(_ALTS, 1) for t in _tree(alt, r.anchor_without)]
_FIELDS = ("block_id", "i", "head_i", "text", "lower", "lemma", "pos", "tag", "dep", "extra")


def rule_tokens(spark, d) -> DataFrame:
    """For each evaluation row and each alternative of a rule its tree; a digest of place and row spoils some of the tokens."""
    ddl = "array<struct<block_id:bigint,i:int,head_i:int,text:string,lower:string,lemma:string,pos:string,tag:string,dep:string,extra:boolean>>"
    rows = spread(table(spark, d, "evaluation").select(F.col("eval_no").alias("doc_id"))).select("doc_id", F.inline(F.from_json(F.lit(json.dumps([{k: t[k] for k in _FIELDS} for t in _TOKENS])), ddl)))
    h = F.substring(F.md5(F.concat_ws("/", "doc_id", "block_id", "i")), 1, 1)
    rows = rows.where(~F.col("extra") | (h < "4")).withColumn("lemma", F.when(h == "0", "zz").otherwise(F.col("lemma"))).withColumn("pos", F.when(h == "0", "X").otherwise(F.col("pos"))).withColumn("dep", F.when((h == "1") & ~F.col("extra"), "zz").otherwise(F.col("dep")))
    return rows.select("doc_id", "block_id", "i", F.lit(0).alias("idx"), "text", "lower", "lemma", "pos", "tag", "dep", "head_i")


def _values(t: dict) -> str:
    return "(" + ", ".join(O.q(t[k]) if isinstance(t[k], str) else str(t[k]).lower() for k in _FIELDS) + ")"


def _condition(alias: str, attrs: dict) -> str:
    out = []
    for a, v in attrs.items():
        c = f"{alias}.{_COLUMN[a]}"
        for op, x in (v if isinstance(v, dict) else {"=": v}).items():
            some = ", ".join(O.q(y) for y in x) if isinstance(x, list) else ""
            out.append({"=": f"{c} = {O.q(x) if isinstance(x, str) else x}", "IN": f"{c} IN ({some})", "NOT_IN": f"{c} NOT IN ({some})", "REGEX": f"regexp_matches({c}, {O.q(x) if isinstance(x, str) else x})"}[op])
    return " AND ".join(out) or "true"


def _alternative(rule, alt) -> str:
    """The alternative as joins of tokens written out node by node."""
    place = {n["RIGHT_ID"]: k for k, n in enumerate(alt)}
    tables, on = [], []
    for k, n in enumerate(alt):
        tables.append(f"t n{k}")
        on.append(_condition(f"n{k}", n.get("RIGHT_ATTRS", {})))
        if k:
            a, b = f"n{place[n['LEFT_ID']]}", f"n{k}"
            together = f"{b}.head_i = {a}.head_i AND {b}.i <> {b}.head_i"
            on.append(f"{b}.doc_id = {a}.doc_id AND {b}.block_id = {a}.block_id AND {b}.i <> {a}.i")
            on.append({
                ">": f"{b}.head_i = {a}.i", ">--": f"{b}.head_i = {a}.i AND {b}.i < {a}.i", ">>": f"EXISTS (SELECT 1 FROM u WHERE u.doc_id = {a}.doc_id AND u.block_id = {a}.block_id AND u.i = {b}.i AND u.above = {a}.i)",
                "$+": f"{together} AND {b}.i = {a}.i + 1", "$++": f"{together} AND {b}.i > {a}.i", "$--": f"{together} AND {b}.i < {a}.i",
            }[n["REL_OP"]])
    if rule.anchor_without:
        some = ", ".join(O.q(x) for x in rule.anchor_without)
        on.append(f"NOT EXISTS (SELECT 1 FROM t c WHERE c.doc_id = n0.doc_id AND c.block_id = n0.block_id AND c.head_i = n0.i AND c.i <> c.head_i AND (c.dep IN ({some}) OR c.dep || ':' || c.lower IN ({some})))")
    nodes = " || ',' || ".join(f"n{k}.i" for k in range(len(alt)))
    return f"SELECT n0.doc_id, n0.block_id, {O.q(rule.id)} AS rule_id, {nodes} AS nodes FROM {', '.join(tables)} WHERE {' AND '.join(on)}"


@query(
    f"""WITH RECURSIVE z({', '.join(_FIELDS)}) AS (VALUES {', '.join(map(_values, _TOKENS))}), h AS (SELECT eval_no AS doc_id, z.*, left(md5(eval_no || '/' || block_id || '/' || i), 1) AS h FROM evaluation, z),
    t AS MATERIALIZED (SELECT doc_id, block_id, i, head_i, text, lower, CASE WHEN h = '0' THEN 'zz' ELSE lemma END AS lemma, CASE WHEN h = '0' THEN 'X' ELSE pos END AS pos, tag, CASE WHEN h = '1' AND NOT extra THEN 'zz' ELSE dep END AS dep FROM h WHERE NOT extra OR h < '4'),
    u AS (SELECT doc_id, block_id, i, head_i AS above FROM t WHERE head_i <> i UNION SELECT u.doc_id, u.block_id, u.i, t.head_i FROM u JOIN t ON t.doc_id = u.doc_id AND t.block_id = u.block_id AND t.i = u.above WHERE t.head_i <> t.i)
    SELECT DISTINCT doc_id, block_id::BIGINT AS block_id, rule_id, nodes FROM ({' UNION ALL '.join(_alternative(r, a) for r, a in _ALTS)})"""
)
def dependency_matches(spark, d):
    """Every alternative of every dependency rule, with its forbidden children, over trees in which some of them match."""
    m = graph.rule_matches(written(rule_tokens(spark, d), "tokens"), RULES)
    return m.select("doc_id", "block_id", "rule_id", F.array_join(F.transform("nodes", lambda i: i.cast("string")), ",").alias("nodes")).distinct()


# --- conversations as they arrive ---------------------------------------------------------------------------------------


def arena_lines(spark, d) -> DataFrame:
    """The corpus' conversations as one JSON line each: both sides with their turns in order."""
    t = table(spark, d, "corpus_records").where("side is not null").select("dataset", "row_index", "side", "turn_index", "record_id", "role", "model", "text")
    g = t.groupBy("dataset", "row_index", "side").agg(F.min("record_id").alias("first"), F.max("model").alias("model"), F.array_sort(F.collect_list(F.struct("turn_index", "record_id", "role", "text"))).alias("ts"))
    turns_ = F.transform("ts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    side = lambda s, c: F.max(F.when(F.col("side") == s, c))
    rows = g.groupBy("dataset", "row_index").agg(F.min("first").alias("n"), side("a", F.col("model")).alias("model_a"), side("b", F.col("model")).alias("model_b"), side("a", turns_).alias("conversation_a"), side("b", turns_).alias("conversation_b"))
    return rows.select(F.col("n").alias("row_index"), F.to_json(F.struct("model_a", "model_b", "conversation_a", "conversation_b")).alias("value"))


_S = f"regexp_matches(text, {O.q(screening.ARENA)}) OR regexp_matches(text, {O.q(screening.UNSAFE)}) OR regexp_matches(text, {O.q(screening.REASONING)})"


@query(
    f"""WITH s AS (SELECT *, min(record_id) OVER (PARTITION BY dataset, row_index) AS n, max(model) OVER (PARTITION BY dataset, row_index, side) AS m, row_number() OVER (PARTITION BY dataset, row_index, side ORDER BY turn_index, record_id) - 1 AS k FROM corpus_records WHERE side IS NOT NULL),
    g0 AS (SELECT n, record_id, role, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM s WHERE text IS NOT NULL), g1 AS (SELECT n, record_id, role, w, unnest(range(1, len(w) - 6)) AS i FROM g0 WHERE len(w) >= 8), g AS (SELECT DISTINCT n, record_id, role, array_to_string(w[i:i + 7], ' ') AS gram FROM g1),
    x AS (SELECT n, m, text, side, k, row_number() OVER (PARTITION BY m, text ORDER BY n, side, k) AS r FROM s WHERE role = 'assistant' AND text IS NOT NULL AND trim(text) <> '' AND m IS NOT NULL AND m <> '' AND length(m) <= 200 AND NOT regexp_matches(m, {O.q(screening.UNSAFE)})
      AND octet_length(encode(text)) <= {screening.MAX_TEXT_BYTES} AND NOT ({_S}) AND record_id NOT IN (SELECT a.record_id FROM g a JOIN g b ON a.n = b.n AND a.gram = b.gram WHERE a.role = 'assistant' AND b.role = 'user'))
    SELECT n AS row_index, side, k AS turn_index, m AS model, sha256(text) AS digest FROM x WHERE r = 1"""
)
def arena_records(spark, d):
    return screening.arena_records(arena_lines(spark, d)).select("row_index", "side", F.col("turn_index").cast("bigint").alias("turn_index"), "model", "digest")


_ROW = "min(record_id) OVER (PARTITION BY dataset, row_index)"
_SIZES = f"octet_length(encode(text)) > {screening.MAX_TEXT_BYTES}"


def conversation_rows(spark, d) -> DataFrame:
    """The corpus' conversations as rows of a viewer: JSON with model and turns; every 20th flagged, every 25th cut, every 30th without a model, every 35th turn from a tool."""
    t = turns(spark, d).select("dataset", "row_index", "turn_index", "record_id", "role", "language", "text", "model")
    one = F.struct("role", "language", F.col("text").alias("content"), F.when(F.col("record_id") % 35 == 0, "tool_calls").alias("finish_reason"))
    g = t.groupBy("dataset", "row_index").agg(F.min("record_id").alias("row_no"), F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "record_id", one.alias("t")))), lambda x: x["t"]).alias("conversation"))
    n = F.col("row_no")
    row = F.struct(F.when(n % 30 != 0, F.lit("model-x")).alias("model"), "conversation", F.struct((n % 20 == 0).alias("flagged")).alias("moderation"))
    return g.select("row_no", F.to_json(F.struct(row.alias("row"), F.when(n % 25 == 0, F.array(F.lit("conversation"))).alias("truncated_cells"))).alias("value"))


_CONVERSATION = f"""s AS (SELECT *, {_ROW} AS n, row_number() OVER (PARTITION BY dataset, row_index ORDER BY turn_index, record_id) - 1 AS k FROM corpus_records),
r AS (SELECT n, CASE WHEN n % 25 = 0 THEN 'cut_cells' WHEN n % 20 = 0 THEN 'flagged_row' WHEN n % 30 = 0 THEN 'bad_model' END AS row_reason FROM (SELECT DISTINCT n FROM s))"""


@query(f"WITH {_CONVERSATION} SELECT n AS row_no, coalesce(row_reason, 'kept') AS reason FROM r")
def row_reasons(spark, d):
    return screening.parsed_rows(conversation_rows(spark, d)).select("row_no", F.coalesce("row_reason", F.lit("kept")).alias("reason"))


@query(
    f"""WITH {_GRAMS}, {_CONVERSATION}, y AS (SELECT s.n, s.k, s.text, CASE WHEN s.text IS NULL OR trim(regexp_replace(s.text, '\\s+', ' ', 'g')) = '' OR {_SIZES.replace('text', 's.text')} THEN 'empty_or_size_or_content_schema' WHEN s.record_id % 35 = 0 THEN 'incomplete_or_tool_or_reasoning'
    WHEN regexp_matches(s.text, {O.q(screening.REASONING)}) THEN 'reasoning_marker' WHEN regexp_matches(s.text, {O.q(screening.UNSAFE)}) THEN 'conservative_privacy_prose_screen' WHEN c.record_id IS NOT NULL THEN 'nonassistant_overlap' END AS why
    FROM s JOIN r ON r.n = s.n AND r.row_reason IS NULL LEFT JOIN c ON c.record_id = s.record_id WHERE s.role = 'assistant')
    SELECT n AS row_no, k AS turn_index, CASE WHEN why IS NOT NULL THEN why WHEN row_number() OVER (PARTITION BY text, why ORDER BY n, k) > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM y"""
)
def turn_reasons(spark, d):
    rows = screening.parsed_rows(conversation_rows(spark, d))
    return screening.parsed_turns(rows).select("row_no", F.col("turn_index").cast("bigint").alias("turn_index"), F.coalesce("reason", F.lit("kept")).alias("reason"))


# --- findings of a corpus -----------------------------------------------------------------------------------------------


@query(f"WITH {O.views()}, {_F} SELECT rule_id, count(*) AS findings, count(DISTINCT doc_id) AS documents, count(*) FILTER (span_start % 2 = 1) AS new_findings FROM f GROUP BY rule_id")
def findings_by_rule(spark, d):
    """Findings, documents and what is new against an earlier run: here the findings at even places."""
    f = seeded(views(spark, d))
    return reduce.findings_by_rule(f, f.where("span_start % 2 = 0"))


@query(
    f"""WITH {O.views()}, {_F}, w AS (SELECT doc_id, greatest({O.words('prose')}, 1) AS n FROM v), c AS (SELECT doc_id, count(*) AS k, array_to_string(list_sort(list_distinct(list(rule_id))), ', ') AS rules FROM f WHERE severity <> 'bite' AND rule_id <> 'z.of' GROUP BY doc_id)
    SELECT doc_id, round(k * 100.0 / n, 6) AS density, rules FROM c JOIN w USING (doc_id) WHERE k * 100.0 / n > 1.0"""
)
def soft_density(spark, d):
    """Documents with more than one weaker finding per 100 words; a rule that requires an answer does not count."""
    v = views(spark, d)
    rules = spark.createDataFrame([("z.of", True)], "rule_id string, veto_required boolean")
    return reduce.soft_density(seeded(v), v.select("doc_id", F.regexp_count("prose", F.lit(metrics.WORD)).cast("bigint").alias("n_words")), rules).withColumn("density", F.round("density", 6))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY path NULLS FIRST, doc_id) AS n FROM documents) WHERE n <= 100")
def first_per_source(spark, d):
    """The first hundred documents of each source, in the order of their paths."""
    return screening.first_per_group(table(spark, d, "documents").select("source", "doc_id", "path"), "source", ["path", "doc_id"], 100).select("source", "doc_id")


_W = "list_filter(list_transform(regexp_split_to_array(lower(sentence), '[,;]'), lambda p: regexp_extract_all(p, {w})), lambda w: len(w) > 0)".format(w=O.q(metrics.WORD))


@query(
    f"""WITH {O.prose()}, e AS (SELECT doc_id, span_start, {_W} AS ps FROM s), n AS (SELECT *, list_transform(ps, lambda w: len(w)) AS n FROM e WHERE len(ps) > 1)
    SELECT doc_id, span_start, len(ps) AS pieces, len(list_filter(range(1, len(ps)), lambda i: len(list_intersect(ps[i][:2], ps[i + 1][:2])) > 0)) AS repeats, len(ps) = 3 AS triple, n[-1] >= 2 * list_max(n[:-2]) AS long_tail FROM n"""
)
def echo_features(spark, d):
    p = metrics.Prose.of(views(spark, d))
    return p.sentences.select("doc_id", "span_start", study.echoes(F.col("sentence")).alias("x")).select("doc_id", "span_start", "x.*").where("pieces > 1")


@query(
    f"""WITH e AS (SELECT id, unnest(map_keys(expected)) AS feature, unnest(map_values(expected)) AS expected FROM cases), p AS (SELECT feature, expected, {_PROB.format("id || '/' || feature")} AS p, ('0x' || left(md5(id), 2))::INT % 5 AS h FROM e),
    b AS (SELECT *, CASE WHEN h = 0 THEN 'not_run' WHEN h = 1 THEN 'error' WHEN p >= {structural.FLAGGED} THEN 'flagged' WHEN p <= {structural.CLEAR} THEN 'clear' ELSE 'review' END AS status FROM p)
    SELECT feature, count(*) AS labelled, count(*) FILTER (status = 'flagged' AND expected) AS tp, count(*) FILTER (status = 'flagged' AND NOT expected) AS fp, count(*) FILTER (status = 'clear' AND NOT expected) AS tn, count(*) FILTER (status = 'clear' AND expected) AS fn,
    count(*) FILTER (status = 'review') AS abstentions, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'not_run') AS not_run FROM b WHERE expected IS NOT NULL GROUP BY feature"""
)
def structural_scores(spark, d):
    """Cases against a judge's answers, by feature; a fifth of the cases has no answer and a fifth failed."""
    c = table(spark, d, "cases").select("id", "expected")
    h = F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") % 5
    a = c.select("id", F.explode("expected").alias("feature", "_"), h.alias("h")).where("h > 0").select("id", "feature", F.when(F.col("h") > 1, prob(F.concat("id", F.lit("/"), "feature"))).alias("probability"))
    return structural.scores(c, a)


_NOT_LATEST = "row_number() OVER (PARTITION BY dataset, row_index, turn_index ORDER BY loaded_at DESC, record_id DESC)"


@query(f"SELECT coalesce(model, 'unattributed') AS model, count(*) AS records, count(*) FILTER (n > 1) AS superseded FROM (SELECT model, {_NOT_LATEST} AS n FROM corpus_records) GROUP BY 1")
def superseded_records(spark, d):
    """By model, records and those that a later load of the same natural key replaces."""
    t = table(spark, d, "corpus_records").select("dataset", "row_index", "turn_index", "record_id", "loaded_at", F.coalesce("model", F.lit("unattributed")).alias("model"))
    last = t.groupBy("dataset", "row_index", "turn_index").agg(F.max_by("record_id", F.struct("loaded_at", "record_id")).alias("record_id")).select("record_id", F.lit(True).alias("last"))
    return t.join(last, "record_id", "left").groupBy("model").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("last").isNull(), 1)).alias("superseded"))



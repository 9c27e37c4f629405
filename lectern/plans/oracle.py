"""DuckDB SQL of the text relations, written against RE2: the independent side of the queries' check."""

from __future__ import annotations

from lectern.functions.text import WORD
from lectern.operators import metrics as M
from lectern.operators import views as V

A, B, P, U = "\ue000", "\ue001", "\ue003", "\ue004"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parts(expr: str, pattern: str) -> str:
    return f"string_split(replace(regexp_replace(translate({expr}, '{A}{B}', '\ufffd\ufffd'), {q(pattern)}, '{A}\\0{B}', 'g'), '{B}', '{A}'), '{A}')"


def blank(x: str) -> str:
    return f"regexp_replace({x}, '[^\\n]', ' ', 'g')"


def rewrite(expr: str, pattern: str, body: str | None = None) -> str:
    return f"array_to_string(list_transform({parts(expr, pattern)}, lambda x, i: CASE WHEN i % 2 = 0 THEN {body or blank('x')} ELSE x END), '')"


def spans(expr: str, pattern: str) -> str:
    """List of structs s, e of the matches."""
    p = parts(expr, pattern)
    return (
        f"list_filter(list_transform(range(1, len({p}) + 1), lambda k: {{'k': k, 's': coalesce(list_sum(list_transform({p}[:k - 1], lambda y: length(y))), 0)::BIGINT, 'e': list_sum(list_transform({p}[:k], lambda y: length(y)))::BIGINT}}), lambda z: z.k % 2 = 0 AND z.e > z.s)"
    )


KEYS = ", ".join(q(k) for k in V.MACHINE_KEYS)
_HEAD = "regexp_extract(l, '^[ \\t]*(?:-[ \\t]+)?(?:[A-Za-z_][\\w-]*:[ \\t]+)?', 0)"
_KEY = "lower(regexp_extract(l, '^[ \\t]*(?:-[ \\t]+)?([A-Za-z_][\\w-]*):[ \\t]+', 1))"
_TAIL = "regexp_extract(l, '[ \\t]*$', 0)"
_REST = f"substring(l, length({_HEAD}) + 1, greatest(length(l) - length({_HEAD}) - length({_TAIL}), 0))"
_VALUE = f"CASE WHEN length({_REST}) >= 2 AND left({_REST}, 1) = right({_REST}, 1) AND left({_REST}, 1) IN ('\"', '''') THEN ' ' || substring({_REST}, 2, length({_REST}) - 2) || ' ' ELSE {_REST} END"
_FRONT = (
    "array_to_string(list_transform(string_split(x, chr(10)), lambda l: CASE WHEN trim(l) <> '---' AND len(regexp_extract_all("
    f"{_VALUE}, '[A-Za-zÀ-ɏ]{{2,}}')) >= 2 AND {_KEY} NOT IN ({KEYS}) THEN repeat(' ', length({_HEAD})) || {_VALUE} || repeat(' ', length({_TAIL})) ELSE repeat(' ', length(l)) END), chr(10))"
)
_WORDS = "list_filter(regexp_split_to_array(substring(x, 2, length(x) - 3), '[\\s-]+'), lambda w: w <> '')"
_LABEL = (
    f"' ' || CASE WHEN len({_WORDS}) >= 2 AND len(list_filter({_WORDS}, lambda w: NOT regexp_matches(left(w, 1), '^[\\p{{Lu}}\\p{{Lt}}\\p{{Nd}}]'))) = 0 THEN repeat(' ', length(x) - 3) ELSE substring(x, 2, length(x) - 3) END || ']('"
)
_H, _T = "regexp_extract(x, '^#{1,6}[ \\t]+', 0)", "regexp_extract(x, '[ \\t]+#+[ \\t]*$', 0)"
_BODY = f"substring(x, length({_H}) + 1, greatest(length(x) - length({_H}) - length({_T}), 0))"
_HEADING = f"repeat(' ', length({_H})) || {_BODY} || repeat(' ', length(x) - length({_H}) - length({_BODY}))"


def views(source: str = "documents", key: str = "doc_id", extra: str = "") -> str:
    """CTEs ending in ``v`` (key, text, masked, prose); each pass is a step, so no expression is repeated."""
    steps = [f"v0 AS (SELECT {key}, {extra} coalesce(text, '') AS text, coalesce(text, '') AS t FROM {source})"]
    k = 0

    def step(expr: str) -> None:
        nonlocal k
        steps.append(f"v{k + 1} AS (SELECT * EXCLUDE (t), {expr} AS t FROM v{k})")
        k += 1

    step(rewrite("t", V.FRONT, _FRONT))
    step(rewrite("t", V.FENCE))
    for p in (V.INLINE_CODE, V.COMMENT, V.TAG, V.CONTAINER):
        step(rewrite("t", p))
    step(rewrite("t", V.LABEL, _LABEL))
    for p in (V.TARGET, V.URL, V.TABLE):
        step(rewrite("t", p))
    steps.append(f"m0 AS (SELECT * EXCLUDE (t), t AS masked, translate(t, {q(V.CURLY)}, {q(V.STRAIGHT)}) AS t FROM v{k})")
    steps.append(f"m1 AS (SELECT * EXCLUDE (t), {rewrite('t', V.HEADING_LINE, _HEADING)} AS t FROM m0)")
    steps.append(f"m2 AS (SELECT * EXCLUDE (t), {rewrite('t', '(?m)' + V.QUOTE)} AS t FROM m1)")
    steps.append(f"m3 AS (SELECT * EXCLUDE (t), {rewrite('t', '(?m)' + V.BULLET)} AS t FROM m2)")
    keep = "t"
    for c, mark in (("\\*", P), ("_", U)):
        for _ in range(2):
            keep = f"regexp_replace({keep}, '(\\A|\\s){c}(\\s|\\z)', '\\1{mark}\\2', 'g')"
    steps.append(f"v AS MATERIALIZED (SELECT * EXCLUDE (t), translate(translate({keep}, '*_', '  '), '{P}{U}', '*_') AS prose FROM m3)")
    return ",\n".join(steps)


def lines(key: str = "doc_id") -> str:
    front = f"string_split({rewrite('text', V.FRONT, blank_as('x', chr(0xE002)))}, chr(10))"
    return f"""l0 AS (SELECT {key}, string_split(masked, chr(10)) AS m, {front} AS f FROM v),
l1 AS (SELECT {key}, unnest(range(len(m))) AS line_no, m, f FROM l0),
l2 AS (SELECT {key}, line_no, m[line_no + 1] AS line, contains(f[line_no + 1], chr(57346)) AS front FROM l1),
l3 AS (SELECT *, CASE WHEN trim(regexp_replace(line, '[\\s\\x0B]', ' ', 'g')) = '' THEN 'blank' WHEN front THEN 'field' WHEN regexp_matches(line, {q(V.QUOTE)}) THEN 'quote'
  WHEN regexp_matches(line, {q(V.HEADING)}) THEN 'heading' WHEN regexp_matches(line, {q(V.BULLET)}) THEN 'list' ELSE 'plain' END AS raw,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS span_start FROM l2),
l4 AS (SELECT *, raw = 'plain' AND coalesce(last_value(CASE WHEN raw <> 'plain' THEN raw END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'list' AS continued FROM l3),
l AS (SELECT {key}, line_no, span_start, span_start + length(line) AS span_end, CASE WHEN raw = 'blank' THEN NULL WHEN continued THEN 'list' WHEN raw = 'plain' THEN 'paragraph' ELSE raw END AS kind, continued FROM l4)"""


def blank_as(x: str, c: str) -> str:
    return f"regexp_replace({x}, '[^\\n]', '{c}', 'g')"


def blocks(key: str = "doc_id") -> str:
    return f"""b0 AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER w = kind AND (kind IN ('paragraph', 'quote') OR continued), false) THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY {key} ORDER BY line_no)),
b1 AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY line_no) AS run FROM b0),
b2 AS (SELECT {key}, run, any_value(kind) AS kind, min(span_start) AS span_start, max(span_end) AS span_end FROM b1 WHERE kind IS NOT NULL GROUP BY {key}, run),
b AS MATERIALIZED (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY span_start) AS block_id, kind, span_start, span_end FROM b2)"""


_NEAR = "[.!?]+[\"'')\\]]*"
_MARKED = f"regexp_replace(t, '({_NEAR})(\\s+[\"''(\\[]?[A-Za-z0-9]|\\s*\\z)', '\\1{A}\\2', 'g')"


def sentences(name: str = "s", source: str = "b", where: str = "kind IN ('paragraph', 'list', 'quote', 'field')", key: str = "doc_id") -> str:
    """CTE ``name`` (key, block_id, kind, sent_no, span_start, span_end, sentence) of the blocks of ``source`` that pass ``where``."""
    n = name
    return f"""{n}0 AS (SELECT {source}.*, substring(prose, (span_start + 1)::BIGINT, (span_end - span_start)::BIGINT) AS t FROM {source} JOIN v USING ({key})),
{n}1 AS (SELECT *, string_split({_MARKED}, '{A}') AS ps FROM {n}0 WHERE {where}),
{n}2 AS (SELECT {key}, block_id, kind, span_start AS base, t, len(ps) AS n, unnest(range(len(ps))) AS k, ps FROM {n}1),
{n}3 AS (SELECT * EXCLUDE (ps), ps[k + 1] AS piece, sum(length(ps[k + 1])) OVER (PARTITION BY {key}, block_id ORDER BY k)::BIGINT AS e FROM {n}2),
{n}4 AS (SELECT *, substring(t, greatest(e - 24, 0) + 1, least(e, 24)) AS tail, substring(t, e + 1, 40) AS nxt FROM {n}3),
{n}5 AS (SELECT *, k < n - 1 AND NOT (regexp_matches(tail, {q(V.ABBREVIATION)}) OR (regexp_matches(tail, {q(V.CONTINUING)}) AND regexp_matches(nxt, '^\\s+["''(\\[]?[a-z]')) OR (regexp_matches(tail, {q(V.INITIAL)}) AND regexp_matches(nxt, '^\\s+[a-z]'))) AS stop FROM {n}4),
{n}6 AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY {key}, block_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {n}5),
{n}7 AS (SELECT {key}, block_id, kind, base, g, string_agg(piece, '' ORDER BY k) AS raw, min(e - length(piece)) AS a FROM {n}6 GROUP BY ALL),
{n}8 AS (SELECT *, row_number() OVER (PARTITION BY {key}, block_id ORDER BY g) AS no, length(regexp_extract(raw, '^[\\s\\x0B]*', 0)) AS lead, regexp_replace(raw, '^[\\s\\x0B]+|[\\s\\x0B]+\\z', '', 'g') AS sentence FROM {n}7),
{name} AS MATERIALIZED (SELECT {key}, block_id, kind, row_number() OVER (PARTITION BY {key}, block_id ORDER BY no) AS sent_no, base + a + lead AS span_start, base + a + lead + length(sentence) AS span_end, sentence FROM {n}8 WHERE sentence <> '')"""


def prose(key: str = "doc_id") -> str:
    """CTEs v, l, b, p0 (paragraphs and items with text), p (paragraphs) and s (their sentences)."""
    return f"""{views()},
{lines(key)},
{blocks(key)},
p0 AS MATERIALIZED (SELECT b.*, substring(prose, (span_start + 1)::BIGINT, (span_end - span_start)::BIGINT) AS tt FROM b JOIN v USING ({key}) WHERE kind IN ('paragraph', 'list')),
p1 AS (SELECT * FROM p0 WHERE kind = 'list' OR contains(tt, chr(10)) OR regexp_matches(tt, {q(M.SENTENCE_END)})),
p AS (SELECT {key}, block_id, span_start, span_end, tt AS t FROM p1 WHERE kind = 'paragraph'),
pb AS (SELECT {key}, block_id, kind, span_start, span_end FROM p1),
{sentences("s", "pb", "true", key)}"""


WORDS = f"len(regexp_extract_all({{}}, {q(WORD)}))"


def words(x: str) -> str:
    return WORDS.format(x)


def opener(x: str, n: int) -> str:
    return f"lower(array_to_string(regexp_extract_all({x}, {q(WORD)})[:{n}], ' '))"


def per_doc(body: str, neutral: float) -> str:
    """One row a document from a subquery with doc_id, value, span_start, span_end."""
    return f"SELECT v.doc_id, round(coalesce(r.value::DOUBLE, {neutral}), 6) AS value, r.span_start::BIGINT AS span_start, r.span_end::BIGINT AS span_end FROM v LEFT JOIN ({body}) r ON v.doc_id = r.doc_id"


def metric_sql() -> dict[str, str]:
    lead = "regexp_replace(t, '^\\s+', '')"

    def density(view: str, pattern: str, least: int = 1) -> str:
        return per_doc(f"SELECT doc_id, CASE WHEN n >= {least} THEN len(x) * 100.0 / greatest(n, 1) ELSE 0.0 END AS value, x[1].s AS span_start, x[1].e AS span_end FROM (SELECT doc_id, {words('prose')} AS n, {spans(view, pattern)} AS x FROM v)", 0.0)

    def openers(pattern: str) -> str:
        return per_doc(f"SELECT doc_id, count(*) AS value, arg_min(a, span_start) AS span_start, arg_min(a + length(h), span_start) AS span_end FROM (SELECT doc_id, span_start, span_start + length(t) - length({lead}) AS a, regexp_extract({lead}, {q('(?i)' + pattern)}, 0) AS h FROM p) WHERE h <> '' GROUP BY doc_id", 0.0)

    out = {
        "sentence_length_cv": per_doc(f"SELECT doc_id, CASE WHEN count(*) < 2 THEN 1.0 ELSE stddev_pop(n) / avg(n) END AS value, NULL AS span_start, NULL AS span_end FROM (SELECT doc_id, {words('sentence')} AS n FROM s) WHERE n > 0 GROUP BY doc_id", 1.0),
        "paragraph_opener_repeats": per_doc(
            f"""SELECT doc_id, max(n) - 1 AS value, arg_max(a, (n, -a)) AS span_start, arg_max(e, (n, -a)) AS span_end FROM (SELECT doc_id, k, count(*) AS n, min(span_start) AS a, arg_min(least(span_end, span_start + 60), span_start) AS e
            FROM (SELECT doc_id, span_start, span_end, {opener('t', 2)} AS k FROM p) WHERE k <> '' GROUP BY doc_id, k) GROUP BY doc_id""", 0.0),
        "sentence_opener_run": per_doc(
            f"""SELECT doc_id, max(n) AS value, arg_max(a, (n, -a)) AS span_start, arg_max(e, (n, -a)) AS span_end FROM (SELECT doc_id, block_id, run, count(*) AS n, min(span_start) AS a, max(span_end) AS e FROM
            (SELECT *, sum(new) OVER (PARTITION BY doc_id, block_id ORDER BY sent_no) AS run FROM (SELECT *, CASE WHEN k <> '' AND coalesce(lag(k) OVER (PARTITION BY doc_id, block_id ORDER BY sent_no), '') = k THEN 0 ELSE 1 END AS new
            FROM (SELECT *, {opener('sentence', 1)} AS k FROM s WHERE kind = 'paragraph'))) GROUP BY doc_id, block_id, run HAVING count(*) > 1) GROUP BY doc_id""", 0.0),
        "triad_density": density("prose", "(?i)" + M.TRIAD),
        "signpost_density": density("prose", "(?i)" + M.SIGNPOST, 150),
        "em_dash_density": density("masked", "—"),
        "bold_label_bullets": per_doc(f"SELECT doc_id, len(x) AS value, x[1].s AS span_start, x[1].e AS span_end FROM (SELECT doc_id, {spans('masked', M.BOLD_LABEL)} AS x FROM v)", 0.0),
        "connective_openers": openers(M.CONNECTIVE),
        "every_template_openers": openers(M.EVERY),
        "rhetorical_question_share": per_doc(
            f"""SELECT doc_id, k * 1.0 / n AS value, a AS span_start, e AS span_end FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (hit) AS k, min(span_start) FILTER (hit) AS a, arg_min(nxe, span_start) FILTER (hit) AS e
            FROM (SELECT *, coalesce(regexp_matches(sentence, {q(M.QUESTION)}) AND NOT regexp_matches(nx, {q(M.QUESTION)}), false) AS hit FROM (SELECT *, lead(sentence) OVER w AS nx, lead(span_end) OVER w AS nxe FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY span_start, span_end))) GROUP BY doc_id) WHERE k >= 3""", 0.0),
        "short_paragraph_share": per_doc(
            "SELECT doc_id, avg(one) AS value, min(span_start) FILTER (one = 1) AS span_start, arg_min(span_end, span_start) FILTER (one = 1) AS span_end FROM (SELECT p.doc_id, p.span_start, p.span_end, CASE WHEN count(s.sent_no) <= 1 THEN 1.0 ELSE 0.0 END AS one FROM p LEFT JOIN s ON p.doc_id = s.doc_id AND p.block_id = s.block_id GROUP BY ALL) GROUP BY doc_id", 0.0),
        "participial_closer_share": per_doc(
            f"""SELECT doc_id, avg((h <> '')::INT) AS value, min(a) FILTER (h <> '') AS span_start, arg_min(span_end, a) FILTER (h <> '') AS span_end FROM (SELECT doc_id, span_end, h, span_start + length(bare) - length(h) AS a
            FROM (SELECT *, regexp_extract(bare, {q('(?i)' + M.CLOSER)}, 0) AS h FROM (SELECT *, regexp_replace(sentence, '[.!?"'']+\\z', '') AS bare FROM s))) GROUP BY doc_id""", 0.0),
        "conclusion_coda": per_doc(
            f"""SELECT doc_id, CASE WHEN coda <> '' THEN 1.0 WHEN u > 0 THEN i * 1.0 / u ELSE 0.0 END AS value, CASE WHEN coda <> '' THEN le - length(lt) WHEN i > 0 THEN ls END AS span_start, CASE WHEN coda <> '' THEN le - length(lt) + length(coda) WHEN i > 0 THEN le END AS span_end
            FROM (SELECT *, len(list_intersect(ca, cb)) AS i, len(list_distinct(list_concat(ca, cb))) AS u FROM (SELECT *, regexp_extract(lt, {q('(?i)' + M.CODA)}, 0) AS coda, {_content('ft')} AS ca, {_content('lt')} AS cb
            FROM (SELECT doc_id, f.t AS ft, regexp_replace(z.t, '^\\s+', '') AS lt, z.span_start AS ls, z.span_end AS le FROM (SELECT doc_id, f, CASE WHEN n >= 3 AND regexp_matches(regexp_replace(z1.t, '^\\s+', ''), {q('(?i)' + M.SIGNOFF)}) THEN z2 ELSE z1 END AS z
            FROM (SELECT doc_id, count(*) AS n, any_value({{'t': t, 'span_start': span_start, 'span_end': span_end}}) FILTER (up = 1) AS f, any_value({{'t': t, 'span_start': span_start, 'span_end': span_end}}) FILTER (down = 1) AS z1,
            any_value({{'t': t, 'span_start': span_start, 'span_end': span_end}}) FILTER (down = 2) AS z2 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_start) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY span_start DESC) AS down FROM p) GROUP BY doc_id) WHERE n >= 2))))""", 0.0),
    }
    return {k: f"WITH {prose()}\n{v}" for k, v in out.items()}


def _content(x: str) -> str:
    stop = ", ".join(q(w) for w in M.STOPWORDS)
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, {q(WORD)}), lambda w: lower(w)), lambda w: length(w) > 3 AND w NOT IN ({stop})))"

"""DuckDB SQL of the queries that SQL can state over whole tables."""

from __future__ import annotations


def _fold(x: str) -> str:
    return f"regexp_replace(replace(translate(lower({x}), 'ſς', 'sσ'), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]|[\\x{{FE00}}-\\x{{FE0F}}\\x{{34F}}]', '', 'g')"


_NUMBER = "regexp_full_match(v, '-?(0|[1-9]\\d*)(\\.\\d+)?([eE][+-]?\\d+)?')"
_KEYS = f"""f AS (SELECT raw_id, lower(trim(key)) AS k, CASE WHEN {_NUMBER} THEN '#' || (v::DOUBLE)::VARCHAR ELSE {_fold('v')} END AS x FROM (SELECT raw_id, e.key AS key, e.value ->> '$' AS v FROM raw_records, json_each(payload) e WHERE e.type <> 'NULL') WHERE lower(trim(key)) <> 'sha256'),
k AS (SELECT 'evaluation' AS origin, eval_no AS rec_id, loaded_at AS arrived, {_fold('sentence')} AS key FROM evaluation WHERE sentence IS NOT NULL UNION ALL SELECT 'session_records', rec_no, loaded_at, {_fold('text')} FROM session_records WHERE text IS NOT NULL
UNION ALL SELECT 'raw_records', raw_id, any_value(received_at), string_agg(k || chr(1) || x, chr(2) ORDER BY k, x) FROM f JOIN raw_records USING (raw_id) GROUP BY raw_id),
g AS (SELECT origin, key, min(rec_id) AS keep_id, arg_min(rec_id, (coalesce(arrived, TIMESTAMP '9999-12-31'), rec_id)) AS first_id, count(*) AS copies FROM k GROUP BY origin, key)"""

P4_FOUND = f"WITH {_KEYS} SELECT k.origin, g.keep_id, k.rec_id AS copy_id FROM k JOIN g ON k.origin = g.origin AND k.key = g.key WHERE k.rec_id > g.keep_id"

P4_RECORDS = f"""WITH {_KEYS}, d AS (SELECT rec_no, CASE WHEN sha256 IS NULL THEN 'missing' WHEN lower(trim(sha256)) = sha256(text) THEN 'right' ELSE 'stale' END AS s FROM session_records)
SELECT k.origin, any_value(g.keep_id) AS keep_id, any_value(g.first_id) AS first_id, any_value(g.copies) AS copies, count(*) FILTER (d.s = 'right') AS digest_right, count(*) FILTER (d.s = 'stale') AS digest_stale, count(*) FILTER (d.s = 'missing') AS digest_missing
FROM k JOIN g ON k.origin = g.origin AND k.key = g.key LEFT JOIN d ON k.origin = 'session_records' AND d.rec_no = k.rec_id GROUP BY k.origin, k.key"""

# every window of 200 characters by its digest: those of two documents, joined where they overlap or touch
_SPANS = """w AS (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200), h AS (SELECT doc_id, i, md5(substring(text, i + 1, 200)) AS h FROM w),
s AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)), r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM s)),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
p AS (SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) + 200)::BIGINT AS span_end FROM g GROUP BY doc_id, run)"""

P5_FOUND = f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM p"

P5_SHARES = f"""WITH {_SPANS}, t AS (SELECT doc_id, count(*) AS spans, sum(span_end - span_start)::BIGINT AS shared FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0) AS chars, coalesce(spans, 0) AS spans, coalesce(shared, 0) AS shared, CASE WHEN coalesce(length(text), 0) > 0 THEN round(coalesce(shared, 0) / length(text), 6) ELSE 0.0 END AS share FROM documents d LEFT JOIN t USING (doc_id)"""

P5_REMOVED = f"""WITH {_SPANS}, t AS (SELECT doc_id, list(span_start ORDER BY span_start) AS a, list(span_end ORDER BY span_start) AS b FROM p GROUP BY doc_id),
k AS (SELECT d.doc_id, CASE WHEN a IS NULL THEN coalesce(text, '') ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda i: substring(text, coalesce(b[i - 1], 0) + 1, coalesce(a[i], length(text)) - coalesce(b[i - 1], 0))), '') END AS kept FROM documents d LEFT JOIN t USING (doc_id))
SELECT doc_id, length(kept)::BIGINT AS chars, md5(kept) AS kept FROM k"""

_COVER = "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS covered, 0::BIGINT AS first, coalesce(length(text), 0)::BIGINT AS last{} FROM documents"
P7_COVER, P9_COVER = _COVER.format(", 0::BIGINT AS over"), _COVER.format("")

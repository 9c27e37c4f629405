"""Queries over corpus records: screening, sampling, integrity, structural scores, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.runtime import spread, table
from lectern.operators import screening as S
from lectern.operators import structural
from lectern.plans import oracle as O
from lectern.plans.queries_findings import _PROB, prob
from lectern.sources import files, sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return deco


def turns(spark, d):
    return spread(table(spark, d, "corpus_records").select("record_id", "dataset", "row_index", "turn_index", "side", "role", "model", "language", "text", "loaded_at"))


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_GRAMS = f"""g0 AS (SELECT record_id, dataset, row_index, role = 'assistant' AS mine, {_WORDS} AS w FROM corpus_records), g1 AS (SELECT record_id, dataset, row_index, mine, w, unnest(range(1, len(w) - 6)) AS i FROM g0 WHERE len(w) >= 8),
g AS (SELECT DISTINCT record_id, dataset, row_index, mine, array_to_string(w[i:i + 7], ' ') AS gram FROM g1), c AS (SELECT DISTINCT a.record_id FROM g a JOIN g b ON a.dataset = b.dataset AND a.row_index = b.row_index AND a.gram = b.gram WHERE a.mine AND NOT b.mine)"""


@query(f"WITH {_GRAMS} SELECT record_id FROM c")
def ngram_overlap(spark, d):
    return S.overlapping(turns(spark, d), ["dataset", "row_index"], "record_id")


_SCREEN = f"""WITH {_GRAMS}, t AS (SELECT r.*, CASE WHEN text IS NULL OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' OR octet_length(encode(text)) > {S.MAX_TEXT_BYTES} THEN 'empty_or_size_or_content_schema' WHEN regexp_matches(text, {O.q(S.REASONING)}) THEN 'reasoning_marker'
WHEN regexp_matches(text, {O.q(S.UNSAFE)}) THEN 'conservative_privacy_prose_screen' WHEN c.record_id IS NOT NULL THEN 'nonassistant_overlap' END AS why FROM corpus_records r LEFT JOIN c ON r.record_id = c.record_id WHERE role = 'assistant'),
u AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN row_number() OVER (PARTITION BY text, why ORDER BY dataset, row_index, turn_index, record_id) > 1 THEN 'duplicate' END AS reason FROM t)"""


@query(_SCREEN + " SELECT record_id, coalesce(reason, 'kept') AS reason FROM u")
def screen_turns(spark, d):
    return S.screened(turns(spark, d)).select("record_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(_SCREEN + " SELECT dataset, coalesce(reason, 'kept') AS reason, count(*) AS n FROM u GROUP BY ALL")
def rejection_counts(spark, d):
    return S.rejection_counts(S.screened(turns(spark, d)))


@query("SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY model, text ORDER BY row_index, turn_index, record_id) AS n FROM corpus_records WHERE role = 'assistant' AND model IS NOT NULL AND text IS NOT NULL) WHERE n = 1")
def distinct_replies(spark, d):
    """One record for each model and text: the first in source order."""
    r = turns(spark, d).where("role = 'assistant' and model is not null and text is not null")
    return r.groupBy("model", F.sha2("text", 256).alias("digest")).agg(F.min_by("record_id", F.struct("row_index", "turn_index", "record_id")).alias("record_id")).select("record_id")


@query("SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY dataset, row_index, turn_index ORDER BY loaded_at DESC, record_id DESC) AS n FROM corpus_records) WHERE n = 1")
def latest_records(spark, d):
    """The last load of every natural key."""
    return turns(spark, d).groupBy("dataset", "row_index", "turn_index").agg(F.max_by("record_id", F.struct("loaded_at", "record_id")).alias("record_id")).select("record_id")


@query("SELECT dataset, digest FROM (SELECT dataset, digest, row_number() OVER (PARTITION BY dataset ORDER BY digest) AS n FROM (SELECT DISTINCT dataset, sha256(text) AS digest FROM corpus_records WHERE text IS NOT NULL)) WHERE n <= 50")
def group_sample(spark, d):
    """Fifty texts of each dataset, by content hash."""
    return S.group_sample(turns(spark, d).select("dataset", "text"), "dataset", "text", 50).select("dataset", "digest")


@query(f"SELECT record_id, octet_length(encode(text)) <= {S.MAX_TEXT_BYTES} AND NOT regexp_matches(text, {O.q(S.ARENA)}) AND NOT regexp_matches(text, {O.q(S.UNSAFE)}) AND NOT regexp_matches(text, {O.q(S.REASONING)}) AS safe FROM corpus_records WHERE text IS NOT NULL")
def arena_screen(spark, d):
    return turns(spark, d).where("text is not null").select("record_id", S.arena_safe(F.col("text")).alias("safe"))


_SAFE = " AND ".join(f"NOT regexp_matches(text, {O.q(p)})" for p in S.SESSION)


@query(f"SELECT rec_no, coalesce(length(text) BETWEEN 160 AND 12000 AND NOT regexp_matches(regexp_replace(text, '`[^`\\n]*`', '', 'g'), {O.q(S.SESSION_QUOTES)}) AND {_SAFE}, false) AS safe FROM session_records")
def session_screen(spark, d):
    return spread(table(spark, d, "session_records").select("rec_no", "text")).select("rec_no", S.safe_session_text(F.col("text")).alias("safe"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN sha256 IS NULL THEN 'missing' WHEN lower(trim(sha256)) = sha256(text) THEN 'right' ELSE 'stale' END AS status FROM session_records) GROUP BY status")
def digest_check(spark, d):
    s = table(spark, d, "session_records").select("text", "sha256")
    ok = files.verify(F.encode("text", "UTF-8"), F.col("sha256"), F.octet_length(F.encode("text", "UTF-8")))
    return s.select(F.when(F.col("sha256").isNull(), "missing").when(ok, "right").otherwise("stale").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT raw_id, json_extract_string(payload, '$.dataset') AS dataset, json_extract_string(payload, '$.role') AS role, md5(json_extract_string(payload, '$.text')) AS text FROM raw_records")
def raw_fields(spark, d):
    r = sessions.records_from_json(table(spark, d, "raw_records").select("raw_id", "payload"))
    return r.select("raw_id", F.col("rec_dataset").alias("dataset"), F.col("rec_role").alias("role"), F.md5("rec_text").alias("text"))


@query("SELECT DISTINCT 'record/' || left(sha256(text), 2) || '/' || sha256(text) || '.txt' AS path, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256, 'record' AS kind FROM corpus_records WHERE text IS NOT NULL")
def manifest_rows(spark, d):
    return files.manifest(turns(spark, d))


@query("SELECT DISTINCT 'record/' || left(sha256(text), 2) || '/' || sha256(text) || '.txt' AS path FROM session_records s WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM corpus_records c WHERE c.text = s.text)")
def manifest_missing(spark, d):
    """Session texts that the corpus manifest does not hold yet."""
    return files.missing(files.manifest(table(spark, d, "session_records").select("text")), files.manifest(turns(spark, d))).select("path")


_DATASETS = "SELECT dataset, language, text FROM corpus_records"


@query("SELECT record_id FROM corpus_records WHERE lower(language) IN ('en', 'english')")
def language_filter(spark, d):
    return turns(spark, d).where(S.language_equal(F.col("language"), F.lit("english"))).select("record_id")


@query("SELECT record_id FROM (SELECT record_id, row_number() OVER w AS n, sum(octet_length(encode(coalesce(text, '')))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM corpus_records WINDOW w AS (PARTITION BY dataset ORDER BY row_index, turn_index, record_id)) WHERE n <= 500 AND b <= 50000")
def budget_prefix(spark, d):
    """The first records of each dataset within 500 rows and 50,000 bytes."""
    return S.within_budget(turns(spark, d), ["row_index", "turn_index", "record_id"], F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), 500, 50_000, ["dataset"]).select("record_id")


_CASES = f"""e AS (SELECT id, lower(trim(split)) AS split, unnest(map_keys(expected)) AS feature, unnest(map_values(expected)) AS expected FROM cases), p AS (SELECT *, {_PROB.format("id || '/' || feature")} AS p FROM e),
b AS (SELECT *, CASE WHEN p >= {structural.FLAGGED} THEN 'flagged' WHEN p <= {structural.CLEAR} THEN 'clear' ELSE 'review' END AS status FROM p)"""


def scored_cases(spark, d):
    c = table(spark, d, "cases").select("id", F.lower(F.trim("split")).alias("split"), F.explode("expected").alias("feature", "expected"))
    return c.withColumn("p", prob(F.concat("id", F.lit("/"), "feature"))).withColumn("status", structural.band(F.col("p")))


@query(f"WITH {_CASES} SELECT feature, status, count(*) AS n FROM b GROUP BY ALL")
def probability_bands(spark, d):
    return scored_cases(spark, d).groupBy("feature", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_CASES} SELECT coalesce(split, '') AS split, feature, count(*) AS labelled, count(*) FILTER (status = 'flagged' AND expected) AS tp, count(*) FILTER (status = 'flagged' AND NOT expected) AS fp, count(*) FILTER (status = 'clear' AND NOT expected) AS tn,
    count(*) FILTER (status = 'clear' AND expected) AS fn, count(*) FILTER (status = 'review') AS abstentions, 0 AS errors, 0 AS not_run FROM b WHERE expected IS NOT NULL GROUP BY ALL"""
)
def structural_confusion(spark, d):
    return structural.confusion(scored_cases(spark, d).withColumn("split", F.coalesce("split", F.lit(""))), ["split"])


@query("SELECT outcome, count(*) AS n, count(DISTINCT dataset) AS datasets, count(*) FILTER (assessment IS NOT NULL) AS assessed FROM evaluation GROUP BY outcome")
def outcome_histogram(spark, d):
    return table(spark, d, "evaluation").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("datasets"), F.count("assessment").alias("assessed"))


@query("SELECT session_id, count(*) AS blocks, count(DISTINCT message_id) AS messages, sum(len(jsonl_lines))::BIGINT AS lines FROM session_records GROUP BY session_id")
def session_statistics(spark, d):
    return table(spark, d, "session_records").groupBy("session_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("message_id").alias("messages"), F.sum(F.size("jsonl_lines")).cast("bigint").alias("lines"))


@query("SELECT source_path, message_id, any_value(text_line) AS text_line, any_value(sha256(text)) AS sha256 FROM session_records WHERE message_id IS NOT NULL AND text IS NOT NULL GROUP BY source_path, message_id HAVING count(*) = 1 AND any_value(coalesce(model, 'unknown')) <> '<synthetic>'")
def session_extraction(spark, d):
    """Session lines rebuilt as JSON, then read back as messages with exactly one text block."""
    s = table(spark, d, "session_records").where("message_id is not null and text is not null")
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.lit("assistant").alias("role"), F.col("message_id").alias("id"), "model", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    return sessions.session_records(s.select("source_path", F.col("text_line").alias("line_no"), line.alias("value"))).select("source_path", "message_id", "text_line", "sha256")

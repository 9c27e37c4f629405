"""Corpus screening and sampling: assistant turns out of conversations, with reasons, budgets and hashes.

The screens are JVM predicates in a fixed order; the first that fails is the reason. Overlap with what others
said is a join of 8-grams inside one conversation, not across the corpus. Records are rejected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.runtime import written

# Screens for private, unsafe or unoriginal text. ASCII classes, so that engines agree.
UNSAFE = (
    r"(?im)[\w.+-]+@[\w.-]+\.[a-z]{2,}|https?://|www\.|\b(?:sk-|ghp_|github_pat_|AKIA)[a-z0-9_-]{8,}|"
    r"\b(?:password|passwd|api[_ -]?key|access[_ -]?token|secret|authorization)\s*[:=]|-----BEGIN\s+.*PRIVATE\s+KEY|\b(?:\d{1,3}\.){3}\d{1,3}\b|"
    r"(?:\+?\d[\d ()-]{8,}\d)|\b\d{3}-\d{2}-\d{4}\b|\b(?:my\s+name\s+is|my\s+address|date\s+of\s+birth|i\s+live\s+at)\b|"
    r"\b\d+\s+\w+\s+(?:street|avenue|road|lane|drive)\b|\[\s*(?:redacted|removed|pii)\s*\]|<(?:redacted|pii)>|```|^\s*>|[“”]|\"[^\"\n]{12,}\"|"
    r"\b(?:copyright|all\s+rights\s+reserved|verbatim|lyrics|excerpt|quoted|quotation)\b|\b(?:fuck|shit|nigger|faggot)\w*|"
    r"(?:^|\n)\s*(?:def\s+\w+|class\s+\w+|import\s+\w+|diff\s+--git|@@)"
)
REASONING = r"(?im)</?(?:think|analysis|reasoning)\b|\[(?:analysis|reasoning)\]|^\s*(?:analysis|reasoning)\s*:|<\|(?:analysis|channel)\|>"
ARENA = (
    r"(?im)[@]|https?://|\b(?:api[_ -]?key|password|secret|token|bearer|ssh-rsa|AKIA[A-Z0-9]+)\b|\b(?:\d[ -]?){7,}\b|```|`|</?(?:think|thinking|analysis)>|"
    r"\b(?:def |import |function |console\.|SELECT .+ FROM|chain.of.thought|let.s think|step.by.step)\b|[\"“”「」『』]|^\s*>"
)
SESSION = (
    r"(?i)```|~~~", r"(?im)^\s*>", r"(?i)https?://|www\.", r"(?i)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", r"(?i)/(?:home|Users|tmp|workspace|projects|root|mnt|var|private|opt)/", r"(?i)[A-Za-z]:[\\/]",
    r"(?i)\[(?:REDACTED|ANON|EMAIL|SECRET|USER|NAME)", r"(?i)~[/\\]", r"(?i)\b(?:sk-|gh[pousr]_|github_pat_|glpat-|AKIA|ASIA|xox[baprs]-|AIza|Bearer\s)", r"(?i)\b(?:password|secret|token|api[_ -]?key)\s*[:=]",
    r"(?i)BEGIN [A-Z ]*PRIVATE KEY", r"(?i)\beyJ[A-Za-z0-9_-]+\.", r"(?i)<(?:user|system|assistant|tool|script|style|blockquote)\b", r"(?im)^\s*(?:def |class |import |from \w+ import |function |const |let |diff --git|@@ )",
)
SESSION_QUOTES = '["“”]'
MAX_TEXT_BYTES = 100_000
LANGUAGE_ALIASES = {"en": "english", "ja": "japanese"}
FLAGS = ("toxic", "redacted", "flagged")


def grams(text: Column, n: int = 8) -> Column:
    """Distinct runs of n lower-cased words, joined by blanks; none if there are fewer words."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def language_equal(a: Column, b: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv))
    norm = lambda c: F.coalesce(F.try_element_at(m, F.lower(c)), F.lower(c))
    return norm(a) == norm(b)


def _bare(json: Column) -> Column:
    """JSON without escapes and string values, so that words in texts are no flags; keys stay."""
    return F.regexp_replace(F.regexp_replace(json, r"\\.", ""), r'("[^"]*"\s*:)|"[^"]*"', "$1")


def flagged(json: Column) -> Column:
    """A flag, or a category of moderation, that is true in a JSON value, at any depth."""
    t = _bare(json)
    return F.coalesce(t.rlike(rf'"(?:{"|".join(FLAGS)})"\s*:\s*true') | t.rlike(r'"categories"\s*:\s*\{[^{}]*:\s*true'), F.lit(False))


def any_true(json: Column) -> Column:
    """Anything that is true in a JSON value, at any depth; maps of scores do not count."""
    return F.coalesce(F.regexp_replace(_bare(json), r'"(?:category_scores|scores)"\s*:\s*(?:\{[^{}]*\}|\[[^\[\]]*\])', "").rlike(r"(?:^|[:\[,])\s*true\b"), F.lit(False))


def incomplete(json: Column) -> Column:
    """A turn that was cut off, calls a tool, reasons, or ended for such a reason."""
    marks = ("truncated", "is_truncated", "tool_calls", "function_call", "thinking", "reasoning", "reasoning_content")
    set_ = F.exists(F.array(*(F.get_json_object(json, f"$.{k}") for k in marks)), lambda x: F.coalesce(~x.isin("", "false", "0", "[]", "{}", "null"), F.lit(False)))
    return set_ | F.coalesce(F.get_json_object(json, "$.finish_reason").isin("length", "max_tokens", "tool_calls", "function_call"), F.lit(False))


def overlapping(turns: DataFrame, conversation: list[str], key: str, n: int = 8) -> DataFrame:
    """Keys of assistant turns that share n words in a row with another role's turn of the same conversation."""
    g = turns.select(key, *conversation, (F.col("role") == "assistant").alias("mine"), F.explode(grams(F.coalesce("text", F.lit("")), n)).alias("gram")).withColumn("gram", F.md5("gram"))
    mine = g.where("mine").drop("mine").distinct()
    theirs = g.where("not mine").select(*conversation, "gram").distinct()
    return mine.join(theirs, [*conversation, "gram"], "left_semi").select(key).distinct()


def screened(turns: DataFrame, conversation: list[str] = ("dataset", "row_index"), key: str = "record_id") -> DataFrame:
    """Assistant turns with ``reason``: null if they pass, else the first screen that rejects them.

    Null texts are rejected as empty. Repeats of a text that passes are marked 'duplicate' but for the first
    by (dataset, row_index, turn_index, key).
    """
    conversation = list(conversation)
    hit = overlapping(turns, conversation, key).withColumn("copied", F.lit(True))
    t = turns.where("role = 'assistant'").join(hit, key, "left")
    size = F.octet_length(F.encode("text", "UTF-8"))
    reason = (
        F.when(F.col("text").isNull() | (F.trim(F.regexp_replace("text", r"\s+", " ")) == "") | (size > MAX_TEXT_BYTES), "empty_or_size_or_content_schema")
        .when(F.col("text").rlike(REASONING), "reasoning_marker")
        .when(F.col("text").rlike(UNSAFE), "conservative_privacy_prose_screen")
        .when(F.col("copied"), "nonassistant_overlap")
    )
    t = t.withColumn("reason", reason).withColumn("digest", F.sha2("text", 256)).drop("copied")
    order = ["dataset", "row_index", "turn_index", key]
    first = t.where("reason is null").groupBy("digest").agg(F.min(F.struct(*order)).alias("first"))
    t = t.join(first, "digest", "left")
    return t.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.struct(*order) != F.col("first"), "duplicate")).drop("first")


def rejection_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def safe_session_text(text: Column) -> Column:
    """160 to 12,000 characters and none of the session screens; quotes inside code do not count."""
    bare = F.regexp_replace(text, r"`[^`\n]*`", "")
    ok = F.length(text).between(160, 12_000) & ~bare.rlike(SESSION_QUOTES)
    for p in SESSION:
        ok = ok & ~text.rlike(p)
    return F.coalesce(ok, F.lit(False))


def arena_safe(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-8")) <= MAX_TEXT_BYTES) & ~text.rlike(ARENA) & ~text.rlike(UNSAFE) & ~text.rlike(REASONING)


def within_budget(rows: DataFrame, order: list[str], size: Column, max_rows: int | None = None, max_bytes: int | None = None, by: list[str] = ()) -> DataFrame:
    """The longest prefix in this order of at most so many rows and bytes, in each group.

    The rows are sorted once over all tasks, so a group that is most of the table is spread over many of them.
    """
    if not by and max_bytes is None:
        return rows.orderBy(*order).limit(max_rows)
    # two passes: totals per range partition, then a running sum inside each; no task sees more than its range
    part = written(rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()).withColumn("_s", size.cast("bigint")), "budget")
    tot = part.groupBy(*by, "_p").agg(F.sum("_s").alias("_b0"), F.count(F.lit(1)).alias("_n0"))  # a row for each partition and group in it
    w0 = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = tot.select(*by, "_p", F.coalesce(F.sum("_b0").over(w0), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n0").over(w0), F.lit(0)).alias("_n0"))
    w = Window.partitionBy(*by, "_p").orderBy(*order)
    out = part.alias("l").join(base.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_p")]).select("l.*", "r._b0", "r._n0")
    out = out.withColumn("_n", F.row_number().over(w) + F.col("_n0")).withColumn("_b", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_b0")).drop("_p", "_s", "_b0", "_n0")
    if max_rows is not None:
        out = out.where(F.col("_n") <= max_rows)
    if max_bytes is not None:
        out = out.where(F.col("_b") <= max_bytes)
    return out.drop("_n", "_b")


def group_sample(rows: DataFrame, group: str, text: str, n: int) -> DataFrame:
    """At most n rows of each group, those with the least SHA-256 of their text; equal texts once.

    A first cut per hash bucket keeps every task small before the last rank of each group.
    """
    d = rows.where(F.col(text).isNotNull()).withColumn("digest", F.sha2(text, 256)).dropDuplicates([group, "digest"])
    salt = F.substring("digest", -2, 2)
    first = d.withColumn("_r", F.row_number().over(Window.partitionBy(group, salt).orderBy("digest"))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("digest"))).where(F.col("_r") <= n).drop("_r")


# The bounds of a request, of a row's turns, of a model's name and of what others said in a row.
MAX_LIMIT, MAX_ROWS, MAX_TURNS, MAX_MODEL, MAX_OTHERS = 10_000, 100_000, 1000, 200, 4 * 1024 * 1024
CHANNELS = ("analysis", "reasoning", "commentary")
ROW_DDL = "row_idx bigint, truncated_cells array<string>, row string"


class BoundsError(ValueError):
    """A limit outside its bounds."""


def bounds(limit: int, max_rows: int) -> None:
    for name, value, top in (("limit", limit, MAX_LIMIT), ("max_rows", max_rows, MAX_ROWS)):
        if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= top:
            raise BoundsError(f"{name} must be 1..{top}")


def parsed_rows(rows: DataFrame, field: str = "conversation", model: str | None = None) -> DataFrame:
    """rows (row_no, value: a JSON wrapper or row) with row_index, model, language, turns (JSON of each) and ``row_reason``: null, or why the row is out.

    The order of the reasons: no object, cut cells, flagged, no or too many turns, a bad model, a bad index, more than
    4 MB of other people's text. ``model`` is that of the whole set where rows have none.
    """
    w = F.from_json("value", ROW_DDL)
    row = F.coalesce(w["row"], F.col("value"))
    x = rows.select("row_no", "value", w["truncated_cells"].alias("cells"), F.get_json_object("value", "$.row_idx").alias("raw_index"), row.alias("row"))
    turns = F.from_json(F.get_json_object("row", f"$.{field}"), "array<string>")
    named = F.lit(model) if model else F.get_json_object("row", "$.model")
    x = x.select("*", turns.alias("turns"), named.alias("model"), F.get_json_object("row", "$.language").alias("language"))
    others = F.aggregate(
        F.filter(F.coalesce("turns", F.array().cast("array<string>")), lambda t: F.coalesce(F.get_json_object(t, "$.role"), F.lit("")) != "assistant"), F.lit(0).cast("bigint"),
        lambda n, t: n + F.coalesce(F.octet_length(F.encode(F.get_json_object(t, "$.content"), "UTF-8")), F.lit(0)),
    )
    is_object = lambda c: F.coalesce(F.trim(c).startswith("{") & F.get_json_object(c, "$").isNotNull(), F.lit(False))
    reason = (
        F.when(~is_object(F.col("value")) | ~is_object(F.col("row")), "no_object")
        .when(F.size(F.coalesce("cells", F.array().cast("array<string>"))) > 0, "cut_cells")
        .when(flagged(F.col("row")), "flagged_row")
        .when(F.col("turns").isNull() | (F.size("turns") > MAX_TURNS), "no_turns")
        .when(F.col("model").isNull() | (F.trim("model") == "") | (F.length("model") > MAX_MODEL) | F.col("model").rlike(UNSAFE), "bad_model")
        .when(F.col("raw_index").isNotNull() & ~F.coalesce(F.col("raw_index").rlike(r"^\d+$"), F.lit(False)), "bad_index")
        .when(others > MAX_OTHERS, "too_much_text")
    )
    return x.select("row_no", F.coalesce(F.col("raw_index").try_cast("bigint"), F.col("row_no")).alias("row_index"), "model", "language", "turns", reason.alias("row_reason"))


def parsed_turns(rows: DataFrame, language: str | None = None) -> DataFrame:
    """Assistant turns of ``parsed_rows``: row_no, row_index, turn_index, model, language, text, digest, reason.

    A turn in another language than the one asked for is left out, not rejected. The reasons in order: no text or too
    long, incomplete (tools, reasoning, cut off), flagged, marks of reasoning, unsafe text, overlap with what others said in the row; of the
    rest all but the first of a text are 'duplicate'. Null fields are as absent ones.
    """
    t = rows.where("row_reason is null").select("row_no", "row_index", "model", F.col("language").alias("row_language"), F.posexplode("turns").alias("turn_index", "t"))
    get = lambda k: F.get_json_object("t", f"$.{k}")
    t = t.select("row_no", "row_index", "turn_index", "model", F.coalesce(get("language"), F.col("row_language")).alias("language"), get("role").alias("role"), get("content").alias("text"), "t")
    hit = overlapping(t.select(F.struct("row_no", "turn_index").alias("key"), "row_no", F.coalesce("role", F.lit("")).alias("role"), "text"), ["row_no"], "key").select("key.*", F.lit(True).alias("copied"))
    a = t.where("role = 'assistant'")
    if language is not None:
        a = a.where(F.coalesce(language_equal(F.col("language"), F.lit(language)), F.lit(False)))
    a = a.join(hit, ["row_no", "turn_index"], "left")
    size = F.octet_length(F.encode("text", "UTF-8"))
    reason = (
        F.when(F.col("text").isNull() | (F.trim(F.regexp_replace("text", r"\s+", " ")) == "") | (size > MAX_TEXT_BYTES), "empty_or_size_or_content_schema")
        .when(incomplete(F.col("t")), "incomplete_or_tool_or_reasoning")
        .when(flagged(F.col("t")), "privacy_flag")
        .when(F.col("text").rlike(REASONING) | F.coalesce(F.get_json_object("t", "$.channel").isin(*CHANNELS), F.lit(False)), "reasoning_marker")
        .when(F.col("text").rlike(UNSAFE), "conservative_privacy_prose_screen")
        .when(F.col("copied"), "nonassistant_overlap")
    )
    a = a.withColumn("reason", reason).withColumn("digest", F.sha2("text", 256))
    order = F.struct("row_no", "turn_index")
    first = a.where("reason is null").groupBy("digest").agg(F.min(order).alias("first"))
    a = a.join(first, "digest", "left").withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(order != F.col("first"), "duplicate"))
    return a.select("row_no", "row_index", "turn_index", "model", "language", "text", "digest", "reason")


def all_rejections(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """reason, n over rows and turns; duplicates are skipped, not rejected."""
    return rows.where("row_reason is not null").select(F.col("row_reason").alias("reason")).unionByName(turns.where("reason is not null and reason <> 'duplicate'").select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


ARENA_DDL = "language string, model_a string, model_b string, conversation_a array<string>, conversation_b array<string>, openai_moderation string"


def arena_records(lines: DataFrame, limit: int | None = None, language: str | None = None, screen=None) -> DataFrame:
    """row_index, side, turn_index, model, language, text, digest: assistant turns of both sides that pass, in source order.

    ``lines``: row_index, value (JSON). Flagged and incomplete rows and turns are out, models without a proper name, texts that
    ``screen`` (a function of a column, ``arena_safe`` if none is given) turns down or that share eight words in a row with a user turn of the
    row; of equal texts of a model the first stays.
    """
    j = F.from_json("value", ARENA_DDL)
    x = lines.where(F.col("value").isNotNull()).select("row_index", "value", j.alias("j")).where("j is not null").where(~any_true(F.col("j.openai_moderation")) & ~incomplete(F.col("value")))
    if language is not None:
        x = x.where(F.lower("j.language") == language.lower())
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"j.model_{s}").alias("model"), F.col(f"j.conversation_{s}").alias("turns")) for s in "ab"))
    t = x.select("row_index", F.col("j.language").alias("language"), F.explode(sides).alias("s")).select("row_index", "language", "s.side", "s.model", F.posexplode("s.turns").alias("turn_index", "t"))
    t = t.select("row_index", "language", "side", "model", "turn_index", F.get_json_object("t", "$.role").alias("role"), F.get_json_object("t", "$.content").alias("text"), incomplete(F.col("t")).alias("cut"))
    hit = overlapping(t.where("role in ('user', 'assistant')").select(F.struct("row_index", "side", "turn_index").alias("key"), "row_index", "role", "text"), ["row_index"], "key").select("key.*")
    good = t.where("role = 'assistant' and not cut and text is not null and trim(text) <> '' and model is not null and model <> ''").where((F.length("model") <= MAX_MODEL) & ~F.col("model").rlike(UNSAFE) & (screen or arena_safe)(F.col("text")))
    good = good.join(hit, ["row_index", "side", "turn_index"], "left_anti").withColumn("digest", F.sha2("text", 256))
    got = good.groupBy("model", "digest").agg(F.min_by(F.struct("row_index", "side", "turn_index", "language", "text"), F.struct("row_index", "side", "turn_index")).alias("r"))
    got = got.select("r.row_index", "r.side", "r.turn_index", "model", "r.language", "r.text", "digest")
    return got if limit is None else got.orderBy("row_index", "side", "turn_index").limit(limit)


def first_per_group(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group. A first cut within hash buckets keeps the last rank of a hot group small."""
    salt = F.pmod(F.xxhash64(*order), F.lit(64))
    cut = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))).where(F.col("_r") <= n)
    return cut.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")

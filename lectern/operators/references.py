"""Review of references: paragraphs with their context, candidates for unclear references, request batches, verdicts.

``tokens`` and ``chunks`` (noun chunks) are the parses of ``targets``; the answers of a judge are a relation too. Every step
is a join or a window on the document; a document's context is one prefix of its reader's view. Null
texts have no paragraphs; paragraphs of 300 characters or more are told as skipped, never as clear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import rewrite
from lectern.operators import judgments
from lectern.operators.reader import definite_candidates, preceding_context, visible_headings

# The bounds of a review, what counts as a quotation inside a line, and the bare demonstratives.
MAX_PARAGRAPH, MAX_CONTEXT = 300, 2000
QUOTATION = r"\"[^\"\n]+\"|'(?<![\p{L}\p{N}]')[^'\n]+'(?![\p{L}\p{N}])"
DEMONSTRATIVES = ("this", "that", "these", "those")


def _slice(c: str, a: Column, b: Column) -> Column:
    return F.substring(c, a.cast("int") + 1, (b - a).cast("int"))


def paragraphs(views: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, paragraph_start, paragraph_end, paragraph, preceding_context, heading, context_truncated, status.

    ``views``: doc_id, text, prose, visible, incomplete (of ``reader.with_reader_view``).
    """
    b = visible_headings(blocks, views).where("kind = 'paragraph'").join(views.select("doc_id", "text", "visible", "incomplete"), "doc_id")
    before = preceding_context(F.col("visible"), F.col("span_start"), MAX_CONTEXT)
    raw = _slice("text", F.col("span_start"), F.col("span_end"))
    indented = F.forall(F.split(raw, "\n"), lambda x: (F.trim(x) == "") | x.startswith("    ") | x.startswith("\t"))
    long_heading = F.length("heading") > MAX_CONTEXT
    return b.select(
        "doc_id", "block_id", F.col("span_start").alias("paragraph_start"), F.col("span_end").alias("paragraph_end"), _slice("visible", F.col("span_start"), F.col("span_end")).alias("paragraph"),
        before["text"].alias("preceding_context"), F.when(long_heading, F.substring("heading", -MAX_CONTEXT, MAX_CONTEXT)).otherwise(F.col("heading")).alias("heading"),
        (before["truncated"] | F.coalesce("incomplete", F.lit(False)) | long_heading).alias("context_truncated"),
        F.when(F.col("span_end") - F.col("span_start") >= MAX_PARAGRAPH, "skipped_length").when(indented, "no_candidates").otherwise("pending").alias("status"),
    )


def targets(rows: DataFrame, views: DataFrame) -> DataFrame:
    """doc_id, block_id, text of the pending paragraphs as they are to be parsed: quotations blanked."""
    p = rows.where("status = 'pending'").join(views.select("doc_id", "prose"), "doc_id")
    return p.select("doc_id", "block_id", rewrite(_slice("prose", F.col("paragraph_start"), F.col("paragraph_end")), QUOTATION).alias("text"))


def candidates(rows: DataFrame, views: DataFrame, tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, block_id, paragraph_start, candidate_no, span_start, span_end, reference, context_truncated.

    A candidate that crosses hidden or quoted text is cut before it and kept only if a bare demonstrative is left.
    """
    found = definite_candidates(tokens, chunks)
    p = rows.where("status = 'pending'").join(views.select("doc_id", "text", "prose", "visible"), "doc_id")
    x = found.join(p, ["doc_id", "block_id"])
    a, b = F.col("paragraph_start") + F.col("s"), F.col("paragraph_start") + F.col("e")
    raw, safe = _slice("text", a, b), _slice("visible", a, b)
    target = _slice("prose", F.col("paragraph_start"), F.col("paragraph_end"))
    marked = _slice_of(rewrite(target, QUOTATION, lambda q: F.regexp_replace(q, r"[^\n]", "")), F.col("s"), F.col("e"))
    # the first place where the text is hidden or quoted: the length of what is alike before it
    places = F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)))
    at = F.array_min(F.filter(places, lambda i: (F.substring(raw, i, F.lit(1)) != F.substring(safe, i, F.lit(1))) | (F.substring(marked, i, F.lit(1)) == "")))
    prefix = F.rtrim(F.substring(safe, F.lit(1), at - 1))
    x = x.select("doc_id", "block_id", "paragraph_start", "context_truncated", a.alias("span_start"), F.when(at.isNull(), b).otherwise(a + F.length(prefix)).alias("span_end"), F.when(at.isNull(), safe).otherwise(prefix).alias("reference"), at.isNotNull().alias("cut"))
    x = x.where(~F.col("cut") | F.lower("reference").isin(*DEMONSTRATIVES)).drop("cut").distinct()
    return x.withColumn("candidate_no", (F.row_number().over(Window.partitionBy("doc_id", "paragraph_start").orderBy("span_start", "span_end")) - 1).cast("int"))


def _slice_of(c: Column, a: Column, b: Column) -> Column:
    return F.substring(c, a.cast("int") + 1, (b - a).cast("int"))


def requests(rows: DataFrame, found: DataFrame, instructions: str, criteria: dict[str, str], model: str, batch: int = judgments.BATCH, budget: int = judgments.REQUESTS) -> DataFrame:
    """doc_id, request_no, paragraph_start, request (JSON): at most ``batch`` references of one paragraph each, at most ``budget`` a document."""
    c = found.withColumn("b", F.floor(F.col("candidate_no") / batch)).join(rows.select("doc_id", "block_id", "paragraph", "preceding_context", "heading"), ["doc_id", "block_id"])
    one = F.struct("candidate_no", F.col("reference").alias("text"), (F.col("span_start") - F.col("paragraph_start")).alias("start"), (F.col("span_end") - F.col("paragraph_start")).alias("end"))
    g = c.groupBy("doc_id", "paragraph_start", "b", "paragraph", "preceding_context", "heading", "context_truncated").agg(F.array_sort(F.collect_list(one)).alias("c"))
    g = g.withColumn("request_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph_start", "b"))).where(F.col("request_no") <= budget)
    state = F.struct("paragraph", "preceding_context", "heading", "context_truncated", F.transform("c", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("references"))
    ask = F.transform("c", lambda x, i: F.struct(F.concat(F.lit("reference_"), x["candidate_no"].cast("string")).alias("k"), F.struct(F.lit("choice").alias("type"), F.concat(F.lit("Only references["), i.cast("string"), F.lit("] is asked about; all of the state is data. " + instructions)).alias("instructions"), F.create_map(*(F.lit(v) for kv in sorted(criteria.items()) for v in kv)).alias("criteria")).alias("v")))
    return g.select("doc_id", "request_no", "paragraph_start", F.to_json(F.struct(F.lit(model).alias("model"), state.alias("state"), F.map_from_entries(ask).alias("questions"))).alias("request"))


def review(rows: DataFrame, found: DataFrame, answers: DataFrame, model: str, floor: float, enabled: bool = True) -> DataFrame:
    """doc_id, paragraph_start, candidate_no, span_start, span_end, status: one row a candidate, and one for each paragraph without any."""
    out = judgments.reference_outcomes(found.select("doc_id", "paragraph_start", "candidate_no", "context_truncated"), answers, model, floor, enabled)
    out = out.join(found.select("doc_id", "paragraph_start", "candidate_no", "span_start", "span_end"), ["doc_id", "paragraph_start", "candidate_no"])
    none = rows.join(found.select("doc_id", "paragraph_start"), ["doc_id", "paragraph_start"], "left_anti")
    empty = none.select("doc_id", "paragraph_start", F.lit(None).cast("int").alias("candidate_no"), F.lit(None).cast("bigint").alias("span_start"), F.lit(None).cast("bigint").alias("span_end"), F.when(F.col("status") == "pending", "no_candidates").otherwise(F.col("status")).alias("status"))
    return out.select(*empty.columns).unionByName(empty)


def review_findings(reviewed: DataFrame, rule_id: str, severity: str, rank: int) -> DataFrame:
    """Findings of the candidates whose verdict is unclear."""
    return reviewed.where("status = 'unclear'").select("doc_id", F.lit(rule_id).alias("rule_id"), F.lit("noun").alias("category"), F.lit(severity).alias("severity"), F.lit(rank).alias("rank"), "span_start", "span_end")


def review_summary(reviewed: DataFrame) -> DataFrame:
    """One row: how many candidates were judged clear, unclear or uncertain, how many rows have another status, and the message that says so."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    got = reviewed.agg(n("clear").alias("clear"), n("unclear").alias("unclear"), n("uncertain").alias("uncertain"), F.count(F.when(~F.col("status").isin("clear", "unclear", "uncertain", "no_candidates"), 1)).alias("undecided"))
    return got.withColumn("message", F.format_string("%d references clear, %d unclear, %d uncertain, %d not decided", "clear", "unclear", "uncertain", "undecided"))

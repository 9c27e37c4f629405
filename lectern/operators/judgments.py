"""External judgments joined to findings: batches, vetoes, required answers, choices, budgets.

No service is called here. Findings become request batches; answers come back as a relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH, CONTEXT, REQUESTS = 6, 2000, 40


def batches(findings: DataFrame, blocks: DataFrame, sents: DataFrame, size: int = BATCH, context: int = CONTEXT) -> DataFrame:
    """doc_id, finding_no, batch_no, context_start, context_end of the findings that can be asked about.

    A finding is asked about if it lies in one block whose sentences around it span at most ``context``
    characters. A batch holds consecutive findings of one block, at most ``size``.
    """
    b = blocks.select(F.col("doc_id").alias("b_doc"), "block_id", F.col("span_start").alias("b_start"), F.col("span_end").alias("b_end"))
    f = findings.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("span_start") >= F.col("b_start")) & (F.col("span_end") <= F.col("b_end"))).drop("b_doc")
    s = sents.select(F.col("doc_id").alias("s_doc"), F.col("span_start").alias("s_start"), F.col("span_end").alias("s_end"))
    touch = f.join(s, (F.col("doc_id") == F.col("s_doc")) & (F.col("s_start") < F.greatest("span_end", F.col("span_start") + 1)) & (F.col("s_end") > F.col("span_start")))
    ask = touch.groupBy("doc_id", "finding_no", "block_id").agg(F.min("s_start").alias("context_start"), F.max("s_end").alias("context_end")).where(F.col("context_end") - F.col("context_start") <= context)
    n = F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy("finding_no"))
    return ask.withColumn("slot", n).select("doc_id", "finding_no", "block_id", F.floor((F.col("slot") - 1) / size).cast("bigint").alias("batch_no"), "context_start", "context_end")


def settle(findings: DataFrame, rules: DataFrame, judgments: DataFrame) -> DataFrame:
    """Findings left after judgments (doc_id, finding_no, probability, failed).

    A valid probability at or above the rule's threshold removes the finding; a rule that requires an answer
    keeps nothing without one; a failure in a document voids all its answers. Rules without a veto pass.
    """
    broken = judgments.groupBy("doc_id").agg(F.bool_or(F.coalesce("failed", F.lit(False))).alias("broken"))
    j = judgments.join(broken, "doc_id").where(~F.col("broken") & F.col("probability").between(0, 1)).groupBy("doc_id", "finding_no").agg(F.max("probability").alias("p"))
    r = rules.select("rule_id", "veto_threshold", "veto_required")
    out = findings.join(r, "rule_id", "left").join(j, ["doc_id", "finding_no"], "left")
    gone = F.col("veto_threshold").isNotNull() & F.when(F.col("p").isNull(), F.coalesce("veto_required", F.lit(False))).otherwise(F.col("p") >= F.col("veto_threshold"))
    return out.where(~gone).drop("veto_threshold", "veto_required", "p")


def choice_status(answers: DataFrame, floor: float) -> DataFrame:
    """answers (…, type, label, confidence, probabilities map) with ``status``: missing, invalid, low confidence or the label."""
    p = F.map_values("probabilities")
    valid = (
        (F.col("type") == "choice") & F.col("label").isin("clear", "unclear", "uncertain") & F.col("confidence").between(0, 1)
        & (F.array_sort(F.map_keys("probabilities")) == F.array(F.lit("clear"), F.lit("uncertain"), F.lit("unclear"))) & F.forall(p, lambda x: x.between(0, 1))
        & (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) <= 0.01) & (F.try_element_at("probabilities", F.col("label")) == F.array_max(p))
    )
    return answers.withColumn(
        "status", F.when(F.col("label").isNull() & F.col("type").isNull(), "missing_answer").when(~F.coalesce(valid, F.lit(False)), "invalid_answer").when(F.col("confidence") < floor, "low_confidence").otherwise(F.col("label"))
    )


def reference_outcomes(candidates: DataFrame, answers: DataFrame, model: str, floor: float, enabled: bool = True, batch: int = BATCH, budget: int = REQUESTS) -> DataFrame:
    """One verdict for each candidate (doc_id, paragraph_start, candidate_no, context_truncated).

    Order: no credential, an earlier failure, the request budget, a missing response, a wrong model (which
    fails all later requests), then the answer itself; "unclear" over cut context is incomplete.
    """
    c = candidates.withColumn("b", F.floor((F.row_number().over(Window.partitionBy("doc_id", "paragraph_start").orderBy("candidate_no")) - 1) / batch))
    c = c.withColumn("request_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("paragraph_start", "b")))
    a = choice_status(c.join(answers, ["doc_id", "paragraph_start", "candidate_no"], "left"), floor)
    bad = F.coalesce((F.col("model") != model) | F.col("failed"), F.lit(False))
    reqs = a.groupBy("doc_id", "request_no").agg(F.bool_or(bad).alias("bad"), F.bool_or(F.coalesce("failed", F.lit(False))).alias("raised"), F.max("model").alias("got"))
    w = Window.partitionBy("doc_id").orderBy("request_no").rowsBetween(Window.unboundedPreceding, -1)
    reqs = reqs.withColumn("earlier", F.coalesce(F.max(F.col("bad").cast("int")).over(w), F.lit(0)) == 1)
    out = a.join(reqs, ["doc_id", "request_no"])
    verdict = (
        F.when(F.lit(not enabled), "missing_key").when(F.col("earlier") | F.col("raised"), "request_failed").when(F.col("request_no") > budget, "request_budget")
        .when(F.col("got").isNull(), "missing_response").when(F.col("bad"), "model_mismatch").when((F.col("status") == "unclear") & F.col("context_truncated"), "context_incomplete").otherwise(F.col("status"))
    )
    return out.select("doc_id", "paragraph_start", "candidate_no", verdict.alias("status"))

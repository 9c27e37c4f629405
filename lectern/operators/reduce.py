"""Findings reduced: interval union, shadowing, containment, order, messages, summary.

``marks`` is array<struct<s, e>>; an empty array means the whole span. All steps are joins and windows on
the document; none depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKS = "array<struct<s:bigint,e:bigint>>"


def with_marks(f: DataFrame) -> DataFrame:
    return f if "marks" in f.columns else f.withColumn("marks", F.array().cast(MARKS))


def merge_overlaps(f: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings of one rule that overlap or touch become one; their marks are united."""
    f = with_marks(f)
    by = Window.partitionBy(key, "rule_id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = f.withColumn("new", F.when(F.col("span_start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    keep = [c for c in ("category", "severity", "rank") if c in f.columns]
    return runs.groupBy(key, "rule_id", "run", *keep).agg(
        F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("marks")
    ).drop("run")


def marks_cover(outer: Column, outer_s: Column, outer_e: Column, inner: Column, inner_s: Column, inner_e: Column) -> Column:
    """Every mark of the inner finding lies in a mark of the outer one."""
    whole = lambda m, s, e: F.when(F.size(m) > 0, m).otherwise(F.array(F.struct(s.alias("s"), e.alias("e"))))
    return F.forall(whole(inner, inner_s, inner_e), lambda i: F.exists(whole(outer, outer_s, outer_e), lambda o: (o["s"] <= i["s"]) & (i["e"] <= o["e"])))


def dedupe(f: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without findings strictly inside an equally strong or stronger one that covers their marks; document rules take no part.

    The relation is transitive, so one test against all findings is exact. A finding without marks covers all that it
    holds: whether one reaches as far is a running maximum for each rank, from further left or from the
    same start. Only findings with marks meet the others in an anti-join.
    """
    f = with_marks(f)
    whole = (F.col("category") != "doc") & (F.size("marks") == 0)
    left = Window.partitionBy(key).orderBy("span_start").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(key, "span_start")
    within = F.lit(False)
    for r in range(3):
        end = F.when(whole & (F.col("rank") == r), F.col("span_end"))
        reach = F.coalesce(F.max(end).over(left) >= F.col("span_end"), F.lit(False)) | F.coalesce(F.max(end).over(same) > F.col("span_end"), F.lit(False))
        within = within | (reach & (F.col("rank") >= r))
    rows = f.withColumn("_in", within & (F.col("category") != "doc"))
    i, o = rows.where("not _in").drop("_in").alias("i"), f.where("category <> 'doc' and size(marks) > 0").alias("o")
    inside = (
        (F.col(f"i.{key}") == F.col(f"o.{key}")) & (F.col("i.category") != "doc") & (F.col("o.span_start") <= F.col("i.span_start")) & (F.col("i.span_end") <= F.col("o.span_end"))
        & ((F.col("o.span_end") - F.col("o.span_start")) > (F.col("i.span_end") - F.col("i.span_start"))) & (F.col("o.rank") <= F.col("i.rank"))
        & marks_cover(F.col("o.marks"), F.col("o.span_start"), F.col("o.span_end"), F.col("i.marks"), F.col("i.span_start"), F.col("i.span_end"))
    )
    return i.join(o, inside, "left_anti")


def shadow_weaker(f: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without findings that overlap a kept, strictly stronger finding of another rule of their category: two staged anti-joins."""
    f = with_marks(f)

    def free(weak: DataFrame, strong: DataFrame) -> DataFrame:
        a, b = weak.alias("a"), strong.alias("b")
        on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.category") == F.col("b.category")) & (F.col("a.rule_id") != F.col("b.rule_id")) & (F.col("a.span_start") < F.col("b.span_end")) & (F.col("b.span_start") < F.col("a.span_end"))
        return a.join(b, on, "left_anti")

    bites, barks, sniffs = (f.where(F.col("rank") == r) for r in range(3))
    barks = free(barks, bites)
    kept = bites.unionByName(barks)
    return kept.unionByName(free(sniffs, kept))


def report_order(f: DataFrame, key: str = "doc_id") -> DataFrame:
    """finding_no in reading order: start, strength, rule, end."""
    return f.withColumn("finding_no", F.row_number().over(Window.partitionBy(key).orderBy("span_start", "rank", "rule_id", "span_end")).cast("bigint"))


def first_or_repeat(f: DataFrame, messages: DataFrame, key: str = "doc_id") -> DataFrame:
    """The full message where a rule fires first in the run (by document, then place), its short one afterwards.

    Only each rule's first place is aggregated; no rule's findings are gathered in one task.
    """
    first = f.groupBy("rule_id").agg(F.min(F.struct(F.col(key).alias("d"), "span_start", "span_end")).alias("first"))
    rows = f.join(first, "rule_id").join(messages.select("rule_id", "message", "repeat_message"), "rule_id")
    here = (F.col(key) == F.col("first.d")) & (F.col("span_start") == F.col("first.span_start")) & (F.col("span_end") == F.col("first.span_end"))
    return rows.withColumn("shown", F.when(here, F.col("message")).otherwise(F.coalesce("repeat_message", "message"))).drop("first", "message", "repeat_message")


def severity_summary(f: DataFrame, words: DataFrame, key: str = "doc_id", by: str | None = None) -> DataFrame:
    """Counts by severity and findings per 100 words, over documents or by a column of ``words`` (key, n_words, ...)."""
    per = f.groupBy(key).agg(*(F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("bite", "bark", "sniff")))
    rows = words.join(per, key, "left").na.fill(0, ["bite", "bark", "sniff"])
    out = rows.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"), *(F.sum(s).alias(s) for s in ("bite", "bark", "sniff"))
    )
    return out.withColumn("per_100_words", F.round((F.col("bite") + F.col("bark") + F.col("sniff")) * 100.0 / F.when(F.col("words") > 0, F.col("words")), 6))


def exit_status(f: DataFrame, strict: bool = False) -> DataFrame:
    """One row: 1 if a bite (or, strict, a bark) is left, else 0."""
    bad = F.col("severity").isin(*(("bite", "bark") if strict else ("bite",)))
    return f.agg(F.coalesce(F.max(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("exit_status"))


def findings_by_rule(found: DataFrame, earlier: DataFrame, key: str = "doc_id") -> DataFrame:
    """rule_id, findings, documents, new_findings: those that an earlier run has not at the same place."""
    at = [key, "rule_id", "span_start", "span_end"]
    old = earlier.select(*at, F.lit(True).alias("_old")).distinct()
    return found.select(*at).join(old, at, "left").groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct(key).alias("documents"), F.count(F.when(F.col("_old").isNull(), 1)).alias("new_findings"))


def soft_density(found: DataFrame, words: DataFrame, rules: DataFrame, ceiling: float = 1.0, key: str = "doc_id") -> DataFrame:
    """key, density, rules: documents whose weaker findings per 100 words exceed the ceiling.

    Findings of rules that require an answer are candidates, not warnings, and do not count. A text without words has one.
    """
    asked = rules.where("veto_required").select("rule_id")
    soft = found.where("severity <> 'bite'").join(asked, "rule_id", "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("rule_id")), ", ").alias("rules"))
    density = F.col("n") * 100.0 / F.greatest("n_words", F.lit(1))
    return soft.join(words.select(key, "n_words"), key).select(key, density.alias("density"), "rules").where(F.col("density") > ceiling)


def absent(expected: DataFrame, present: DataFrame, name: str = "path") -> DataFrame:
    """Names that are expected but not there."""
    return expected.select(name).exceptAll(expected.select(name).intersectAll(present.select(name))).distinct()

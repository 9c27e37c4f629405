"""The lint plan: documents in, findings out, as one Spark plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.runtime import spread, written
from lectern.functions.text import WORD
from lectern.operators import graph, judgments, metrics, parsed_metrics, reader, reduce, references, regex_rules, scanner
from lectern.operators import views as V
from lectern.sources.catalogue import CatalogueError, Rule, load, rules_df, select


@dataclass(frozen=True)
class Options:
    only: frozenset[str] = frozenset()
    disable: frozenset[str] = frozenset()
    disable_category: frozenset[str] = frozenset()
    no_emoji: bool = False
    skip_quotes: bool = False
    strict: bool = False
    lang: str = "en"


def lint(docs: DataFrame, options: Options = Options(), rules: list[Rule] | None = None, tokens: DataFrame | dict[str, DataFrame] | None = None, lexicon: DataFrame | None = None, answers: DataFrame | None = None, parsed: dict[str, DataFrame] | None = None, reference_model: str = "") -> DataFrame:
    """doc_id, finding_no, rule_id, category, severity, rank, span_start, span_end, marks.

    ``docs``: doc_id, text (and more). Layers without an active rule are not planned. Dependency rules run if
    ``tokens`` are given, one relation or one for each language, of which ``options.lang`` names one; the rules of parsed candidates if ``parsed`` has the candidates' tokens: "prefixes" (of
    ``regex_rules.sentence_matches``, the sentence's start as block_id), "pieces" and "beats" (of ``parsed_metrics``), "isolated" (of ``graph.isolated_spans``).
    References are reviewed if ``parsed`` has "targets" (tokens of ``references.targets``), "chunks" and "reference_answers" of the model named. Judgments run if ``answers`` are; without answers, rules that require one report nothing.
    """
    if isinstance(tokens, dict):
        if options.lang not in tokens:
            raise CatalogueError(f"no parses for language {options.lang!r}")
        tokens = tokens[options.lang]
    active = select(rules or load(), set(options.only), set(options.disable), set(options.disable_category), options.no_emoji)
    # read by every layer: kept in memory or on the executors' disks, and recomputed if an executor is lost
    views = V.with_views(spread(docs.select("doc_id", "text")), quotes=not options.skip_quotes).persist()
    blocks = V.blocks(V.lines(views))
    blocks = blocks.withColumn("cut", V.sentence_spans(blocks)).persist()
    prose = metrics.Prose.of(views, blocks=blocks)
    cols = ("doc_id", "rule_id", "category", "severity", "rank", "span_start", "span_end", "marks")
    parts = []
    parsed = parsed or {}
    regex = [r for r in active if r.category in ("phrase", "template", "punct") and r.pattern]
    if regex:
        sents5 = V.sentences(blocks, (*V.TEXT_KINDS, "heading"))
        found = regex_rules.raw_matches(views, regex)
        if "prefixes" in parsed:
            nominal = graph.nominal(parsed["prefixes"], ["doc_id", "block_id"]).withColumnRenamed("block_id", "span_start")
            found = found.unionByName(regex_rules.sentence_matches(sents5, regex).drop("prefix").join(nominal, ["doc_id", "span_start"], "left_semi"))
        parts.append(reduce.with_marks(regex_rules.gated(found, views, blocks, sents5, regex)).select(*cols))
    for r in active:
        if r.construction:
            c = scanner.contrasts(V.sentences(blocks)).select("doc_id", *(F.lit(x).alias(n) for n, x in (("rule_id", r.id), ("category", r.category), ("severity", r.severity), ("rank", r.rank))), "span_start", "span_end")
            parts.append(reduce.with_marks(c).select(*cols))
    grammar = [r for r in active if r.dependency]
    if grammar and tokens is not None:
        parts.append(graph.graph_findings(tokens, views, blocks, V.sentences(blocks), grammar, lexicon, parsed.get("isolated")).select(*cols))
    for r in active:
        if r.confidence_floor is not None and "reference_answers" in parsed:
            seen = reader.with_reader_view(views)
            rows = references.paragraphs(seen, blocks)
            found = references.candidates(rows, seen, parsed["targets"], parsed["chunks"])
            c = references.review_findings(references.review(rows, found, parsed["reference_answers"], reference_model, r.confidence_floor), r.id, r.severity, r.rank)
            parts.append(reduce.with_marks(c).select(*cols))
    values = {f.__name__: f(prose, parsed[k]) for k, f in (("pieces", parsed_metrics.parallel_clause_repeats), ("beats", parsed_metrics.staccato_beats)) if k in parsed}
    doc_rules = [r for r in active if r.metric in metrics.METRICS or r.metric in values]
    if doc_rules:
        parts.append(reduce.with_marks(metrics.fired(prose, doc_rules, values)).select(*cols))
    if not parts:
        views.unpersist()
        return docs.sparkSession.createDataFrame([], f"doc_id bigint, finding_no bigint, rule_id string, category string, severity string, rank int, span_start bigint, span_end bigint, marks {reduce.MARKS}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # written once: the anti-join reads the findings twice, and the branches' many small partitions are coalesced
    out = written(out, "lint")
    for kept in (views, blocks, prose.paragraphs, prose.sentences):
        kept.unpersist()
    out = reduce.report_order(reduce.dedupe(out))
    spark = docs.sparkSession
    if answers is None:
        answers = spark.createDataFrame([], "doc_id bigint, finding_no bigint, probability double, failed boolean")
    return judgments.settle(out, rules_df(spark, active), answers).select("doc_id", "finding_no", *cols[1:])


def words_of(docs: DataFrame, by: str | None = None) -> DataFrame:
    """doc_id, n_words (of the prose view) and the grouping column."""
    v = V.with_views(spread(docs.select("doc_id", "text", *([by] if by else []))))
    return v.select("doc_id", *([by] if by else []), F.regexp_count("prose", F.lit(WORD)).cast("bigint").alias("n_words"))

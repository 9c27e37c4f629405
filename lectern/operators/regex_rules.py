"""Phrase, template and punctuation rules: literal patterns over text views, then gates.

Every pattern is a literal expression of one narrow projection, compiled once per task; a row's findings
come out of one explode. Blocks and sentences meet the matches in one sort by place within a document.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.guards import covered, needed, only, rarest, trie, within_line
from lectern.functions.runtime import written
from lectern.functions.text import java, quoted, rewrite, spans_sql
from lectern.operators import views as V
from lectern.sources.catalogue import CatalogueError, Rule, rules_df

FINDING = "doc_id, rule_id, category, severity, rank, span_start, span_end"


def pattern_of(rule: Rule) -> str:
    """The rule's pattern for the JVM. A sentence follows blanks or starts the text, so rules of sentence starts try no other place."""
    return java(f"(?<!\\S)(?:{rule.pattern})" if rule.sentence_start else rule.pattern)


def context_pattern(pattern: str) -> str:
    """An exception searched in a sentence: any case, and ^ and $ are the sentence's ends."""
    return java(pattern, "idU")


def compiled(spark: SparkSession, rules: list[Rule]) -> None:
    """Compile every pattern and exception of the rules where they will run; one that cannot be is an error before any job starts."""
    for r in rules:
        for p in ((pattern_of(r) if r.pattern else None), *(context_pattern(x) if x else None for x in (r.unless, r.match_unless))):
            if p is None or p in _COMPILED:
                continue
            try:
                spark._jvm.java.util.regex.Pattern.compile(p)
            except (Py4JJavaError, PySparkException) as e:
                raise CatalogueError(f"{r.id}: {e}") from None
            _COMPILED.add(p)


_COMPILED: set[str] = set()


def excepted(rules: list[Rule], context: Column, which: str = "unless") -> Column:
    """Whether the rule of a row has an exception that the context holds; each pattern is a literal, compiled once a task."""
    out = F.lit(False)
    for r in rules:
        if p := getattr(r, which):
            out = F.when(F.col("rule_id") == r.id, context.rlike(context_pattern(p))).otherwise(out)
    return out


def raw_matches(views: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """key, rule_id, span_start, span_end, found (the text) of every non-empty match. Punctuation reads ``masked``, the rest ``prose``.

    The literals of all rules are found in one pass over a lower-cased copy of each line. A pattern that no line feed can meet
    runs on the lines that have one of the literals it needs, any other on the texts that have one.
    """
    active = [r for r in rules if r.pattern is not None and not r.nominal_prefix]
    if not active:
        return views.sparkSession.createDataFrame([], f"{key} bigint, rule_id string, span_start bigint, span_end bigint, found string")
    compiled(views.sparkSession, active)
    need = {r.id: needed(r.pattern) for r in active}
    words = {r.id: rarest(w) if r.category != "punct" and (w := only("lit", need[r.id])) else None for r in active}
    every = sorted(frozenset().union(*(w for w in words.values() if w)))
    parts = []
    for r in active:
        view = "masked" if r.category == "punct" else "prose"
        row = lambda found, base, r=r: f"transform({found}, y -> named_struct('rule_id', {quoted(r.id)}, 'span_start', cast({base}y.s as bigint), 'span_end', cast({base}y.e as bigint)))"
        if not (w := words[r.id]):
            signs = only("sign", need[r.id])
            parts.append(row(spans_sql(view, pattern_of(r), " OR ".join(f"contains({view}, {quoted(x)})" for x in sorted(rarest(signs))) if signs else None), ""))
            continue
        some = "exists({}, h -> h in (" + ", ".join(map(quoted, covered(list(w), every))).replace("{", "{{").replace("}", "}}") + "))"
        if within_line(r.pattern):
            start = "CASE WHEN l.i = 0 THEN 0 ELSE length(substring_index(prose, '\\n', l.i)) + 1 END + "
            parts.append(f"CASE WHEN {some.format('_hits')} THEN flatten(transform(filter(_lines, l -> {some.format('l.h')}), l -> {row(spans_sql('l.p', pattern_of(r)), start)})) ELSE {_NO_MATCHES} END")
        else:
            parts.append(row(spans_sql(view, pattern_of(r), some.format("_hits")), ""))
    if every:
        hits = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.upper(t)), F.lit(f"(?=({trie(every)}))"), F.lit(1)))
        lines = F.filter(F.transform(F.split("prose", "\n", -1), lambda p, i: F.struct(i.alias("i"), p.alias("p"), hits(p).alias("h"))), lambda x: F.size(x["h"]) > 0)
    else:
        lines = F.array().cast("array<struct<i:int,p:string,h:array<string>>>")
    rows = views.select(key, "masked", "prose", lines.alias("_lines"))
    rows = rows.select("*", F.array_distinct(F.flatten(F.transform("_lines", lambda x: x["h"]))).alias("_hits"))
    rows = rows.select(key, "masked", "prose", F.explode(F.expr(f"flatten(array({', '.join(parts)}))")).alias("m"))
    view = F.when(F.col("m.rule_id").isin(*(r.id for r in active if r.category == "punct")), F.col("masked")).otherwise(F.col("prose"))
    return rows.select(key, "m.*", F.substring(view, F.col("m.span_start").cast("int") + 1, (F.col("m.span_end") - F.col("m.span_start")).cast("int")).alias("found"))


_NO_MATCHES = "cast(array() as array<struct<rule_id:string,span_start:bigint,span_end:bigint>>)"


def sentence_matches(sents: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """Rules that must match a whole sentence (named group "prefix" kept)."""
    out = None
    for r in rules:
        if not r.nominal_prefix:
            continue
        p = java("(?:" + r.pattern + ")", "idmU")
        part = sents.where(F.col("sentence").rlike("^" + p + "\\z")).select(key, F.lit(r.id).alias("rule_id"), "span_start", "span_end", F.regexp_extract("sentence", "^" + p + "\\z", 1).alias("prefix"), F.col("sentence").alias("found"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else sents.sparkSession.createDataFrame([], f"{key} bigint, rule_id string, span_start bigint, span_end bigint, prefix string, found string")


# Constructs that a reader sees before an opening.
_RENDERED = r"(?m)^[ \t]*(?:```|~~~)|`[^`\n]+`|^[ \t]*\||\[[^\]\n]+\]\(|(?:https?|ftp)://|www\."


def opening(text: Column, prose: Column, at: Column) -> Column:
    """Nothing visible stands before the offset: no prose, code, table, link or address outside comments and front matter."""
    shown = rewrite(rewrite(text, V.unix(V.FRONT)), V.unix(V.COMMENT))
    before = F.substring(shown, F.lit(1), at.cast("int"))
    return (F.trim(F.regexp_replace(F.substring(prose, F.lit(1), at.cast("int")), r"\s+", " ")) == "") & ~before.rlike(V.unix(_RENDERED))


def located(points: DataFrame, key: str = "doc_id", at: str = "span_start", **intervals: DataFrame) -> DataFrame:
    """``points`` with a struct column for each named relation: its interval that holds the point, or null.

    The intervals (key, span_start, span_end and more) of one relation are disjoint within a document, so the one that
    holds a point is the last that starts before it: one sort by place, no join of points and intervals.
    """
    fields = {n: [c for c in i.columns if c != key] for n, i in intervals.items()}
    empty = {n: F.lit(None).cast(i.select(F.struct(*fields[n]).alias("x")).schema["x"].dataType) for n, i in intervals.items()}
    rows = points.select(F.col(key).alias("_k"), F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_o"), F.struct(*points.columns).alias("_p"), *(empty[n].alias(n) for n in intervals))
    point = F.lit(None).cast(rows.schema["_p"].dataType)
    for n, i in intervals.items():
        got = {m: F.struct(*fields[n]) if m == n else empty[m] for m in intervals}
        rows = rows.unionByName(i.select(F.col(key).alias("_k"), F.col("span_start").cast("bigint").alias("_at"), F.lit(0).alias("_o"), point.alias("_p"), *(got[m].alias(m) for m in intervals)))
    before = Window.partitionBy("_k").orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("_at", "_p", *(F.last(n, True).over(before).alias(n) for n in intervals)).where("_p is not null")
    return rows.select("_p.*", *(F.when(F.col(n)["span_end"] > F.col("_at"), F.col(n)).alias(n) for n in intervals))


def opening_only(m: DataFrame, block_rows: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """Rows of ``m`` (text, prose, span_start, b: the block) without those of opening rules that do not open their document."""
    names = [r.id for r in rules if r.opening_reference]
    if not names:
        return m
    quote = block_rows.where("kind = 'quote'").groupBy(key).agg(F.min("span_start").alias("first_quote"))
    m = m.join(quote, key, "left")
    opens = opening(F.coalesce("text", F.lit("")), F.col("prose"), F.col("span_start")) & (F.coalesce(F.col("b.kind"), F.lit("")) == "paragraph") & (F.coalesce(F.col("first_quote"), F.lit(1 << 40)) > F.col("span_start"))
    return m.where(~F.col("rule_id").isin(*names) | opens)


def gated(matches: DataFrame, views: DataFrame, block_rows: DataFrame, sents: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """Matches that pass the gates. ``sents`` has the sentences of all five kinds, headings too."""
    table = rules_df(matches.sparkSession, rules).select("rule_id", "category", "severity", "rank", "headings", "heading_only", "sentence_start")
    compiled(matches.sparkSession, rules)
    m = located(matches, key, b=block_rows.select(key, "kind", "span_start", "span_end"), s=sents.select(key, "span_start", "span_end", "sentence"))
    m = m.join(F.broadcast(table), "rule_id")  # at most the catalogue's rows
    m = m.where((F.col("category") != "template") | (F.col("b.span_end").isNotNull() & (F.col("span_end") <= F.col("b.span_end"))))
    m = m.where(~F.col("sentence_start") | (F.coalesce(F.col("s.span_start"), F.lit(-1)) == F.col("span_start")))
    heading = F.coalesce(F.col("b.kind") == "heading", F.lit(False))
    m = m.where(F.col("headings") | ~heading).where(~F.col("heading_only") | heading)
    # the context of an exception is the sentence, or the match where none holds it; only openings and exceptions in the other view need a text again
    whole = [r for r in rules if r.opening_reference or (r.unless and r.category == "punct")]
    names = [r.id for r in whole]
    if whole:
        m = written(m.select(key, *_OUT, "found", "b", "s"), "matches")  # read twice
    context = F.when(F.col("s").isNotNull(), F.col("s.sentence")).otherwise(F.col("found"))
    out = (m.where(~F.col("rule_id").isin(*names)) if names else m).where(~excepted([r for r in rules if r not in whole], context)).select(*_OUT, key)
    if whole:
        x = m.where(F.col("rule_id").isin(*names)).join(views.select(key, "text", "masked", "prose"), key)
        a, e = F.coalesce("s.span_start", "span_start"), F.coalesce("s.span_end", "span_end")
        view = F.when(F.col("category") == "punct", F.col("masked")).otherwise(F.col("prose"))
        x = opening_only(x.where(~excepted(whole, F.substring(view, a.cast("int") + 1, (e - a).cast("int")))), block_rows, whole, key)
        out = out.unionByName(x.select(*_OUT, key))
    return out.select(key, *_OUT).distinct()


_OUT = ("rule_id", "category", "severity", "rank", "span_start", "span_end")


def regex_findings(views: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """All findings of the regex rules. ``views`` has key, text, masked, prose."""
    regex = [r for r in rules if r.category in ("phrase", "template", "punct")]
    block_rows = V.blocks(V.lines(views, key), key)
    block_rows = written(block_rows.withColumn("cut", V.sentence_spans(block_rows)), "blocks")  # read by both gates and the sentences
    sents = V.sentences(block_rows, (*V.TEXT_KINDS, "heading"), key)
    return gated(raw_matches(views, regex, key), views, block_rows, sents, regex, key)

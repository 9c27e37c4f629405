"""Document statistics as aggregates, windows and higher-order functions; thresholds as a filter.

Every metric is a function from a ``Prose`` (views, blocks, paragraphs, sentences of one set of documents) to
rows (doc_id, value, span_start, span_end): one row for each document, null spans where nothing is pointed at.
Values are doubles. A document without paragraphs or words has the metric's neutral value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import WORD, java, spans
from lectern.operators import views as V
from lectern.sources.catalogue import Rule

# Patterns and word lists of the metrics.
SENTENCE_END = "[.!?:;,][\"')\\]]*\\s*$"
TRIAD = r"\b[\w'-]+, [\w'-]+,? and [\w'-]+\b"
BOLD_LABEL = r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\*\*[^*:\n]{1,60}(?::\*\*|\*\*[ \t]*[:.])"
CONNECTIVE = r"^(?:however|moreover|furthermore|additionally|in addition|overall|consequently|nevertheless|ultimately|importantly|crucially|notably|that said|in short|in summary)\b"
SIGNPOST = r"(?:\b(?:first|next),|\bhaving (?:covered|established)\b|\bin (?:this|the following|the next) section\b|\bas (?:mentioned|noted) (?:above|earlier)\b|\blet(?: us|'s) turn to\b)"
CODA = r"^(?:ultimately,|in the end,|in conclusion|as we've seen|only time will tell|remember,|the future\b)"
SIGNOFF = r"^(?:let me know if|i hope this helps|happy to|feel free to)\b"
STOPWORDS = (
    "a an and are as at be been being but by can could did do does for from had has have he her here him his i if in into is it its may me might more most my no not of on or "
    "our out over should so that the their them then there these they this those to under us was we were what when where which who will with would you your"
).split()
EVERY = r"^every\s+[a-z][\w'-]*\s+(?:is|are|was|were|be|been|being|has|have|had|do|does|did|can|will|shall|must|should|would|may|might|[a-z]+(?:s|ed))\b"
QUESTION = "\\?[\"')\\]]*\\s*$"
CLOSER = r",\s+(?:ensuring|highlighting|reflecting|allowing|enabling|underscoring|showcasing|emphasizing|fostering|driving|paving|reinforcing|solidifying|demonstrating|signaling|signalling|making it|contributing to)\b[^.!?]*$"


@dataclass
class Prose:
    """The relations that the metrics read; build once, cache ``views`` for several metrics."""

    views: DataFrame
    blocks: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame

    @classmethod
    def of(cls, views: DataFrame, key: str = "doc_id", blocks: DataFrame | None = None) -> Prose:
        """With ``blocks`` given, what the metrics share is kept: they read it a dozen times."""
        v = views.withColumnRenamed(key, "doc_id") if key != "doc_id" else views
        b = V.blocks(V.lines(v)) if blocks is None else blocks
        text = b.where("kind in ('paragraph', 'list')")
        # a lone line without a closing mark is a title or caption, no paragraph
        text = text.where((F.col("kind") == "list") | F.col("t").contains("\n") | F.col("t").rlike(java(SENTENCE_END, "d")))
        sents = text.select("doc_id", "block_id", "kind", F.col("span_start").alias("base"), "t", F.posexplode(V.sentence_spans(text)).alias("n", "x"))
        sents = sents.select("doc_id", "block_id", "kind", F.col("n").alias("sent_no"), (F.col("base") + F.col("x.s")).alias("span_start"), (F.col("base") + F.col("x.e")).alias("span_end"), F.substring("t", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("sentence"))
        paragraphs = text.where("kind = 'paragraph'")
        return cls(v, b, paragraphs, sents) if blocks is None else cls(v, b, paragraphs.persist(), sents.persist())

    def per_doc(self, rows: DataFrame, neutral: float) -> DataFrame:
        """One row a document: those without a row get the neutral value."""
        out = self.views.select("doc_id").join(rows, "doc_id", "left")
        return out.select("doc_id", F.coalesce(F.col("value").cast("double"), F.lit(neutral)).alias("value"), F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def _opener(c: Column, n: int) -> Column:
    return F.lower(F.array_join(F.slice(_words(c), 1, n), " "))


def _lead(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def _pointed(value: Column, at: Column | None = None) -> Column:
    """struct<value, s, e> of a value and the span it points at."""
    null = F.lit(None).cast("bigint")
    return F.struct(value.cast("double").alias("value"), (at["s"] if at is not None else null).cast("bigint").alias("s"), (at["e"] if at is not None else null).cast("bigint").alias("e"))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("s"), end.cast("bigint").alias("e"))


# --- what is read off a text: one projection --------------------------------------------------------------------------


def _counted(views: DataFrame) -> DataFrame:
    """``views`` with _n, the words of the prose: what no word holds splits it, and may stand at either end."""
    cut = F.filter(F.split("prose", WORD.replace("[", "[^"), -1), lambda w: w != "")
    return views.select("doc_id", "masked", "prose", F.size(cut).alias("_n"))


def _in_view(view: str, pattern: str, least_words: int | None) -> Column:
    found = spans(F.col(view), pattern)
    n = F.col("_n")
    first = F.try_element_at(found, F.lit(1))
    if least_words is None:
        return _pointed(F.size(found), first)
    return _pointed(F.when(n >= least_words, F.size(found) * 100.0 / F.greatest(n, F.lit(1))).otherwise(0.0), first)


_OF_TEXT: dict[str, Callable[[], Column]] = {
    "triad_density": lambda: _in_view("prose", java(TRIAD, "idU"), 1), "signpost_density": lambda: _in_view("prose", java(SIGNPOST, "idU"), 150),
    "em_dash_density": lambda: _in_view("masked", "—", 1), "bold_label_bullets": lambda: _in_view("masked", "(?d)" + BOLD_LABEL, None),
}

# --- what is aggregated over sentences or paragraphs: one aggregate each ---------------------------------------------------


def _sentence_rows(p: Prose) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    q = java(QUESTION, "d")
    bare = F.regexp_replace("sentence", "[.!?\"']+\\z", "")
    s = p.sentences.select("doc_id", "span_start", "span_end", "sentence", F.lead("sentence").over(by).alias("next"), F.lead("span_end").over(by).alias("next_end"))
    s = s.withColumn("closer", F.regexp_extract(bare, java(CLOSER, "idU"), 0))
    return s.select(
        "doc_id", "span_start", "span_end", "next_end", F.nullif(F.regexp_count("sentence", F.lit(WORD)), F.lit(0)).alias("words"), (F.col("sentence").rlike(q) & F.col("next").isNotNull() & ~F.col("next").rlike(q)).alias("asks"),
        (F.col("closer") != "").alias("closes"), (F.col("span_start") + F.length(bare) - F.length("closer")).alias("closer_at"),
    )


def _paragraph_rows(p: Prose) -> DataFrame:
    t = _lead(F.col("t"))
    at = F.col("span_start") + F.length("t") - F.length(t)
    x = p.paragraphs.select(
        "doc_id", "span_start", "span_end", "t", at.alias("at"), F.regexp_extract(t, java(CONNECTIVE, "idU"), 0).alias("connective"), F.regexp_extract(t, java(EVERY, "idU"), 0).alias("every"), (F.size(V.sentence_spans(p.paragraphs)) <= 1).alias("one"),
    )
    down = Window.partitionBy("doc_id").orderBy(F.desc("span_start"))
    return x.withColumn("down", F.row_number().over(down))


def _coda() -> Column:
    """Stock words that open the last paragraph (before a sign-off), else how many of its content words the first one has."""
    first, l1, l2 = F.min(F.struct("span_start", "t")), F.max(F.when(F.col("down") == 1, F.struct("t", "span_start", "span_end"))), F.max(F.when(F.col("down") == 2, F.struct("t", "span_start", "span_end")))
    n = F.count(F.lit(1))
    last = F.when((n >= 3) & _lead(l1["t"]).rlike(java(SIGNOFF, "idU")), l2).otherwise(l1)
    text = _lead(last["t"])
    content = lambda c: F.array_distinct(F.filter(F.transform(_words(c), F.lower), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS)))
    a, b = content(first["t"]), content(text)
    union = F.size(F.array_union(a, b))
    overlap = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
    coda = F.regexp_extract(text, java(CODA, "idU"), 0)
    start = last["span_end"] - F.length(text)
    at = F.when(coda != "", _span(start, start + F.length(coda))).when(overlap > 0, _span(last["span_start"], last["span_end"]))
    return F.when(n >= 2, _pointed(F.when(coda != "", 1.0).otherwise(overlap), at)).otherwise(_pointed(F.lit(0.0)))


def _opened(column: str) -> Column:
    hit = F.col(column) != ""
    return _pointed(F.count(F.when(hit, 1)), F.min(F.when(hit, _span(F.col("at"), F.col("at") + F.length(column)))))


def _share(hit: str, start: str) -> Column:
    return _pointed(F.avg(F.col(hit).cast("double")), F.min(F.when(F.col(hit), _span(F.col(start), F.col("span_end")))))


def _asked() -> Column:
    k = F.count(F.when(F.col("asks"), 1))
    first = F.min(F.when(F.col("asks"), _span(F.col("span_start"), F.col("next_end"))))
    return F.when(k >= 3, _pointed(k / F.count(F.lit(1)), first)).otherwise(_pointed(F.lit(0.0)))


_OF_SENTENCES: dict[str, Callable[[], Column]] = {
    "sentence_length_cv": lambda: _pointed(F.when(F.count("words") < 2, 1.0).otherwise(F.stddev_pop("words") / F.avg("words"))),
    "rhetorical_question_share": _asked, "participial_closer_share": lambda: _share("closes", "closer_at"),
}
_OF_PARAGRAPHS: dict[str, Callable[[], Column]] = {
    "connective_openers": lambda: _opened("connective"), "every_template_openers": lambda: _opened("every"), "short_paragraph_share": lambda: _share("one", "span_start"), "conclusion_coda": _coda,
}


# --- runs and repeats -------------------------------------------------------------------------------------------------


def _opener_repeats(p: Prose) -> DataFrame:
    o = p.paragraphs.select("doc_id", "span_start", F.least("span_end", F.col("span_start") + 60).alias("span_end"), _opener(F.col("t"), 2).alias("k")).where("k <> ''")
    per = o.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"), F.min(_span(F.col("span_start"), F.col("span_end"))).alias("at"))
    best = per.groupBy("doc_id").agg(F.max_by(F.struct("n", "at"), F.struct("n", (-F.col("at.s")).alias("f"))).alias("b"))
    return best.select("doc_id", _pointed(F.col("b.n") - 1, F.col("b.at")).alias("paragraph_opener_repeats"))


def _opener_run(p: Prose) -> DataFrame:
    s = p.sentences.where("kind = 'paragraph'").select("doc_id", "block_id", "sent_no", "span_start", "span_end", _opener(F.col("sentence"), 1).alias("k"))
    by = Window.partitionBy("doc_id", "block_id").orderBy("sent_no")
    s = s.withColumn("new", F.when((F.col("k") != "") & (F.lag("k").over(by) == F.col("k")), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    runs = s.groupBy("doc_id", "block_id", "run").agg(F.count(F.lit(1)).alias("n"), _span(F.min("span_start"), F.max("span_end")).alias("at")).where("n > 1")
    best = runs.groupBy("doc_id").agg(F.max_by(F.struct("n", "at"), F.struct("n", (-F.col("at.s")).alias("f"))).alias("b"))
    return best.select("doc_id", _pointed(F.col("b.n"), F.col("b.at")).alias("sentence_opener_run"))


_OF_RUNS: dict[str, Callable[[Prose], DataFrame]] = {"paragraph_opener_repeats": _opener_repeats, "sentence_opener_run": _opener_run}
NEUTRAL = {"sentence_length_cv": 1.0}
#: metric: whether it fires at or above the threshold (else at or below)
METRICS: dict[str, bool] = {n: n != "sentence_length_cv" for n in (*_OF_SENTENCES, *_OF_PARAGRAPHS, *_OF_RUNS, *_OF_TEXT)}


def wide(p: Prose, names: list[str]) -> DataFrame:
    """doc_id, n_sentences, n_paragraphs and a struct<value, s, e> for each metric: one row a document.

    A text's own metrics are one projection, those of sentences and of paragraphs one aggregate each; the
    results meet by document, as everything here is spread by it.
    """
    out = _counted(p.views).select("doc_id", *(_OF_TEXT[n]().alias(n) for n in names if n in _OF_TEXT))
    s = _sentence_rows(p).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), *(_OF_SENTENCES[n]().alias(n) for n in names if n in _OF_SENTENCES))
    g = _paragraph_rows(p).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"), *(_OF_PARAGRAPHS[n]().alias(n) for n in names if n in _OF_PARAGRAPHS))
    out = out.join(s, "doc_id", "left").join(g, "doc_id", "left")
    for n in names:
        if n in _OF_RUNS:
            out = out.join(_OF_RUNS[n](p), "doc_id", "left")
    rest = {n: F.coalesce(n, _pointed(F.lit(NEUTRAL.get(n, 0.0)))) for n in names}
    return out.select("doc_id", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), *(c.alias(n) for n, c in rest.items()))


def metric(p: Prose, name: str) -> DataFrame:
    """doc_id, value, span_start, span_end of one metric."""
    if name in _OF_TEXT:
        got = _counted(p.views).select("doc_id", _OF_TEXT[name]().alias("m"))
    elif name in _OF_SENTENCES:
        got = _sentence_rows(p).groupBy("doc_id").agg(_OF_SENTENCES[name]().alias("m"))
    elif name in _OF_PARAGRAPHS:
        got = _paragraph_rows(p).groupBy("doc_id").agg(_OF_PARAGRAPHS[name]().alias("m"))
    else:
        got = _OF_RUNS[name](p).withColumnRenamed(name, "m")
    return p.per_doc(got.select("doc_id", F.col("m.value").alias("value"), F.col("m.s").alias("span_start"), F.col("m.e").alias("span_end")), NEUTRAL.get(name, 0.0))


def measured(p: Prose, names: list[str] | None = None) -> DataFrame:
    """doc_id, metric, value, span_start, span_end of the named metrics."""
    names = list(names or METRICS)
    one = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"{n}.value").alias("value"), F.col(f"{n}.s").alias("span_start"), F.col(f"{n}.e").alias("span_end")) for n in names))
    return wide(p, names).select("doc_id", F.explode(one).alias("m")).select("doc_id", "m.*")


def fired(p: Prose, rules: list[Rule], parsed: dict[str, DataFrame] | None = None) -> DataFrame:
    """Findings of the document rules whose metric passes its threshold in a long enough document.

    ``parsed`` has the values of metrics that need a parser; they fire from the threshold on. Where a metric points at nothing, the first block does.
    """
    own = [r for r in rules if r.metric in METRICS]
    w = wide(p, list(dict.fromkeys(r.metric for r in own)))

    def hit(r: Rule) -> Column:
        v = F.col(f"{r.metric}.value")
        ok = (v >= r.threshold if METRICS[r.metric] else v <= r.threshold) & (F.col("n_sentences") >= r.min_sentences) & (F.col("n_paragraphs") >= r.min_paragraphs)
        return F.when(ok, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.rank).alias("rank"), v.alias("value"), F.col(f"{r.metric}.s").alias("span_start"), F.col(f"{r.metric}.e").alias("span_end")))

    out = w.select("doc_id", F.explode(F.filter(F.array(*map(hit, own)), lambda x: x.isNotNull())).alias("m")).select("doc_id", "m.*") if own else None
    for r in rules:
        if parsed and r.metric in parsed:
            v = parsed[r.metric].where(F.col("value") >= r.threshold).join(w.select("doc_id", "n_sentences", "n_paragraphs").where((F.col("n_sentences") >= r.min_sentences) & (F.col("n_paragraphs") >= r.min_paragraphs)).select("doc_id"), "doc_id")
            v = v.select("doc_id", F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.rank).alias("rank"), "value", "span_start", "span_end")
            out = v if out is None else out.unionByName(v)
    first = p.blocks.groupBy("doc_id").agg(F.min(F.struct("span_start", "span_end")).alias("b"))
    return out.join(first, "doc_id", "left").select(
        "doc_id", "rule_id", F.lit("doc").alias("category"), "severity", "rank", F.coalesce("span_start", "b.span_start", F.lit(0)).cast("bigint").alias("span_start"),
        F.coalesce("span_end", F.least("b.span_end", F.col("b.span_start") + 60), F.lit(0)).cast("bigint").alias("span_end"), "value",
    )

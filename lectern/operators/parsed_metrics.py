"""The two document metrics that need parses: parallel clause triples and staccato beats.

The cheap shape filters run first, so that only candidates are parsed. ``pieces_to_parse`` and
``beats_to_parse`` give the candidates; their tokens come back as in ``graph`` with the candidate's number as
``block_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import WORD, spans
from lectern.operators import views as V
from lectern.operators.graph import densest, with_ancestors
from lectern.operators.metrics import Prose
from lectern.operators.study import clause_parts

# Words that make a piece a dependent clause, finite tags, subject labels, the reach of both windows.
SUBORDINATE = "if unless when whenever while although though because since where wherever which who whose whom that whether until before after once as".split()
FINITE = ("VBD", "VBP", "VBZ", "MD")
SUBJECTS = ("nsubj", "nsubjpass")
TRIPLE_REACH, BEAT_REACH = 50, 8


def _numbered(p: Prose) -> DataFrame:
    return p.sentences.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("span_start", "span_end")))


def triples(p: Prose) -> DataFrame:
    """doc_id, pos, span_start, span_end, parts of the sentences with the shape of a triple."""
    return _numbered(p).select("doc_id", "pos", "span_start", "span_end", clause_parts(F.col("sentence")).alias("parts")).where("parts is not null")


def pieces_to_parse(p: Prose) -> DataFrame:
    """doc_id, block_id (3 * pos + 0..2), text."""
    return triples(p).select("doc_id", "pos", F.posexplode("parts").alias("k", "text")).select("doc_id", (F.col("pos") * 3 + F.col("k")).cast("bigint").alias("block_id"), "text")


def assertions(tokens: DataFrame) -> DataFrame:
    """doc_id, block_id, lemma, subject of the pieces that assert something by themselves.

    One verbal root, no subordinate opener or marker, exactly one subject before the root, a finite tag on the root or
    its children, and something behind the root. The subject is the text of its whole subtree.
    """
    t = with_ancestors(tokens.where("pos not in ('PUNCT', 'SPACE')"))
    keys = ["doc_id", "block_id"]
    g = t.groupBy(*keys).agg(
        F.min_by("lower", "i").alias("first"), F.count(F.when(F.col("dep") == "ROOT", 1)).alias("roots"), F.max("i").alias("last"),
        F.max(F.when(F.col("dep") == "ROOT", F.struct("i", "lemma", "pos", "tag"))).alias("root"), F.array_sort(F.collect_list(F.struct("i", "lower", "dep", "tag", "head_i", "above"))).alias("ts"),
    )
    r = F.col("root.i")
    kids = F.filter("ts", lambda x: (x["head_i"] == r) & (x["i"] != r))
    subjects = F.filter(kids, lambda x: x["dep"].isin(*SUBJECTS) & (x["i"] < r))
    g = g.where(~F.col("first").isin(*SUBORDINATE) & (F.col("roots") == 1) & F.col("root.pos").isin("VERB", "AUX") & (F.col("last") > r))
    g = g.withColumn("kids", kids).withColumn("s", subjects)
    g = g.where((F.size("s") == 1) & ~F.exists("kids", lambda x: x["dep"] == "mark") & (F.col("root.tag").isin(*FINITE) | F.exists("kids", lambda x: x["tag"].isin(*FINITE))))
    s = F.col("s")[0]["i"]
    tree = F.array_join(F.transform(F.filter("ts", lambda x: (x["i"] == s) | F.array_contains(x["above"], s)), lambda x: x["lower"]), " ")
    return g.select(*keys, F.lower("root.lemma").alias("lemma"), tree.alias("subject"))


def parallel_clause_repeats(p: Prose, tokens: DataFrame) -> DataFrame:
    """doc_id, value, span_start, span_end: most parallel triples in 50 consecutive sentences; fewer than two candidates score 0."""
    c = triples(p)
    a = assertions(tokens)
    n = F.transform("parts", lambda x: F.regexp_count(x, F.lit(WORD)))
    for k in range(3):
        one = a.select(F.col("doc_id").alias("d"), F.col("block_id").alias("b"), F.struct("lemma", "subject").alias(f"a{k}"))
        c = c.join(one, (F.col("doc_id") == F.col("d")) & (F.col("pos") * 3 + k == F.col("b")), "left").drop("d", "b")
    # a status label ("green means done") is an assertion whatever the parser makes of it
    label = lambda k, tail: F.regexp_extract(F.col("parts")[k], rf"(?i)^([a-z][\w'-]*) means {tail}$", 1)
    both = (label(0, "fix it") != "") & (label(1, "done") != "")
    for k, tail in ((0, "fix it"), (1, "done")):
        c = c.withColumn(f"a{k}", F.when(both, F.struct(F.lit("mean").alias("lemma"), F.lower(label(k, tail)).alias("subject"))).otherwise(F.col(f"a{k}")))
    c = c.withColumn("n", n)
    most = F.greatest(F.col("n")[0], F.col("n")[1])
    hit = c.where(
        (F.col("a0.lemma") == F.col("a1.lemma")) & (F.col("a0.subject") != F.col("a1.subject")) & F.col("a2.lemma").isNotNull()
        & ((F.col("a2.lemma") == F.col("a0.lemma")) | ((most <= 8) & (F.col("n")[2] >= F.greatest(F.lit(7), 1.5 * most))))
    )
    enough = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("doc_id")
    best = densest(hit.join(enough, "doc_id", "left_semi"), TRIPLE_REACH, position="pos")
    spans = hit.select("doc_id", F.col("pos").alias("at"), "span_start", "span_end")
    return p.per_doc(best.join(spans, ["doc_id", "at"]), 0.0)


def _beats(p: Prose) -> DataFrame:
    """Sentences of running paragraphs: doc_id, grp, k (place in the group), span, text, words, candidate.

    A group ends at a block of another kind and wherever anything visible stands between two paragraphs.
    """
    by = Window.partitionBy("doc_id").orderBy("span_start")
    b = p.blocks.join(p.views.select("doc_id", "text"), "doc_id")
    gap = F.substring("text", F.coalesce(F.lag("span_end").over(by), F.lit(0)).cast("int") + 1, (F.col("span_start") - F.coalesce(F.lag("span_end").over(by), F.lit(0))).cast("int"))
    b = b.withColumn("new", F.when((F.col("kind") != "paragraph") | (F.trim(F.regexp_replace(gap, r"\s+", " ")) != ""), 1).otherwise(0)).withColumn("grp", F.sum("new").over(by))
    s = V.sentences(p.blocks, ("paragraph",)).join(b.where("kind = 'paragraph'").select("doc_id", "block_id", "grp"), ["doc_id", "block_id"])
    s = s.withColumn("words", F.regexp_count("sentence", F.lit(WORD)))
    quoted = p.views.select("doc_id", spans(F.coalesce("text", F.lit("")), "\"[^\"]*\"|“[^”]*”").alias("q"))
    s = s.join(quoted, "doc_id")
    free = ~F.exists("q", lambda x: (F.col("span_start") < x["e"]) & (x["s"] < F.col("span_end")))
    s = s.withColumn("candidate", F.col("words").between(1, 5) & free & F.col("sentence").rlike(r"[.!]\s*$") & ~F.col("sentence").contains(":")).drop("q")
    return s.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "grp").orderBy("span_start")))


def beats_to_parse(p: Prose) -> DataFrame:
    """doc_id, block_id (the sentence's start), text: only of documents with three candidates or more."""
    s = _beats(p).where("candidate")
    enough = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("doc_id")
    return s.join(enough, "doc_id", "left_semi").select("doc_id", F.col("span_start").alias("block_id"), F.trim(F.regexp_replace("sentence", r"\s+", " ")).alias("text"))


def staccato_beats(p: Prose, tokens: DataFrame) -> DataFrame:
    """doc_id, value, span_start, span_end: most beats (short verbless sentences) in eight sentences of running prose.

    The window needs a sentence of more than five words and three different beats; the earliest of equals wins.
    """
    verbal = tokens.groupBy("doc_id", "block_id").agg(F.bool_or(F.col("pos").isin("VERB", "AUX", "PROPN") | F.col("dep").isin("nsubj", "nsubjpass", "csubj")).alias("verbal"))
    s = _beats(p).join(verbal.select("doc_id", F.col("block_id").alias("span_start"), "verbal"), ["doc_id", "span_start"], "left")
    s = s.withColumn("beat", F.col("candidate") & ~F.coalesce("verbal", F.lit(True)))
    w = Window.partitionBy("doc_id", "grp").orderBy("k").rowsBetween(0, BEAT_REACH - 1)
    folded = F.lower(F.regexp_replace(F.trim("sentence"), r"\.+$", ""))
    s = s.withColumn("win", F.collect_list(F.struct("beat", "words", folded.alias("t"), "span_start", "span_end")).over(w))
    hits = F.filter("win", lambda x: x["beat"])
    s = s.withColumn("hits", hits).where(F.exists("win", lambda x: x["words"] > 5) & (F.size(F.array_distinct(F.transform("hits", lambda x: x["t"]))) >= 3))
    best = s.groupBy("doc_id").agg(F.max_by(F.struct(F.size("hits").alias("n"), F.col("hits")[0].alias("h")), F.struct(F.size("hits").alias("n"), (-F.col("span_start")).alias("f"))).alias("b"))
    few = _beats(p).where("candidate").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("doc_id")
    return p.per_doc(best.join(few, "doc_id", "left_semi").select("doc_id", F.col("b.n").alias("value"), F.col("b.h.span_start").alias("span_start"), F.col("b.h.span_end").alias("span_end")), 0.0)

"""Dependency rules as join chains over a relation of parsed tokens.

``tokens``: doc_id, block_id, i, idx (offset in the block), text, lower, lemma, pos, tag, dep, head_i - an edge list.
How it is filled is open: a table, or a parser behind ``parsed``. A pattern is a list of nodes; the first is
the anchor, each later one names an earlier node, a relation and constraints. Node filters are pushed below
the joins, all joins are equi-joins on (document, block) and mostly on the head, so a pattern of n nodes is n - 1
hash or sort-merge joins of pre-filtered rows. Alternatives are a union.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import java
from lectern.operators.reduce import MARKS, merge_overlaps, shadow_weaker
from lectern.operators.regex_rules import compiled, excepted, located, opening_only
from lectern.operators.views import code_spans, parse
from lectern.sources.catalogue import Rule

TOKENS_DDL = "doc_id bigint, block_id bigint, i int, idx int, text string, lower string, lemma string, pos string, tag string, dep string, head_i int"
_ATTRS = {"DEP": "dep", "POS": "pos", "LEMMA": "lemma", "TAG": "tag", "LOWER": "lower", "ORTH": "text"}


def parsed(views: DataFrame, blocks: DataFrame, parser: Callable[[list[str]], Iterator[list[tuple]]]) -> DataFrame:
    """Tokens from a parser called with batches of block texts; it yields (i, idx, text, lower, lemma, pos, tag, dep, head_i) lists."""
    rows = blocks.join(views.select("doc_id", "parse"), "doc_id").select("doc_id", "block_id", F.substring("parse", F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, k, *tok) for d, k, toks in zip(b["doc_id"], b["block_id"], parser(b["t"].tolist())) for tok in toks]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TOKENS_DDL.split(", ")])

    return rows.mapInPandas(run, TOKENS_DDL)


def fits(attrs: dict, alias: str = "") -> Column:
    """The constraints of one node as a predicate."""
    ok = F.lit(True)
    for k, v in attrs.items():
        c = F.col(alias + _ATTRS[k])
        if isinstance(v, dict):
            for op, x in v.items():
                ok = ok & {"IN": lambda: c.isin(*x), "NOT_IN": lambda: ~c.isin(*x), "REGEX": lambda: c.rlike(java(x, ""))}[op]()
        else:
            ok = ok & (c == v)
    return ok


def with_ancestors(tokens: DataFrame) -> DataFrame:
    """tokens and ``above``: the token's ancestors, nearest first; a loop of heads ends where it would repeat.

    All paths of a block grow together and double in each step - a path and the path of its last token - so
    a block of n tokens takes log2(n) steps; no loop of joins.
    """
    heads = tokens.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_set(F.struct("i", "head_i"))).alias("all"))
    # of repeated tokens the first counts
    heads = heads.select("doc_id", "block_id", F.filter("all", lambda x, k: (k == 0) | (x["i"] != F.get("all", k - 1)["i"])).alias("hs"))
    place = F.map_from_entries(F.transform("hs", lambda x, k: F.struct(x["i"].alias("i"), k.alias("k"))))
    heads = heads.withColumn("at", place)
    first = F.transform("hs", lambda x: F.when((x["i"] == x["head_i"]) | F.element_at("at", x["head_i"]).isNull(), F.array().cast("array<int>")).otherwise(F.array(F.element_at("at", x["head_i"]))))
    paths = F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.log2(F.size("hs") + 1)).cast("int")), first,
        lambda ps, _: F.transform(ps, lambda p: F.when(F.size(p) == 0, p).otherwise(F.array_distinct(F.concat(p, F.get(ps, F.element_at(p, -1)))))),
    )
    rows = heads.select("doc_id", "block_id", "hs", F.posexplode(paths).alias("k", "p"))
    own = F.get("hs", F.col("k"))["i"]
    rows = rows.select("doc_id", "block_id", own.alias("i"), F.filter(F.transform("p", lambda q: F.get("hs", q)["i"]), lambda i: i != own).alias("above"))
    return tokens.join(rows, ["doc_id", "block_id", "i"])


def match(tokens: DataFrame, pattern: tuple[dict, ...] | list[dict]) -> DataFrame:
    """doc_id, block_id, nodes array<int>: token numbers in pattern order, one row per match."""
    src = with_ancestors(tokens) if any(n.get("REL_OP") == ">>" for n in pattern) else tokens.withColumn("above", F.array().cast("array<int>"))
    out, place = None, {}
    for k, node in enumerate(pattern):
        t = src.where(fits(node.get("RIGHT_ATTRS", {}))).select(*(F.col(c).alias(f"{c}{k}") for c in ("doc_id", "block_id", "i", "head_i", "above")))
        place[node["RIGHT_ID"]] = k
        if out is None:
            out = t
            continue
        a = place[node["LEFT_ID"]]
        left, right, head_l, head_r = F.col(f"i{a}"), F.col(f"i{k}"), F.col(f"head_i{a}"), F.col(f"head_i{k}")
        on = (F.col("doc_id0") == F.col(f"doc_id{k}")) & (F.col("block_id0") == F.col(f"block_id{k}")) & (left != right)
        sibling = (head_l == head_r) & (right != head_r)
        on = on & {
            ">": lambda: head_r == left,
            ">--": lambda: (head_r == left) & (right < left),
            ">>": lambda: F.array_contains(f"above{k}", left),
            "$+": lambda: sibling & (right == left + 1),
            "$++": lambda: sibling & (right > left),
            "$--": lambda: sibling & (right < left),
        }[node["REL_OP"]]()
        out = out.join(t, on)
    return out.select(F.col("doc_id0").alias("doc_id"), F.col("block_id0").alias("block_id"), F.array(*(F.col(f"i{k}") for k in range(len(pattern)))).alias("nodes"))


def graph_findings(tokens: DataFrame, views: DataFrame, blocks: DataFrame, sents: DataFrame, rules: list[Rule], lexicon: DataFrame | None = None, isolated: DataFrame | None = None) -> DataFrame:
    """Findings of the dependency rules with marks: matched, gated, merged and shadowed.

    ``views`` has doc_id, text, prose; ``lexicon`` (form, upos) drops noun clusters that hold a word with no noun reading;
    ``isolated`` (doc_id, span_start, span_end, i, pos, tag, dep, head_i), the parses of ``isolated_spans``, drops clusters
    that alone read as a gerund with its object. Without these two relations their gates are open. Repeated
    ``tokens`` rows change nothing; matches of null texts are of no document.
    """
    m = located_matches(tokens, views, blocks, sents, rules)
    if lexicon is not None:
        no_noun = lexicon.groupBy(F.lower("form").alias("lower")).agg(F.bool_or(F.col("upos").isin("ADJ", "VERB")).alias("other"), F.bool_or(F.col("upos").isin("NOUN", "PROPN")).alias("noun")).where("other and not noun").select("lower")
        between = m.where("category = 'noun'").select("m", "doc_id", "block_id", F.explode(F.sequence(F.array_min("nodes"), F.array_max("nodes"))).alias("i")).join(tokens.select("doc_id", "block_id", "i", "lower"), ["doc_id", "block_id", "i"])
        m = m.join(between.join(no_noun, "lower", "left_semi").select("m").distinct(), "m", "left_anti")
    if isolated is not None:
        at = ["doc_id", "span_start", "span_end"]
        verb = isolated.where("pos = 'VERB' and tag = 'VBG'").select(*at, "i")
        dobj = isolated.where("dep = 'dobj' and i <> head_i").select(*at, F.col("head_i").alias("i"))
        m = m.join(verb.join(dobj, [*at, "i"], "left_semi").select(*at, F.lit(True).alias("gerund")).distinct(), at, "left").where("not (category = 'noun' and ing and coalesce(gerund, false))")
    return shadow_weaker(merge_overlaps(m.select("doc_id", "rule_id", "category", "severity", "rank", "span_start", "span_end", "marks")))


def isolated_spans(tokens: DataFrame, views: DataFrame, blocks: DataFrame, sents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, span_start, span_end, text of the noun clusters that hold a word in -ing: to be parsed by themselves."""
    m = located_matches(tokens, views, blocks, sents, [r for r in rules if r.category == "noun"])
    got = m.where("ing").select("doc_id", "span_start", "span_end").distinct().join(views.select("doc_id", "text", "prose"), "doc_id")
    return got.select("doc_id", "span_start", "span_end", F.substring(parse(F.coalesce("text", F.lit("")), F.col("prose")), F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int")).alias("text"))


def rule_matches(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, block_id, nodes, rule_id, category, severity, rank: matches of every alternative whose anchor has no forbidden child."""
    children = tokens.select("doc_id", "block_id", F.col("head_i").alias("c_head"), F.col("i").alias("c_i"), "dep", F.concat_ws(":", "dep", "lower").alias("dl"))
    all_ = None
    for r in rules:
        for alt in r.dependency:
            m = match(tokens, alt).withColumn("rule_id", F.lit(r.id)).withColumn("category", F.lit(r.category)).withColumn("severity", F.lit(r.severity)).withColumn("rank", F.lit(r.rank))
            if r.anchor_without:
                bad = children.where((F.col("dep").isin(*r.anchor_without) | F.col("dl").isin(*r.anchor_without)) & (F.col("c_i") != F.col("c_head"))).select("doc_id", "block_id", "c_head").distinct()
                m = m.join(bad.select(F.col("doc_id").alias("x_d"), F.col("block_id").alias("x_b"), "c_head"), (F.col("doc_id") == F.col("x_d")) & (F.col("block_id") == F.col("x_b")) & (F.element_at("nodes", 1) == F.col("c_head")), "left_anti")
            all_ = m if all_ is None else all_.unionByName(m)
    if all_ is None:
        all_ = match(tokens.limit(0), [{"RIGHT_ID": "x"}]).select("*", *(F.lit("").alias(c) for c in ("rule_id", "category", "severity")), F.lit(0).alias("rank"))
    return all_


def located_matches(tokens: DataFrame, views: DataFrame, blocks: DataFrame, sents: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches with places and marks that pass the gates of text: m, doc_id, block_id, rule_id, ..., nodes, ing (has a word in -ing)."""
    all_ = rule_matches(tokens, rules)
    compiled(tokens.sparkSession, rules)
    m = all_.withColumn("m", F.xxhash64("doc_id", "block_id", "rule_id", "nodes"))
    base = blocks.select("doc_id", "block_id", F.col("span_start").alias("base"))
    tok = tokens.join(base, ["doc_id", "block_id"]).select("doc_id", "block_id", "i", (F.col("base") + F.col("idx")).cast("bigint").alias("s"), F.length("text").alias("n"), "text", "lower")
    spot = m.select("m", "doc_id", "block_id", F.explode("nodes").alias("i")).join(tok, ["doc_id", "block_id", "i"]).join(views.select("doc_id", code_spans(F.coalesce("text", F.lit(""))).alias("code")), "doc_id")
    # a name that stands for code marks the whole of the code
    over = F.get(F.filter("code", lambda x: x["s"] == F.col("s")), F.lit(0))["e"].cast("bigint")
    spot = spot.select("m", "s", F.coalesce(over, F.col("s") + F.col("n")).alias("e"), over.isNotNull().alias("code"), F.col("text").rlike(r"\p{L}").alias("lettered"), F.col("lower").endswith("ing").alias("ing"))
    spans = spot.groupBy("m").agg(
        F.min("s").alias("span_start"), F.max("e").alias("span_end"), F.array_sort(F.collect_set(F.struct("s", "e"))).cast(MARKS).alias("marks"), F.bool_and("lettered").alias("lettered"), F.bool_or("code").alias("code"), F.bool_or("ing").alias("ing")
    )
    m = located(m.dropDuplicates(["m"]).join(spans, "m"), s=sents.select("doc_id", "span_start", "span_end"), b=blocks.select("doc_id", "kind", "span_start", "span_end"))
    m = m.join(views.select("doc_id", "text", "prose"), "doc_id")
    part = F.substring("prose", F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int"))
    a, e = F.coalesce("s.span_start", "span_start"), F.coalesce("s.span_end", "span_end")
    m = opening_only(m, blocks, rules).where(~excepted(rules, part, "match_unless") & ~excepted(rules, F.substring("prose", a.cast("int") + 1, (e - a).cast("int"))))
    m = m.where((F.col("category") != "noun") | (~part.rlike("[-/]") & F.col("lettered") & ~F.col("code")))
    return m.select("m", "doc_id", "block_id", "rule_id", "category", "severity", "rank", "nodes", "span_start", "span_end", "marks", "ing")


def nominal(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys of parsed prefixes that are nominal: a nominal root and no finite verb."""
    return tokens.groupBy(*keys).agg(
        F.bool_or((F.col("dep") == "ROOT") & F.col("pos").isin("NOUN", "PROPN", "PRON")).alias("root"), F.bool_or(F.col("tag").isin("VBD", "VBP", "VBZ", "MD")).alias("finite")
    ).where("root and not finite").select(*keys)


def densest(hits: DataFrame, reach: int, key: str = "doc_id", position: str = "sent_no") -> DataFrame:
    """key, value, at: most hits within ``reach`` consecutive positions, and where that run starts (the earliest of equals)."""
    w = Window.partitionBy(key).orderBy(position).rangeBetween(0, reach - 1)
    n = hits.withColumn("n", F.count(F.lit(1)).over(w))
    return n.groupBy(key).agg(F.max("n").alias("value"), F.max_by(position, F.struct("n", (-F.col(position)).alias("p"))).alias("at"))


def participles(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is a past participle of some verb (lexicon: form, tag)."""
    forms = lexicon.where("tag = 'VBN'").select(F.lower("form").alias("_f")).distinct()
    return words.join(forms, F.lower(F.col(word)) == F.col("_f"), "left_semi")


def grammar_rejection(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason: why a parsed prefix is no noun phrase - 'finite_verb', 'no_nominal_root' - or null."""
    g = tokens.groupBy(*keys).agg(F.bool_or(F.col("tag").isin("VBD", "VBP", "VBZ", "MD")).alias("f"), F.bool_or((F.col("dep") == "ROOT") & F.col("pos").isin("NOUN", "PROPN", "PRON")).alias("n"))
    return g.select(*keys, F.when(F.col("f"), "finite_verb").when(~F.col("n"), "no_nominal_root").alias("reason"))


def dump(tokens: DataFrame) -> DataFrame:
    """doc_id, block_id, line_no, line: a parse as text, one token a line with its head."""
    head = tokens.select("doc_id", "block_id", F.col("i").alias("head_i"), F.col("text").alias("head"))
    line = F.concat_ws(" ", F.rpad("text", 18, " "), F.rpad("lemma", 18, " "), F.rpad("pos", 6, " "), F.rpad("tag", 5, " "), F.rpad("dep", 10, " "), F.concat(F.lit("<- "), F.coalesce("head", F.lit("-"))))
    return tokens.join(head, ["doc_id", "block_id", "head_i"], "left").select("doc_id", "block_id", F.col("i").alias("line_no"), line.alias("line"))

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.guards import literals, needed, only, rarest, within_line
from lectern.operators import graph, judgments, reduce, regex_rules, scanner
from lectern.operators import views as V
from lectern.plans.lint import Options, lint
from lectern.sources import catalogue as C

RULES = C.load()


def test_catalogue():
    assert len(RULES) == 168
    assert [sum(r.severity == s for r in RULES) for s in ("bite", "bark", "sniff")] == [108, 44, 16]
    assert "punct.emoji" not in {r.id for r in C.select(RULES)} and "punct.emoji" in {r.id for r in C.select(RULES, no_emoji=True)}
    assert {r.category for r in C.select(RULES, disable_category={"doc"})} == {"phrase", "template", "punct", "verb", "adj", "noun"}
    with pytest.raises(C.CatalogueError):
        C.select(RULES, only={"phrase.none"})


@pytest.mark.parametrize(
    "raw, category",
    [
        ({"id": "phrase.x", "severity": "bite", "message": "m"}, "phrase"),
        ({"id": "phrase.X", "severity": "bite", "message": "m", "pattern": "a"}, "phrase"),
        ({"id": "phrase.x", "severity": "loud", "message": "m", "pattern": "a"}, "phrase"),
        ({"id": "phrase.x", "severity": "bite", "message": "m", "pattern": "("}, "phrase"),
        ({"id": "phrase.x", "severity": "bite", "message": "m", "pattern": "a", "odd": 1}, "phrase"),
        ({"id": "doc.x", "severity": "sniff", "message": "m", "metric": "a"}, "doc"),
        ({"id": "punct.x", "severity": "bark", "message": "m", "pattern": "a", "veto": {"threshold": 0.4}}, "punct"),
    ],
)
def test_bad_rules(raw, category):
    with pytest.raises(C.CatalogueError):
        C.rule_from(raw, category)


def test_guards_are_necessary():
    import re

    assert literals("(?:foobar|bazqux)\\s+x") == ["bazqux", "foobar"]
    assert literals("a?b*") is None
    for r in RULES:
        if r.pattern and (g := literals(r.pattern)):
            for t in ("This load-bearing change plays a pivotal role, and both properties are the point.", "In conclusion, it's not a tool, it's a promise. At its core, delve into this."):
                if re.search(r.pattern, t, re.I | re.M):
                    assert any(x in t.lower() for x in g), r.id


def test_what_patterns_need():
    assert needed(r"\b(?:the (?:move|fix)|in due course)\b") == ("or", ("and", ("lit", "the "), ("or", ("lit", "move"), ("lit", "fix"))), ("lit", "in due course"))
    assert rarest(needed(r"\bis not the problem, and\b|the (?:upshot|catch)\b")) == {"is not the problem, and", "upshot", "catch"}
    assert only("sign", needed(r"\s?\u2014\s?|[a-z]+; ")) is None and needed(r"\u2014|[a-z];") == ("or", ("sign", "\u2014"), ("sign", ";"))
    assert needed("(?:foo)?x*") is None


def test_patterns_within_lines():
    assert all(map(within_line, (r"^[ \t]*a[^.\n]{1,9}\b.*$", r"(?<!\S)(?P<x>\w+) (?P=x)", r"(?<=[.!?] )a(?! b)")))
    assert not any(map(within_line, (r"a\s+b", r"a[^.]b", r"a(?!\s)", r"(?s:a.b)", r"a\Z", r"a\Wb", "a\nb")))


def test_matches_by_line(spark):
    """Places count from the text, also behind wide characters and blank lines; literals are those of the view that the rule reads."""
    text = "\U0001f600 First.\n\n\nIt isn\u2019t just a tool.\nIn conclusion, we follow\nfrom that. In conclusion, it isn't just a toy."
    v = V.with_views(spark.createDataFrame([(1, text), (2, "Nothing."), (3, None)], "doc_id bigint, text string")).persist()
    rules = [r for r in RULES if r.id in ("template.no-x-no-y-just-z", "phrase.signposted-conclusion", "phrase.follows-from")]
    got = {(r.doc_id, r.rule_id, r.span_start, r.span_end, r.found) for r in regex_rules.raw_matches(v, rules).collect()}
    prose = text.replace("\u2019", "'")
    at = lambda rule, found: {(1, rule, i, i + len(found), found) for i in range(len(prose)) if prose.startswith(found, i)}
    assert {x for x in got if x[1] == "template.no-x-no-y-just-z"} == at("template.no-x-no-y-just-z", "isn't just a ")
    assert {x for x in got if x[1] == "phrase.follows-from"} == at("phrase.follows-from", "follow\nfrom")
    assert {x[2] for x in got if x[1] == "phrase.signposted-conclusion"} == {x[2] for x in at("", "In conclusion")}


CASES = [
    ("The cache is load-bearing here.", "phrase.load-bearing", True),
    ("The beam bears the load here.", "phrase.load-bearing", False),
    ("In conclusion, the tool works.", "phrase.signposted-conclusion", True),
    ("She wrote it — quickly.", "punct.em-dash", True),
    ("A plain hyphen-word.", "punct.em-dash", False),
    ("`In conclusion` is code.", "phrase.signposted-conclusion", False),
    ("Two options, both bad.", "template.count-opener", True),
    ("We saw two options, both bad.", "template.count-opener", False),
]


@pytest.mark.parametrize("k", range(1))
def test_rules_fire_alone(spark, k):
    d = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id bigint, text string")
    v = V.with_views(d).persist()
    rules = [r for r in RULES if r.id in {c[1] for c in CASES}]
    got = {(r.doc_id, r.rule_id) for r in regex_rules.regex_findings(v, rules).collect()}
    for i, (t, rule, fires) in enumerate(CASES):
        assert ((i, rule) in got) == fires, t


def greedy_dedupe(fs):
    kept = []
    for f in sorted(fs, key=lambda f: (f[2], -(f[3] - f[2]), f[1])):
        if not any(k[2] <= f[2] and f[3] <= k[3] and k[3] - k[2] > f[3] - f[2] and k[1] <= f[1] for k in kept):
            kept.append(f)
    return set(kept)


def greedy_shadow(fs):
    kept = []
    for f in sorted(fs, key=lambda f: (f[1], f[2])):
        if not any(k[0] != f[0] and k[1] < f[1] and k[2] < f[3] and f[2] < k[3] for k in kept):
            kept.append(f)
    return set(kept)


def test_reductions_against_loops(spark):
    rnd = random.Random(9)
    rows = [(d, f"x.{rnd.randint(0, 3)}", "x", "s", rnd.randint(0, 2), a, a + rnd.randint(1, 9)) for d in range(60) for a in [rnd.randint(0, 25) for _ in range(rnd.randint(0, 9))]]
    rows = list({(r[0], r[1], r[5]): r for r in rows}.values())
    f = spark.createDataFrame(rows, "doc_id bigint, rule_id string, category string, severity string, rank int, span_start bigint, span_end bigint")
    for fn, loop in ((reduce.dedupe, greedy_dedupe), (reduce.shadow_weaker, greedy_shadow)):
        got = {}
        for r in fn(f).collect():
            got.setdefault(r.doc_id, set()).add((r.rule_id, r["rank"], r.span_start, r.span_end))
        for d in range(60):
            assert got.get(d, set()) == loop([(r[1], r[4], r[5], r[6]) for r in rows if r[0] == d])
    again = reduce.dedupe(reduce.dedupe(f).drop("marks"))
    assert again.count() == reduce.dedupe(f).count()


def test_merge_touching_and_marks(spark):
    f = spark.createDataFrame([(1, "a", 0, 5), (1, "a", 5, 7), (1, "a", 9, 10), (1, "b", 4, 6)], "doc_id bigint, rule_id string, span_start bigint, span_end bigint")
    got = sorted((r.rule_id, r.span_start, r.span_end) for r in reduce.merge_overlaps(f).collect())
    assert got == [("a", 0, 7), ("a", 9, 10), ("b", 4, 6)]


CONTRAST = [
    ("This is a tool, not a toy.", True), ("It works, but not for long.", True), ("She stayed; he did not.", True), ("We left early, and it rained.", False),
    ("He never stopped running, but he was tired.", False), ("It cannot fail.", False), ("", False), (None, False), ("Usually, not all of them are open.", False), ("Therefore, not every visitor was able to enter.", False),
    ("The crowd, not knowing the reason, waited outside.", False), ("The crowd, not knowing the reason, waited, not in vain.", True), ("Growing, not shrinking, was the plan.", True), ("The door, not the window, was open.", True),
    ("It ran well — not fast, though.", True), ("But not now.", False), ("We did not ask, but they told us.", True), ("We did not ask (they told us) but left.", False), ("The price rose, neither here nor there.", True),
    ("He has never ceased to wonder; she has.", False), ("It ended; nobody could see that, but it was not late.", True), (", not this", False), ("Not this, but that.", True), ("We left; they never really stopped talking.", False),
]


def test_contrast(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CONTRAST)], "i int, sentence string")
    got = {r.i: r.contrast for r in scanner.facts(d).collect()}
    assert [t for i, (t, want) in enumerate(CONTRAST) if got[i] is not want] == []


def test_contrast_pairs(spark):
    d = spark.createDataFrame([(1, "The plan is a map. It is not a promise."), (2, "It is not a map. It is not a promise."), (3, None)], "doc_id bigint, text string")
    v = V.with_views(d)
    got = {r.doc_id: (r.span_start, r.span_end) for r in scanner.contrasts(V.sentences(V.blocks(V.lines(v)))).collect()}
    assert got == {1: (0, 39)}


# "This buys us time ." with a hand-made parse
TOKENS = [
    (1, 1, 0, 0, "This", "this", "this", "PRON", "DT", "nsubj", 1), (1, 1, 1, 5, "buys", "buys", "buy", "VERB", "VBZ", "ROOT", 1),
    (1, 1, 2, 10, "us", "us", "we", "PRON", "PRP", "dative", 1), (1, 1, 3, 13, "time", "time", "time", "NOUN", "NN", "dobj", 1), (1, 1, 4, 17, ".", ".", ".", "PUNCT", ".", "punct", 1),
]


def test_graph_rule(spark):
    d = spark.createDataFrame([(1, "This buys us time.")], "doc_id bigint, text string")
    v = V.with_views(d)
    b = V.blocks(V.lines(v))
    t = spark.createDataFrame(TOKENS, graph.TOKENS_DDL)
    rules = [r for r in RULES if r.id in ("verb.buys-us", "verb.lands")]
    got = graph.graph_findings(t, v, b, V.sentences(b), rules).collect()
    assert [(r.rule_id, r.span_start, r.span_end) for r in got] == [("verb.buys-us", 0, 12)]
    assert [tuple(m) for m in got[0].marks] == [(0, 4), (5, 9), (10, 12)]


def test_graph_relations_and_empty(spark):
    t = spark.createDataFrame(TOKENS, graph.TOKENS_DDL)
    node = lambda n, a, l=None, op=None: {"RIGHT_ID": n, "RIGHT_ATTRS": a} | ({"LEFT_ID": l, "REL_OP": op} if l else {})  # noqa: E731, E741
    n = lambda op, a, b: graph.match(t, [node("a", a), node("b", b, "a", op)]).count()
    assert n(">", {"LEMMA": "buy"}, {}) == 4 and n(">--", {"LEMMA": "buy"}, {}) == 1 and n(">>", {"LEMMA": "buy"}, {"LOWER": {"REGEX": "^t"}}) == 2
    assert n("$+", {"LOWER": "us"}, {}) == 1 and n("$++", {"LOWER": "us"}, {}) == 2 and n("$--", {"LOWER": "us"}, {"POS": {"IN": ["PRON"]}}) == 1
    assert graph.match(t.limit(0), [node("a", {}), node("b", {}, "a", ">>")]).count() == 0


def test_settle(spark):
    f = spark.createDataFrame([(1, 1, "v"), (1, 2, "r"), (1, 3, "n"), (2, 1, "v"), (2, 2, "r")], "doc_id bigint, finding_no bigint, rule_id string")
    rules = spark.createDataFrame([("v", 0.7, False), ("r", 0.7, True), ("n", None, False)], "rule_id string, veto_threshold double, veto_required boolean")
    j = spark.createDataFrame([(1, 1, 0.7, False), (1, 2, 0.2, False), (2, 1, 0.9, False), (2, 2, 0.1, True)], "doc_id bigint, finding_no bigint, probability double, failed boolean")
    got = sorted((r.doc_id, r.finding_no) for r in judgments.settle(f, rules, j).collect())
    assert got == [(1, 2), (1, 3), (2, 1)]


def test_reference_outcomes(spark):
    c = spark.createDataFrame([(1, 0, k, False) for k in range(8)] + [(1, 9, 0, True)], "doc_id bigint, paragraph_start bigint, candidate_no int, context_truncated boolean")
    p = {"clear": 0.05, "unclear": 0.9, "uncertain": 0.05}
    a = spark.createDataFrame([(1, 0, k, "choice", "unclear", 0.95, p, "m", False) for k in range(8)] + [(1, 9, 0, "choice", "unclear", 0.95, p, "m", False)], "doc_id bigint, paragraph_start bigint, candidate_no int, type string, label string, confidence double, probabilities map<string,double>, model string, failed boolean")
    got = {(r.paragraph_start, r.candidate_no): r.status for r in judgments.reference_outcomes(c, a, "m", 0.8).collect()}
    assert got[(0, 0)] == "unclear" and got[(9, 0)] == "context_incomplete"
    wrong = {r.status for r in judgments.reference_outcomes(c, a.withColumn("model", F.lit("x")), "m", 0.8).collect()}
    assert wrong == {"model_mismatch", "request_failed"}
    assert {r.status for r in judgments.reference_outcomes(c, a, "m", 0.8, enabled=False).collect()} == {"missing_key"}


def test_lint_options_and_edge_rows(spark):
    d = spark.createDataFrame([(1, "In conclusion, it works — fine.\n\n> In conclusion, quoted.", "x"), (2, None, "x"), (3, "", "x")], "doc_id bigint, text string, rule_id string")
    only = Options(only=frozenset(("phrase.signposted-conclusion", "punct.em-dash")))
    got = lint(d, only).orderBy("doc_id", "finding_no").collect()
    assert [(r.doc_id, r.finding_no, r.rule_id) for r in got] == [(1, 1, "phrase.signposted-conclusion"), (1, 2, "punct.em-dash"), (1, 3, "phrase.signposted-conclusion")]
    skipped = lint(d, Options(only=only.only, skip_quotes=True)).collect()
    assert len(skipped) == 2
    assert lint(d.limit(0), only).count() == 0


EXAMPLES = [
    ("Every plan counts, every map matters, every legend helps.", "template.echo-triplet"), ("Same tool, different hands.", "template.verbless-pair"), ("It shipped \U0001F680 today.", "punct.emoji"),
    ("The list is long and complete, and both properties are required.", "template.appended-backreference"), ("Two options, both bad.", "template.count-opener"),
]


def test_patterns_run_in_the_jvm(spark):
    """Every pattern and exception of the catalogue compiles where it will run; those written in another dialect match there."""
    regex_rules.compiled(spark, RULES)
    bad = C.rule_from({"id": "phrase.x", "severity": "bite", "message": "m", "pattern": "(?P<a_b>x)"}, "phrase")
    with pytest.raises(C.CatalogueError):
        regex_rules.compiled(spark, [bad])
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXAMPLES)], "doc_id bigint, text string")
    got = {(r.doc_id, r.rule_id) for r in regex_rules.regex_findings(V.with_views(d), C.select(RULES, no_emoji=True)).collect()}
    assert lint(d).count() > 2
    assert [r for i, (_, r) in enumerate(EXAMPLES) if (i, r) not in got] == []


def test_located_against_a_loop(spark):
    rnd = random.Random(3)
    cut = {k: sorted(rnd.sample(range(60), 8)) for k in range(30)}
    iv = [(k, a, b) for k, c in cut.items() for a, b in zip(c[::2], c[1::2])]
    pts = [(k, rnd.randint(0, 60), "p") for k in range(32) for _ in range(6)] * 2
    i = spark.createDataFrame(iv, "doc_id bigint, span_start bigint, span_end bigint")
    p = spark.createDataFrame(pts, "doc_id bigint, span_start bigint, tag string")
    got = sorted((r.doc_id, r.span_start, r.x and (r.x.span_start, r.x.span_end), r.y) for r in regex_rules.located(p, x=i, y=i.limit(0)).collect())
    want = sorted((k, a, next(((s, e) for d, s, e in iv if d == k and s <= a < e), None), None) for k, a, _ in pts)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_noun_gates(spark):
    """A cluster that names code, or reads alone as a gerund with its object, is none; marks of code cover all of it."""
    d = spark.createDataFrame([(1, "`make all` cache size."), (2, "Testing cache size."), (3, "disk cache size.")], "doc_id bigint, text string")
    v = V.with_views(d)
    b = V.blocks(V.lines(v))
    rows = []
    for doc, words in ((1, ("Bob", "cache", "size")), (2, ("Testing", "cache", "size")), (3, ("disk", "cache", "size"))):
        at = {1: (0, 11, 17), 2: (0, 8, 14), 3: (0, 5, 11)}[doc]
        rows += [(doc, 1, i, at[i], w, w.lower(), w.lower(), "NOUN", "NN", "compound" if i < 2 else "ROOT", min(i + 1, 2)) for i, w in enumerate(words)]
    t = spark.createDataFrame(rows, graph.TOKENS_DDL)
    rule = C.rule_from({"id": "noun.three", "severity": "bark", "message": "m", "dependency": [[{"RIGHT_ID": "a", "RIGHT_ATTRS": {"POS": "NOUN"}}, {"LEFT_ID": "a", "REL_OP": ">", "RIGHT_ID": "b", "RIGHT_ATTRS": {"POS": "NOUN"}}, {"LEFT_ID": "b", "REL_OP": ">", "RIGHT_ID": "c", "RIGHT_ATTRS": {"POS": "NOUN"}}]]}, "noun")
    s = V.sentences(b)
    assert {r.doc_id for r in graph.graph_findings(t, v, b, s, [rule]).collect()} == {2, 3}
    todo = graph.isolated_spans(t, v, b, s, [rule]).collect()
    assert [(r.doc_id, r.text) for r in todo] == [(2, "Testing cache size")]
    alone = spark.createDataFrame([(2, 0, todo[0].span_end, 0, "VERB", "VBG", "ROOT", 0), (2, 0, todo[0].span_end, 2, "NOUN", "NN", "dobj", 0)], "doc_id bigint, span_start bigint, span_end bigint, i int, pos string, tag string, dep string, head_i int")
    assert {r.doc_id for r in graph.graph_findings(t, v, b, s, [rule], isolated=alone).collect()} == {3}
    lex = spark.createDataFrame([("disk", "VERB")], "form string, upos string")
    assert {r.doc_id for r in graph.graph_findings(t, v, b, s, [rule], lex).collect()} == {2}


def test_ancestors(spark):
    rnd = random.Random(5)
    heads = {(1, b): [0] + [rnd.randint(0, i - 1) for i in range(1, 40)] for b in range(6)} | {(2, 1): [1, 0, 1, 9]}
    rows = [(d, b, i, 0, "x", "x", "x", "X", "X", "dep", h) for (d, b), hs in heads.items() for i, h in enumerate(hs)]
    got = {(r.doc_id, r.block_id, r.i): list(r.above) for r in graph.with_ancestors(spark.createDataFrame(rows + rows[:50], graph.TOKENS_DDL)).collect()}
    for (d, b), hs in heads.items():
        for i in range(len(hs)):
            want, k = [], i
            while hs[k] != k and hs[k] < len(hs) and hs[k] not in want and hs[k] != i:
                k = hs[k]
                want.append(k)
            assert got[(d, b, i)] == want, (d, b, i)


def test_opening_gate_of_dependency_rules(spark):
    """A dependency rule with opening_reference fires where its match opens the document."""
    rule = next(r for r in RULES if r.id == "verb.demonstrative-enables")
    assert rule.opening_reference
    d = spark.createDataFrame([(1, "This enables growth."), (2, "Some words. This enables growth."), (3, "> quoted\n\nThis enables growth.")], "doc_id bigint, text string")
    v = V.with_views(d)
    b = V.blocks(V.lines(v))
    m = b.where("kind = 'paragraph'").select("doc_id", F.lit(rule.id).alias("rule_id"), (F.col("span_end") - 20).alias("span_start"), F.struct("kind", "span_end").alias("b")).join(v.select("doc_id", "text", "prose"), "doc_id")
    assert {r.doc_id for r in regex_rules.opening_only(m, b, [rule]).collect()} == {1}

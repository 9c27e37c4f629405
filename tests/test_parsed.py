from __future__ import annotations

import json

from pyspark.sql import functions as F

from lectern.operators import graph, metrics, parsed_metrics, screening
from lectern.operators import views as V
from lectern.sources import sessions


def prose(spark, texts):
    return metrics.Prose.of(V.with_views(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))


def clause(doc, block, text):
    """A hand-made parse: the, noun, verb, rest."""
    w = text.split()
    rows = [(doc, block, 0, 0, w[0], w[0].lower(), w[0].lower(), "DET", "DT", "det", 1), (doc, block, 1, 0, w[1], w[1], w[1], "NOUN", "NN", "nsubj", 2), (doc, block, 2, 0, w[2], w[2], w[2].rstrip("s"), "VERB", "VBZ", "ROOT", 2)]
    return rows + [(doc, block, i, 0, x, x, x, "NOUN", "NN", "dobj", 2) for i, x in enumerate(w[3:], 3)]


def test_parallel_triples(spark):
    s = "The cat runs home, the dog runs home, and the bird runs home. "
    p = prose(spark, [s + "A plain line stands here. " + s, s, "The cat runs home, the cat runs home, and the bird runs home. " + s, None])
    todo = parsed_metrics.pieces_to_parse(p).collect()
    assert len(todo) == 15
    t = spark.createDataFrame([r for x in todo for r in clause(x.doc_id, x.block_id, x.text)], graph.TOKENS_DDL)
    got = {r.doc_id: (r.value, r.span_start) for r in parsed_metrics.parallel_clause_repeats(p, t).collect()}
    assert got == {0: (2.0, 0), 1: (0.0, None), 2: (1.0, 62), 3: (0.0, None)}
    a = parsed_metrics.assertions(t).where("doc_id = 1").orderBy("block_id").collect()
    assert [r.subject for r in a] == ["the cat", "the dog", "the bird"]


def test_staccato(spark):
    beat = "The whole team met in the large room today. Fast. Clean. Simple. Then everybody went back to work again."
    p = prose(spark, [beat, beat.replace("Simple.", "Fast."), "Fast.\n\n# Head\n\nClean.\n\nSimple and long enough to be a full sentence here.", 'He said "Fast. Clean. Simple." to the whole large team today.', ""])
    todo = parsed_metrics.beats_to_parse(p).collect()
    t = spark.createDataFrame([(x.doc_id, x.block_id, 0, 0, x.text, x.text.lower(), x.text.lower(), "ADJ", "JJ", "ROOT", 0) for x in todo], graph.TOKENS_DDL)
    got = {r.doc_id: r.value for r in parsed_metrics.staccato_beats(p, t).collect()}
    assert got == {0: 3.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    verbs = t.withColumn("pos", F.lit("VERB"))
    assert {r.value for r in parsed_metrics.staccato_beats(p, verbs).collect()} == {0.0}


def test_code_restored(spark):
    d = spark.createDataFrame([("Use `make all` now, not `x`.",)], "text string")
    v = V.with_views(d)
    assert v.select(V.prose_with_code(F.col("text"), F.col("prose"), F.lit(0), F.lit(19))).first()[0] == "Use `make all` now,"


def test_incomplete_and_trajectories(spark):
    rows = [('{"truncated": true}', True), ('{"finish_reason": "length"}', True), ('{"tool_calls": []}', False), ('{"tool_calls": [{"a": 1}]}', True), ("{}", False), (None, False)]
    d = spark.createDataFrame(rows, "j string, want boolean")
    assert all(r.got == r.want for r in d.select(screening.incomplete(F.col("j")).alias("got"), "want").collect())
    line = json.dumps({"message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Write", "input": {"content": "body", "file_path": "a.md"}}, {"type": "tool_use", "name": "Read", "input": {}}]}})
    got = sessions.trajectory_texts(spark.createDataFrame([("p", 1, line), ("p", 2, "{")], "source_path string, line_no int, value string")).orderBy("block_no").collect()
    assert [(r.kind, r.text) for r in got] == [("text", "hi"), ("write", "body")]


def test_prefix_grammar(spark):
    t = spark.createDataFrame(clause(1, 1, "The cat runs home") + [(2, 1, 0, 0, "cats", "cats", "cat", "NOUN", "NNS", "ROOT", 0)], graph.TOKENS_DDL)
    assert {r.doc_id: r.reason for r in graph.grammar_rejection(t, ["doc_id"]).collect()} == {1: "finite_verb", 2: None}
    assert [r.doc_id for r in graph.nominal(t, ["doc_id"]).collect()] == [2]
    lex = spark.createDataFrame([("sorted", "VBN"), ("run", "VB")], "form string, tag string")
    assert graph.participles(spark.createDataFrame([("Sorted",), ("run",)], "word string"), lex).count() == 1


def test_lint_runs_the_parsed_rules(spark):
    from lectern.plans.lint import Options, lint

    beat = "The whole team met in the large room today. Fast. Clean. Simple. Then everybody went back to work again."
    d = spark.createDataFrame([(1, "Your data, simplified."), (2, "We run, simplified."), (3, " ".join([beat] * 3))], "doc_id bigint, text string")
    word = lambda doc, block, w, pos, tag: (doc, block, 0, 0, w, w.lower(), w.lower(), pos, tag, "ROOT", 0)
    prefixes = spark.createDataFrame([word(1, 0, "data", "NOUN", "NNS"), word(2, 0, "run", "VERB", "VBP")], graph.TOKENS_DDL)
    p = prose(spark, ["", "", "", " ".join([beat] * 3)])
    beats = spark.createDataFrame([word(x.doc_id, x.block_id, x.text, "ADJ", "JJ") for x in parsed_metrics.beats_to_parse(p).collect()], graph.TOKENS_DDL)
    only = Options(only=frozenset({"phrase.detached-outcome", "doc.staccato-beats"}))
    got = {(r.doc_id, r.rule_id) for r in lint(d, only, parsed={"prefixes": prefixes, "beats": beats}).collect()}
    assert got == {(1, "phrase.detached-outcome"), (3, "doc.staccato-beats")}
    assert lint(d, only).count() == 0

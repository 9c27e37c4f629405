from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import metrics, screening, structural, study
from lectern.operators import views as V
from lectern.sources import files, sessions


def test_screening(spark):
    words = "one two three four five six seven eight nine"
    rows = [
        (1, "d", 1, 0, "user", f"please repeat {words}", None), (2, "d", 1, 1, "assistant", f"sure {words}", None), (3, "d", 2, 0, "assistant", "mail me at a@b.org", None),
        (4, "d", 3, 0, "assistant", "a fine text", None), (5, "d", 4, 0, "assistant", "a fine text", None), (6, "d", 5, 0, "assistant", None, None), (7, "d", 6, 0, "assistant", "<think>x</think>", None),
    ]
    t = spark.createDataFrame(rows, "record_id bigint, dataset string, row_index bigint, turn_index bigint, role string, text string, reason string").drop("reason")
    got = {r.record_id: r.reason for r in screening.screened(t).collect()}
    assert got == {2: "nonassistant_overlap", 3: "conservative_privacy_prose_screen", 4: None, 5: "duplicate", 6: "empty_or_size_or_content_schema", 7: "reasoning_marker"}
    assert screening.screened(t.limit(0)).count() == 0


def test_budget_and_sample(spark):
    d = spark.createDataFrame([(i, f"t{i}", "g") for i in range(50)], "i int, t string, g string")
    assert sorted(r.i for r in screening.within_budget(d, ["i"], F.lit(10), max_bytes=95).collect()) == list(range(9))
    assert screening.within_budget(d, ["i"], F.lit(10), max_rows=7).count() == 7
    assert screening.group_sample(d.union(d), "g", "t", 5).count() == 5


def test_cases(spark, tmp_path):
    good = {"id": "a", "text": "t", "expected": {"empty_roadmap": True}, "split": "train", "provenance": "p"}
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps(good) + "\n" + json.dumps(good | {"id": "b"}))
    assert structural.read_cases(spark, str(p)).count() == 2
    for bad in (good, good | {"id": "c", "expected": {"unknown": True}}, good | {"id": " "}):
        p.write_text(json.dumps(good) + "\n" + json.dumps(bad))
        with pytest.raises(structural.CaseError):
            structural.read_cases(spark, str(p)).count()


def test_bands(spark):
    d = spark.createDataFrame([(0.9,), (0.1,), (0.5,), (None,), (1.5,)], "p double")
    assert [r[0] for r in d.select(structural.band(F.col("p"))).collect()] == ["flagged", "clear", "review", "error", "error"]


def test_sessions(spark):
    line = lambda i, blocks: json.dumps({"type": "assistant", "message": {"role": "assistant", "id": i, "model": "m", "content": blocks}})
    text = {"type": "text", "text": "hello"}
    rows = [("s/a.jsonl", 1, line("1", [text])), ("s/a.jsonl", 2, line("1", [{"type": "thinking"}])), ("s/a.jsonl", 3, line("2", [text, text])), ("s/a.jsonl", 4, "{bad"), ("s/a.jsonl", 5, line("3", None))]
    got = sessions.session_records(spark.createDataFrame(rows, "source_path string, line_no int, value string")).collect()
    assert [(r.message_id, r.session_id, r.jsonl_lines, r.text_line) for r in got] == [("1", "a", [1, 2], 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("hé")
    r = files.read_texts(spark, str(tmp_path)).first()
    assert r.text == "hé" and r.bytes == 3
    m = files.manifest(spark.createDataFrame([("x",), ("x",), (None,)], "text string"))
    assert m.count() == 1
    files.write_inventory(m, str(tmp_path / "inv"))
    with pytest.raises(Exception):
        files.write_inventory(m, str(tmp_path / "inv"))
    with pytest.raises(files.ManifestError):
        files.write_inventory(m.withColumn("path", F.lit("../x")), str(tmp_path / "inv2"))
    for bad in ("../a", "/a", "a/../b", "a b"):
        with pytest.raises(files.ManifestError):
            files.safe_path(str(tmp_path), bad)
    (tmp_path / "ln").symlink_to(tmp_path)
    with pytest.raises(files.ManifestError):
        files.safe_path(str(tmp_path), "ln/a")


def test_metrics_neutral_values(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "One line without end"), (4, "A, b, and c. A, b and c. Why? No.\n\nHowever, it is. Every test is one.\n\nEvery test runs.")], "doc_id bigint, text string")
    p = metrics.Prose.of(V.with_views(d))
    got = {(r.doc_id, r.metric): r.value for r in metrics.measured(p).collect()}
    assert all(got[(k, m)] == (1.0 if m == "sentence_length_cv" else 0.0) for k in (1, 2) for m in metrics.METRICS)
    assert got[(4, "connective_openers")] == 1 and got[(4, "every_template_openers")] == 1 and got[(4, "triad_density")] > 0


@pytest.mark.parametrize(
    "path, text, parts",
    [
        ("a.html", "<p>One</p><script>x</script><!-- note --><p>Two</p>", ["One\n\nTwo", "note"]), ("a.py", '"""Doc."""\nx = "no"  # yes\n', ["Doc.", "yes"]), ("a.js", 'let a = "// no"; // yes\n/* and */', ["yes", "and"]),
        ("a.md", "text", ["text"]), ("a.bin", "text", []), (None, None, []), ("a.py", "def (:", []),
    ],
)
def test_artifacts(path, text, parts):
    assert study.artifact_parts(text, path) == parts


def test_clause_parts(spark):
    d = spark.createDataFrame([("the cat ran home, the dog ran home, and the bird ran home",), ("a, b, and c",), ("no commas at all",), ("one two three, four five six, seven eight nine",)], "s string")
    got = [r[0] for r in d.select(study.clause_parts(F.col("s"))).collect()]
    assert got[0] == ["the cat ran home", "the dog ran home", "the bird ran home"] and got[1:] == [None, None, None]


def test_stream(spark, tmp_path):
    from lectern.plans.lint import Options
    from lectern.streaming import lint as L

    spark.createDataFrame([(1, "In conclusion, done.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    out = []
    q = L.lint_stream(L.documents(spark, str(tmp_path / "in"), "doc_id bigint, text string"), lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"), Options(only=frozenset(("phrase.signposted-conclusion",))))
    q.awaitTermination(120)
    assert [r.rule_id for r in out] == ["phrase.signposted-conclusion"]


def test_registry_has_sql_for_known_names():
    from lectern.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


FLAGGED = [
    ('{"a": {"b": [{"flagged": true}]}}', True, True), ('{"categories": {"x": false, "y": true}}', True, True), ('{"text": "\\"toxic\\": true", "toxic": false}', False, False), ('{"t": ": true", "n": 1}', False, False),
    ('{"category_scores": {"x": true}, "z": false}', False, False), ('{"anything": [false, true]}', False, True), ("true", False, True), (None, False, False), ("", False, False), ('{"t": "' + "\\n" * 30000 + 'true"}', False, False),
]


def test_flags_at_any_depth(spark):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(FLAGGED)], "i int, j string, f boolean, a boolean")
    for r in d.select("i", screening.flagged(F.col("j")).alias("gf"), screening.any_true(F.col("j")).alias("ga"), "f", "a").collect():
        assert (r.gf, r.ga) == (r.f, r.a), FLAGGED[r.i][0][:60]


def turn(role, content, **more):
    return {"role": role, "content": content} | more


def test_rows_and_turns_in_order_of_their_reasons(spark):
    row = lambda *turns, **more: json.dumps({"model": "m", "conversation": list(turns)} | more)
    nine = "one two three four five six seven eight nine"
    values = [
        row(turn("user", "hi"), turn("assistant", "fine text"), turn("assistant", "fine text"), turn("assistant", "mail a@b.org"), turn("assistant", " "), turn("assistant", "x", tool_calls=[1]), turn("assistant", "y", finish_reason="length"), turn("assistant", "z", channel="analysis"), turn("assistant", nine), turn("user", nine + "!")),
        json.dumps({"row": {"model": "m", "conversation": []}, "truncated_cells": ["conversation"]}), row(turn("assistant", "y", toxic=True)), "[1]", "{", json.dumps({"model": "m"}), json.dumps({"model": " ", "conversation": []}), json.dumps({"row": {"model": "m", "conversation": []}, "row_idx": -1}),
        row(turn("user", "x" * (4 * 1024 * 1024 + 1)), turn("assistant", "ok")), json.dumps({"row": {"model": "m", "conversation": [turn("assistant", "other", language="ja")]}, "row_idx": 7}), None, row(*[turn("user", "u")] * 1001),
    ]
    d = spark.createDataFrame(list(enumerate(values)), "row_no bigint, value string")
    rows = screening.parsed_rows(d)
    assert {r.row_no: r.row_reason for r in rows.collect()} == {0: None, 1: "cut_cells", 2: "flagged_row", 3: "no_object", 4: "no_object", 5: "no_turns", 6: "bad_model", 7: "bad_index", 8: "too_much_text", 9: None, 10: "no_object", 11: "no_turns"}
    got = {(r.row_index, r.turn_index): r.reason for r in screening.parsed_turns(rows).collect()}
    assert got == {
        (0, 1): None, (0, 2): "duplicate", (0, 3): "conservative_privacy_prose_screen", (0, 4): "empty_or_size_or_content_schema", (0, 5): "incomplete_or_tool_or_reasoning", (0, 6): "incomplete_or_tool_or_reasoning", (0, 7): "reasoning_marker", (0, 8): "nonassistant_overlap", (7, 0): None,
    }
    assert [(r.row_index, r.turn_index) for r in screening.parsed_turns(rows, "Japanese").collect()] == [(7, 0)]
    n = {r.reason: r.n for r in screening.all_rejections(rows, screening.parsed_turns(rows)).collect()}
    assert n["no_object"] == 3 and "duplicate" not in n and sum(n.values()) == 16
    screening.bounds(1, 100_000)
    for bad in ((0, 1), (10_001, 1), (1, 0), (True, 1), (1, "2")):
        with pytest.raises(screening.BoundsError):
            screening.bounds(*bad)


def test_arena(spark):
    eight = "a b c d e f g h"
    rows = [
        {"language": "English", "model_a": "m", "model_b": "n", "conversation_a": [turn("user", "say " + eight), turn("assistant", "first"), turn("assistant", eight)], "conversation_b": [turn("assistant", "first"), turn("assistant", "cut", truncated=True)]},
        {"language": "English", "model_a": "m", "model_b": None, "conversation_a": [turn("assistant", "first"), turn("assistant", "mail @ me")], "conversation_b": [turn("assistant", "no model")]},
        {"openai_moderation": [{"flagged": True}], "model_a": "m", "conversation_a": [turn("assistant", "bad")]}, {"language": "Japanese", "model_a": "o", "conversation_a": [turn("assistant", "later")]},
    ]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, None), (10, "{")], "row_index bigint, value string")
    key = lambda x: sorted((r.row_index, r.side, r.turn_index, r.text) for r in x.collect())
    assert key(screening.arena_records(d)) == [(0, "a", 1, "first"), (0, "b", 0, "first"), (3, "a", 0, "later")]
    assert key(screening.arena_records(d, 1)) == [(0, "a", 1, "first")] and key(screening.arena_records(d, language="japanese")) == [(3, "a", 0, "later")]
    assert len(key(screening.arena_records(d, screen=lambda c: c != "later"))) == 3


def test_budget_by_group_and_first_rows(spark):
    d = spark.createDataFrame([(i, "hot" if i % 10 else None) for i in range(300)], "i int, g string")
    got = sorted(r.i for r in screening.within_budget(d, ["i"], F.lit(10), 50, 95, ["g"]).collect())
    assert got == sorted([i for i in range(300) if i % 10][:9] + [i for i in range(0, 300, 10)][:9])
    assert sorted(r.i for r in screening.first_per_group(d, "g", ["i"], 3).collect()) == [0, 1, 2, 3, 10, 20]

from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, reader, reduce, references, structural, study
from lectern.operators import views as V
from lectern.plans import run
from lectern.plans.lint import Options, lint
from lectern.sources import acquire, files
from lectern.sources.catalogue import CatalogueError

LONG = "This paragraph goes on. " * 20


def tree(doc, block, words, det=(), pron=()):
    """Tokens of a text by blanks; the places of determiners and of bare pronouns."""
    out, at = [], 0
    for i, w in enumerate(words.split(" ")):
        if w:
            bare = w.strip(".,")
            out.append((doc, block, i, at, bare, bare.lower(), bare.lower(), "DET" if i in det else "PRON" if i in pron else "NOUN", "DT", "det" if i in det else "nsubj", i + 1 if i in det else 0))
        at += len(w) + 1
    return out


def test_reference_review(spark):
    texts = {1: "# Setup\n\nThe cache holds this value. These are old.", 2: LONG, 3: "    this is code", 4: None, 5: 'Read "the old note" and that.'}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    v = reader.with_reader_view(V.with_views(d))
    b = V.blocks(V.lines(v))
    rows = references.paragraphs(v, b)
    got = {r.doc_id: r for r in rows.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "pending", 2: "skipped_length", 3: "no_candidates", 5: "pending"} and got[1].heading == "Setup" and got[1].preceding_context == "# Setup" and not got[1].context_truncated
    asked = {r.doc_id: r.text for r in references.targets(rows, v).collect()}
    assert asked == {1: "The cache holds this value. These are old.", 5: "Read                and that."}
    tokens = spark.createDataFrame(tree(1, 2, texts[1][9:], det=(0, 3), pron=(5,)) + tree(5, 1, "Read                and that.", pron=(17,)), graph.TOKENS_DDL)
    chunks = spark.createDataFrame([(1, 2, 0, 1), (1, 2, 3, 4)], "doc_id bigint, block_id bigint, start_i int, end_i int")
    found = references.candidates(rows, v, tokens, chunks)
    assert [(r.doc_id, r.candidate_no, r.reference) for r in found.orderBy("doc_id", "candidate_no").collect()] == [(1, 0, "The cache"), (1, 1, "this value"), (1, 2, "These"), (5, 0, "that")]
    asks = references.requests(rows, found, "Is it clear?", {"clear": "yes", "unclear": "no"}, "m", batch=2).orderBy("doc_id", "request_no").collect()
    assert [(r.doc_id, r.request_no) for r in asks] == [(1, 1), (1, 2), (5, 1)]
    one = json.loads(asks[0].request)
    assert [x["text"] for x in one["state"]["references"]] == ["The cache", "this value"] and set(one["questions"]) == {"reference_0", "reference_1"}
    p = {"clear": 0.05, "unclear": 0.9, "uncertain": 0.05}
    answers = spark.createDataFrame([(1, 9, 0, "choice", "unclear", 0.95, p, "m", False), (1, 9, 1, "choice", "unclear", 0.2, p, "m", False), (5, 0, 0, "choice", "clear", 0.9, {"clear": 1.0, "unclear": 0.0, "uncertain": 0.0}, "m", False)], "doc_id bigint, paragraph_start bigint, candidate_no int, type string, label string, confidence double, probabilities map<string,double>, model string, failed boolean")
    out = references.review(rows, found, answers, "m", 0.8)
    status = {(r.doc_id, r.candidate_no): r.status for r in out.collect()}
    assert status == {(1, 0): "unclear", (1, 1): "low_confidence", (1, 2): "missing_answer", (2, None): "skipped_length", (3, None): "no_candidates", (5, 0): "clear"}
    assert [(r.doc_id, r.span_start, r.span_end) for r in references.review_findings(out, "noun.unclear-reference", "sniff", 2).collect()] == [(1, 9, 18)]
    assert references.review_summary(out).first().message == "1 references clear, 1 unclear, 0 uncertain, 3 not decided"
    assert references.paragraphs(v.limit(0), b.limit(0)).count() == 0
    whole = lint(d, Options(only=frozenset({"noun.unclear-reference"})), parsed={"targets": tokens, "chunks": chunks, "reference_answers": answers}, reference_model="m")
    assert [(r.doc_id, r.rule_id, r.span_start, r.span_end) for r in whole.collect()] == [(1, "noun.unclear-reference", 9, 18)]
    with pytest.raises(CatalogueError):
        lint(d, Options(lang="xx"), tokens={"en": tokens})


def test_candidates_do_not_cross_hidden_text(spark):
    d = spark.createDataFrame([(1, "We read this <!-- no --> note."), (2, "We read the <!-- no --> note.")], "doc_id bigint, text string")
    v = reader.with_reader_view(V.with_views(d))
    rows = references.paragraphs(v, V.blocks(V.lines(v)))
    tokens = spark.createDataFrame([(k, 1, i, at, w, w, w, "DET" if i == 2 else "NOUN", "DT", "det" if i == 2 else "dobj", 3) for k, det in ((1, "this"), (2, "the")) for i, (at, w) in enumerate(((0, "we"), (3, "read"), (8, det), (25 if k == 1 else 24, "note")))], graph.TOKENS_DDL)
    chunks = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 2, 3)], "doc_id bigint, block_id bigint, start_i int, end_i int")
    assert [(r.doc_id, r.span_start, r.span_end, r.reference) for r in references.candidates(rows, v, tokens, chunks).collect()] == [(1, 8, 12, "this")]


def test_run_over_files(spark, tmp_path, capsys):
    a, b = tmp_path / "b.md", tmp_path / "a.md"
    a.write_text("In conclusion, it works.\n\nIn conclusion, it works again.")
    b.write_text("In conclusion, one more.\n")
    out = io.StringIO()
    only = ["--only", "phrase.signposted-conclusion"]
    assert run.main([str(a), str(b), *only], spark, out) == 1
    text = out.getvalue()
    assert text.index("b.md:1:1") < text.index("b.md:3:1") < text.index("a.md:1:1") and text.count("^^^") >= 3 and "3 bites" in text and "phrase.toml" in text
    assert run.main([str(tmp_path / "none.md")], spark, out) == 2 and run.main(["--only", "phrase.none", str(a)], spark, out) == 2
    out = io.StringIO()
    assert run.main(only, spark, out, io.StringIO("All is well.")) == 0 and "0 bites" in out.getvalue()
    assert run.main([], spark, out, io.StringIO("  ")) == 2
    (tmp_path / "c.md").write_bytes(b"\xff\xfe bad")
    assert run.main([str(tmp_path / "c.md"), *only], spark, out) == 2
    out = io.StringIO()
    assert run.main(["--list-rules", "--disable-category", "phrase,doc"], spark, out) == 0 and "phrase." not in out.getvalue()


def test_acquire(spark, tmp_path):
    cat = tmp_path / "d.json"
    cat.write_text(json.dumps([{"name": "a", "kind": "viewer"}, {"name": "b", "kind": "arena"}]))
    assert acquire.datasets(spark, str(cat)).count() == 2
    cat.write_text(json.dumps([{"name": "a", "kind": "viewer"}, {"name": "a", "kind": "arena"}]))
    with pytest.raises(acquire.AcquireError):
        acquire.datasets(spark, str(cat))
    row = lambda i: json.dumps({"row": {"model": "m", "conversation": [{"role": "assistant", "content": f"text {i}"}]}, "row_idx": i})
    rows = spark.createDataFrame([(i, row(i)) for i in range(20)], "row_no bigint, value string")
    got, about = acquire.sampled("viewer", rows, 5, revisions=("r1", "r1"))
    assert [r.text for r in got.orderBy(F.col("source").cast("int")).collect()] == [f"text {i}" for i in range(5)] and about.first().reason == "limit"
    got, about = acquire.sampled("viewer", rows, 100, max_rows=7)
    assert got.count() == 7 and about.first().reason == "rows_or_bytes" and acquire.sampled("viewer", rows, 100)[1].first().reason == "end"
    for bad in ({"revisions": ("r1", "r2")}, {"revisions": (None, None)}, {"language": "Japanese"}):
        with pytest.raises(acquire.AcquireError):
            acquire.sampled("viewer", rows, 5, **bad)
    arena = spark.createDataFrame([(0, json.dumps({"model_a": "m", "conversation_a": [{"role": "assistant", "content": "hi"}]}))], "row_index bigint, value string")
    assert acquire.sampled("arena", arena, 5)[0].count() == 1
    m = acquire.store(got, "file://" + str(tmp_path / "out"), "a")
    assert m.count() == 7 and not any(p.name.startswith(".pending") for p in (tmp_path / "out").iterdir())
    with pytest.raises(files.ManifestError):
        acquire.store(got, "file://" + str(tmp_path / "out"), "a")


def test_structural_requests_and_scores(spark):
    c = spark.createDataFrame([("a", "t", {"x": True, "y": False}), ("b", " ", {"x": False}), ("c", None, None)], "id string, text string, expected map<string,boolean>")
    asks = structural.requests(c, {"x": ("q?", "yes", "no"), "y": ("r?", "yes", "no")}, "m").collect()
    assert [r.id for r in asks] == ["a"] and set(json.loads(asks[0].request)["questions"]) == {"x", "y"}
    a = spark.createDataFrame([("a", "x", 0.95), ("a", "y", None)], "id string, feature string, probability double")
    got = {r.feature: r.asDict() for r in structural.scores(c, a).collect()}
    assert got["x"]["tp"] == 1 and got["x"]["not_run"] == 1 and got["y"]["errors"] == 1


def test_study_relations_and_dump(spark):
    rows = [("1", "d", "m", "assistant_message", None, "hello"), ("2", None, None, "write_payload", "a.md", "# Head\n\nText."), ("3", "d", "", "write_payload", "a.bin", "x"), ("4", "d", "m", "write_payload", None, None)]
    got = study.reader_records(spark.createDataFrame(rows, "id string, dataset string, model string, genre string, file_path string, text string")).orderBy("id").collect()
    assert [(r.id, r.grp) for r in got] == [("1", "d/m/assistant"), ("2/extract/0", "unnamed/unattributed/write_payload")]
    n = study.decision_counts(spark.createDataFrame([("g", "a"), ("g", "a"), ("g", None)], "grp string, reason string")).first()
    assert (n.candidates, n.proposals, n.rejections) == (3, 1, {"a": 2})
    t = spark.createDataFrame(tree(1, 1, "the cat", det=(0,)), graph.TOKENS_DDL)
    assert [r.line.split()[-1] for r in graph.dump(t).orderBy("line_no").collect()] == ["cat", "the"]
    e = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in reduce.absent(e, e.where("path = 'a'")).collect()] == ["b"]


def test_streams(spark, tmp_path):
    from lectern.streaming import lint as streaming

    rows = [(1, "In conclusion, it works.", "a", "2024-01-01 10:00:00"), (2, "Plain.", "a", "2024-01-01 11:00:00"), (3, "In conclusion, more. In conclusion, yes.", "b", "2024-01-02 10:00:00"), (4, None, "b", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, at string").select("doc_id", "text", "source", F.col("at").cast("timestamp").alias("loaded_at"))
    d.write.parquet(str(tmp_path / "in"))
    got = []
    only = Options(only=frozenset({"phrase.signposted-conclusion"}))
    ddl = "doc_id bigint, text string, source string, loaded_at timestamp"
    q = streaming.lint_stream(streaming.documents(spark, str(tmp_path / "in"), ddl), lambda f, n: got.extend(f.collect()), "file://" + str(tmp_path / "cp"), only)
    q.awaitTermination()
    assert sorted(r.doc_id for r in got) == [1, 3, 3]
    rates = streaming.rate_by_window(streaming.documents(spark, str(tmp_path / "in"), ddl), "in conclusion")
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.source, r.documents, r.matches) for r in spark.table("rates").collect()} == {("a", 2, 1), ("b", 1, 2)}

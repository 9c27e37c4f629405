from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import copies, language, ledger, markup, mixing, overlap, packing, pieces, queries, sentences, spans, tokens
from lectern.llm.canonical import fold, json_key, source_name, split_name

SF = "/root/testdata/sf0.001"


def save(spark, path, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


CASES = "id string, text string, expected map<string,boolean>, split string, provenance string"


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_p1_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 11))) for _ in range(400)]
    base = [" ".join(rnd.choice(vocab) for _ in range(30)) for _ in range(40)]
    rows = []
    for i in range(160):
        t = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 12])):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        s = " ".join(t)
        rows.append((f"c{i:03d}", s.upper() if i % 7 == 0 else s + "!!", None, rnd.choice([" Train", "train", "dev", "HOLDOUT ", None]), "x"))
    rows += [("e1", "", None, "train", None), ("e2", None, None, "dev", None), ("e3", "…", None, "dev", None), ("s1", "Kurz", None, "train", "x"), ("s2", "kurz.", None, "dev", "x")]
    save(spark, tmp_path, "cases", rows, CASES)
    got = {(r.id_a, r.id_b) for r in overlap.p1_found(spark, str(tmp_path)).collect()}
    norm = lambda t: re.sub(r"\W", "", (t or "").lower())
    want = set()
    for a in rows:
        for b in rows:
            if (a[3] or "").strip().lower() == "train" and b[3] and b[3].strip().lower() != "train":
                x, y = norm(a[1]), norm(b[1])
                if x and y and distance(x, y) * 5 <= max(len(x), len(y)):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want and ("s1", "s2") in got
    total = overlap.p1_overlaps(spark, str(tmp_path)).agg(F.sum("cases")).first()[0]
    assert total == sum(1 for r in rows if r[3] and r[3].strip().lower() != "train" and norm(r[1]))


def test_p1_scattered_edits(spark, tmp_path):
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, want = [], set()
    for i in range(120):
        n = (15, 5, 9, 40, 300, 640)[i % 6]
        t = [rnd.choice(letters) for _ in range(n)]
        u, k = list(t), max(1, n * (8, 10, 12, 15, 18, 20)[i // 6 % 6] // 100)
        for at in [n // 2] if k == 1 else sorted(rnd.sample(range(n), k), reverse=True):
            kind = rnd.choice("srdi") if n > 15 else "s"
            u[at : at + 1] = [] if kind == "d" else [u[at], "7"] if kind == "i" else ["7"]
        rows += [(f"t{i:03d}", "".join(t), None, "train", "x"), (f"u{i:03d}", "".join(u), None, "dev", "x")]
        if distance("".join(t), "".join(u)) * 5 <= max(n, len(u)):
            want.add((f"t{i:03d}", f"u{i:03d}"))
    assert len(want) > 100
    save(spark, tmp_path, "cases", rows, CASES)
    got = {(r.id_a, r.id_b) for r in overlap.p1_found(spark, str(tmp_path)).collect()}
    assert want <= got
    for a, b in got - want:
        x, y = rows[int(a[1:]) * 2][1], rows[int(b[1:]) * 2 + 1][1]
        assert distance(x, y) * 5 <= max(len(x), len(y))


def test_p1_blocks_miss_no_pair():
    rnd = random.Random(8)
    pool = ["".join(rnd.choice(("ab", "abcdefgh", "日本語𝒳🙂ß")[i % 3]) for _ in range(rnd.choice((1, 3, 12, 60)))) for i in range(40)]
    edit = lambda t: "".join(rnd.choice(("", c, c + "x", "z")) if rnd.random() < 0.15 else c for c in t) or "q"
    xs, ys = pool, [edit(rnd.choice(pool)) for _ in range(60)]
    for dense, rows in ((2048, 512), (3, 7)):
        before, (overlap.DENSE, overlap.ROWS) = (overlap.DENSE, overlap.ROWS), (dense, rows)
        i, j, _ = overlap.block_pairs(xs, ys)
        overlap.DENSE, overlap.ROWS = before
        got = set(zip(i.tolist(), j.tolist()))
        want = {(a, b) for a, x in enumerate(xs) for b, y in enumerate(ys) if distance(x, y) * 5 <= max(len(x), len(y))}
        assert want <= got and len(want) > 60
    assert [len(c) for c in overlap.block_pairs(["ab"], [])] == [0, 0, 0]


def test_p1_other_order_is_not_compared():
    rnd = random.Random(4)
    sentences = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(12)]
    texts = ["".join(rnd.sample(sentences, 10)) for _ in range(60)]
    i, j, _ = overlap.block_pairs(texts, texts)
    got = set(zip(i.tolist(), j.tolist()))
    # any two of the texts share most of their runs
    assert {(n, n) for n in range(60)} <= got and len(got) < 60 * 60 // 5


def test_p1_tiles_and_long_lists_miss_no_pair(monkeypatch):
    rnd = random.Random(9)
    texts = ["a" * n for n in (1, 2, 4, 5, 8, 10, 60, 75, 100, 125)] + ["ab" * n for n in (3, 30, 36, 45)] + ["".join(rnd.choice("ab") for _ in range(n)) for n in (59, 60, 61, 74, 75, 93)]
    texts += [t[1:] + "c" for t in texts if len(t) > 4] + [t[: len(t) // 2] + t[len(t) // 2 + len(t) // 5 :] for t in texts]
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if distance(x, y) * 5 <= max(len(x), len(y))}
    for tile, rows, entries in ((1024, 64, 1_000_000), (4, 3, 50)):
        monkeypatch.setattr(overlap, "DENSE", tile)
        monkeypatch.setattr(overlap, "ROWS", rows)
        monkeypatch.setattr(overlap, "ENTRIES", entries)
        i, j, _ = overlap.block_pairs(texts, texts)
        assert want <= set(zip(i.tolist(), j.tolist()))


def test_canonical(spark):
    d = spark.createDataFrame([("Große  SORGFALT!", "GROSSE sorg\u00adfalt"), ("5.5", "5 5"), ("a\u200bb", "AB")], "a string, b string")
    assert all(r[0] == r[1] for r in d.select(fold(F.col("a")), fold(F.col("b"))).collect())
    j = [('{"a": 1.0, "b": "X y", "sha256": "1"}', '{"b":"x Y!","a":1}', True), ('{"a": 1}', '{"a": 2}', False), ('{"a": "\\u00e9"}', '{"a":"é"}', True), ("{bad", "{bad ", True), ('{"a": 10}', '{"a": 1.0}', False), ('{"a":1,"n":null}', '{"a":1}', True)]
    d = spark.createDataFrame(j, "a string, b string, same boolean")
    for r in d.select((json_key(F.col("a"), ("sha256",)) == json_key(F.col("b"), ("sha256",))).alias("eq"), "same").collect():
        assert r.eq == r.same
    p = spark.createDataFrame([("desk-exercises",), ("Source: Desk_Exercises. Collected in batch 1.",), ('{"batch": 2, "source": "DESK-EXERCISES"}',), (" ",), (None,)], "p string")
    assert [r[0] for r in p.select(source_name(F.col("p"))).collect()] == ["desk-exercises"] * 3 + [None, None]
    assert spark.createDataFrame([(" Train\u00a0",)], "s string").select(split_name(F.col("s"))).first()[0] == "train"


MARKUP = [
    ("plain text with 3 < 5, $42 – $47 and C:\\new\\table [12] (x<0) A&B 7 (2 * 3) (\\* 4) #5 ~9 %", ""),
    ("<p>one</p>", "html"), ("a<br>b", "html"), ("x &amp; y", "html"), ("<!-- c -->", "html"), ("<div>open", ""), ("<font color=#123456>open", "html"), ("List<String> x", ""), ("<notatag>x</notatag>", ""),
    ("# Title", "markdown"), ("Title\n=====", "markdown"), ("- item", "markdown"), ("> quote", "markdown"), ("a **b** c", "markdown"), ("a *b* c", "markdown"), ("a `b` c", "markdown"), ("[a](b.md)", "markdown"), ("x[^1]", "markdown"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown"), ("---\ntitle: x\n---\ntext", "markdown"), ("~~x~~", "markdown"), ("```\n<b>x</b> [[y]] $z_1$\n```", "markdown"), ("a * b * c", ""), ("snake_case_name", ""),
    ("[[Page]]", "wiki"), ("{{tpl|a=1}}", "wiki"), ("== Head ==", "wiki"), ("'''bold'''", "wiki"), ("{|\n! a\n|}", "wiki"), ("; term\n: meaning", "wiki"), ("0 == 1, 2 == 2", ""),
    ("\\emph{x}", "latex"), ("\\begin{a}x\\end{a}", "latex"), ("$x_{1}$", "latex"), ("\\[ x \\]", "latex"), ("\\(n\\)", "latex"), ("\\begin{verbatim}\n# x\n**y**\n\\end{verbatim}", "latex"),
    ("<pre><code># no\n**no**</code></pre>", "html"), ("<p>a</p> and **b** and [[c]] and \\cite{d}", "html markdown wiki latex"), ("https://a.b/c_d_e?x=1&y=2", ""), ("", ""), (None, ""),
]


@pytest.mark.parametrize("text, want", MARKUP)
def test_families(text, want):
    bits, view = markup.view(text)
    assert [f for i, f in enumerate(markup.FAMILIES) if bits >> i & 1] == want.split()
    assert len(view) == len(text or "")


def test_clean():
    t = markup.clean("<h2>Head</h2><ul><li>one</li><li>two &amp; three</li></ul><pre><code>x = 1 &lt; 2\n</code></pre><script>no</script>")
    assert t == "## Head\n\n- one\n\n- two & three\n\n```\nx = 1 < 2\n```"
    assert markup.clean("== H ==\n'''b''' [[P|shown]] {{gone|x=1}}") == "== H ==\n".replace("== H ==", "## H") + "b shown"
    assert markup.clean("\\section{S}\n\\textbf{b} $x_{1}$ \\cite{k}\n\\begin{itemize}\n\\item one\n\\end{itemize}").split("\n")[0] == "## S"
    assert markup.clean("**b** [l](u) `c` ~~s~~\n\n* [x] done") == "b l `c` s\n\n- done"
    assert markup.clean(None) == "" and markup.clean("plain, 3 < 5.") == "plain, 3 < 5."


def test_site_templates(spark):
    foot = "<div><p>Footer of the site</p></div>"
    rows = [("documents", i, "h1", f"<p>page {i}</p>{foot}") for i in range(30)] + [("documents", 99, "h2", foot), ("documents", 100, "h1", None)]
    d = spark.createDataFrame(rows, "origin string, rec_id bigint, host string, text string")
    got = {r.rec_id: (r.clean, r.dropped) for r in markup.cleaned(d).collect()}
    assert got[3] == ("page 3", 2) and got[99][0] == "Footer of the site" and got[100] == ("", 0)
    assert markup.cleaned(d.limit(0)).count() == 0


def test_site_templates_do_not_depend_on_the_size_of_the_host(spark):
    foot = "<div><p>Footer of the site</p></div>"
    rows = [("documents", i, "h1", f"<p>page {i}</p>{foot}") for i in range(12)] + [("documents", i, "h1", f"<p>other {i}</p>" if i % 2 else "no HTML") for i in range(100, 1100)]
    d = spark.createDataFrame(rows, "origin string, rec_id bigint, host string, text string")
    assert {(r.clean, r.dropped) for r in markup.cleaned(d).where("rec_id = 3").collect()} == {("page 3", 2)}


def test_site_templates_leave_copied_pages_whole(spark):
    page = "<div><h1>Long read</h1><p>All of it {}.</p></div>"
    rows = [("documents", i, "h", page.format("here") + " " * i) for i in range(40)] + [("documents", 100 + i, "h", f"<div><p>nav bar</p></div><p>own {i}</p>") for i in range(10)]
    d = spark.createDataFrame(rows, "origin string, rec_id bigint, host string, text string")
    got = {r.rec_id: (r.clean, r.dropped) for r in markup.cleaned(d).collect()}
    assert {got[i] for i in range(40)} == {("# Long read\n\nAll of it here.", 0)} and got[103] == ("own 3", 2)
    few = spark.createDataFrame(rows[:40] + rows[40:49], d.schema)
    assert {r.dropped for r in markup.cleaned(few).collect()} == {0}


def test_subtree_hashes_are_of_shape_and_words():
    one = lambda t: {h for _, _, h in markup.subtrees(t)}
    assert one("<div class='a'>\n <p>Say <b>it</b></p></div>") == one("<DIV id=x><p>say   <b>IT</b><!-- no --></p></DIV>")
    assert not one("<div><p>a</p><p>b</p></div>") & one("<div><p>b</p><p>c</p><p>a b</p></div>") - one("<p>b</p>") and not one("<div><p> </p></div>")
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert len(one(deep)) == 3000


@pytest.mark.parametrize("n", [3, 59, 60, 5000])
def test_elements_without_end_tags(n):
    for head, item, foot in (("<ul>", "<li>item {}", "</ul>"), ("<table>", "<tr><td>item {}<td>x", "</table>"), ("<div>", "<p>item {}", "</div>"), ("<dl>", "<dt>item {}<dd>x", "</dl>")):
        text = head + "".join(item.format(i) for i in range(n)) + foot
        shown = markup.clean(text)
        assert "<" not in shown and all(f"item {i}" in shown for i in range(n))
        got = markup.subtrees(text)
        assert any((a, b) == (0, len(text)) for a, b, _ in got)
        if "dt" not in item:  # each item is a subtree, up to the next one
            assert (len(head), len(head) + len(item.format(0))) in {(a, b) for a, b, _ in got}
    assert markup.clean("<p>a<div>b</div></p>c<ul><li>d<ul><li>e</ul><li>f</ul>").split() == ["a", "b", "c", "-", "d", "-", "e", "-", "f"]


def test_p2_found_is_the_whole_operator(spark, tmp_path, monkeypatch):
    save(spark, tmp_path, "documents", [(1, "<p>a</p> **b**", "h"), (2, "plain", "h"), (3, None, None)], "doc_id bigint, text string, source string")
    save(spark, tmp_path, "evaluation", [(4, "\\emph{x}", "d")], "eval_no bigint, context string, dataset string")
    seen, whole = [], markup.cleaned
    monkeypatch.setattr(markup, "cleaned", lambda pages: seen.append(1) or whole(pages))
    assert sorted(tuple(r) for r in markup.p2_found(spark, str(tmp_path)).collect()) == [("documents", 1, "html"), ("documents", 1, "markdown"), ("evaluation", 4, "latex")] and seen


SENTENCES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("Dr. Who met Mr. X at 5.30 p.m. in Oslo. Then he left.", ["Dr. Who met Mr. X at 5.30 p.m. in Oslo.", "Then he left."]),
    ("# Head #\ntext goes\non here.Next one", ["Head", "text goes\non here.", "Next one"]), ("- a b\n- c d\n\nend", ["a b", "c d", "end"]), ('"Stop it!" said Ann. Bob left.', ['"Stop it!" said Ann.', "Bob left."]),
    ('He said "so." Then left.', ['He said "so."', "Then left."]), ("这是吗？”他问道。下一句。", ["这是吗？”", "他问道。", "下一句。"]), ("“好吗？”小组问道。下一句。", ["“好吗？”小组问道。", "下一句。"]),
    ("ทีมงาน เปิด Kafava แปล", ["ทีมงาน", "เปิด Kafava แปल".replace("ल", "ล")]), ("काम हुआ। फिर गया।", ["काम हुआ।", "फिर गया।"]), ("v1.2.3 of a.txt and www.x.org/a.B. Done", ["v1.2.3 of a.txt and www.x.org/a.B.", "Done"]),
    ("We waited... and left. Yip! parser ran.", ["We waited... and left.", "Yip! parser ran."]), ("am 7. Mai kam er. Gut", ["am 7. Mai kam er.", "Gut"]), ("z. B. in Teil 4. Danach", ["z. B. in Teil 4.", "Danach"]), ("", []), (None, []), ("  \n\n ", []), ("***", []),
]


@pytest.mark.parametrize("text, want", SENTENCES)
def test_units(text, want):
    (got,) = sentences.units([text])
    assert [text[a:b] for a, b in got] == want


def test_scan_equals_sequential_machine():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 127, 128, 129, 3000):
        sym = rnd.integers(0, sentences.N_SYMBOLS, n).astype(np.uint8)
        s, want = 0, []
        for x in sym:
            want.append(bool(sentences.CUT[s, x]))
            s = sentences.NEXT[s, x]
        for chunk in (1, 7, 128):
            assert sentences.scan(sym, chunk).tolist() == want


def test_units_do_not_depend_on_the_batch(spark):
    texts = [t for t, _ in SENTENCES] * 3
    random.Random(1).shuffle(texts)
    assert [u.tolist() for u in sentences.units(texts)] == [sentences.units([t])[0].tolist() for t in texts]
    d = spark.createDataFrame([("a", "One. Two", 1)], "id string, t string, span_start int")
    assert sentences.sentence_units(d, "t", ["id"]).count() == 2


def test_ledger_batches(spark, tmp_path):
    d = spark.createDataFrame([(f"k{i % 7}".encode(), i) for i in range(100)], "key binary, rec_id bigint")
    one, three = ledger.Ledger(spark, str(tmp_path / "a"), 8), ledger.Ledger(spark, str(tmp_path / "b"), 8)
    one.absorb(d)
    for k in (2, 0, 1):
        three.absorb(d.where(F.col("rec_id") % 3 == k))
    rows = lambda x: sorted((bytes(r.key), r.n, r.keep_id) for r in x.rows().collect())
    assert rows(one) == rows(three) and sum(r[1] for r in rows(one)) == 100
    three.absorb(d.limit(0))
    assert rows(one) == rows(three)


def test_ledger_joins_touched_buckets_and_is_opened_by_path(spark, tmp_path):
    path = str(tmp_path / "l")
    one = ledger.Ledger(spark, path, 8)
    one.absorb(spark.createDataFrame([(f"k{i}".encode(), i) for i in range(100)], "key binary, rec_id bigint"))
    assert len(one.latest) == 8
    two = ledger.Ledger(spark, path, 64)
    assert (two.buckets, two.latest, two.version) == (8, one.latest, 1)
    two.absorb(spark.createDataFrame([(b"k5", 200), (b"k5", 3)], "key binary, rec_id bigint"))
    assert sorted(v[-2:] for v in two.latest.values()) == ["v1"] * 7 + ["v2"]
    (tmp_path / "l" / "v3" / "bucket=0").mkdir(parents=True)  # a batch that failed half-way
    three = ledger.Ledger(spark, path)
    got = {bytes(r.key): (r.n, r.keep_id) for r in three.rows().collect()}
    assert len(got) == 100 and got[b"k5"] == (3, 3) and got[b"k6"] == (1, 6) and three.version == 3 and three.latest == two.latest


def test_p4(spark, tmp_path):
    save(spark, tmp_path, "evaluation", [(3, "A b.", None), (1, "a  B", None), (2, None, None), (4, "other", None)], "eval_no bigint, sentence string, loaded_at timestamp")
    save(spark, tmp_path, "session_records", [(1, "x", None, None), (2, "X!", "bad", None)], "rec_no bigint, text string, sha256 string, loaded_at timestamp")
    save(spark, tmp_path, "raw_records", [(5, '{"a":1,"sha256":"q"}', None), (6, '{ "a" : 1.0 }', None)], "raw_id bigint, payload string, received_at timestamp")
    got = sorted(tuple(r) for r in copies.p4_found(spark, str(tmp_path)).collect())
    assert got == [("evaluation", 1, 3), ("raw_records", 5, 6), ("session_records", 1, 2)]
    rec = {(r.origin, r.keep_id): r.copies for r in copies.p4_records(spark, str(tmp_path)).collect()}
    assert rec == {("evaluation", 1): 2, ("evaluation", 4): 1, ("raw_records", 5): 2, ("session_records", 1): 2}


def brute_spans(texts, length):
    where = {}
    for k, t in texts.items():
        for i in range(len(t) - length + 1):
            where.setdefault(t[i : i + length], set()).add(k)
    out = set()
    for k, t in texts.items():
        run = None
        for i in range(len(t) - length + 1):
            if len(where[t[i : i + length]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + length
                else:
                    if run:
                        out.add((k, *run))
                    run = [i, i + length]
        if run:
            out.add((k, *run))
    return out


@pytest.mark.parametrize("most", [500, 1])
def test_p5_against_brute_force(spark, most):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdé😀") for _ in range(rnd.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rnd.randint(30, 200))) for _ in range(6)]
    texts = {}
    for k in range(40):
        t = " ".join(word() for _ in range(rnd.randint(0, 120)))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randrange(max(1, len(s) // 3))
            t += s[a : a + rnd.randint(150, 900)] + " ".join(word() for _ in range(rnd.randint(0, 60)))
        texts[k] = t
    texts |= {50: "", 51: "x" * 700, 52: "x" * 900, 53: texts[1]}
    d = spark.createDataFrame([*texts.items(), (60, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.span_start, r.span_end) for r in spans.spans_of(d, max_contexts=most).collect()}
    assert got == brute_spans(texts, 200)
    assert spans.spans_of(d.limit(0)).count() == 0


def test_language_model():
    parts = {"en": ["the reader counts every open note before the meeting", "a writer keeps the list without asking the group"], "de": ["der Leser zählt jede offene Notiz vor der Sitzung", "die Gruppe behält die Liste ohne zu fragen"], "ru": ["читатель считает каждую открытую заметку", "группа хранит список без вопросов"]}
    texts = [t + f" {w}" for v in parts.values() for t in v for w in ("Alpha", "Beta", "Gamma", "Delta")]
    labels = [k for k, v in parts.items() for t in v for _ in range(4)]
    m = language.Model.fit(texts, labels, landmarks=12)
    # the folded table gives the scores of kernel (batch x landmarks) times weights
    assert [m.languages[i] for i in m.score(["the group keeps a note", "die offene Liste", "группа считает список"])[0].argmax(1)] == ["en", "de", "ru"]
    text = "The reader keeps every open note before the meeting. Der Leser zählt jede offene Notiz vor der Sitzung."
    (seg,) = language.segments([text], m)
    assert [m.languages[s[2]] for s in seg] == ["en", "de"]
    assert language.segments([None, "", "123 !!"], m) == [[], [], [(0, 3, -1, 0.0, 0, 0)]] or language.segments(["123 !!"], m)[0][0][2] == -1
    assert not language.is_case({}, None, m.languages)


def test_short_texts_with_a_wrong_label():
    parts = {"en": ["the reader counts every open note before the meeting", "a writer keeps the list without asking the group"], "de": ["der Leser zählt jede offene Notiz vor der Sitzung", "die Gruppe behält die Liste ohne zu fragen"]}
    m = language.Model.fit([t + f" {w}" for v in parts.values() for t in v for w in ("Alpha", "Beta", "Gamma", "Delta")], [k for k, v in parts.items() for _ in v for _ in range(4)], landmarks=8)
    texts = ["Jede offene Notiz.", "Vor der Sitzung. Ohne zu fragen.", "The open note.", "Notiz", "123", None]
    got = language.segments(texts, m)
    found = [language.languages_of(g, m.languages, p) for g, p in zip(got, language.pools(texts, got, m))]
    cases = [language.is_case(f, "en", m.languages, sum(u[5] for u in g)) for f, g in zip(found, got)]
    assert cases == [True, True, False, False, False, False] and [len(f) for f in found] == [1, 1, 1, 1, 0, 0]
    unclear = {0: language.MARGIN - 0.1}
    assert language.is_case(unclear, m.languages[1], m.languages, 12) and not language.is_case(unclear, m.languages[1], m.languages, 4)


def test_p6_held_out_accuracy(spark):
    labelled = language.labelled(spark, "/root/testdata/sf0.01").where("origin = 'documents' and code is not null").limit(400).collect()
    m = language.fitted(spark, "/root/testdata/sf0.01", 100)
    found = [language.languages_of(g, m.languages) for g in language.segments([r.text for r in labelled], m)]
    same = [r.code in {m.languages[k] for k in f} for r, f in zip(labelled, found) if f]
    assert sum(same) / len(same) > 0.9  # about one label in twenty is wrong


@pytest.mark.parametrize("kind", ["long tail", "even", "no small", "thirds", "one size"])
def test_pack_is_whole_and_tight(kind):
    rnd = random.Random(2)
    draw = {
        "long tail": lambda: min(2048, int(rnd.expovariate(1 / 400))), "even": lambda: rnd.randint(0, 2048), "no small": lambda: rnd.randint(600, 1000),
        "thirds": lambda: rnd.choice((682, 683, 400)), "one size": lambda: 256,
    }[kind]
    sizes = [draw() for _ in range(3000)] + [0, 0, 2048]
    boxes = packing.pack(sizes, 2048)
    assert sorted(i for b in boxes for w in b for i in w) == list(range(len(sizes)))
    loads = [sum(sizes[i] for w in b for i in w) for b in boxes]
    least = -(-sum(sizes) // 2048)
    # plain best fit of the sorted sizes, for comparison
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        k = min((r, k) for k, r in enumerate([*rooms, 2048]) if r >= s)[1]
        rooms = rooms + [2048] if k == len(rooms) else rooms
        rooms[k] -= s
    assert max(loads) <= 2048 and len(boxes) <= 1.02 * len(rooms) + 1 and (kind != "long tail" or len(boxes) <= 1.01 * least)
    tier = packing.tiers_of(np.array(sizes), 2048)
    for b in boxes:
        for w in b:  # a window is no longer than the context of its longest item
            assert sum(sizes[i] for i in w) <= 2048 // packing.TIERS[max(tier[i] for i in w)]
    assert packing.pack([], 2048) == []


def test_p7_covers_every_text(spark):
    d = spark.createDataFrame([(1, "word " * 5000), (2, "short"), (3, ""), (4, None), (5, "a b c " * 50)], "doc_id bigint, text string")
    got = packing.packed(packing.items_of(d, 2048), 2048).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5}
    load = Counter()
    for r in got:
        load[r.container] += r.tokens
    assert max(load.values()) <= 2048
    one = sorted((r.span_start, r.span_end) for r in got if r.doc_id == 1)
    assert one[0][0] == 0 and one[-1][1] == 25000 and all(a[1] == b[0] for a, b in zip(one, one[1:]))


def test_poisson_inversion():
    for rate, top in ((0.3, 1), (0.9, 2), (2.5, 4), (3.0, 3), (9.0, 3), (0.0, 3)):
        steps = mixing.inversion(rate, top)
        n = 20_000
        mean = sum(sum(s <= (k + 0.5) / n for s in steps) for k in range(n)) / n
        assert abs(mean - min(rate, top)) < 0.01 and len(steps) <= top


def test_p8(spark, tmp_path):
    save(spark, tmp_path, "documents", [(i, "word " * 50, "big" if i % 5 else "small") for i in range(500)] + [(900, None, "big"), (901, "x", None)], "doc_id bigint, text string, source string")
    save(spark, tmp_path, "mix_targets", [("p", "big", 0.5, 3), ("p", "small", 0.45, 2), ("p", "none", 0.05, 9)], "profile string, source string, target_share double, max_repeats bigint")
    assert sorted(r.source for r in mixing.p8_found(spark, str(tmp_path)).collect()) == ["none", "small"]
    s = {r.source: r for r in mixing.p8_shares(spark, str(tmp_path)).collect()}
    assert s["small"].repeats == 2.0 and abs(s["big"].repeats - 0.625) < 0.12 and s["none"].mixed == 0
    mix = mixing.p8_mix(spark, str(tmp_path)).collect()
    assert max(Counter((r.doc_id) for r in mix).values()) <= 3 and mix == mixing.p8_mix(spark, str(tmp_path)).collect()


def test_pieces():
    rnd = random.Random(6)
    para = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(rnd.randint(20, 120)))
    for text in ("\n\n".join(para() for _ in range(60)), "日本語。" * 3000, "0123456789abcdef" * 2000, "😀" * 3000):
        got = pieces.cut(text, 512, 32)
        assert got[0][0] == 0 and got[-1][2] == len(text) and all(a[2] == b[1] for a, b in zip(got, got[1:]))
        assert all(n <= 512 and tokens.count(text[a:b]) == n for a, _, b, n, _ in got)
        assert all(s <= c for s, c, *_ in got) and all(o == 32 for *_, o in got[1:-1])
    assert pieces.cut(None, 512, 32) == [] and pieces.cut("", 512, 32) == [] and len(pieces.cut("short", 512, 32)) == 1


def test_edit_moves_only_neighbours():
    rnd = random.Random(7)
    text = "\n\n".join(" ".join(rnd.choice(["alpha", "beta", "gamma,", "delta.", "epsilon"]) for _ in range(rnd.randint(20, 90))) for _ in range(200))
    at = len(text) // 2
    a = {c for _, c, *_ in pieces.cut(text, 1024, 64)}
    b = {c if c < at else c - 9 for _, c, *_ in pieces.cut(text[:at] + " inserted"[:9] + text[at:], 1024, 64)}
    assert len(a ^ b) <= 6


def test_offsets():
    t = "naïve 日本 😀 text"
    o = tokens.offsets(t)
    assert o[0] == 0 and o[-1] == len(t) and (np.diff(o) >= 0).all()
    for text in ("word, " * 90, "字" * 70 + "。" + "語" * 99, "a1" * 300, "x" * 500, "tab\t\t  \n" * 60, "it's 3.5% " * 40):
        for size in (64, 100, 333):
            cut = tokens.stretches(text, size)
            assert "".join(cut) == text and max(map(len, cut)) <= size
            whole = len(tokens.encoder().encode_ordinary(text))
            assert sum(len(tokens.encoder().encode_ordinary(c)) for c in cut) == whole or text[0] in "x字t"
    assert tokens.count(None) == 0 and tokens.count("a " * 300_000) == sum(tokens.count(s) for s in tokens.stretches("a " * 300_000))


def test_extra_columns_do_not_clash(spark):
    d = spark.createDataFrame([("documents", 1, "h", "<p>x</p>", 9, "y")], "origin string, rec_id bigint, host string, text string, families int, drop string")
    assert markup.cleaned(d).first().clean == "x"
    t = spark.createDataFrame([("p", "a", 1.0, 2, 5)], "profile string, source string, target_share double, max_repeats bigint, total int")
    x = spark.createDataFrame([(1, "a", 10, 3, "z")], "doc_id bigint, source string, tokens bigint, copies int, steps string")
    assert mixing.replicated(x, t).count() <= 1
    s = spark.createDataFrame([(1, "a" * 300, 0), (2, "a" * 300, 0)], "doc_id bigint, text string, span_start int")
    assert spans.spans_of(s).count() == 2
    p = spark.createDataFrame([(1, 0, 0, 5, 5, "q")], "doc_id bigint, piece int, span_start bigint, span_end bigint, tokens bigint, g string")
    assert packing.packed(p, 8).count() == 1


def test_registered_names():
    names = list(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"p{k}" for k in range(1, 10)} and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_copies_of_hot_groups(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(copies, "HOT", hot)
    rows = [("t", i, i * 10 if i % 3 else None, b"hot" if i % 2 else bytes([i % 7])) for i in range(60)]
    r = spark.createDataFrame(rows, "origin string, rec_id bigint, arrived bigint, key binary")
    ledger_ = copies.absorbed(r)
    got = sorted((x.keep_id, x.copy_id) for x in copies.copies(r, ledger_).collect())
    keep = {}
    for _, i, _, k in rows:
        keep.setdefault(k, i)
    assert got == sorted((keep[k], i) for _, i, _, k in rows if keep[k] != i)
    first = {bytes(x.key): x["first"].id for x in ledger_.rows().collect()}
    assert first == {k: min((i for _, i, a, kk in rows if kk == k), key=lambda i: (i % 3 == 0, i)) for k in keep}


def test_ledger_reads_the_touched_buckets_only(spark, tmp_path):
    r = spark.createDataFrame([(i, bytes([i])) for i in range(40)], "rec_id bigint, key binary")
    one = ledger.Ledger(spark, str(tmp_path / "l"), 8)
    one.absorb(r)
    bucket = one.touched(r.select(one.bucket(F.col("key")).alias("bucket")).limit(1))[0]
    files = one.rows([bucket]).select(F.input_file_name()).distinct().collect()
    assert files and all(f"bucket={bucket}/" in f[0] for f in files)
    assert ledger.Ledger(spark, str(tmp_path / "m")).rows().count() == 0


def test_letters_beyond_the_first_planes():
    _, _, letters, words = language.runs(["𠀀𠀁𪜀 🙂", "\U000e0001", "a b"])
    assert letters.tolist() == [3, 0, 2] and words.tolist() == [1, 0, 2]

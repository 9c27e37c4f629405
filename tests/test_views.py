from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import reader, report
from lectern.operators import views as V

SAMPLE = """---
title: A visible title here
slug: machine-1
layout: two columns wide
---

# Heading with `code` ##

A paragraph with a [lower label](http://x.example/a) and a [Title Label](b.md).
It goes on www.example.org here -- 3 < 5 stays.

- item one
  lazy continuation
1. numbered

> quoted text
> - nested bullet

```py
hidden = 1
```

  ~~~
  also hidden
  ~~~

| a | b |
| - | - |

<!-- a comment
over two lines -->
<Tag attr="x"
  other='y'>shown</Tag>
::: note
“Curly” and **bold** text e.g. this one. Dr. Who came. U.S. policy vs. others.
"""


def collect(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    v = V.with_views(d)
    return d, v


def test_same_length_and_what_is_hidden(spark):
    _, v = collect(spark, [SAMPLE, "", None, "   \n\t\n", "one unterminated line", "a\r\nb 😀 c"])
    rows = v.orderBy("doc_id").collect()
    for r in rows:
        t = r.text or ""
        assert len(r.masked) == len(r.prose) == len(t)
        assert [i for i, c in enumerate(t) if c == "\n"] == [i for i, c in enumerate(r.masked) if c == "\n"]
    m, p = rows[0].masked, rows[0].prose
    for needle in ("hidden = 1", "also hidden", "`code`", "x.example", "www.example", "a comment", "| a |", "Title Label", "machine-1", "two columns", "attr=", "::: note"):
        assert needle not in m, needle
    for needle in ("A visible title here", "lower label", "shown", "3 < 5", "quoted text", "“Curly”"):
        assert needle in m, needle
    assert '"Curly" and   bold   text' in p and "#" not in p.split("\n")[6]


def test_blocks_and_sentences(spark):
    _, v = collect(spark, [SAMPLE, ""])
    b = V.blocks(V.lines(v))
    kinds = [r.kind for r in b.where("doc_id = 0").orderBy("block_id").collect()]
    assert kinds == ["field", "heading", "paragraph", "list", "list", "quote", "paragraph"] or kinds[:6] == ["field", "heading", "paragraph", "list", "list", "quote"]
    s = [r.sentence for r in V.sentences(b).where("doc_id = 0").orderBy("span_start").collect()]
    assert any(x.startswith("item one") and "lazy continuation" in x for x in s)
    assert any(x.endswith("e.g. this one.") for x in s)
    assert "Dr. Who came." in s and "U.S. policy vs. others." in s
    assert b.where("doc_id = 1").count() == 0


def naive(text: str) -> list[str]:
    """Row-at-a-time splitter for the property test."""
    out, at = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s+[\"'(\[]?[A-Za-z0-9]|\s*\Z)", text):
        left, rest = text[at : m.end()], text[m.end() :]
        if re.search(r"\b(?:e\.g|i\.e|vs|etc|Mr|Mrs|Dr|Ms|St|No|Fig|approx|cf)\.$", left, re.I):
            continue
        if re.search(r"\b(?:Inc|Ltd|Co|Corp)\.$|\b(?:[a-z]\.){2,}$", left, re.I) and re.match(r"\s+[\"'(\[]?[a-z]", rest):
            continue
        if re.search(r"\b[A-Z]\.$", left) and re.match(r"\s+[a-z]", rest):
            continue
        out.append(left.strip())
        at = m.end()
    out.append(text[at:].strip())
    return [x for x in out if x]


def test_splitter_against_row_at_a_time(spark):
    import random

    rnd = random.Random(4)
    words = ["Dr.", "e.g.", "vs.", "Inc.", "a.m.", "B.", "end.", "stop!", "why?", '"so."', "word", "Word", "7.", "(x)", "...", "No.", "etc.", "\n"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in d.select("i", F.transform(V.split_sentences(F.col("t")), lambda x: F.substring("t", x["s"] + 1, x["e"] - x["s"])).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == naive(t), t


def test_line_and_column(spark):
    d = spark.createDataFrame([("ab\ncd\n", 0), ("ab\ncd\n", 3), ("ab\ncd\n", 5), ("", 0)], "t string, o int")
    got = [tuple(r.p) for r in d.select(V.line_and_column(F.col("t"), F.col("o")).alias("p")).collect()]
    assert got == [(1, 1), (2, 1), (2, 3), (1, 1)]


@pytest.mark.parametrize(
    "text, hidden, shown",
    [
        ("a <!-- x --> b", ["x"], ["a", "b"]),
        ("[label](http://a(b)c) z", ["http"], ["label", "z"]),
        ("<script>var a = '<b>'</script>after", ["var"], ["after"]),
        ("`<b>code</b>` stays", [], ["<b>code</b>"]),
        ("[ref]: http://x\ntext", ["http"], ["text"]),
        ("---\ntitle: Shown # no\nother: hidden\n---\nbody", ["no\n", "other", "hidden"], ["Shown", "body"]),
        ("", [], []),
    ],
)
def test_reader_view(text, hidden, shown):
    v, _ = reader.reader_view(text)
    assert len(v) == len(text)
    assert not any(h in v for h in hidden) and all(s in v for s in shown)


def test_reader_incomplete():
    assert reader.reader_view("---\ntitle: |\n  block\n---\n")[1]
    assert not reader.reader_view("---\ntitle: plain\n---\n")[1]


def test_excerpt_tabs_wide_and_window():
    assert report.excerpt("a\tb", 2, 3, [(2, 3)]) == [("a   b", "    ^")]
    assert report.excerpt("日本x", 2, 3, [(2, 3)]) == [("日本x", "    ^")]
    long = "word " * 60 + "TARGET" + " word" * 60
    (line, carets), = report.excerpt(long, 300, 306, [(300, 306)], 60)
    assert line.startswith("…") and line.endswith("…") and len(line) <= 62
    assert line[carets.index("^") : carets.index("^") + 6] == "TARGET"
    assert len(report.excerpt("one\ntwo", 0, 7, [(0, 7)])) == 2

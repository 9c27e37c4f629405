"""Every regex rule over whole documents against a plain loop that follows the gates one by one."""

from __future__ import annotations

import bisect
import re
from pathlib import Path

import pytest

from lectern.operators import regex_rules
from lectern.operators import views as V
from lectern.sources import catalogue

DATA = Path("/root/testdata/sf0.001/documents.parquet")
RULES = [r for r in catalogue.load() if r.pattern and not r.nominal_prefix]
HIDDEN = re.compile(r"(?s)<!--.*?-->|(?:\A|(?<=\n\n))---[ \t]*\n(?:[A-Za-z_][^\n]*\n|[ \t]+[^\n]*\n)*?---[ \t]*\n")
RENDERED = re.compile(r"(?m)^[ \t]*(?:```|~~~)|`[^`\n]+`|^[ \t]*\||\[[^\]\n]+\]\(|(?:https?|ftp)://|www\.")


def holding(spans: list[tuple], at: int):
    k = bisect.bisect_right([s[0] for s in spans], at) - 1
    return spans[k] if k >= 0 and at < spans[k][1] else None


def by_hand(text: str, masked: str, prose: str, blocks: list[tuple], sents: list[tuple]) -> set[tuple]:
    out = set()
    for r in RULES:
        view = masked if r.category == "punct" else prose
        for m in re.finditer(r.pattern, view, re.I | re.M):
            a, e = m.span()
            block, sent = holding(blocks, a), holding(sents, a)
            if a == e or r.category == "template" and not (block and e <= block[1]) or r.sentence_start and not (sent and sent[0] == a):
                continue
            heading = bool(block) and block[2] == "heading"
            if heading and not r.headings or r.heading_only and not heading:
                continue
            if r.opening_reference:
                shown = HIDDEN.sub(lambda x: re.sub(r"[^\n]", " ", x[0]), text)
                if prose[:a].strip() or not block or block[2] != "paragraph" or any(k == "quote" and s < a for s, _, k in blocks) or RENDERED.search(shown[:a]):
                    continue
            s, t = (sent[0], sent[1]) if sent else (a, e)
            if r.unless and re.search(r.unless, view[s:t], re.I):
                continue
            out.add((r.id, a, e))
    return out


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_every_regex_rule_against_a_loop(spark):
    made = [r"In today’s world — not just a tool; a way of life.", "Not anymore. The queue is durable now.\n\n# Why it matters\n\nThe result? Chaos. Honestly, here's the thing: it works.", "This matters. That is the point.\n\n> quoted\n\nThis changes everything."]
    docs = spark.read.parquet(str(DATA)).select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(made, 1)], "doc_id bigint, text string")).where("text is not null")
    v = V.with_views(docs).persist()
    b = V.blocks(V.lines(v)).persist()
    got: dict[int, set] = {}
    for r in regex_rules.regex_findings(v, catalogue.select(catalogue.load(), no_emoji=True)).collect():
        got.setdefault(r.doc_id, set()).add((r.rule_id, r.span_start, r.span_end))
    blocks: dict[int, list] = {}
    sents: dict[int, list] = {}
    for r in b.orderBy("span_start").collect():
        blocks.setdefault(r.doc_id, []).append((r.span_start, r.span_end, r.kind))
    for r in V.sentences(b, (*V.TEXT_KINDS, "heading")).orderBy("span_start").collect():
        sents.setdefault(r.doc_id, []).append((r.span_start, r.span_end))
    wrong, n = [], 0
    for r in v.collect():
        want = by_hand(r.text, r.masked, r.prose, blocks.get(r.doc_id, []), sents.get(r.doc_id, []))
        n += len(want)
        if want != got.get(r.doc_id, set()):
            wrong.append((r.doc_id, sorted(want ^ got.get(r.doc_id, set()))[:3]))
    assert not wrong and n > 100
    v.unpersist()
    b.unpersist()

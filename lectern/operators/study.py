"""Study features: clause triples, surface echoes, detached endings, visible text of artefacts, group statistics."""

from __future__ import annotations

import io
import re
import tokenize
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WORD


def clause_parts(sentence: Column) -> Column:
    """Three pieces around commas or semicolons, the third led by "and", of balanced length; else null."""
    raw = F.transform(F.split(sentence, "[,;]", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    ps = F.array(raw[0], raw[1], F.regexp_replace(raw[2], r"(?i)^and\s+", ""))
    n = F.transform(ps, lambda p: F.regexp_count(p, F.lit(WORD)))
    a, b, c = n[0], n[1], n[2]
    ok = a.between(3, 12) & b.between(3, 12) & c.between(3, 40) & (F.greatest(a, b) <= 2 * F.least(a, b))
    even = F.array_max(n) <= 2 * F.array_min(n)
    tail = (F.greatest(a, b) <= 8) & (c >= F.greatest(F.lit(7), 1.5 * F.greatest(a, b)))
    return F.when((F.size(raw) == 3) & F.get(raw, F.lit(2)).rlike(r"(?i)^and\s+"), F.when(ok & (even | tail), ps))


def echoes(sentence: Column) -> Column:
    """struct<pieces, repeats, triple, long_tail>: adjacent pieces that share a first or second word, and the shape of the pieces."""
    ps = F.filter(F.transform(F.split(F.lower(sentence), "[,;]", -1), lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0))), lambda w: F.size(w) > 0)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ps) - 1, F.lit(1))), lambda i: F.size(F.array_intersect(F.slice(F.try_element_at(ps, i), 1, 2), F.slice(F.coalesce(F.try_element_at(ps, i + 1), F.array().cast("array<string>")), 1, 2))) > 0)
    n = F.transform(ps, F.size)
    return F.struct(
        F.size(ps).cast("bigint").alias("pieces"), F.when(F.size(ps) > 1, F.size(F.filter(pairs, lambda x: x))).otherwise(0).cast("bigint").alias("repeats"), (F.size(ps) == 3).alias("triple"),
        ((F.size(ps) >= 2) & (F.try_element_at(n, F.lit(-1)) >= 2 * F.coalesce(F.array_max(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0)))), F.lit(1 << 20)))).alias("long_tail"),
    )


# Words that end a detached outcome.
OUTCOMES = "answered charted compared decoded demystified explained explored mapped mended outlined ranked retold reviewed revisited settled solved sorted summarised summarized untangled unpacked weighed".split()


def detached(sentence: Column) -> Column:
    """struct<prefix, separator, outcome, reason>: a sentence that ends in a mark and one outcome word."""
    p = r"(?i)^\s*(.+?)\s*([,;:]|—|–)\s+(\w+)[.!]?\s*$"
    prefix, sep, word = (F.regexp_extract(sentence, p, k) for k in (1, 2, 3))
    n = F.regexp_count(prefix, F.lit(WORD))
    return F.struct(
        F.nullif(prefix, F.lit("")).alias("prefix"), F.nullif(sep, F.lit("")).alias("separator"), F.nullif(F.lower(word), F.lit("")).alias("outcome"),
        F.when(prefix == "", "no_ending").when(~F.lower(word).isin(*OUTCOMES), "other_word").when(n < 2, "short_prefix").when(prefix.rlike(r"[.!?;]\s"), "several_sentences").otherwise("candidate").alias("reason"),
    )


class _Visible(HTMLParser):
    _SKIP = frozenset(("script", "style", "pre", "code", "template", "svg"))
    _PARAGRAPH = frozenset("p div section article li ul ol h1 h2 h3 h4 h5 h6 table tr td th br blockquote header footer main nav title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.notes, self.depth = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self._SKIP
        if tag in self._PARAGRAPH:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self._SKIP and self.depth:
            self.depth -= 1
        if tag in self._PARAGRAPH:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)

    def handle_comment(self, data):
        self.notes.append(data.strip())


def visible_html(html: str | None) -> tuple[str, list[str]]:
    """(visible text with block breaks, comments)."""
    v = _Visible()
    v.feed(html or "")
    v.close()
    text = "\n\n".join(p for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n", "".join(v.out))) if p)
    return text, v.notes


# File endings by kind of artefact.
PROSE_ENDS = ("md", "markdown", "txt", "rst", "tex", "wiki", "text")
C_ENDS = ("js", "ts", "jsx", "tsx", "java", "c", "h", "cc", "cpp", "rs", "go", "swift", "kt", "cs", "css", "scss")


def artifact_parts(text: str | None, path: str | None) -> list[str]:
    """Prose of a file by its ending: all of a prose file, visible HTML and its comments, comments and docstrings of code."""
    end = (path or "").rpartition(".")[2].lower()
    text = text or ""
    if end in ("html", "htm"):
        shown, notes = visible_html(text)
        return [x for x in [shown, *notes] if x]
    if end == "py":
        out = []
        try:
            previous = None
            for t in tokenize.generate_tokens(io.StringIO(text).readline):
                if t.type == tokenize.COMMENT:
                    out.append(t.string.lstrip("# ").strip())
                elif t.type == tokenize.STRING and previous in (None, tokenize.INDENT, tokenize.NEWLINE, tokenize.NL):
                    out.append(t.string.strip("\"'").strip())
                if t.type != tokenize.NL or previous is None:
                    previous = t.type
        except (tokenize.TokenError, IndentationError, SyntaxError):
            pass
        return [x for x in out if x]
    if end in C_ENDS:
        found = re.findall(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//([^\n]*)|/\*(.*?)\*/", text, re.S)
        return [x for x in ((a or b).strip(" *\n") for a, b in found) if x]
    return [text] if end in PROSE_ENDS and text.strip() else []


def with_parts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, part_no, part: the prose parts of every artefact (text, path)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(k, n, p) for k, t, path in zip(b[key], b["text"], b["path"]) for n, p in enumerate(artifact_parts(t, path), 1)]
            yield pd.DataFrame(rows, columns=[key, "part_no", "part"])

    return docs.select(key, "text", "path").mapInPandas(run, f"{key} {kind}, part_no bigint, part string")


def group_statistics(sents: DataFrame, groups: DataFrame, key: str = "doc_id", group: str = "grp") -> DataFrame:
    """group, documents, sentences, words, triples, documents with one."""
    s = sents.select(key, F.regexp_count("sentence", F.lit(WORD)).alias("w"), clause_parts(F.col("sentence")).isNotNull().alias("triple"))
    per = s.groupBy(key).agg(F.count(F.lit(1)).alias("sentences"), F.sum("w").alias("words"), F.count(F.when(F.col("triple"), 1)).alias("triples"))
    return groups.join(per, key, "left").na.fill(0, ["sentences", "words", "triples"]).groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"), F.sum("words").alias("words"), F.sum("triples").alias("triples"), F.count(F.when(F.col("triples") > 0, 1)).alias("with_triple")
    )


# Contrast families of the paragraph collection.
FAMILIES = {"not_but": r"(?i)\bnot\b[^.!?\n]{0,80}\bbut\b", "more_than_just": r"(?i)\bmore than just\b", "not_promise": r"(?i)\bit's not\b[^.!?\n]{0,80}\bit's\b", "rather_than": r"(?i)\brather than\b"}


def family_paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct paragraphs of any family: id (12 hex digits of the SHA-256 of the normalised text), families, documents."""
    p = docs.select(key, F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n[ \t\r]*\n", -1)).alias("raw"))
    p = p.select(key, F.regexp_replace(F.regexp_replace("raw", r"\s+", " "), "^ | $", "").alias("paragraph"))
    fam = F.filter(F.array(*(F.when(F.col("paragraph").rlike(r), n) for n, r in sorted(FAMILIES.items()))), lambda x: x.isNotNull())
    hit = p.withColumn("families", fam).where(F.size("families") > 0)
    return hit.groupBy("paragraph").agg(F.array_join(F.first("families"), ",").alias("families"), F.count_distinct(key).alias("documents")).select(F.substring(F.sha2("paragraph", 256), 1, 12).alias("id"), "families", "documents")


def reader_records(rows: DataFrame) -> DataFrame:
    """id, grp, genre, text of mixed rows (id, dataset, model, genre, file_path, text): what people read of them.

    Messages stay as they are; of a written file its prose parts come, numbered. Blank parts are left out.
    """
    named = rows.withColumns({"dataset": F.coalesce("dataset", F.lit("unnamed")), "model": F.coalesce(F.nullif("model", F.lit("")), F.lit("unattributed"))})
    message = F.col("genre").isin("assistant_message", "assistant_trace_text")
    said = named.where(message).select("id", F.concat_ws("/", "dataset", "model", F.lit("assistant")).alias("grp"), "genre", "text")
    made = named.where(~message)
    parts = with_parts(made.select("id", "text", F.coalesce("file_path", F.lit("")).alias("path")), "id").where("trim(part) <> ''")
    wrote = parts.join(made.select("id", "dataset", "model", "genre"), "id").select(F.concat_ws("/", "id", F.lit("extract"), (F.col("part_no") - 1).cast("string")).alias("id"), F.concat_ws("/", "dataset", "model", "genre").alias("grp"), "genre", F.col("part").alias("text"))
    return said.unionByName(wrote)


def decision_counts(rows: DataFrame, group: str = "grp") -> DataFrame:
    """group, candidates, proposals, and the count of each reason why a candidate was turned down (rows: group, reason; null: proposed)."""
    per = rows.groupBy(group, "reason").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(group).agg(F.sum("n").alias("candidates"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("proposals"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("rejections"))

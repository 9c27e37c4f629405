"""Offset-preserving text views, lines, blocks and sentences.

``masked`` hides code, tags, targets, tables and the like behind spaces of the same length; ``prose``
also straightens quotes and hides line markers and emphasis; ``parse`` puts a name over each code span. All passes are
narrow JVM expressions over one row. Lines and blocks follow by windows over a document; the one shuffle
is by document id.

Null texts count as empty; an empty document has views '' and no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import blanked, parts, rewrite, spans

# What the views hide (valid in Java and RE2 alike).
FRONT = r"(?:\A|\n\n)---[ \t]*\n(?:[A-Za-z_][^\n]*\n|[ \t]+[^\n]*\n)*?---[ \t]*\n"
FENCE = r"(?ms)^[ \t]*```[^\n]*\n.*?^[ \t]*```[^\n]*$|^[ \t]*~~~[^\n]*\n.*?^[ \t]*~~~[^\n]*$"
INLINE_CODE = r"`[^`\n]+`"
COMMENT = r"(?s)<!--.*?-->"
TAG = "</?[A-Za-z][A-Za-z0-9.:-]*(?:\\s+[A-Za-z_:@#][\\w.:@#-]*(?:=(?:\"[^\"]*\"|'[^']*'|[^\\s\"'<>`]+))?)*\\s*/?>"
CONTAINER = r"(?m)^[ \t]*:{3,}[^\n]*$"
LABEL = r"\[[^\]\n]+\]\("
TARGET = r"\]\([^)\n]*\)"
URL = r"(?:https?|ftp)://[^\s)>\]]+|www\.[^\s)>\]]+"
TABLE = r"(?m)^[ \t]*\|[^\n]*$"
HEADING_LINE = r"(?m)^#{1,6}[ \t]+[^\n]*$"
HEADING = r"^#{1,6}[ \t]+"
BULLET = r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+"
QUOTE = r"^(?:[ \t]*>)+[ \t]?"
EMPHASIS = r"(?:\*\*|__|\*|_)(?=\S)|(?<=\S)(?:\*\*|__|\*|_)"
MACHINE_KEYS = "class style src href url link image background backgroundimage icon color colour accent layout theme transition font fonts id key glob path file files tags".split()
CODE_NAME = "Bob"
CURLY, STRAIGHT = "‘’“”", "''\"\""


def unix(pattern: str) -> str:
    """Only line feeds end lines."""
    return "(?d)" + pattern


def _yaml_value(line: Column) -> Column:
    """A front-matter line with only its visible value left, or blanks."""
    head = F.regexp_extract(line, r"^[ \t]*(?:-[ \t]+)?(?:[A-Za-z_][\w-]*:[ \t]+)?", 0)
    key = F.lower(F.regexp_extract(line, r"^[ \t]*(?:-[ \t]+)?([A-Za-z_][\w-]*):[ \t]+", 1))
    tail = F.regexp_extract(line, r"[ \t]*$", 0)
    rest = F.substring(line, F.length(head) + 1, F.greatest(F.length(line) - F.length(head) - F.length(tail), F.lit(0)))
    quoted = (F.length(rest) >= 2) & rest.rlike("(?s)^([\"']).*\\1$")
    value = F.when(quoted, F.concat(F.lit(" "), F.substring(rest, F.lit(2), F.length(rest) - 2), F.lit(" "))).otherwise(rest)
    shown = (F.trim(line) != "---") & (F.regexp_count(value, F.lit("[A-Za-zÀ-ɏ]{2,}")) >= 2) & ~key.isin(*MACHINE_KEYS)
    return F.when(shown, F.concat(F.repeat(F.lit(" "), F.length(head)), value, F.repeat(F.lit(" "), F.length(tail)))).otherwise(F.repeat(F.lit(" "), F.length(line)))


def expose_front(piece: Column) -> Column:
    """A front-matter block reduced to the values a reader sees."""
    return F.array_join(F.transform(F.split(piece, "\n", -1), _yaml_value), "\n")


def _label(piece: Column) -> Column:
    """"[label](" without its bracket, and without the label where all of two or more words start with a capital or digit."""
    label = F.substring(piece, F.lit(2), F.length(piece) - 3)
    words = F.filter(F.split(label, r"[\s-]+"), lambda w: w != "")
    title = (F.size(words) >= 2) & F.forall(words, lambda w: F.substring(w, 1, 1).rlike(r"^[\p{Lu}\p{Lt}\p{Nd}]"))
    return F.concat(F.lit(" "), F.when(title, F.repeat(F.lit(" "), F.length(label))).otherwise(label), F.lit("]("))


def masked(text: Column) -> Column:
    t = rewrite(text, unix(FRONT), expose_front, ("---",))
    t = rewrite(t, unix(FENCE), blanked, ("```", "~~~"))
    for p, *signs in ((INLINE_CODE, "`"), (COMMENT, "<!--"), (TAG, "<"), (CONTAINER, ":::")):
        t = rewrite(t, unix(p), blanked, tuple(signs))
    t = rewrite(t, unix(LABEL), _label, ("](",))
    for p, *signs in ((TARGET, "]("), (URL, "://", "www."), (TABLE, "|")):
        t = rewrite(t, unix(p), blanked, tuple(signs))
    return t


def _heading_line(line: Column) -> Column:
    head = F.regexp_extract(line, HEADING, 0)
    tail = F.regexp_extract(line, r"[ \t]+#+[ \t]*$", 0)
    body = F.substring(line, F.length(head) + 1, F.greatest(F.length(line) - F.length(head) - F.length(tail), F.lit(0)))
    return F.concat(F.repeat(F.lit(" "), F.length(head)), body, F.repeat(F.lit(" "), F.length(line) - F.length(head) - F.length(body)))


def prose(masked_: Column) -> Column:
    t = F.translate(masked_, CURLY, STRAIGHT)
    t = rewrite(t, unix(HEADING_LINE), _heading_line, ("#",))
    t = rewrite(t, unix("(?m)" + QUOTE), blanked, (">",))
    t = rewrite(t, unix("(?m)" + BULLET))
    return rewrite(t, EMPHASIS, blanked, ("*", "_"))


def skip_quotes(masked_: Column) -> Column:
    """The masked view with quote lines hidden as well."""
    return rewrite(masked_, unix("(?m)" + QUOTE + r"[^\n]*$"))


def code_spans(text: Column) -> Column:
    """array<struct<s, e>> of the inline code spans outside front matter and fences."""
    return spans(rewrite(rewrite(text, unix(FRONT), expose_front), unix(FENCE)), INLINE_CODE)


def parse(text: Column, prose_: Column) -> Column:
    """``prose`` with a name over the start of every inline code span."""
    return F.aggregate(code_spans(text), prose_, lambda t, x: F.overlay(t, F.lit(CODE_NAME), x["s"] + 1, F.lit(3)))


def with_views(docs: DataFrame, text: str = "text", quotes: bool = True) -> DataFrame:
    """The columns of ``docs`` and masked, prose. ``quotes=False`` hides quotations."""
    t = F.coalesce(F.col(text), F.lit(""))
    m = masked(t)
    out = docs.withColumn("masked", m if quotes else skip_quotes(m))
    return out.withColumn("prose", prose(F.col("masked")))


def lines(views: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, span_start, span_end, kind, continued, line (of the prose view): one row per line; kind is null for blank lines."""
    marked = F.split(rewrite(F.col("text"), unix(FRONT), lambda x: F.regexp_replace(x, r"[^\n]", "\ue002")), "\n", -1)
    front = F.when(F.contains("text", F.lit("---")), F.transform(marked, lambda x: x.contains("\ue002")))  # null: no line is of front matter
    rows = views.select(key, F.posexplode(F.arrays_zip(F.split("masked", "\n", -1).alias("m"), F.split("prose", "\n", -1).alias("p"), F.coalesce(front, F.array().cast("array<boolean>")).alias("f"))).alias("line_no", "x"))
    rows = rows.select(key, "line_no", F.col("x.m").alias("masked_line"), F.col("x.p").alias("line"), F.coalesce("x.f", F.lit(False)).alias("front"))
    by = Window.partitionBy(key).orderBy("line_no")
    raw = (
        F.when(F.trim(F.regexp_replace("masked_line", r"\s", " ")) == "", "blank")
        .when(F.col("front"), "field")
        .when(F.col("masked_line").rlike(QUOTE), "quote")
        .when(F.col("masked_line").rlike(HEADING), "heading")
        .when(F.col("masked_line").rlike(BULLET), "list")
        .otherwise("plain")
    )
    rows = rows.withColumn("raw", raw).withColumn("span_start", F.coalesce(F.sum(F.length("line") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.last(F.when(F.col("raw") != "plain", F.col("raw")), True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("continued", (F.col("raw") == "plain") & (F.coalesce(before, F.lit("")) == "list"))
    kind = F.when(F.col("raw") == "blank", None).when(F.col("continued"), "list").when(F.col("raw") == "plain", "paragraph").otherwise(F.col("raw"))
    return rows.select(key, F.col("line_no").cast("bigint").alias("line_no"), "span_start", (F.col("span_start") + F.length("line")).alias("span_end"), kind.alias("kind"), "continued", "line")


def blocks(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_id, kind, span_start, span_end, t (the prose): lines joined to headings, items, paragraphs, quotations and fields."""
    by = Window.partitionBy(key).orderBy("line_no")
    before = F.lag("kind").over(by)
    joined = (before == F.col("kind")) & (F.col("kind").isin("paragraph", "quote") | F.col("continued"))
    rows = line_rows.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(by)).where("kind is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy(key, "run").agg(F.first("kind").alias("kind"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), text.alias("t"))
    return out.select(key, F.row_number().over(Window.partitionBy(key).orderBy("span_start")).cast("bigint").alias("block_id"), "kind", "span_start", "span_end", "t")


# Sentence boundaries and what is none.
BOUNDARY = r"[.!?]+[\"')\]]*(?=\s+[\"'(\[]?[A-Za-z0-9]|\s*\z)"
ABBREVIATION = r"(?i)\b(?:e\.g|i\.e|vs|etc|Mr|Mrs|Dr|Ms|St|No|Fig|approx|cf)\.$"
CONTINUING = r"(?i)\b(?:Inc|Ltd|Co|Corp)\.$|\b(?:[a-z]\.){2,}$"
INITIAL = r"\b[A-Z]\.$"
TEXT_KINDS = ("paragraph", "list", "quote", "field")


def split_sentences(text: Column) -> Column:
    """array<struct<s, e>> of the sentences of one block's text, trimmed.

    A boundary is turned down by its local context only, so the fold over boundaries is a filter.
    """
    ps = parts(text, BOUNDARY)
    bounds = F.aggregate(
        ps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), (a["i"] + 1).alias("i"), F.when(a["i"] % 2 == 1, F.array_append(a["out"], a["at"] + F.length(x))).otherwise(a["out"]).alias("out")),
    )["out"]

    def accepted(b: Column) -> Column:
        tail = F.substring(text, F.greatest(b - 24, F.lit(0)) + 1, F.least(b, F.lit(24)))
        nxt = F.substring(text, b + 1, F.lit(40))
        return ~(tail.rlike(ABBREVIATION) | (tail.rlike(CONTINUING) & nxt.rlike(r"^\s+[\"'(\[]?[a-z]")) | (tail.rlike(INITIAL) & nxt.rlike(r"^\s+[a-z]")))

    good = F.filter(bounds, accepted)
    starts = F.concat(F.array(F.lit(0)), good)
    ends = F.concat(good, F.array(F.length(text)))

    def trimmed(p: Column) -> Column:
        raw = F.substring(text, p["a"] + 1, p["b"] - p["a"])
        left = F.length(F.regexp_extract(raw, r"^\s*", 0))
        right = F.length(F.regexp_extract(raw, r"\s*\z", 0))
        return F.struct((p["a"] + left).alias("s"), F.greatest(p["b"] - right, p["a"] + left).alias("e"))

    return F.filter(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), trimmed), lambda x: x["e"] > x["s"])


def sentence_spans(block_rows: DataFrame) -> Column:
    """The sentences of each block: column ``cut`` where the blocks have it, so that they are split once, else split here."""
    return F.col("cut") if "cut" in block_rows.columns else split_sentences(F.col("t"))


def sentences(block_rows: DataFrame, kinds: tuple[str, ...] = TEXT_KINDS, key: str = "doc_id") -> DataFrame:
    """key, block_id, kind, sent_no, span_start, span_end, sentence of the blocks of these kinds."""
    cut = sentence_spans(block_rows)
    rows = block_rows.where(F.col("kind").isin(*kinds))
    rows = rows.select(key, "block_id", "kind", F.col("span_start").alias("base"), "t", F.posexplode(cut).alias("sent_no", "x"))
    return rows.select(
        key, "block_id", "kind", (F.col("sent_no") + 1).cast("bigint").alias("sent_no"), (F.col("base") + F.col("x.s")).alias("span_start"), (F.col("base") + F.col("x.e")).alias("span_end"),
        F.substring(F.col("t"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("sentence"),
    )


def line_and_column(text: Column, offset: Column) -> Column:
    """struct<line, col> of an offset, both from 1; only line feeds count."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    last = F.length(F.regexp_extract(before, r"(?s)(?:\A|\n)([^\n]*)\z", 1))
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("line"), (last + 1).cast("bigint").alias("col"))


def prose_with_code(text: Column, prose_: Column, start: Column, end: Column) -> Column:
    """The slice of ``prose`` with the inline code spans that lie wholly inside it put back."""
    whole = F.aggregate(
        F.filter(code_spans(text), lambda x: (x["s"] >= start) & (x["e"] <= end)), prose_, lambda t, x: F.overlay(t, F.substring(text, x["s"] + 1, x["e"] - x["s"]), x["s"] + 1, x["e"] - x["s"])
    )
    return F.substring(whole, start.cast("int") + 1, (end - start).cast("int"))

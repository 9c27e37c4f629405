"""The reader's view: what of a document a reader sees, at the same length.

One pattern with a branch for each construct cuts a text into constructs and what lies between; the branches are
in the order front matter, comment, tag, definition, link, code, so at one place the first of these wins, and
nothing is looked for inside a construct. A construct is kept (code), or hidden but for the stretches that it shows, which
are viewed in turn: a link its label, front matter the plain values of heading, title, lede and callout. Scripts and
styles go with their content. ``incomplete`` says that a value was there which could not be shown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The constructs.
_ATTRIBUTES = r"""(?=[\s/>])(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)"""
_BRANCHES = {
    "front": r"^---[ \t]*\r?\n(?s:.)*?(?:^(?:---|\.\.\.)[ \t]*(?:\r?\n|$)|\Z)",
    "comment": r"<!--(?s:.)*?(?:-->|\Z)",
    "tag": r"</?(?P<name>[A-Za-z][\w:.-]*)" + _ATTRIBUTES,
    "definition": r"^ {0,3}\[(?:\\.|[^\]\\\n])+\]:[^\n]*(?:\n[ \t]+[^\n]*)*",
    "link": r"!?\[(?P<label>(?:\\.|[^\]\\\n])*)\]\(",
    "fence": r"^[ \t]*(?P<mark>```|~~~)[^\n]*\n(?s:.)*?^[ \t]*(?P=mark)[^\n]*$",
    "indented": r"^(?: {4}|\t)[^\n]*(?:\n(?:[ \t]*(?=\n)|(?: {4}|\t)[^\n]*))*",
    "inline": r"`[^`\n]+`",
}
SHOWN_FIELDS = ("heading", "title", "lede", "callout")
UNPLAIN = "|>!&*[{"
_HIDDEN_WITH_CONTENT = ("script", "style")
_KEPT = ("fence", "indented", "inline")

_lexer = lambda kinds: re.compile("|".join(f"(?P<{k}>{_BRANCHES[k]})" for k in kinds), re.M)
_WITH_FRONT, _INNER = _lexer(_BRANCHES), _lexer([k for k in _BRANCHES if k != "front"])
_CLOSING = {n: re.compile(f"</{n}{_ATTRIBUTES}", re.I) for n in _HIDDEN_WITH_CONTENT}
# the pieces of a link target of which only the parentheses count
_TARGET = re.compile(r"""\\(?s:.)?|"(?:\\(?s:.)|[^"\\])*"?|'(?:\\(?s:.)|[^'\\])*'?|<(?:\\(?s:.)|[^>\\])*>?|(?P<open>\()|(?P<close>\))""")
_FIELD = re.compile(rf"^(?:{'|'.join(SHOWN_FIELDS)})[ \t]*:[ \t]*(?P<value>[^\n]*)", re.M | re.I)
_QUOTED = re.compile(r"""\s*(?:"(?:\\(?s:.)|[^"\\])*"?|'(?:''|[^'])*'?)""")
_HASH = re.compile(r"(?<!\S)#")
# a line further in, behind blank lines and comments, continues a value
_CONTINUED = re.compile(r"(?:\n[^\S\n]*(?:#[^\n]*)?(?=\n))*\n[ \t]\s*[^\s#]")


def after_target(text: str, at: int) -> int:
    """End of a link target that is open at ``at``: past the parenthesis that balances it, or the text's end."""
    depth = 1
    for piece in _TARGET.finditer(text, at):
        depth += (piece["open"] is not None) - (piece["close"] is not None)
        if not depth:
            return piece.end()
    return len(text)


def without_comment(value: str) -> str:
    """A YAML scalar without its comment: a # after a blank, but not inside the quotes that open the value."""
    quoted = _QUOTED.match(value)
    comment = _HASH.search(value, quoted.end() if quoted else 0)
    return value[: comment.start()] if comment else value


def constructs(text: str, front: bool) -> Iterator[tuple[str, re.Match, int]]:
    """(kind, match, end) of the constructs in order."""
    lexer, at = (_WITH_FRONT if front else _INNER), 0
    while m := lexer.search(text, at):
        kind, at = next(k for k in _BRANCHES if k in lexer.groupindex and m[k] is not None), m.end()
        if kind == "link":
            at = after_target(text, at)
        elif kind == "tag" and m[0][1] != "/" and (closing := _CLOSING.get(m["name"].lower())):
            last = closing.search(text, at)
            at = last.end() if last else len(text)
        yield kind, m, at


def shown(kind: str, m: re.Match, end: int) -> tuple[list[tuple[int, int]], bool]:
    """The stretches that a hidden construct shows, and whether it has a value that cannot be shown."""
    if kind == "link":
        return [m.span("label")], False
    if kind != "front":
        return [], False
    spans, lost = [], False
    for f in _FIELD.finditer(m.string, m.start(), end):
        value = without_comment(f["value"])
        if value.strip()[:1] in ("", *UNPLAIN):
            lost = True
        else:
            spans.append((f.start("value"), f.start("value") + len(value)))
            lost |= _CONTINUED.match(m.string, f.end(), end) is not None
    return spans, lost


def reader_view(text: str, front: bool = True) -> tuple[str, bool]:
    """(visible text of the same length, incomplete)."""
    out, at, incomplete = [], 0, False
    for kind, m, end in constructs(text, front):
        out.append(text[at : m.start()])
        at = m.start()
        if kind not in _KEPT:
            spans, lost = shown(kind, m, end)
            incomplete |= lost
            for a, b in spans:
                inner, lost = reader_view(text[a:b], False)
                out += (re.sub(r"[^\n]", " ", text[at:a]), inner)
                at, incomplete = b, incomplete | lost
            out.append(re.sub(r"[^\n]", " ", text[at:end]))
        else:
            out.append(text[at:end])
        at = end
    return "".join((*out, text[at:])), incomplete


@F.pandas_udf(T.StructType([T.StructField("visible", T.StringType()), T.StructField("incomplete", T.BooleanType())]))
def _views(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([reader_view(t or "") for t in s], columns=["visible", "incomplete"])


def with_reader_view(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with visible, incomplete. Texts without any construct skip Python."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = ~t.rlike(r"(?m)[<\[`]|^(?: {4}|\t)|^---|^[ \t]*~~~")
    a = docs.where(plain).withColumn("visible", t).withColumn("incomplete", F.lit(False))
    b = docs.where(~plain).withColumn("v", _views(t)).withColumns({"visible": F.col("v.visible"), "incomplete": F.col("v.incomplete")}).drop("v")
    return a.unionByName(b)


def visible_headings(blocks: DataFrame, views: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with ``heading``: the last visible heading that ends before the block."""
    h = blocks.join(views.select(key, "visible"), key)
    raw = F.trim(F.substring("visible", F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int")))
    title = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[ \t]+#+[ \t]*$", ""), r"^#{1,6}(?:[ \t]+|$)", ""))
    by = Window.partitionBy(key).orderBy("span_start").rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("heading", F.coalesce(F.last(F.when((F.col("kind") == "heading") & (title != ""), title), True).over(by), F.lit(""))).drop("visible")


def definite_candidates(tokens: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_id, s, e: determiner-led noun chunks from the determiner on, and bare demonstratives outside them.

    ``tokens`` as in ``graph``; ``chunks``: key, block_id, start_i, end_i (last token, inclusive).
    """
    det = tokens.where("lower in ('the', 'this', 'that', 'these', 'those') and dep = 'det'")
    c = chunks.select(F.col(key).alias("c_k"), F.col("block_id").alias("c_b"), "start_i", "end_i")
    last = tokens.select(F.col(key).alias("l_k"), F.col("block_id").alias("l_b"), F.col("i").alias("l_i"), (F.col("idx") + F.length("text")).alias("e"))
    led = det.join(c, (F.col(key) == F.col("c_k")) & (F.col("block_id") == F.col("c_b")) & (F.col("i") >= F.col("start_i")) & (F.col("i") <= F.col("end_i")))
    led = led.join(last, (F.col(key) == F.col("l_k")) & (F.col("block_id") == F.col("l_b")) & (F.col("end_i") == F.col("l_i"))).select(key, "block_id", F.col("idx").alias("s"), "e")
    bare = tokens.where("lower in ('this', 'that', 'these', 'those') and pos = 'PRON' and dep <> 'det' and tag <> 'WDT'").select(key, "block_id", F.col("idx").alias("s"), (F.col("idx") + F.length("text")).alias("e"))
    o = led.select(F.col(key).alias("o_k"), F.col("block_id").alias("o_b"), F.col("s").alias("o_s"), F.col("e").alias("o_e"))
    free = bare.join(o, (F.col(key) == F.col("o_k")) & (F.col("block_id") == F.col("o_b")) & (F.col("o_s") <= F.col("s")) & (F.col("e") <= F.col("o_e")), "left_anti")
    return led.unionByName(free).distinct()


def preceding_context(visible: Column, at: Column, limit: int = 2000) -> Column:
    """struct<text, truncated>: the last ``limit`` characters of visible text before an offset."""
    before = F.regexp_replace(F.substring(visible, F.lit(1), at.cast("int")), r"\A\s+|\s+\z", "")
    return F.struct(F.when(F.length(before) > limit, F.substring(before, -limit, limit)).otherwise(before).alias("text"), (F.length(before) > limit).alias("truncated"))

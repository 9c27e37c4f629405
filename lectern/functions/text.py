"""Text expressions that keep offsets: matches as spans, same-length blanking. All JVM-side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"


def parts(text: Column, pattern: str) -> Column:
    """The text cut around the matches of a literal pattern: odd elements (from 0) are the matches."""
    plain = F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")
    return F.split(F.regexp_replace(plain, pattern, OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]", -1)


def blanked(piece: Column) -> Column:
    """Spaces of the same length; line ends stay."""
    return F.regexp_replace(piece, r"[^\n]", " ")


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column] = blanked, signs: tuple[str, ...] = ()) -> Column:
    """Each match replaced by ``change`` of it, which must keep the length.

    ``signs``: a text with none of them has no match and stays as it is. The text is bound to a variable, so that it is
    computed once however often it is read.
    """
    if not signs:
        return F.array_join(F.transform(parts(text, pattern), lambda x, i: F.when(i % 2 == 1, change(x)).otherwise(x)), "")

    def guarded(t: Column) -> Column:
        has = F.contains(t, F.lit(signs[0]))
        for x in signs[1:]:
            has = has | F.contains(t, F.lit(x))
        return F.when(has, rewrite(t, pattern, change)).otherwise(t)

    return F.transform(F.array(text), guarded)[0]


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e>> of non-empty matches, zero-based and half-open."""
    ps = parts(text, pattern)
    ends = F.aggregate(
        ps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x)).alias("at"),
            (a["i"] + 1).alias("i"),
            F.when((a["i"] % 2 == 1) & (F.length(x) > 0), F.array_append(a["out"], F.struct(a["at"].alias("s"), (a["at"] + F.length(x)).alias("e")))).otherwise(a["out"]).alias("out"),
        ),
    )
    return F.when(text.rlike(pattern), ends["out"]).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(view: str, pattern: str, guard: str | None = None) -> str:
    """``spans`` of a column as SQL text, behind an optional cheap condition: one expression to parse instead of dozens of calls."""
    empty = "cast(array() as array<struct<s:int,e:int>>)"
    ps = f"split(regexp_replace(translate({view}, '\\uE000\\uE001', '\\uFFFD\\uFFFD'), {quoted(pattern)}, '\\uE000$0\\uE001'), '[\\uE000\\uE001]', -1)"
    step = (
        "(a, x) -> named_struct('at', a.at + length(x), 'i', a.i + 1, 'out', "
        "CASE WHEN a.i % 2 = 1 AND length(x) > 0 THEN array_append(a.out, named_struct('s', a.at, 'e', a.at + length(x))) ELSE a.out END)"
    )
    test = f"{view} rlike {quoted(pattern)}"
    return f"CASE WHEN {f'({guard}) AND ' if guard else ''}{test} THEN aggregate({ps}, named_struct('at', 0, 'i', 0, 'out', {empty}), {step}).out ELSE {empty} END"


_WIDE = re.compile(r"\\U([0-9A-Fa-f]{8})")


def java(pattern: str, flags: str = "imdU") -> str:
    """A pattern in the usual script dialect for the JVM: flags, named groups, wide escapes, absolute end."""
    out = _WIDE.sub(lambda m: "\\x{" + m[1].lstrip("0") + "}", pattern).replace("(?P<", "(?<").replace("\\Z", "\\z")
    while "(?P=" in out:
        a = out.index("(?P=")
        b = out.index(")", a)
        out = out[:a] + "\\k<" + out[a + 4 : b] + ">" + out[b + 1 :]
    return f"(?{flags}){out}" if flags else out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


# Fixed value: a word, as counted by all metrics.
WORD = "[A-Za-z0-9'À-ɏ]+"

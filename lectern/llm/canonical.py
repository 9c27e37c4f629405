"""Canonical forms of text and JSON records as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything but letters, marks and digits; variation selectors and joiners are marks that show nothing.
_NOT_TEXT = r"[^\p{L}\p{M}\p{N}]|[\x{FE00}-\x{FE0F}\x{34F}]"


def fold(c: Column) -> Column:
    """Letters, marks and digits in one case. Letters that share a capital with others (ß, ſ, ς) are joined too."""
    return F.regexp_replace(F.replace(F.translate(F.lower(c), "ſς", "sσ"), F.lit("ß"), F.lit("ss")), _NOT_TEXT, "")


def _value(v: Column) -> Column:
    """A JSON scalar: numbers by value in any notation, the rest as folded text."""
    number = F.when(v.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$") & (F.length(v) < 300), v.try_cast("double"))
    return F.when(number.isNotNull(), F.concat(F.lit("#"), number.cast("string"))).otherwise(fold(v))


def json_key(payload: Column, skip: tuple[str, ...] = ()) -> Column:
    """One string for all JSON notations of an object: its non-null fields in name order.

    Field order, blanks, escapes and number notation don't count; neither do the fields in ``skip``.
    What is no JSON object is folded as text under a mark of its own.
    """
    fields = F.from_json(payload, "map<string,string>", {"mode": "PERMISSIVE"})
    entries = F.transform(
        F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull() & ~F.lower(F.trim(e["key"])).isin(*skip)),
        lambda e: F.concat(F.lower(F.trim(e["key"])), F.lit("\x01"), _value(e["value"])),
    )
    return F.coalesce(F.concat(F.lit("o\x02"), F.array_join(F.array_sort(entries), "\x02")), F.concat(F.lit("t\x02"), fold(payload)))


def source_name(provenance: Column) -> Column:
    """The source that a provenance note names: JSON object, sentence ("Source: name. ...") or bare name.

    Letter case, blanks and underscores don't count; null or blank gives null.
    """
    named = F.coalesce(
        F.get_json_object(provenance, "$.source"),
        F.nullif(F.regexp_extract(provenance, r"(?i)\bsource\s*[:=]\s*([\w\- ]+)", 1), F.lit("")),
        provenance,
    )
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(named)), r"[\s_\-]+", "-"), r"^-+|-+$|[^\p{L}\p{N}\-]", ""), F.lit(""))


def split_name(split: Column) -> Column:
    """A split's name without outer blanks and letter case; blank gives null."""
    return F.nullif(F.lower(F.regexp_replace(split, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), F.lit(""))

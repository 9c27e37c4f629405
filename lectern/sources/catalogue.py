"""The rule catalogue: TOML files, strict validation, pruning, the rules as a DataFrame."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent.parent / "rules"
CATEGORIES = ("phrase", "template", "punct", "verb", "adj", "noun", "doc")
RANK = {"bite": 0, "bark": 1, "sniff": 2}
# Other names of the severities.
ALIASES = {"error": "bite", "warning": "bark", "suggestion": "sniff", "violation": "bite"}
REGEX = frozenset(("phrase", "template", "punct"))
GRAPH = frozenset(("verb", "adj", "noun"))
_ALLOWED = frozenset(
    "id severity message repeat_message pattern unless headings heading_only sentence_start opening_reference nominal_prefix construction dependency anchor_without match_unless metric threshold min_sentences min_paragraphs veto confidence_floor example acceptable".split()
)
#: Off unless asked for.
OPT_IN = frozenset(("punct.emoji",))


class CatalogueError(ValueError):
    """A rule file that cannot be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    message: str
    source_file: str = ""
    repeat_message: str | None = None
    pattern: str | None = None
    unless: str | None = None
    headings: bool = False
    heading_only: bool = False
    sentence_start: bool = False
    opening_reference: bool = False
    nominal_prefix: bool = False
    construction: str | None = None
    dependency: tuple = ()
    anchor_without: tuple = ()
    match_unless: str | None = None
    metric: str | None = None
    threshold: float | None = None
    min_sentences: int = 0
    min_paragraphs: int = 0
    veto_threshold: float | None = None
    veto_required: bool = False
    confidence_floor: float | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def rank(self) -> int:
        return RANK[self.severity]


def rule_from(raw: dict, category: str, where: str = "") -> Rule:
    """One validated rule; anything unknown or contradictory is an error."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise CatalogueError(f"{where}: {raw.get('id', '?')}: {what}")

    need(isinstance(raw, dict), "a rule is a table")
    need(set(raw) <= _ALLOWED, f"unknown keys {sorted(set(raw) - _ALLOWED)}")
    need(isinstance(raw.get("id"), str) and re.fullmatch(rf"{category}\.[a-z0-9]+(?:-[a-z0-9]+)*", raw["id"]) is not None, "id must be category.name")
    severity = ALIASES.get(raw.get("severity"), raw.get("severity"))
    need(severity in RANK, "unknown severity")
    need(isinstance(raw.get("message"), str) and raw["message"].strip() != "", "a message is required")
    if category in REGEX:
        need(("pattern" in raw) != ("construction" in raw), "exactly one of pattern and construction")
        need("dependency" not in raw and "metric" not in raw, "a regex rule has no dependency or metric")
        for k in ("pattern", "unless"):
            if k in raw:
                try:
                    re.compile(raw[k], re.I | re.M)
                except re.error as e:
                    need(False, f"{k}: {e}")
        need(not (raw.get("construction") and (set(raw) & {"unless", "headings", "heading_only", "sentence_start", "nominal_prefix"})), "a construction has no regex options")
        need(not (raw.get("heading_only") and raw.get("headings") is False), "heading_only needs headings")
    elif category in GRAPH:
        need("pattern" not in raw and "metric" not in raw, "a graph rule has no pattern or metric")
        need(("dependency" in raw) != ("confidence_floor" in raw), "dependency, or a reviewed reference")
        for alt in raw.get("dependency", ()):
            need(bool(alt) and "LEFT_ID" not in alt[0], "the first node is the anchor")
            known = {alt[0].get("RIGHT_ID")}
            for node in alt[1:]:
                need(node.get("LEFT_ID") in known and node.get("REL_OP") in (">", ">>", "$+", "$++", "$--", ">--"), "a node names an earlier node and a known relation")
                known.add(node.get("RIGHT_ID"))
    else:
        need(isinstance(raw.get("metric"), str) and isinstance(raw.get("threshold"), (int, float)), "metric and threshold are required")
    veto = raw.get("veto") or {}
    if veto:
        t = veto.get("threshold")
        need(isinstance(t, (int, float)) and not isinstance(t, bool) and 0.5 < t <= 1, "veto threshold must be in (0.5, 1]")
    return Rule(
        raw["id"], category, severity, raw["message"], f"{category}.toml", raw.get("repeat_message"), raw.get("pattern"), raw.get("unless"),
        raw.get("headings", category == "phrase" or bool(raw.get("heading_only"))), raw.get("heading_only", False), raw.get("sentence_start", False), raw.get("opening_reference", False), raw.get("nominal_prefix", False),
        raw.get("construction"), tuple(tuple(a) for a in raw.get("dependency", ())), tuple(x if isinstance(x, str) else str(x) for x in ([raw["anchor_without"]] if isinstance(raw.get("anchor_without"), str) else raw.get("anchor_without", ()))),
        raw.get("match_unless"), raw.get("metric"), float(raw["threshold"]) if "threshold" in raw else None, int(raw.get("min_sentences", 0)), int(raw.get("min_paragraphs", 0)),
        float(veto["threshold"]) if veto else None, bool(veto.get("required", False)), raw.get("confidence_floor"),
    )


def load(folder: Path | str = HERE) -> list[Rule]:
    """All rules, one file per category in fixed order; repeated ids and an empty catalogue are errors."""
    out: list[Rule] = []
    for c in CATEGORIES:
        path = Path(folder) / f"{c}.toml"
        if not path.exists():
            continue
        try:
            raw = tomllib.loads(path.read_text("utf-8"))
        except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
            raise CatalogueError(f"{path}: {e}") from None
        out += [rule_from(r, c, str(path)) for r in raw.get("rule", [])]
    if not out:
        raise CatalogueError(f"{folder}: no rules")
    seen: set[str] = set()
    for r in out:
        if r.id in seen:
            raise CatalogueError(f"{r.id}: repeated")
        seen.add(r.id)
    return out


def select(rules: list[Rule], only: set[str] = frozenset(), disable: set[str] = frozenset(), disable_category: set[str] = frozenset(), no_emoji: bool = False) -> list[Rule]:
    """Rules to run, pruned before any plan is built. Unknown names are errors."""
    ids = {r.id for r in rules}
    if unknown := (set(only) | set(disable)) - ids:
        raise CatalogueError(f"unknown rules {sorted(unknown)}")
    if unknown := set(disable_category) - set(CATEGORIES):
        raise CatalogueError(f"unknown categories {sorted(unknown)}")
    return [
        r for r in rules
        if (r.id in only if only else True) and r.id not in disable and r.category not in disable_category and (r.id not in OPT_IN or no_emoji or r.id in only)
    ]


RULES_DDL = (
    "rule_id string, category string, severity string, rank int, message string, repeat_message string, source_file string, unless string, headings boolean, heading_only boolean, "
    "sentence_start boolean, opening_reference boolean, nominal_prefix boolean, metric string, threshold double, min_sentences bigint, min_paragraphs bigint, veto_threshold double, veto_required boolean, confidence_floor double"
)


def rules_df(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a small relation (at most a few hundred rows; joins broadcast it by its size)."""
    rows = [
        (r.id, r.category, r.severity, r.rank, r.message, r.repeat_message, r.source_file, r.unless, r.headings, r.heading_only, r.sentence_start, r.opening_reference, r.nominal_prefix, r.metric, r.threshold,
         r.min_sentences, r.min_paragraphs, r.veto_threshold, r.veto_required, r.confidence_floor)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES_DDL)

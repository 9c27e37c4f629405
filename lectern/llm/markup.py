"""Markup residue: which families a text holds, and the text without it.

A text may mix HTML, Markdown, wiki text and LaTeX. ``view`` goes from the outside in: code blocks
first (what stands inside one counts only for the block's family), then comments, scripts and math,
then elements, and last the line and inline constructs; what is recognised is blanked in place, so that a
formula's underscore is no emphasis and an attribute's ampersand no character reference. A construct
counts only if it is complete: a tag with a known name and its end tag (or a name that needs none, or an
attribute with a value), a paired delimiter with text between, a command with its argument. Bare addresses, prices, comparisons,
paths, numbers in brackets and lone signs are none.

``clean`` renders the same constructs as plain text that keeps headings ("# "), list items ("- "), code
blocks (fenced by three back-ticks), tables (cells by tabs) and formulas (between dollar signs).

Site templates: every block element is a subtree with a hash of its names and folded text. Spark counts
on how many pages of a host each hash stands; subtrees on at least ``MIN_PAGES`` pages are deleted before
the text is rendered. It is no share of the host: pages that are added, with HTML or without, never bring a
template back. Hashes meet pages by a join on
(host, hash) after pre-aggregation, so a footer on every page costs one counter per task.

Null texts count as empty: no family, clean text ''.
"""

from __future__ import annotations

import hashlib
import html
import html.entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import arrow_map, spread, table, written

FAMILIES = ("html", "markdown", "wiki", "latex")
MIN_PAGES = 10

# HTML element names.
NAMES = frozenset(
    """a abbr acronym address area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center
    cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form
    frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu
    meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script
    section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time
    title tr track tt u ul var video wbr""".split()
)
# Elements that stand without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont frame".split())
OPTIONAL = frozenset("p li dt dd tr td th thead tbody tfoot option colgroup body html head".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
# The open elements that a start tag ends.
ENDS = {n: frozenset(("p",)) for n in BLOCK} | {
    "li": frozenset(("li", "p")), **dict.fromkeys(("dt", "dd"), frozenset(("dt", "dd", "p"))), **dict.fromkeys(("td", "th"), frozenset(("td", "th", "p"))), "tr": frozenset(("tr", "td", "th", "p", "colgroup")),
    **dict.fromkeys(("thead", "tbody", "tfoot"), frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "p", "colgroup"))), **dict.fromkeys(("option", "optgroup"), frozenset(("option",))), "body": frozenset(("head",)),
}
# Element names of wiki text.
WIKI_NAMES = frozenset("ref references nowiki gallery syntaxhighlight poem noinclude includeonly onlyinclude".split())

_TAG = r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*)\s*(/?)>"
TAG = re.compile(_TAG)
COMMENT = re.compile(r"<!--.*?-->", re.S)
DOCTYPE = re.compile(r"<!DOCTYPE\s[^>]*>|<\?xml\s[^>]*\?>|<!\[CDATA\[.*?\]\]>", re.I | re.S)
RAW = re.compile(r"<(script|style|textarea|title)\b[^>]*>.*?</\1\s*>", re.I | re.S)
PRE = re.compile(r"<pre\b[^>]*>.*?</pre\s*>", re.I | re.S)
CODE_EL = re.compile(r"<(code|kbd|samp|tt)\b[^>]*>.*?</\1\s*>", re.I | re.S)
WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^>/]*>.*?</\1\s*>", re.I | re.S)
CHARREF = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
FENCE = re.compile(r"^([^\S\n]{0,3}(?:>[^\S\n]?|[-*+][^\S\n]+)*[^\S\n]*)(`{3,}|~{3,})([^`\n]*)\n(?:.*\n)*?[^\S\n>]*\2[`~]*[^\S\n]*$", re.M)
FENCED = re.compile(r"^[^\S\n>]*(`{3,}|~{3,})([^`\n]*)$", re.M)
VERB = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}.*?\\end\{\1\}", re.S)
MATH_ENV = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math|flalign)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
DISPLAY = re.compile(r"\\\[(?!\s*\\\])(.+?)\\\]|\\\((.+?)\\\)|\$\$(?=[^\s$])([^$]+?)\$\$", re.S)
INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]{0,300}?[^\s$\\])\$(?![\d$])")
MATHY = re.compile(r"[\\^_{}=<>+*/|]|^[A-Za-z]\w?$")
ENV = re.compile(r"\\begin\{([A-Za-z]+\*?)\}.*?\\end\{\1\}", re.S)
COMMAND = re.compile(r"(?<![\\:\w])\\([A-Za-z]{2,})\*?(?:\[[^\]\n]*\])?\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\}")
BARE_COMMAND = re.compile(r"(?<![\\:\w])\\(?:item|maketitle|tableofcontents|noindent|centering|newpage|clearpage|par|bigskip|medskip|smallskip|LaTeX|TeX|ldots|textbackslash)(?![A-Za-z\\])")
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
FRONT = re.compile(r"\A\ufeff?---[^\S\n]*\n(?:[ \t]*[\w\"'.-]+[ \t]*:.*\n|[ \t]+\S.*\n|[ \t]*-[ \t].*\n|[ \t]*#.*\n|[ \t]*\n)+?(?:---|\.\.\.)[^\S\n]*(?:\n|\Z)")
MD_TABLE = re.compile(r"^[^\S\n]*\|?[^\n|]*\|[^\n]*\n[^\S\n]*\|?[^\S\n]*:?-+:?[^\S\n]*(?:\|[^\S\n]*:?-+:?[^\S\n]*)*\|?[^\S\n]*$", re.M)
ATX = re.compile(r"^[^\S\n]{0,3}(#{1,6})[^\S\n]+(?=\S)([^\n]*?)(?:[^\S\n]+#+)?[^\S\n]*$", re.M)
SETEXT = re.compile(r"^([^\S\n]{0,3}[^\s>#|=-][^\n]*)\n[^\S\n]{0,3}(={2,}|-{2,})[^\S\n]*$", re.M)
HR = re.compile(r"(?:\A|\n[^\S\n]*\n)[^\S\n]{0,3}([-*_])(?:[^\S\n]*\1){2,}[^\S\n]*(?=\n[^\S\n]*\n|\n?\Z)")
BULLET = re.compile(r"^([^\S\n]*)(?:[-*+]|\d{1,3}[.)])[^\S\n]+(\[[ xX]\][^\S\n]+)?(?=\S)", re.M)
QUOTE = re.compile(r"^[^\S\n]{0,3}>[^\S\n]?(?=[^\s>=])", re.M)
LINK = re.compile(r"!?\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\((?!\s*\))(?:<[^<>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)")
REF_LINK = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
DEFINITION = re.compile(r"^[^\S\n]{0,3}\[([^\[\]\n]+)\]:[^\S\n]+\S[^\n]*$", re.M)
FOOTNOTE = re.compile(r"\[\^[^\s\[\]]+\]")
AUTOLINK = re.compile(r"<(?:https?://|mailto:|ftp://)[^\s<>]+>|<[\w.+-]+@[\w-]+\.[\w.]+>")
STRONG = re.compile(r"(?<![\\*0-9A-Za-z])(\*{1,3})(?![\s*])([^*\n]*[^\s*\\])\1(?![*0-9A-Za-z])")
UNDER = re.compile(r"(?<![\\_\w])(_{1,3})(?![\s_])([^_\n]*[^\s_\\])\1(?![_\w])")
STRIKE = re.compile(r"(?<![\\~])~~(?![\s~])([^~\n]*[^\s~])~~(?!~)")
WIKI_HEAD = re.compile(r"^(={1,6})[^\S\n]*([^=\s](?:[^\n]*?[^=\s])?)[^\S\n]*\1[^\S\n]*$", re.M)
WIKI_LINK = re.compile(r"\[\[(?=[^\s\]])([^\[\]\n]+?)\]\](?!\()")
TEMPLATE = re.compile(r"\{\{(?=\s*[^\W_#]|\s*#)[^{}\\]*(?:\{\{[^{}\\]*\}\}[^{}\\]*)*\}\}")
WIKI_TABLE = re.compile(r"^\{\|.*?^\|\}", re.M | re.S)
WIKI_BOLD = re.compile(r"(?<!')('{2,3}|'{5})(?=[^\s'])([^\n]*?[^\s'])\1(?!')")
WIKI_DEF = re.compile(r"^;[^\S\n]*\S[^\n]*\n:[^\S\n]*\S", re.M)
WIKI_EXT = re.compile(r"(?<!\[)\[(?:https?:)?//[^\s\]]+[^\S\n]+[^\]\n]+\](?!\()")
MAGIC = re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX)__|^#REDIRECT\b", re.M)
_PIPES = re.compile(r"^[^\S\n]*\|[^\n]*\|[^\S\n]*$", re.M)
_SOLID = re.compile(r"[^\n]")


def _blank(t: str, spans: list[tuple[int, int]], fill: str = " ") -> str:
    """Spans overwritten, lines kept."""
    if not spans:
        return t
    out, at = [], 0
    for a, b in spans:
        if a < at:
            continue
        out += (t[at:a], _SOLID.sub(fill, t[a:b]))
        at = b
    out.append(t[at:])
    return "".join(out)


def _spans(rx: re.Pattern, t: str) -> list[tuple[int, int]]:
    return [m.span() for m in rx.finditer(t)]


def _elements(t: str) -> tuple[list[re.Match], list[tuple[re.Match, int, int]]]:
    """Tags of complete elements, and the elements that are not void: start tag, end of the content, end.

    An element whose end tag may be left out ends where a sibling or its parent ends it.
    """
    stack: list[tuple[str, re.Match]] = []
    opened: dict[str, list[int]] = {}  # places in the stack by name
    implied: dict[str, int] = {}
    good, pairs = [], []

    def close(down_to: int, at: int) -> None:
        while len(stack) > down_to:
            n, start = stack.pop()
            opened[n].pop()
            if n in OPTIONAL:
                implied[n] = implied.get(n, 0) + 1
                pairs.append((start, at, at))

    for m in TAG.finditer(t):
        name = m[2].lower()
        if name not in NAMES:
            continue
        if m[1]:
            if opened.get(name):
                i = opened[name][-1]
                close(i + 1, m.start())
                start = stack.pop()[1]
                opened[name].pop()
                pairs.append((start, m.start(), m.end()))
                good += (start, m)
            elif implied.get(name):  # the end tag of one that has been ended
                implied[name] -= 1
                good.append(m)
        elif m[4] or name in VOID:
            good.append(m)
        else:
            ends = ENDS.get(name, ())
            while stack and stack[-1][0] in ends:
                close(len(stack) - 1, m.start())
            if name in OPTIONAL or "=" in m[3]:
                good.append(m)
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, m))
    close(0, len(t))
    return good, pairs


def families(text: str | None) -> int:
    """Bit i set: FAMILIES[i] has a complete construct."""
    return view(text)[0]


def view(text: str | None) -> tuple[int, str]:
    """The families' bits, and the text at the same length with code, comments, tags, math and the like blanked."""
    if not text:
        return 0, ""
    t = text.replace("\r\n", " \n").replace("\r", "\n") if "\r" in text else text
    has_lt, has_bs, has_tick = "<" in t, "\\" in t, "`" in t
    got = 0
    # code blocks, comments, math
    if t.startswith(("---", "\ufeff---")) and (m := FRONT.match(t)):
        got |= 2
        t = _blank(t, [m.span()])
    if (has_tick or "~~~" in t) and ("```" in t or "~~~" in t):
        spans = _spans(FENCE, t)
        if spans:
            got |= 2
            t = _blank(t, spans)
    if has_lt:
        if "</pre" in t or "</PRE" in t:
            spans = _spans(PRE, t)
            got |= bool(spans)
            t = _blank(t, spans)
        if "</nowiki" in t or "</syntaxhighlight" in t or "</source" in t:
            spans = _spans(WIKI_CODE, t)
            got |= 4 * bool(spans)
            t = _blank(t, spans)
    if has_bs:
        if "\\end{" in t:
            spans = _spans(VERB, t)
            got |= 8 * bool(spans)
            t = _blank(t, spans)
    if has_tick and (spans := [m.span() for m in INLINE_CODE.finditer(t) if m[2].strip()]):
        got |= 2
        t = _blank(t, spans, "\ue000")
    if has_lt:
        for rx in (COMMENT, DOCTYPE, RAW, CODE_EL):
            if spans := _spans(rx, t):
                got |= 1
                t = _blank(t, spans)
        if spans := _spans(AUTOLINK, t):
            got |= 2
            t = _blank(t, spans)
        good, _ = _elements(t)
        if good:
            got |= 1
            t = _blank(t, sorted(m.span() for m in good), " ")
        if spans := [m.span() for m in TAG.finditer(t) if m[2].lower() in WIKI_NAMES]:
            got |= 4
            t = _blank(t, spans)
    if not got & 1 and "&" in t:
        for m in CHARREF.finditer(t):
            if m[1] is None or m[1] + ";" in html.entities.html5:
                got |= 1
                break
    if has_bs:
        for rx in (MATH_ENV, DISPLAY):
            if spans := _spans(rx, t):
                got |= 8
                t = _blank(t, spans)
        if spans := [m.span() for rx in (COMMAND, BARE_COMMAND) for m in rx.finditer(t)]:
            if got & 8 or ENV.search(t) or any(t[a:b].endswith("}") for a, b in spans):
                got |= 8
                t = _blank(t, sorted(spans))
    if "$" in t:
        spans = [m.span() for m in INLINE_MATH.finditer(t) if MATHY.search(m[1]) and not re.match(r"[\d.,\s]+$", m[1])]
        if spans:
            got |= 8
            t = _blank(t, spans, "\ue000")
    # wiki
    if "{|" in t and (spans := _spans(WIKI_TABLE, t)):
        got |= 4
        t = _blank(t, spans)
    if "{{" in t and (spans := _spans(TEMPLATE, t)):
        got |= 4
        t = _blank(t, spans)
    if "[[" in t and (spans := [m.span() for m in WIKI_LINK.finditer(t) if not re.fullmatch(r"[\d,;\s–-]+", m[1])]):
        got |= 4
        t = _blank(t, spans, "\ue000")
    if not got & 4:
        if (
            ("''" in t and WIKI_BOLD.search(t))
            or ("==" in t and WIKI_HEAD.search(t))
            or (";" in t and WIKI_DEF.search(t))
            or ("[" in t and "//" in t and WIKI_EXT.search(t))
            or ("__" in t and MAGIC.search(t))
        ):
            got |= 4
    # Markdown
    if not got & 2:
        if (
            ("](" in t and LINK.search(t))
            or ("[^" in t and FOOTNOTE.search(t))
            or ("]:" in t and DEFINITION.search(t))
            or ("*" in t and STRONG.search(t))
            or ("_" in t and UNDER.search(t))
            or ("~~" in t and STRIKE.search(t))
            or ("#" in t and ATX.search(t))
            or BULLET.search(t)
            or (">" in t and QUOTE.search(t))
            or ("|" in t and "-" in t and MD_TABLE.search(t))
            or (("--" in t or "==" in t) and SETEXT.search(t))
            or (("--" in t or "**" in t or "__" in t) and HR.search(t))
            or ("][" in t and _resolved(t))
        ):
            got |= 2
    if got & 2:  # no prose either: tables, targets, reference names
        if "|" in t and "-|" in t or ":|" in t:
            t = _blank(t, [m.span() for m in _PIPES.finditer(t)])
        if "](" in t:
            t = _blank(t, [(m.end(1), m.end()) for m in LINK.finditer(t)])
        if "[^" in t:
            t = _blank(t, _spans(FOOTNOTE, t))
    return got, t


def _resolved(t: str) -> bool:
    names = {m[1].lower() for m in DEFINITION.finditer(t)}
    return any((m[2] or m[1]).lower() in names for m in REF_LINK.finditer(t))


# --- subtrees ---------------------------------------------------------------------------------------


def subtrees(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, hash) of every complete block element with visible text.

    An element's hash is made of its name, the words that stand in it and the hashes of its elements, in order; the
    elements come innermost first, so each text is hashed once however deep it is.
    """
    if not text or "<" not in text:
        return []
    t = _blank(text, _spans(COMMENT, text))
    out: list[tuple[int, int, int]] = []
    done: list[tuple[int, int, bytes, bool]] = []  # start, end, digest, visible of the outermost elements so far
    for tag, inner, end in _elements(t)[1]:
        name = tag[2].lower()
        k = len(done)
        while k and done[k - 1][0] >= tag.end():
            k -= 1
        h, at, visible = hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8), tag.end(), False
        for start, stop, digest, seen in (*done[k:], (inner, inner, b"", False)):
            if words := TAG.sub(" ", t[at:start]).lower().split():
                visible = True
                h.update(b"\x00" + " ".join(words).encode("utf-8", "surrogatepass"))
            if digest:
                h.update(b"\x01" + digest)
            visible, at = visible or seen, max(at, stop)
        done[k:] = [(tag.start(), end, h.digest(), visible)]
        if visible and name in BLOCK:
            out.append((tag.start(), end, int.from_bytes(h.digest(), "big", signed=True)))
    return out


# --- rendering --------------------------------------------------------------------------------------

_KEEP = re.compile("\ue000(\\d+)\ue001")


def _code(body: str, lang: str = "") -> str:
    return f"\n\n```{lang.strip()}\n{body.strip(chr(10))}\n```\n\n"


def _math(body: str) -> str:
    return "$" + " ".join(re.sub(r"\\label\{[^}]*\}", "", body).split()) + "$"


def _render_html(t: str, keep) -> str:
    t = COMMENT.sub("", DOCTYPE.sub("", t))
    t = re.sub(r"<title\b[^>]*>(.*?)</title\s*>", lambda m: f"\n\n# {m[1].strip()}\n\n", t, flags=re.I | re.S)
    t = re.sub(r"<(script|style|template)\b[^>]*>.*?</\1\s*>", "", t, flags=re.I | re.S)
    t = CODE_EL.sub(lambda m: keep("`" + html.unescape(TAG.sub("", m[0])).strip() + "`"), t)
    good, _ = _elements(t)
    out, at = [], 0
    for m in sorted(good, key=lambda m: m.start()):
        if m.start() < at:
            continue
        out.append(t[at : m.start()])
        at = m.end()
        name = m[2].lower()
        if name == "br":
            out.append("\n")
        elif name == "hr":
            out.append("\n\n")
        elif name == "img":
            alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[3], re.I)
            out.append((alt[1] or alt[2] or "") if alt else "")
        elif re.fullmatch(r"h[1-6]", name):
            out.append("\n\n" if m[1] else "\n\n" + "#" * int(name[1]) + " ")
        elif name in ("li", "dd", "dt"):
            out.append("\n" if m[1] else "\n- " if name == "li" else "\n")
        elif name in ("td", "th"):
            out.append("\t" if m[1] else "")
        elif name == "tr":
            out.append("\n")
        elif name in BLOCK or name in ("title", "head", "html", "tbody", "thead"):
            out.append("\n\n")
    out.append(t[at:])
    return html.unescape("".join(out))


def _wiki_table(body: str) -> str:
    rows = []
    for part in re.split(r"^\|-.*$", body, flags=re.M):
        cells = []
        for line in part.split("\n"):
            if line.startswith(("{|", "|}", "|+")):
                continue
            if line[:1] in "!|" and line:
                cells += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
        if cells:
            rows.append("\t".join(cells))
    return "\n" + "\n".join(rows) + "\n"


def clean(text: str | None, drop: set[int] | frozenset[int] = frozenset()) -> str:
    """Plain text with structure; subtrees whose hash is in ``drop`` are left out."""
    if not text:
        return ""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t = t.translate({0xE000: None, 0xE001: None, 0xFEFF: None})
    if drop:
        t = _cut(t, [(a, b) for a, b, h in subtrees(t) if h in drop])
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    if t.startswith("---") and (m := FRONT.match(t)):
        title = re.search(r"^title\s*:\s*(.+)$", m[0], re.M)
        t = (f"# {title[1].strip().strip(chr(34) + chr(39))}\n\n" if title else "") + t[m.end() :]
    if "```" in t or "~~~" in t:

        def fence(m):
            lines = m[0].split("\n")
            return keep(_code("\n".join(x[len(m[1]) :] if x.startswith(m[1]) else x for x in lines[1:-1]), m[3]))

        t = FENCE.sub(fence, t)
    if "<" in t:
        t = PRE.sub(lambda m: keep(_code(html.unescape(TAG.sub("", m[0])))), t)
        t = WIKI_CODE.sub(lambda m: keep(_code(TAG.sub("", m[0]))), t)
    if "\\" in t:
        t = VERB.sub(lambda m: keep(_code(re.sub(r"^\\begin\{[^}]*\}(?:\[[^\]]*\]|\{[^}]*\})*|\\end\{[^}]*\}$", "", m[0]))), t)
        t = MATH_ENV.sub(lambda m: "\n\n" + keep(_math(m[3])) + "\n\n", t)
        t = DISPLAY.sub(lambda m: keep(_math(m[1] or m[2] or m[3])), t)
    if "`" in t:
        t = INLINE_CODE.sub(lambda m: keep("`" + m[2].strip() + "`"), t)
    if "$" in t:
        t = INLINE_MATH.sub(lambda m: keep(_math(m[1])) if MATHY.search(m[1]) and not re.match(r"[\d.,\s]+$", m[1]) else m[0], t)
    if "{|" in t:
        t = WIKI_TABLE.sub(lambda m: keep(_wiki_table(m[0])), t)
    if "|" in t:

        def tab(m):
            return "\t".join(c.strip() for c in m[0].strip().strip("|").split("|"))

        heads = _spans(MD_TABLE, t)
        for a, b in reversed(heads):
            end = b
            while (n := re.compile(r"\n[^\S\n]*\|[^\n]*").match(t, end)) is not None:
                end = n.end()
            lines = t[a:end].split("\n")
            t = t[:a] + keep("\n".join("\t".join(c.strip() for c in x.strip().strip("|").split("|")) for i, x in enumerate(lines) if i != 1)) + t[end:]
    if "<" in t or "&" in t:
        t = _render_html(t, keep) if "<" in t else html.unescape(t)
        t = AUTOLINK.sub(lambda m: m[0][1:-1], t)
        t = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", t, flags=re.S)
    # wiki
    if "{{" in t:
        t = TEMPLATE.sub("", t)
    if "[[" in t:
        t = WIKI_LINK.sub(lambda m: m[1].split("|")[-1] if not re.match(r"(?i)(?:file|image|category):", m[1]) else "", t)
    if "==" in t:
        t = WIKI_HEAD.sub(lambda m: "#" * len(m[1]) + " " + m[2], t)
    if "''" in t:
        t = WIKI_BOLD.sub(lambda m: m[2], t)
    if ";" in t:
        t = re.sub(r"^;[^\S\n]*(\S[^\n]*)\n:[^\S\n]*(?=\S)", r"\1: ", t, flags=re.M)
    # LaTeX
    if "\\" in t:
        t = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}", lambda m: "\n\n" + "#" * (max(1, ("part chapter section subsection subsubsection paragraph".split().index(m[1])) - 0)) + " " + m[2] + "\n\n", t)
        t = re.sub(r"\\(?:label|cite[a-z]*|ref|eqref|pageref|index|usepackage|documentclass)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", t)
        t = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?", "\n", t)
        t = re.sub(r"\\item(?:\[([^\]\n]*)\])?[^\S\n]*", r"- ", t)
        for _ in range(3):
            t, n = re.subn(r"(?<![\\:\w])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", t)
            if not n:
                break
        t = BARE_COMMAND.sub("", t)
        t = re.sub(r"(?<!\\)[^\S\n]%[^\S\n][^\n]*$", "", t, flags=re.M) if ENV.search(text) or COMMAND.search(text) else t
        t = re.sub(r"\\([%&#_$*\[\]`~{}])", r"\1", t)
    # Markdown
    t = DEFINITION.sub(lambda m: m[0].split(":", 1)[1].strip() if m[1].startswith("^") else "", t) if "]:" in t else t
    if "](" in t:
        for _ in range(2):
            t = LINK.sub(lambda m: m[1], t)
    if "[^" in t:
        t = FOOTNOTE.sub("", t)
    t = SETEXT.sub(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), t)
    t = HR.sub("\n", t)
    t = ATX.sub(lambda m: m[1] + " " + m[2], t)
    t = BULLET.sub(lambda m: m[1] + "- ", t)
    t = re.sub(r"^[^\S\n]{0,3}(?:>[^\S\n]?)+(?=[^\s>=])", "", t, flags=re.M)
    for rx, g in ((STRONG, 2), (STRONG, 2), (UNDER, 2), (STRIKE, 1)):
        t = rx.sub(lambda m, g=g: m[g], t)
    while "\ue000" in t:
        t = _KEEP.sub(lambda m: kept[int(m[1])], t)
    t = re.sub(r"[^\S\n\t]+$", "", t, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def _cut(t: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out.append(t[at:a])
        at = max(at, b)
    out.append(t[at:])
    return "".join(out)


# --- Spark ------------------------------------------------------------------------------------------


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, rec_id, host, text of both tables. A page's host is its source; evaluation blocks have their dataset."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("rec_id"), F.coalesce("source", F.lit("")).alias("host"), "text")
    e = table(spark, sf_dir, "evaluation").select(F.lit("evaluation").alias("origin"), F.col("eval_no").alias("rec_id"), F.coalesce("dataset", F.lit("")).alias("host"), F.col("context").alias("text"))
    return spread(d).unionByName(spread(e))


def hashed(pages: DataFrame) -> DataFrame:
    """origin, rec_id, host, page (digest of the text, blanks and letter case set aside), subtrees (hashes of block elements, each once) of pages with HTML elements."""
    page = F.xxhash64(F.regexp_replace(F.lower("text"), r"\s+", " "))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [sorted({h for _, _, h in subtrees(t)}) if families(t) & 1 else [] for t in b.column(4).to_pylist()]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(hashes, pa.list_(pa.int64()))], names=["origin", "rec_id", "host", "page", "subtrees"])

    rows = pages.where(F.col("text").rlike("<[A-Za-z]")).select("origin", "rec_id", "host", page.alias("page"), "text")
    return arrow_map(rows, run, "origin string, rec_id bigint, host string, page bigint, subtrees array<bigint>").where(F.size("subtrees") > 0)


def site_templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, hash of the subtrees that recur on a host's pages. Copies of a page count as one, so what only they share stays."""
    once = found.select("host", "page", F.explode("subtrees").alias("hash")).distinct()
    return once.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "hash")


def cleaned(pages: DataFrame) -> DataFrame:
    """origin, rec_id, families, clean, dropped (number of template subtrees left out).

    The numbers of the pages to change, written before, meet the texts in a join that broadcasts them only below the
    session's size limit. Null texts have no families and an empty clean text; a page that is all template comes out empty.
    """
    pages = pages.select("origin", "rec_id", "host", "text")
    found = written(hashed(pages), "p2-found")
    drops = found.select("origin", "rec_id", "host", F.explode("subtrees").alias("hash")).join(site_templates(found), ["host", "hash"]).groupBy("origin", "rec_id").agg(F.collect_set("hash").alias("drop"))
    rows = pages.join(written(drops, "p2-drops"), ["origin", "rec_id"], "left")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ts, ds = b.column(2).to_pylist(), b.column(3).to_pylist()
        bits = [families(t) for t in ts]
        out = [clean(t, frozenset(d or ())) for t, d in zip(ts, ds)]
        n = [len(d or ()) for d in ds]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int32()), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["origin", "rec_id", "families", "clean", "dropped"])

    return arrow_map(rows.select("origin", "rec_id", "text", "drop"), run, "origin string, rec_id bigint, families int, clean string, dropped int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cleaned(texts(spark, sf_dir)).where("families > 0")
    names = F.filter(F.array(*(F.when(F.col("families").bitwiseAND(1 << i) > 0, F.lit(f)) for i, f in enumerate(FAMILIES))), lambda x: x.isNotNull())
    return got.select("origin", "rec_id", F.explode(names).alias("markup"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(texts(spark, sf_dir)).drop("families")

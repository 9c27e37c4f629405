"""Sentence units in many scripts by a finite transducer run as a parallel prefix scan.

Every character becomes one of 20 symbols (letter kinds, blanks, end marks, quotes, structure
marks). Context that needs more than the next symbol (abbreviations, decimals, addresses, paired
quotes, reporting clauses, headings, list markers) is settled by a local look at the text when the
symbol is assigned. A deterministic transducer of ten states reads the symbols and says before
which ones a unit starts.

The symbols of a whole batch are cut into chunks of equal length. For each chunk the function
"state before -> state after" is computed for all ten states at once, for all chunks in step
(numpy); the functions are composed by a parallel prefix scan (doubling), which gives the true
state at each chunk's start; a last pass in step emits the boundaries. A document's symbols are assigned
in one pass over its text; what follows is as deep as a chunk is long, so one long document costs as much as many short ones.
A document is one row of one task.

Null and empty texts have no units. A unit needs at least one letter or digit.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.runtime import arrow_map, spread

(LOW, UP, CASELESS, THAI, DIGIT, SP, NL, HARD, MARK, DOT, EX, CEND, OQ, CQ, CQR, CB, OB, APOS, OTHER, COMMA, RESET) = range(21)
N_SYMBOLS = 21
(S, T, TH, THS, E, ES, Q0, Q0E, Q1, Q1E) = range(10)
N_STATES = 10
CHUNK = 128

# Abbreviations that do not end a sentence, by language group (lower case, last dot left out).
NEVER = frozenset(
    """dr mr mrs ms prof st fig sec vs e.g i.e cf approx eq ch vol rev gen col capt lt sgt hon resp
    z.b d.h bzw vgl nr abb ca hr fr bsp evtl ggf usf dipl ing
    p.ex env m mm mme mlle mgr chap éd av
    p.ej pág págs ej sr sra srta dña aprox núm art
    p.es dott dott.ssa sig sig.ra ing avv pag pagg es ecc.g
    aprox pág dra eng
    d.w.z bijv blz dhr mevr drs o.a m.b.t
    np tj tzn ok ul prof.dr inż mgr dyr str rys
    t.ex dvs bl.a s.k kap ang
    см рис стр гл ср напр им ул тов проф акад т.е т.к
    див мал напр ред с т.зв вул
    د أ م
    डॉ श्री पं प्रो""".split()
)
# The same, but only before a number.
NEVER_NUM = frozenset("no nos nr núm n p pp s fig sec vol art § л стр rys afb bild pos kl".split())
# Month names that follow an ordinal with a dot.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Stems of reporting verbs after a quotation.
REPORT = re.compile(
    r"\b(?:said|says|asked|asks|told|tells|replied|wrote|answered|added|shouted|whispered|explained|sagte|sagt|fragte|schrieb|rief|meinte|"
    r"antwortete|dit|demande|demanda|répond|répondit|écrit|ajoute|dijo|preguntó|respondió|escribió|dice|disse|perguntou|respondeu|escreveu|"
    r"chiese|rispose|scrisse|vroeg|zei|schreef|antwoordde|zapytał\w*|powiedział\w*|odpowiedział\w*|napisał\w*|sade|sa|frågade|svarade|skrev|"
    r"сказал\w*|спросил\w*|ответил\w*|написал\w*|сказав|сказала|спитав|спитала|відповів|відповіла|написав|написала)\b"
    r"|قال|قالت|سأل|سألت|كتب|أجاب|कहा|पूछा|बोल|बताया|लिखा|^\s*(?:と|って)|[说說道问問答喊]|กล่าว|ถาม|บอก|พูด",
    re.I,
)
_INVIS = "\xad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\u180e\u061c\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
INVIS = re.compile(f"[{_INVIS}]")
_PAIRS = [('"', '"'), ("„", "“”"), ("“", "”"), ("”", "”"), ("«", "»"), ("»", "«"), ("「", "」"), ("『", "』"), ("‹", "›")]
_QUOTES = "".join(dict.fromkeys("".join(a + b for a, b in _PAIRS)))
QUOTE_ANY = re.compile(f"[{_QUOTES}]")
#: Opening quote with something to read behind it, up to the first fitting close, inside one paragraph.
QUOTED = re.compile(
    "|".join(f"{re.escape(a)}(?=\\s?[^\\s{_QUOTES}.,;:!?)])(?:[^{re.escape(a + b)}\\n]|\\n(?!\\s*\\n))++[{re.escape(b)}]" for a, b in _PAIRS)
)
_URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"«»“”]*[\w/]")
_BLANK = re.compile(r"\n[^\S\n]*(?=\n)")
_LINE = re.compile(r"^[^\S\n]*(?:(#{1,6})[^\S\n]+[^\n]*|((?:[-*+•‣–]|\d{1,3}[.)])[^\S\n]+(?:\[[ xX]\][^\S\n]+)?)(?=\S)|(>[>\s]*))", re.M)
_HASHES = re.compile(r"[^\S\n]+#+[^\S\n]*$")
_BACK = re.compile(r"[\w.§]{1,10}$")
_NEXT = re.compile(r"\s*")
_SEGMENT = re.compile(r"[^.!?。！？।؟\n]{0,160}")


def _symbol_table() -> np.ndarray:
    """Symbol of each code point below U+30000 by Unicode category; later ones are OTHER or CASELESS."""
    t = np.full(0x30000, OTHER, np.uint8)
    for cp in range(0x30000):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or cp >= 0x20000:
            t[cp] = CASELESS
            continue
        if 0xD800 <= cp <= 0xF8FF:
            continue
        c = chr(cp)
        k = unicodedata.category(c)
        if 0x0E01 <= cp <= 0x0E4E:
            t[cp] = THAI
        elif k == "Ll":
            t[cp] = LOW
        elif k in ("Lu", "Lt"):
            t[cp] = UP
        elif k[0] in "LM":
            t[cp] = CASELESS
        elif k[0] == "N":
            t[cp] = DIGIT
        elif k == "Cc" or k[0] == "Z":
            t[cp] = SP
        elif k == "Ps":
            t[cp] = OB
        elif k == "Pe":
            t[cp] = CB
    t[0x3040:0x3100] = CASELESS
    for s, chars in ((NL, "\n"), (DOT, "."), (EX, "!?…‼⁇⁈⁉؟"), (CEND, "。！？।॥۔｡"), (APOS, "'’‘`´"), (COMMA, ",;:،、，；：–—-")):
        for c in chars:
            t[ord(c)] = s
    for c in "ªº":
        t[ord(c)] = LOW
    return t


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundary before this symbol) by state and symbol."""
    nxt, cut = np.zeros((N_STATES, N_SYMBOLS), np.uint8), np.zeros((N_STATES, N_SYMBOLS), bool)

    def on(states, symbols, to, boundary=False):
        for a in states:
            for b in symbols:
                nxt[a, b], cut[a, b] = to, boundary

    blanks, ends, closers = (SP, NL), (DOT, EX, CEND), (CQ, CQR, CB, APOS)
    on((T, TH, THS), range(N_SYMBOLS), T)
    on((T,), blanks, T)
    on((T, TH, THS), ends, E)
    on((T, TH, THS), (OQ,), Q1)
    on((T, TH), (THAI,), TH)
    on((TH, THS), blanks, THS)
    on((THS,), (THAI,), TH, True)
    on((S,), range(N_SYMBOLS), T)
    on((S,), blanks, S)
    on((S,), (THAI,), TH)
    on((S,), ends, E)
    on((S,), (OQ,), Q0)
    for q in (E, ES):
        on((q,), (LOW, COMMA), T)
        on((q,), (UP, CASELESS, DIGIT), T, True)
        on((q,), (THAI,), TH, True)
        on((q,), (OQ,), Q0, True)
        on((q,), (*ends, *closers), E)
        on((q,), blanks, ES)
    on((E,), (OB, OTHER), E)
    on((ES,), (OB, OTHER), T, True)
    for q, e in ((Q0, Q0E), (Q1, Q1E)):
        on((q, e), range(N_SYMBOLS), q)
        on((q, e), ends, e)
        on((e,), (*blanks, CB, APOS, OTHER), e)
        on((q,), (CQ, CQR), T)
    on((Q0E, Q1E), (CQ,), E)
    on((Q0E,), (CQR,), T)
    on((Q1E,), (CQR,), E)
    on(range(N_STATES), (HARD, MARK, RESET), S, True)
    return nxt, cut


TABLE = _symbol_table()
NEXT, CUT = _machine()


def _dot(t: str, i: int, n: int, capitals: bool = False) -> bool:
    """Whether the dot at i may end a sentence. ``capitals``: the whole text is set in capitals."""
    nxt = t[i + 1] if i + 1 < n else ""
    prv = t[i - 1] if i else ""
    if nxt == "." or prv == ".":
        return True
    if nxt.isalnum():
        if nxt.isdigit() or nxt.islower() or (capitals and nxt.isupper()):
            return False
        if nxt.isupper():
            return i >= 2 and prv.isalnum() and t[i - 2].isalnum() and not (prv.isupper() and t[i - 2] in ".")
        return True
    m = _BACK.search(t, max(0, i - 10), i)
    if not m:
        return True
    w = m[0]
    j = _NEXT.match(t, i + 1).end()
    after = t[j] if j < n else ""
    if not after:
        return True
    low = w.lower().strip(".")
    if w.isdigit():
        word = re.match(r"\w*", t[j : j + 12])[0]
        return word.capitalize() not in MONTHS
    if low in NEVER_NUM and after.isdigit():
        return False
    if low in NEVER and len(w) <= 8:
        return False
    if len(low) == 1 and low.isalpha():
        start = m.start()
        before = t[start - 1] if start else " "
        if not before.isalnum():
            if low in "гпг" and re.search(r"\d\s*$", t[max(0, start - 3) : start]):
                return True
            return False
    if "." in w and w.split(".")[-1].isalpha() and all(len(x) == 1 for x in w.split(".") if x) and after.isupper():
        return True
    return True


def symbols(t: str) -> np.ndarray:
    """One symbol for each code point of a text without invisible characters."""
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = TABLE[np.minimum(cp, 0x2FFFF)]
    capitals = not (s == LOW).any()
    if not (s == UP).any():  # a text set in lower case throughout: its sentences start in lower case
        s[s == LOW] = UP
    n = len(t)
    i = t.find(".")
    while i >= 0:
        if not _dot(t, i, n, capitals):
            s[i] = LOW
        i = t.find(".", i + 1)
    if "://" in t or "www." in t:
        for m in _URL.finditer(t):
            s[m.start() : m.end()] = LOW
    if QUOTE_ANY.search(t):
        for m in QUOTE_ANY.finditer(t):
            s[m.start()] = OTHER if t[m.start()] == '"' else CB
        for m in QUOTED.finditer(t):
            a, b = m.start(), m.end() - 1
            if a and t[a] == '"' and t[a - 1].isalnum():
                continue
            s[a] = OQ
            s[b] = CQR if REPORT.search(_SEGMENT.match(t, b + 1)[0]) else CQ
    if "\n" in t:
        for m in _BLANK.finditer(t):
            s[m.end()] = HARD
    if t[:1] in " \t#-*+•>0123456789\n\xa0" or "\n" in t:
        for m in _LINE.finditer(t):
            if m[1]:
                a, b = m.span(1)
                s[a:b] = MARK
                end = m.end()
                h = _HASHES.search(t, b, end)
                if h:
                    s[h.start() : end] = MARK
                if end < n:
                    s[end] = HARD
            elif m[2]:
                a, b = m.span(2)
                s[a:b] = MARK
            else:
                a, b = m.span(3)
                s[a:b] = SP
    return s


def scan(sym: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Boundary flags of a symbol string: chunk functions, prefix composition, emission."""
    n = len(sym)
    k = max(1, -(-n // chunk))
    x = np.full(k * chunk, RESET, np.uint8)
    x[:n] = sym
    x = np.ascontiguousarray(x.reshape(k, chunk).T)
    flat = NEXT.ravel()
    f = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (k, N_STATES)).copy()
    for j in range(chunk):
        f = flat[f.astype(np.int16) * N_SYMBOLS + x[j][:, None]]
    # inclusive prefix scan of function composition by doubling: g[i] = f[i] o ... o f[0]
    step = 1
    while step < k:
        f[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
        step *= 2
    st = np.zeros(k, np.uint8)
    st[1:] = f[:-1, S]
    out = np.zeros((chunk, k), bool)
    cutf = CUT.ravel()
    for j in range(chunk):
        at = st.astype(np.int16) * N_SYMBOLS + x[j]
        out[j] = cutf[at]
        st = flat[at]
    return out.T.ravel()[:n]


def units(texts: list[str | None]) -> list[np.ndarray]:
    """(start, end) pairs of each text's units, in code points of the original text."""
    parts, maps, where = [], [], []
    for t in texts:
        if not t:
            where.append(None)
            continue
        keep = None
        if INVIS.search(t):
            cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            keep = np.flatnonzero(~np.isin(cp, [ord(c) for c in _INVIS]))
            t = INVIS.sub("", t)
        where.append(len(parts))
        parts.append(symbols(t))
        maps.append(keep)
    none = np.zeros((0, 2), np.int64)
    if not parts:
        return [none for _ in texts]
    lens = np.array([len(p) for p in parts])
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    total = int(lens.sum() + len(lens))
    sym = np.full(total, RESET, np.uint8)
    for a, p in zip(starts, parts):
        sym[a + 1 : a + 1 + len(p)] = p
    cut = scan(sym)
    unit = np.cumsum(cut)
    solid = ~np.isin(sym, (SP, NL, HARD, MARK, RESET))
    pos = np.flatnonzero(solid)
    if not len(pos):
        return [none for _ in texts]
    u = unit[pos]
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    last = np.concatenate((first[1:] - 1, [len(u) - 1]))
    alnum = np.add.reduceat((sym[pos] <= DIGIT).astype(np.int32), first) > 0
    a, b = pos[first], pos[last] + 1
    # a unit of marks alone belongs to the one before it, unless structure parts them
    hard = np.cumsum(np.isin(sym, (HARD, MARK, RESET)))
    keep_u = alnum.copy()
    for i in np.flatnonzero(~alnum):
        if i and hard[a[i]] == hard[b[i - 1] - 1]:
            j = i - 1
            while j > 0 and not keep_u[j]:
                j -= 1
            if keep_u[j]:
                b[j] = b[i]
    a, b = a[keep_u], b[keep_u]
    doc = np.searchsorted(starts, a, side="right") - 1
    out, lo = [], np.searchsorted(doc, np.arange(len(parts)))
    hi = np.append(lo[1:], len(a))
    for w in where:
        if w is None:
            out.append(none)
            continue
        spans = np.stack([a[lo[w] : hi[w]], b[lo[w] : hi[w]]], 1) - starts[w] - 1
        k = maps[w]
        if k is not None and len(spans):
            spans = np.stack([k[spans[:, 0]], k[spans[:, 1] - 1] + 1], 1)
        out.append(spans)
    return out


def blocks(texts: list[str | None], chars: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters, at least one text each."""
    out, a, n = [], 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            out.append((a, i + 1))
            a, n = i + 1, 0
    return out + [(a, len(texts))] * (a < len(texts))


def sentence_units(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row for each unit: the key columns, span_start, span_end, unit (its number in the text).

    Extra columns of ``df`` are left out, so names cannot clash. Null or empty texts give no row.
    """
    src = spread(df.select(*keys, F.col(text).alias("__text")))
    fields = [src.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", span_start bigint, span_end bigint, unit int"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(len(keys)).to_pylist()
        got = [u for lo, hi in blocks(texts, 1_000_000) for u in units(texts[lo:hi])]
        n = np.array([len(g) for g in got])
        take = pa.array(np.repeat(np.arange(b.num_rows), n))
        spans = np.concatenate(got) if got else np.zeros((0, 2), np.int64)
        cols = [b.column(i).take(take) for i in range(len(keys))]
        no = np.concatenate([np.arange(x) for x in n]) if len(n) else np.zeros(0)
        cols += [pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64()), pa.array(no, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "span_start", "span_end", "unit"])

    return arrow_map(src, run, schema)

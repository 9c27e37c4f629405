"""Language of texts and segments by a string kernel.

The kernel of two segments is the cosine of their blended-spectrum presence vectors: the sets of
character runs of ``SPECTRUM`` lengths over letters, everything else being one blank. ``LANDMARKS``
training segments span a Nyström space; in it a kernel ridge regression is fitted for each language
against the rest. A segment's scores are kernel(segment, landmarks) @ weights; as presence kernels are
linear in the runs, landmarks and weights are multiplied once into a table run x language (a fixed
2**``HASH_BITS`` rows) and a batch is scored as one sparse-by-dense matrix product.

The classifier is fitted on a bounded sample: at most about ``SAMPLE`` segments of each language, of rows
whose label names one, chosen by a hash of the text. Labels may be wrong, so the fit is repeated once
without the segments that the first fit gives to another language.

Every text is blanked of code, tags and formulas (``markup.view``), cut into sentence units
(``sentences.units``) and each unit scored. A unit counts as a
sentence from ``MIN_LETTERS`` letters and, where words are spaced, ``MIN_WORDS`` words on. The
confidence of a unit is the margin of its best score over the second, cut to 0..1; a language's
confidence in a text is the largest of its units. Units too short for a sentence are pooled by language and
scored as one, and so are all units of a main language that none of them shows clearly; what is short even
then needs a larger margin. Null texts and texts without letters have no language.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import arrow_map, spread, table
from lectern.llm.markup import view
from lectern.llm.sentences import blocks, units

SPECTRUM = (2, 3, 4)
HASH_BITS = 17
SAMPLE = 500
#: The sample's rows have so many characters and give so many sentences each: bounds of the fit, not of what is scored.
SAMPLE_CHARS, SAMPLE_UNITS = (20, 2000), 4
LANDMARKS = 960
RIDGE = 2e-5
#: Characters scored at a time.
BLOCK = 300_000
MIN_LETTERS, MIN_WORDS = 10, 4
UNSPACED = frozenset(("ja", "th", "zh"))
#: A language other than the text's main one needs a unit of this margin: in another script, in the same script.
MARGIN_SCRIPT, MARGIN = 0.2, 0.3
#: Margin from which a pool counts if it has 2 or 3 words or another than the main language, and from which a label of the same script is wrong from LONG_WORDS words on.
MARGIN_SHORT, MARGIN_LONG, SHORT_WORDS, LONG_WORDS = 0.5, 0.1, 2, 5
# Languages by script; those not listed are written in Latin letters.
SCRIPTS = {"ar": "Arab", "hi": "Deva", "ja": "Jpan", "zh": "Hani", "th": "Thai", "ru": "Cyrl", "uk": "Cyrl"}


def _tables() -> np.ndarray:
    """Code point -> lower-case code point of a letter or mark, 32 for all else."""
    import unicodedata

    t = np.full(0x32400, 32, np.uint32)
    t[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)  # further ideographs
    for cp in range(0x20000):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3:
            t[cp] = cp
        elif not 0xD800 <= cp <= 0xF8FF:
            c = chr(cp)
            if unicodedata.category(c)[0] in "LM":
                low = c.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
    return t


_LETTER = _tables()


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed runs, text numbers, letters, words of each text): each text's set of runs, sorted by text."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seg = np.repeat(np.arange(n, dtype=np.int64), sizes)
    c = _LETTER[np.minimum(cp, len(_LETTER) - 1)]
    letters = np.bincount(seg[c != 32], minlength=n)
    first = c != 32
    first[1:] &= (c[:-1] == 32) | (seg[1:] != seg[:-1])
    words = np.bincount(seg[first], minlength=n)
    # names and quoted words in Latin letters say nothing in a text of another script
    latin = (c < 0x250) & (c != 32)
    few = np.bincount(seg[latin], minlength=n) < 0.85 * letters
    c = np.where(latin & few[seg], 32, c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (seg[1:] != seg[:-1])
    c, seg = c[keep].astype(np.uint64), seg[keep]
    out = []
    mul, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - HASH_BITS)
    with np.errstate(over="ignore"):
        for k in SPECTRUM:
            if len(c) < k:
                continue
            h = c[: len(c) - k + 1].copy()
            for i in range(1, k):
                h = h * np.uint64(0x100000001B3) + c[i : len(c) - k + 1 + i]
            h = ((h + np.uint64(k)) * mul) >> shift
            same = seg[: len(seg) - k + 1] == seg[k - 1 :]
            out.append((seg[: len(seg) - k + 1][same] << HASH_BITS) | h[same].astype(np.int64))
    key = np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key & ((1 << HASH_BITS) - 1), key >> HASH_BITS, letters, words


class Model:
    """Fitted table: runs that occur in a landmark, by language. ``index`` has a run's row; the last row is zero."""

    def __init__(self, languages: list, index: np.ndarray, table: np.ndarray):
        self.languages, self.index, self.table = languages, index, table

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        langs = sorted(set(labels))
        y = np.array([langs.index(x) for x in labels])
        keep = np.arange(len(texts))
        for again in (True, False):
            # landmarks: the same number of each language, in the sample's order
            per = max(1, landmarks // len(langs))
            marks = [i for k in range(len(langs)) for i in keep[y[keep] == k][:per]]
            g, s, _, _ = runs([texts[i] for i in marks])
            cols = np.unique(g)
            index = np.full(1 << HASH_BITS, len(cols), np.int32)
            index[cols] = np.arange(len(cols))
            m = np.zeros((len(cols) + 1, len(marks)), np.float32)
            m[index[g], s] = 1
            m /= np.sqrt(np.maximum(m.sum(0), 1))
            w, v = np.linalg.eigh((m.T @ m).astype(np.float64))
            good = w > 1e-6 * w.max()
            root = v[:, good] / np.sqrt(w[good])
            near = cls(marks, index, m)
            phi = np.concatenate([near.score([texts[i] for i in keep[a : a + 500]])[0] @ root for a in range(0, len(keep), 500)])
            target = -np.ones((len(keep), len(langs)))
            target[np.arange(len(keep)), y[keep]] = 1
            a = np.linalg.solve(phi.T @ phi + ridge * len(keep) * np.eye(phi.shape[1]), phi.T @ target)
            model = cls(langs, index, (m @ (root @ a)).astype(np.float32))
            if again:
                right = np.flatnonzero(model.score(texts)[0].argmax(1) == y)
                keep = right if len(right) else keep
        return model

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores text x language, and the letters and words of each text."""
        g, s, letters, words = runs(texts)
        n = len(texts)
        out = np.zeros((n, self.table.shape[1]), np.float32)
        if len(g):
            size = np.bincount(s, minlength=n)  # all runs count in the norm
            rows = self.index[g]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            step = max(1 << 10, (1 << 20) // self.table.shape[1])  # blocks of runs, so the gathered rows stay in cache
            at = 0
            while at < len(first):
                end = max(int(np.searchsorted(first, first[at] + step)), at + 1)
                lo, hi = first[at], first[end] if end < len(first) else len(g)
                out[s[first[at:end]]] = np.add.reduceat(self.table[rows[lo:hi]], first[at:end] - lo, axis=0)
                at = end
            out /= np.sqrt(np.maximum(size, 1))[:, None]
        return out, letters, words


def segments(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int, float, int, int]]]:
    """For each text its units: start, end, language number (-1: no letters), margin, letters, words."""
    out: list[list[tuple[int, int, int, float, int, int]]] = []
    for a, b in blocks(texts, BLOCK):
        out += _segments(texts[a:b], model)
    return out


def _segments(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int, float, int, int]]]:
    views = [view(t)[1] if t else "" for t in texts]
    spans = units(views)
    flat = [v[a:b] for v, sp in zip(views, spans) for a, b in sp]
    if not flat:
        return [[] for _ in texts]
    score, letters, words = model.score(flat)
    best = score.argmax(1)
    if score.shape[1] < 2:
        score = np.concatenate([score, np.full((len(score), 1), -1, np.float32)], 1)
    two = np.partition(score, -2, axis=1)[:, -2:]
    margin = np.clip(two[:, 1] - two[:, 0], 0, 1)
    best = np.where(letters > 0, best, -1)
    out, k = [], 0
    for sp in spans:
        out.append([(int(a), int(b), int(best[k + i]), float(margin[k + i]), int(letters[k + i]), int(words[k + i])) for i, (a, b) in enumerate(sp)])
        k += len(sp)
    return out


def _sentence(k: int, letters: int, words: int, names: list[str]) -> bool:
    return letters >= MIN_LETTERS and (words >= MIN_WORDS or names[k] in UNSPACED)


def _main(units_: list[tuple[int, int, int, float, int, int]]) -> int:
    """The language with most letters in clear units; -1: none."""
    weight: dict[int, float] = {}
    unclear: dict[int, float] = {}
    for _, _, k, m, n, _ in units_:
        if k >= 0:
            at = weight if m >= MARGIN_SCRIPT else unclear
            at[k] = at.get(k, 0.0) + n * m
    weight = weight or unclear
    return max(weight, key=lambda k: (weight[k], -k)) if weight else -1


def pools(texts: list[str | None], found: list[list[tuple[int, int, int, float, int, int]]], model: Model) -> list[list[tuple[int, float, int, int]]]:
    """For each text (language, margin, letters, words) of its units that are scored as one: the short ones of a language, and all of an unclear main language."""
    out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
    owner, joined = [], []
    for i, units_ in enumerate(found):
        sets: dict[int, list] = {}
        for u in units_:
            if u[2] >= 0 and not _sentence(u[2], u[4], u[5], model.languages):
                sets.setdefault(u[2], []).append(u)
        main = _main(units_)
        own = [u for u in units_ if u[2] == main]
        if main >= 0 and max((u[3] for u in own if _sentence(main, u[4], u[5], model.languages)), default=0.0) < MARGIN:
            sets[-1] = own
        if sets:
            v = view(texts[i])[1]
            for us in sets.values():
                owner.append(i)
                joined.append("\n".join(v[u[0] : u[1]] for u in us))
    for a, b in blocks(joined, BLOCK):
        score, letters, words = model.score(joined[a:b])
        if score.shape[1] < 2:
            score = np.concatenate([score, np.full((len(score), 1), -1, np.float32)], 1)
        two = np.partition(score, -2, axis=1)[:, -2:]
        for i, k, m, n, w in zip(owner[a:b], score.argmax(1), np.clip(two[:, 1] - two[:, 0], 0, 1), letters, words):
            out[i].append((int(k), float(m), int(n), int(w)))
    return out


def languages_of(units_: list[tuple[int, int, int, float, int, int]], names: list[str], pooled: list[tuple[int, float, int, int]] = ()) -> dict[int, float]:
    """Languages in which a text has a sentence, with their confidence. The main one has most letters in clear units."""
    main = _main(units_)
    if main < 0:
        return {}
    conf: dict[int, float] = {}
    for _, _, k, m, n, words in units_:
        if k >= 0 and _sentence(k, n, words, names):
            conf[k] = max(conf.get(k, 0.0), m)
    for k, m, n, words in pooled:  # names and signs make up much of what is short: another language needs a whole sentence and the larger margin
        if _sentence(k, n, words, names) and (k == main or m >= MARGIN_SHORT) or k == main and words >= SHORT_WORDS and m >= MARGIN_SHORT:
            conf[k] = max(conf.get(k, 0.0), m)
    script = SCRIPTS.get(names[main])
    return {main: conf.get(main, 0.0)} | {k: c for k, c in conf.items() if k != main and c >= (MARGIN if SCRIPTS.get(names[k]) == script else MARGIN_SCRIPT)}


def is_case(found: dict[int, float], code: str | None, names: list[str], words: int = MIN_WORDS) -> bool:
    """No label, several languages, or clearly another one than the label's. ``words``: those in units of the main language."""
    if not found:
        return False
    if code is None or len(found) > 1:
        return True
    k, c = next(iter(found.items()))
    return names[k] != code and (c >= (MARGIN_LONG if words >= LONG_WORDS else MARGIN) or SCRIPTS.get(names[k]) != SCRIPTS.get(code))


def label_code(label: Column, names: DataFrame) -> Column:
    """The code a label names: code, iso3 or English name in any case, with or without a region; else null.

    ``names`` is the fixed table of languages (tens of rows); it becomes a literal map.
    """
    known = {}
    for r in names.collect():
        for k in (r["code"], r["iso3"], r["english_name"]):
            if k:
                known[k.lower()] = r["code"]
    if not known:
        return F.lit(None).cast("string")
    m = F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv))
    low = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(m, low), F.try_element_at(m, F.regexp_extract(low, r"^([a-z]{2,3})[-_][a-z0-9]{2,8}$", 1)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, rec_id, label, code (null: the label names no language), text."""
    names = table(spark, sf_dir, "language_names")
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("rec_id"), F.col("lang").alias("label"), "text")
    c = table(spark, sf_dir, "corpus_records").select(F.lit("corpus_records").alias("origin"), F.col("record_id").alias("rec_id"), F.col("language").alias("label"), "text")
    both = spread(c).unionByName(spread(d))
    return both.withColumn("code", label_code(F.col("label"), names))


def fitted(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> Model:
    """A model of labelled records of SAMPLE_CHARS characters: about ``sample`` rows a language, of each the first SAMPLE_UNITS sentences, fitted in one task."""
    names = table(spark, sf_dir, "language_names")
    rows = table(spark, sf_dir, "corpus_records").select(label_code(F.col("language"), names).alias("code"), "text").where(f"code is not null and text is not null and length(text) between {SAMPLE_CHARS[0]} and {SAMPLE_CHARS[1]}")
    sizes = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model(["und"], np.zeros(1 << HASH_BITS, np.int32), np.zeros((1, 1), np.float32))
    if not sizes:
        return none
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, sample / n)))
    at = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    chosen = rows.where(at < F.element_at(share, F.col("code"))).select("code", "text").dropDuplicates()

    def fit(batches):
        got = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        got.sort(key=lambda r: hashlib.md5(r[1].encode("utf-8", "surrogatepass")).digest())
        texts, labels = [], []
        for (code, text), sp in zip(got, units([t for _, t in got])):
            for a, b in sp[:SAMPLE_UNITS]:
                if b - a >= MIN_LETTERS:
                    texts.append(text[a:b])
                    labels.append(code)
        if texts:
            m = Model.fit(texts, labels)
            yield pa.RecordBatch.from_arrays([pa.array([m.languages], pa.list_(pa.string())), pa.array([m.index.astype(np.int32).tobytes()], pa.binary()), pa.array([m.table.astype(np.float32).tobytes()], pa.binary())], names=["languages", "index", "table"])

    # the sample is bounded, so one task holds it; the table that comes back has at most 2**HASH_BITS rows
    r = chosen.repartition(1).mapInArrow(fit, "languages array<string>, index binary, table binary").first()
    if r is None:
        return none
    return Model(list(r["languages"]), np.frombuffer(r["index"], np.int32), np.frombuffer(r["table"], np.float32).reshape(-1, len(r["languages"])))


def _scored(rows: DataFrame, model: Model, detail: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.languages, model.index, model.table))  # at most 2**17 x (languages + 1) numbers: 9 MB

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*shared.value)
        texts = b.column(3).to_pylist()
        got = segments(texts, m)
        if detail:
            n = [len(g) for g in got]
            take = pa.array(np.repeat(np.arange(b.num_rows), n))
            flat = [u for g in got for u in g]
            return pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array([u[0] for u in flat], pa.int64()), pa.array([u[1] for u in flat], pa.int64()), pa.array([m.languages[u[2]] if u[2] >= 0 else None for u in flat], pa.string()), pa.array([u[3] for u in flat], pa.float64())],
                names=["origin", "rec_id", "span_start", "span_end", "language", "confidence"],
            )
        found = [languages_of(g, m.languages, p) for g, p in zip(got, pools(texts, got, m))]
        words = [sum(u[5] for u in g if u[2] == next(iter(f), -1)) for g, f in zip(got, found)]
        codes = b.column(2).to_pylist()
        out = [(i, m.languages[k], c) for i, (f, code, n) in enumerate(zip(found, codes, words)) if is_case(f, code, m.languages, n) for k, c in f.items()]
        take = pa.array([x[0] for x in out], pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.float64())], names=["origin", "rec_id", "language", "confidence"])

    head = "origin string, rec_id bigint, "
    return arrow_map(rows.select("origin", "rec_id", "code", "text"), run, head + ("span_start bigint, span_end bigint, " if detail else "") + "language string, confidence double")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(labelled(spark, sf_dir), fitted(spark, sf_dir), False).select("origin", "rec_id", "language")


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of every text with its language and confidence."""
    return _scored(labelled(spark, sf_dir), fitted(spark, sf_dir), True)

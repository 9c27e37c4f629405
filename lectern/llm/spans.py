"""Long exact spans shared between records, by suffix automata of reference shards.

1. Winnowing. Every run of ``LENGTH`` characters (a window) picks the least of its 64-character hashes as
   its anchor; equal windows pick equal anchors. Consecutive windows with one anchor make a context:
   the text they cover. A row per anchor: its hash, document, place and the context's own 128-bit hash.
2. Anchors of one document only are dropped (minimum and maximum document, combined on the map side), and so are
   those where neither half of a window around the anchor recurs. A context that stands verbatim in two documents is
   shared as a whole.
3. What is left - contexts of one document whose anchor has other contexts elsewhere, the edges of
   passages - goes to suffix automata: all distinct contexts of an anchor lie in one shard of bounded size, one
   generalised automaton is built per shard, every state knows the least and greatest document of its
   occurrences, and the contexts are streamed through it for matching statistics: at each end the longest
   suffix that stands in two documents. Suffixes of ``LENGTH`` or more are spans.
4. Spans of a document that overlap or touch become one.

A shard is sent to the task that streams its contexts instead of being broadcast to all: the reference here is
the corpus itself, which has no size bound. An anchor with more than ``MAX_CONTEXTS`` distinct contexts would
overflow a shard; its windows are counted exactly by their hashes instead. Copies cost one row per
anchor, never a pair. Null and shorter texts have no spans; a run repeated within one document only is not shared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.runtime import arrow_map, spread, table, written

LENGTH = 200
GRAM = 64
SHARD_CHARS = 100_000
MAX_CONTEXTS = 500
#: Characters of a text handled at a time; pieces overlap by a window.
PIECE = 1 << 22
_P1, _P2 = 0x100000001B3, 0xD6E8FEB86659FD93
_I1, _I2 = pow(_P1, -1, 1 << 64), pow(_P2, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Polynomial hashes (modulo 2**64, two multipliers) of any stretch of a text."""

    def __init__(self, cp: np.ndarray):
        n = len(cp)
        x = cp.astype(np.uint64) + np.uint64(1)
        x ^= x << np.uint64(21)
        x *= _MIX
        x ^= x >> np.uint64(29)
        self.sums, self.back = [], []
        for p, inv in ((_P1, _I1), (_P2, _I2)):
            w = np.empty(n + 1, np.uint64)
            w[0] = 1
            w[1:] = np.uint64(inv)
            np.multiply.accumulate(w, out=w)
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(x * w[:-1], out=s[1:])
            b = np.empty(n + 1, np.uint64)
            b[0] = 1
            b[1:] = np.uint64(p)
            np.multiply.accumulate(b, out=b)
            self.sums.append(s)
            self.back.append(b)

    def of(self, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
        h = (self.sums[which][b] - self.sums[which][a]) * self.back[which][a]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values in two passes."""
    n = len(x)
    k = -(-n // w)
    y = np.full(k * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(k, w)
    pre = np.minimum.accumulate(y, axis=1).ravel()
    suf = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def anchors(text: str, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context start, context length, context hash 1, 2, left key, right key) of each context.

    A window holds its anchor and, on one side of it at least, half of its other characters: the keys are hashes of the
    anchor with that many characters before or behind it, -1 where a window has no room for them.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    for at in range(0, max(1, len(cp) - length + 1), PIECE):
        piece = cp[at : at + PIECE + length - 1]
        if len(piece) < length:
            break
        with np.errstate(over="ignore"):
            hs = Hashes(piece)
            i = np.arange(len(piece) - gram + 1)
            h = hs.of(i, i + gram, 0)
            key = (h >> np.uint64(24) << np.uint64(24)) | i.astype(np.uint64)
            pick = (sliding_min(key, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
            last = np.concatenate((first[1:] - 1, [len(pick) - 1])) + length
            a, side = pick[first], (length - gram + 1) // 2
            keys = []
            for lo, hi in ((a - side, a + gram), (a, a + gram + side)):
                room = (lo >= 0) & (hi <= len(piece))
                k = hs.of(np.where(room, lo, 0), np.where(room, hi, 0), 1) >> np.uint64(33)
                keys.append(np.where(room, k.astype(np.int64), -1))
            parts.append((h[a].view(np.int64), first + at, last - first, hs.of(first, last, 0).view(np.int64), hs.of(first, last, 1).view(np.int64), *keys))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(x) for x in zip(*parts))


class Automaton:
    """Generalised suffix automaton; ``low`` and ``high`` are the least and greatest owner of a state's occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.low, self.high = [1 << 62], [-1]

    def add(self, text: str, low: int, high: int) -> None:
        nxt, link, length, lows, highs = self.next, self.link, self.length, self.low, self.high
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
            elif q is not None:
                k = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[last] + 1)
                lows.append(1 << 62)
                highs.append(-1)
                link[q] = k
                p = last
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = k
                    p = link[p]
                last = k
            else:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                lows.append(1 << 62)
                highs.append(-1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                    else:
                        k = len(nxt)
                        nxt.append(nxt[q].copy())
                        link.append(link[q])
                        length.append(length[p] + 1)
                        lows.append(1 << 62)
                        highs.append(-1)
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = k
                            p = link[p]
                        link[q] = link[cur] = k
                last = cur
            if low < lows[last]:
                lows[last] = low
            if high > highs[last]:
                highs[last] = high

    def close(self) -> None:
        """Owners up the suffix links; then for each state the longest suffix that has two owners."""
        order = np.argsort(np.array(self.length), kind="stable")
        link, low, high = self.link, self.low, self.high
        for s in order[::-1].tolist():
            p = link[s]
            if p >= 0:
                if low[s] < low[p]:
                    low[p] = low[s]
                if high[s] > high[p]:
                    high[p] = high[s]
        shared = [0] * len(link)
        for s in order.tolist():
            shared[s] = self.length[s] if low[s] < high[s] and s else (shared[link[s]] if s else 0)
        self.shared = shared

    def statistics(self, text: str, least: int = 1) -> list[int]:
        """At each end from the ``least``-th character on, the length of the longest suffix that stands in two documents."""
        nxt, length, link, shared = self.next, self.length, self.link, self.shared
        out, s, n = [], 0, 0
        for i, c in enumerate(text, 1):
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(c)
            if t is not None:
                s = t
                n += 1
            if i >= least:  # what was really read of the state's longest string, or the longest shared suffix below it
                k = shared[s]
                out.append(n if k >= n else k)
        return out


def shared_spans(contexts: list[tuple[str, int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each (text, least, greatest owner) its stretches of shared runs of at least ``length``.

    A text of two owners is shared as a whole; it only serves as reference for the others.
    """
    a = Automaton()
    for t, low, high in contexts:
        a.add(t, low, high)
    a.close()
    out = []
    for t, low, high in contexts:
        spans: list[tuple[int, int]] = []
        if low < high:
            spans = [(0, len(t))] if len(t) >= length else []
        else:
            for i, n in enumerate(a.statistics(t, length), length):
                if n >= length:
                    if spans and i - n <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], i - n), i)
                    else:
                        spans.append((i - n, i))
        out.append(spans)
    return out


def spans_of(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """doc_id, span_start, span_end: maximal shared stretches."""
    src = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= length)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [anchors(t, length) for t in b.column(1).to_pylist()]
        n = [len(g[0]) for g in got]
        cols = [pa.array(np.concatenate([g[i] for g in got])) for i in range(5)]
        keys = [pa.array(np.concatenate([g[i] for g in got]).astype(np.int32)) for i in (5, 6)]
        return pa.RecordBatch.from_arrays([cols[0], b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n))), *cols[1:], *keys], names=["h", "doc", "at", "len", "c1", "c2", "kl", "kr"])

    fp = written(arrow_map(spread(src), run, "h bigint, doc bigint, at bigint, len bigint, c1 bigint, c2 bigint, kl int, kr int"), "p5-anchors")
    again = fp.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    met = written(fp.join(again, "h"), "p5-met")
    # a phrase that recurs amid differing text: neither half of a window around it stands in another document
    half = lambda k: met.where(F.col(k) >= 0).groupBy("h", k).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h", k, F.lit(True).alias(f"{k}_again"))
    occ = written(met.join(half("kl"), ["h", "kl"], "left").join(half("kr"), ["h", "kr"], "left").where("kl_again or kr_again").select("h", "doc", "at", "len", "c1", "c2"), "p5-again")
    ctx = occ.groupBy("h", "c1", "c2", "len").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min_by("at", "doc").alias("at"))
    per = ctx.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("lo") == F.col("hi"), 1)).alias("single"))
    mixed = written(ctx.join(per.where("n > 1 and single > 0"), "h"), "p5-mixed")

    # texts of the distinct contexts: each from its first document
    wanted = mixed.groupBy(F.col("lo").alias("doc")).agg(F.collect_list(F.struct("h", "c1", "c2", "len", "lo", "hi", "at", "n")).alias("want"))
    with_text = (
        wanted.join(src, "doc")
        .select(F.explode(F.transform("want", lambda w: F.struct(*(w[c].alias(c) for c in ("h", "c1", "c2", "len", "lo", "hi", "n")), F.substring(F.col("text"), w["at"].cast("int") + 1, w["len"].cast("int")).alias("text")))).alias("w"))
        .select("w.*")
    )
    with_text = written(with_text, "p5-contexts")
    size = with_text.where(F.col("n") <= max_contexts).agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_CHARS))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        got = shared_spans(list(zip(pdf["text"], pdf["lo"].tolist(), pdf["hi"].tolist())), length)
        rows = [(h, a, b, n, s, e) for h, a, b, n, g in zip(pdf["h"], pdf["c1"], pdf["c2"], pdf["len"], got) for s, e in g]
        return pd.DataFrame(rows, columns=["h", "c1", "c2", "len", "s", "e"]).astype("int64")

    parts = with_text.where(F.col("n") <= max_contexts).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    edge = parts.groupBy("shard").applyInPandas(shard, "h bigint, c1 bigint, c2 bigint, len bigint, s bigint, e bigint")

    # anchors with too many contexts for a shard: their windows by hash, exactly
    def windows(b: pa.RecordBatch) -> pa.RecordBatch:
        take, w1, w2, at = [], [], [], []
        for k, t in enumerate(b.column(4).to_pylist()):
            cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            i = np.arange(len(cp) - length + 1)
            with np.errstate(over="ignore"):
                hs = Hashes(cp)
                w1.append(hs.of(i, i + length, 0).view(np.int64))
                w2.append(hs.of(i, i + length, 1).view(np.int64))
            take.append(np.full(len(i), k))
            at.append(i)
        ix = pa.array(np.concatenate(take))
        return pa.RecordBatch.from_arrays([*(b.column(c).take(ix) for c in (0, 1, 2, 3, 5, 6)), pa.array(np.concatenate(w1)), pa.array(np.concatenate(w2)), pa.array(np.concatenate(at))], names=["h", "c1", "c2", "len", "lo", "hi", "w1", "w2", "s"])

    many = with_text.where(F.col("n") > max_contexts).select("h", "c1", "c2", "len", "text", "lo", "hi")
    win = arrow_map(many, windows, "h bigint, c1 bigint, c2 bigint, len bigint, lo bigint, hi bigint, w1 bigint, w2 bigint, s bigint")
    twice = win.groupBy("w1", "w2").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("w1", "w2")
    rest = win.join(twice, ["w1", "w2"]).select("h", "c1", "c2", "len", "s", (F.col("s") + length).alias("e"))

    inner = edge.unionByName(rest)
    whole = ctx.where("lo < hi").select("h", "c1", "c2", "len", F.lit(0).cast("bigint").alias("s"), F.col("len").alias("e"))
    spans = occ.join(inner.unionByName(whole), ["h", "c1", "c2", "len"]).select("doc", F.struct((F.col("at") + F.col("s")).alias("a"), (F.col("at") + F.col("e")).alias("b")).alias("x"))
    # overlapping or touching spans of a document: a running maximum, then one group a stretch
    flat = spans.select("doc", "x.a", "x.b").distinct()
    by = Window.partitionBy("doc").orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = flat.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "run").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).select(F.col("doc").alias("doc_id"), "span_start", "span_end")


def without_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept``: the text without its shared stretches. A null text stays null."""
    got = spans.groupBy(F.col("doc_id").alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").cast("int").alias("a"), F.col("span_end").cast("int").alias("b")))).alias("_s"))
    rows = docs.join(got, docs[key] == got["_k"], "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("_s", lambda x: x["b"]))
    starts = F.concat(F.transform("_s", lambda x: x["a"]), F.array(F.length(text)))
    rest = F.array_join(F.transform(F.arrays_zip(ends.alias("b"), starts.alias("a")), lambda x: F.substring(F.col(text), x["b"] + 1, x["a"] - x["b"])), "")
    return rows.withColumn("kept", F.when(F.col("_s").isNull(), F.col(text)).otherwise(rest)).drop("_k", "_s")


def p5_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its shared stretches: what is left, by length and digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_spans(d, spans_of(d)).select("doc_id", F.coalesce(F.length("kept"), F.lit(0)).cast("bigint").alias("chars"), F.md5(F.coalesce("kept", F.lit(""))).alias("kept"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its characters, its shared characters and their part (0 for an empty text)."""
    d = table(spark, sf_dir, "documents")
    got = spans_of(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    out = d.select("doc_id", n.alias("chars")).join(got, "doc_id", "left").na.fill(0, ["spans", "shared"])
    return out.withColumn("share", F.when(F.col("chars") > 0, F.round(F.col("shared") / F.col("chars"), 6)).otherwise(F.lit(0.0)))

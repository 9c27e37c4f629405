"""Oversized texts in pieces by content-defined chunking.

A text of more tokens than the capacity is cut into cores; a piece is a core with the last ``overlap`` tokens
of what precedes it. Landmarks are places where a rolling hash over ``WINDOW`` characters is least among
its neighbours; each snaps to the nearest natural boundary (paragraph, then line, sentence, word). From a
core's start the landmarks between the minimum and maximum size are looked at: the best kind of boundary wins, and
among equals the least hash. Without a landmark there the best boundary near the maximum is taken, without
any boundary the token at the maximum. As the choice hangs on nearby text only, an edit moves the cuts
beside it and later ones fall on the same landmarks again.

Sizes are those of the piece encoded by itself; a piece that comes out above the capacity that way is cut
earlier. A piece has the whole overlap but where the capacity has no room for it; how much it has is
told (``overlap``, in tokens of the text). Null and empty texts give no piece, texts within the capacity one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import arrow_map, spread, table
from lectern.llm.spans import sliding_min
from lectern.llm.tokens import VOCABULARY, count, encoder, limit, offsets

WINDOW = 32
#: Characters on either side among which a landmark's hash is the least.
REACH = 64
#: Characters a landmark may move to a boundary.
SNAP = 160
#: A core's least size as a part of its greatest.
LEAST = 0.5

_PARA = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n+")
_SENT = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+|(?<=[。！？।])[」』”]?")
_WORD = re.compile(r"\s+")
PARAGRAPH, LINE, SENTENCE, WORD, NONE = range(5)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places before which a piece may start, and their kind."""
    kind = np.full(len(text) + 1, NONE, np.int8)
    for k, rx in ((WORD, _WORD), (SENTENCE, _SENT), (LINE, _LINE), (PARAGRAPH, _PARA)):
        for m in rx.finditer(text):
            kind[m.end()] = k
    at = np.flatnonzero(kind < NONE)
    at = at[(at > 0) & (at < len(text))]
    return at, kind[at]


def landmarks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places whose rolling hash is least within REACH, and the hashes."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(cp) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            h = h * np.uint64(0x100000001B3) + cp[i : i + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    low = sliding_min(np.pad(h, REACH, constant_values=np.iinfo(np.uint64).max), 2 * REACH + 1)
    at = np.flatnonzero(h == low)
    return at + WINDOW // 2, h[at]


def cut(text: str, capacity: int, overlap: int, path: str = VOCABULARY) -> list[tuple[int, int, int, int, int]]:
    """(start, core start, end, tokens, tokens of the overlap) of each piece."""
    if not text:
        return []
    n = count(text, path)
    if n <= capacity:
        return [(0, 0, len(text), n, 0)]
    off = offsets(text, path)
    bounds, kinds = boundaries(text)
    marks, hashes = landmarks(text)
    if len(bounds) and len(marks):
        i = np.clip(np.searchsorted(bounds, marks), 1, max(1, len(bounds) - 1))
        left, right = bounds[np.minimum(i - 1, len(bounds) - 1)], bounds[np.minimum(i, len(bounds) - 1)]
        near = np.where(np.abs(marks - left) <= np.abs(right - marks), np.minimum(i - 1, len(bounds) - 1), np.minimum(i, len(bounds) - 1))
        # a better kind of boundary within reach counts for more than a nearer one
        for k in (PARAGRAPH, LINE, SENTENCE):
            better = np.flatnonzero(kinds == k)
            if len(better):
                j = np.clip(np.searchsorted(bounds[better], marks), 0, len(better) - 1)
                for jj in (np.maximum(j - 1, 0), j):
                    ok = (np.abs(bounds[better[jj]] - marks) <= SNAP) & (kinds[near] > k)
                    near = np.where(ok, better[jj], near)
        ok = np.abs(bounds[near] - marks) <= SNAP
        spots, spot_kind, spot_hash = bounds[near][ok], kinds[near][ok], hashes[ok]
        order = np.argsort(spots, kind="stable")
        spots, spot_kind, spot_hash = spots[order], spot_kind[order], spot_hash[order]
    else:
        spots, spot_kind, spot_hash = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
    e = encoder(path)
    out: list[tuple[int, int, int, int, int]] = []

    def add(start: int, core: int, end: int, size: int) -> None:
        out.append((start, core, end, size, int(np.searchsorted(off, core) - np.searchsorted(off, start))))

    core = 0
    room = capacity - overlap
    total = len(off) - 1
    while core < len(text):
        first = int(np.searchsorted(off, core))
        start = min(core, int(off[max(0, first - overlap)])) if out else 0
        most = capacity if not out else room
        if total - first <= most:
            size = len(e.encode_ordinary(text[start:]))
            if size <= capacity:
                add(start, core, len(text), size)
                break
        reach = most
        while True:
            lo, hi = int(off[min(total, first + max(1, int(reach * LEAST)))]), int(off[min(total, first + reach)])
            hi = max(hi, core + 1)
            a, b = np.searchsorted(spots, lo), np.searchsorted(spots, hi, side="right")
            if b > a:
                k = np.lexsort((spot_hash[a:b], spot_kind[a:b]))[0] + a
                end = int(spots[k])
            else:
                a, b = np.searchsorted(bounds, lo), np.searchsorted(bounds, hi, side="right")
                if b > a:
                    best = kinds[a:b].min()
                    end = int(bounds[a:b][kinds[a:b] == best][-1])
                else:  # no boundary at all: the landmark itself, so that edits stay local here too
                    a, b = np.searchsorted(marks, lo), np.searchsorted(marks, hi, side="right")
                    end = int(marks[a + np.argmin(hashes[a:b])]) if b > a else hi
            end = max(end, core + 1)
            size = len(e.encode_ordinary(text[start:end]))
            if size <= capacity or reach <= 1:
                break
            reach = max(1, reach - max(1, size - capacity) - 1)
        kept = overlap
        while size > capacity and start < core:  # no room for the whole overlap here: as much of it as fits
            kept = max(0, kept - (size - capacity))
            start = min(core, max(start + 1, int(off[first - kept])))
            size = len(e.encode_ordinary(text[start:end]))
        add(start, core, end, size)
        core = end
    return out


def pieces(docs: DataFrame, capacity: int, overlap: int, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, piece, span_start, core_start, span_end, tokens, overlap."""
    src = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = src.schema["key"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [cut(t, capacity, overlap, path) for t in b.column(1).to_pylist()]
        n = [len(g) for g in got]
        flat = np.array([p for g in got for p in g], np.int64).reshape(-1, 5)
        no = np.array([i for g in got for i in range(len(g))], np.int32)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n))), pa.array(no), *(pa.array(flat[:, i]) for i in range(5))], names=["key", "piece", "span_start", "core_start", "span_end", "tokens", "overlap"])

    return arrow_map(src, run, f"key {kind}, piece int, span_start bigint, core_start bigint, span_end bigint, tokens bigint, overlap bigint").withColumnRenamed("key", key)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that were cut: those with a second piece."""
    capacity, overlap = limit(spark, sf_dir, "window")
    return pieces(table(spark, sf_dir, "documents"), capacity, overlap).where("piece = 1").select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, overlap = limit(spark, sf_dir, "window")
    return pieces(table(spark, sf_dir, "documents"), capacity, overlap)


def p9_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the characters that its pieces' cores cover, end to end: all of them."""
    got = p9_pieces(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("core_start")).alias("covered"), F.min("core_start").alias("first"), F.max("span_end").alias("last"))
    return table(spark, sf_dir, "documents").select("doc_id").join(got, "doc_id", "left").na.fill(0, ["covered", "first", "last"])

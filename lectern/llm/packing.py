"""Filling containers of one capacity by hierarchical multi-length packing.

Every text (piece, where a text alone exceeds the capacity) is routed to the smallest context size that holds it: an
eighth, a quarter, a half of the capacity, or the whole. From the longest tier to the shortest, the tier's items are packed into
windows of its own context size, and what is left of a window is filled with the longest items of the shorter tiers
that fit. Windows of the longest tier are containers. Whole windows of the shorter tiers then fill the gaps left in containers,
fullest window first, and the rest are put together into containers of their own the same way.
Containers are dealt to step groups in turn and back by their fill, so that the
groups of a training step are alike.

The items - numbers only, no text - are spread by a hash into groups of about ``GROUP`` items that are packed
independently; each group wastes at most a few part-filled containers. A hash keeps a hot source from
filling one group. The sizes at hand in a tier are one integer of capacity + 1 bits, so that the longest
that fits is found at once. Null and empty texts are items of no size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import table, written
from lectern.llm.pieces import pieces
from lectern.llm.tokens import limit

GROUP = 20_000
TIERS = (8, 4, 2, 1)
STEP = 64


class Shelf:
    """Units by size, of which the longest that fits a room is found at once."""

    def __init__(self):
        self.units: dict[int, list] = {}
        self.have = 0

    def put(self, size: int, unit) -> None:
        self.units.setdefault(size, []).append(unit)
        self.have |= 1 << size

    def take(self, room: int) -> tuple[int, object] | None:
        fits = self.have & ((1 << (room + 1)) - 1)
        if not fits:
            return None
        size = fits.bit_length() - 1
        unit = self.units[size].pop()
        if not self.units[size]:
            self.have ^= 1 << size
        return size, unit


def tiers_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Number of the smallest tier that holds each size: 0 is the shortest context."""
    return np.searchsorted(np.array([capacity // d for d in TIERS[:-1]]), sizes, side="left")


def pack(sizes: list[int], capacity: int) -> list[list[list[int]]]:
    """Containers as lists of windows, and these of item numbers; every item in one, no container above the capacity."""
    items = [Shelf() for _ in TIERS]
    for i, (s, t) in enumerate(zip(sizes, tiers_of(np.array(sizes), capacity).tolist())):
        items[t].put(s, i)
    boxes: list[tuple[int, list[list[int]]]] = []
    windows = Shelf()
    for t in range(len(TIERS) - 1, -1, -1):
        context = capacity // TIERS[t]
        while first := items[t].take(context):
            room, window = context - first[0], [first[1]]
            for shorter in range(t, -1, -1):  # its own tier first: only the shortest has items of which two fit
                while more := items[shorter].take(room):
                    room -= more[0]
                    window.append(more[1])
            if t == len(TIERS) - 1:
                boxes.append((room, [window]))
            else:
                windows.put(context - room, window)
    full = []
    for room, box in sorted(boxes, key=lambda b: b[0]):
        while more := windows.take(room):
            room -= more[0]
            box.append(more[1])
        full.append(box)
    while first := windows.take(capacity):
        room, box = capacity - first[0], [first[1]]
        while more := windows.take(room):
            room -= more[0]
            box.append(more[1])
        full.append(box)
    return full


def packed(items: DataFrame, capacity: int, group: int = GROUP, step: int = STEP) -> DataFrame:
    """items (doc_id, piece, span_start, span_end, tokens) with container, step_group, window, position, tier (the shortest context that holds the item, as a part of the capacity)."""
    n = items.count()
    groups = max(1, -(-n // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        loads = pdf["tokens"].to_numpy()
        boxes = pack(loads.tolist(), capacity)
        load = [sum(int(loads[w].sum()) for w in box) for box in boxes]
        order = sorted(range(len(boxes)), key=lambda b: (-load[b], b))
        steps = max(1, -(-len(boxes) // step))
        of = {}
        for rank, b in enumerate(order):  # there and back, so that every step gets its part of full and less full ones
            turn, at = divmod(rank, steps)
            of[b] = at if turn % 2 == 0 else steps - 1 - at
        g = int(pdf["g"].iloc[0])
        rows = [(i, (g << 32) + b, (g << 32) + of[b], w) for b, box in enumerate(boxes) for w, window in enumerate(box) for i in window]
        at = pd.DataFrame(rows, columns=["i", "container", "step_group", "window"])
        at["position"] = at.groupby("container").cumcount()
        out = pdf.drop(columns="g").join(at.set_index("i"))
        out["tier"] = np.array(TIERS)[tiers_of(loads, capacity)]
        return out[["container", "step_group", "window", "position", "doc_id", "piece", "span_start", "span_end", "tokens", "tier"]]

    spread_ = items.select("doc_id", "piece", "span_start", "span_end", "tokens").withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return spread_.groupBy("g").applyInPandas(run, "container bigint, step_group bigint, window int, position int, doc_id bigint, piece int, span_start bigint, span_end bigint, tokens bigint, tier int")


def items_of(docs: DataFrame, capacity: int) -> DataFrame:
    """Pieces without overlap, and the texts that have none as items of no size."""
    cut = written(pieces(docs, capacity, 0).drop("core_start", "overlap"), "p7-items")
    bare = docs.where("text is null or text = ''").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("span_start"), F.lit(0).cast("bigint").alias("span_end"), F.lit(0).cast("bigint").alias("tokens"))
    return cut.unionByName(bare)


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = limit(spark, sf_dir, "pack")
    return packed(items_of(table(spark, sf_dir, "documents"), capacity), capacity)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, the least number that could do (all tokens over the capacity), tokens and the part of the space that is used."""
    capacity, _ = limit(spark, sf_dir, "pack")
    boxes = packed(items_of(table(spark, sf_dir, "documents"), capacity), capacity).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return boxes.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("tokens") / capacity).alias("least"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the characters that its items cover, end to end, and how many of its containers are above the capacity: all, and none."""
    capacity, _ = limit(spark, sf_dir, "pack")
    got = packed(items_of(table(spark, sf_dir, "documents"), capacity), capacity)
    over = got.groupBy("container").agg((F.sum("tokens") > capacity).cast("int").alias("over"))
    return got.join(over, "container").groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("covered"), F.min("span_start").alias("first"), F.max("span_end").alias("last"), F.sum("over").alias("over"))

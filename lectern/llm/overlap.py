"""Same or near-same texts across splits: every pair within an edit distance of a fifth of the longer text.

Texts are folded (case, punctuation, blanks set aside) and collapsed to one representative per distinct
fold. The longer text of a pair, of n characters, is cut into segments of q characters side by side. One edit touches
at most one segment, so of two texts within distance k = n // 5 the shorter has all segments but k, wherever the edits are.
It has them near their place: what is inserted and deleted before a segment and behind it is k at most together, so places
counted from the middles of both texts, doubled, differ by k at most. Weights by document frequency have no such bound, as
edits may hit the heavy terms; all segments weigh the same.

The counts are made in blocks of texts of like length, tile by tile: a text meets the blocks whose lengths may fit, so a
block fits the memory of a task at any size of the table. The runs of all texts of a tile are one sorted list by run and place,
so the texts that have a segment near its place are one stretch of it (q = 4: a fifth of the segments must be there).
The pairs that are left must have two fifths of the segments of ``Q`` characters, and then n - Q + 1 - k * Q of all runs of the
longer text; what passes gets the exact edit distance. Where a bound is nil, all pairs whose lengths fit pass it.
Runs are numbered by a hash, and a run may count for two segments, so a count may be too great, never too small.

Work grows with the number of pairs whose lengths fit. Copies are expanded only at the end, as the found
pairs require.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import spread, table, written
from lectern.llm.canonical import fold, source_name, split_name

Q = 3
EDIT_SHARE = 5
#: Runs of texts of LONG characters and more.
LONG_Q, LONG = 4, 60
#: Texts and characters of a block.
BLOCK, BLOCK_CHARS = 8000, 4_000_000
#: Lengths of a band differ by less than this factor; lengths that fit (a factor of 1.25) are at most REACH bands apart.
BAND, REACH = 1.26, 1
#: Texts that are counted against each other densely, a cell for each pair, with their characters; texts and list entries at hand at a time.
DENSE, TILE_CHARS = 1024, 1_000_000
ROWS, ENTRIES = 64, 1_000_000
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def least_shared(longer: np.ndarray, q: int = Q) -> np.ndarray:
    """Runs that two texts within a fifth of the longer one's length share at least."""
    return longer - q + 1 - longer // EDIT_SHARE * q


class Block:
    """Texts as character codes, and lists of their runs by what they are and where they stand."""

    def __init__(self, texts: list[str], room: int):
        """room: the greatest length that any text compared with these has."""
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(("".join(texts) + "\0" * LONG_Q).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.middle, self.place_bits = room + room // EDIT_SHARE, (2 * room + 2 * (room // EDIT_SHARE) + 1).bit_length()
        self.owner_bits = max(1, len(texts).bit_length())
        self.run_bits = min(24, 62 - self.place_bits - DENSE.bit_length())
        self.key_bits = self.run_bits + self.place_bits
        # what a place adds to a key: its distance from the middle of its text, doubled
        self.place = np.repeat(self.middle - self.size - 2 * self.first, self.size)
        self.place += 2 * np.arange(len(self.place))
        self._hashed: dict[int, np.ndarray] = {}
        self._lists: dict[int, np.ndarray] = {}
        self._segments: dict[int, tuple[np.ndarray, ...]] = {}
        self._own: np.ndarray | None = None
        self._runs: dict[int, np.ndarray] = {}

    def hashed(self, q: int) -> np.ndarray:
        """The key of the q characters from each place of all texts on: their hash, and the place from the middle."""
        if q not in self._hashed:
            run = np.zeros(len(self.place), np.uint64)
            for i, factor in enumerate(_FACTORS[:q]):
                run += self.flat[i : i + len(run)] * factor
            run ^= run >> np.uint64(32)
            run *= _FACTORS[-1]
            run >>= np.uint64(64 - self.run_bits)
            run <<= np.uint64(self.place_bits)
            self._hashed[q] = run.view(np.int64) + self.place
        return self._hashed[q]

    def keys(self, q: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, number of them in each text) of the runs of q characters at every step-th place."""
        n = np.maximum(self.size - q, -step) // step + 1
        at = np.repeat(self.first - (np.cumsum(n) - n) * step, n)
        at += np.arange(0, len(at) * step, step)
        return np.repeat(np.arange(len(n)), n), self.hashed(q)[at], n

    def lists(self, q: int) -> np.ndarray:
        """Keys of all runs, each with its owner in the last bits, sorted."""
        if q not in self._lists:
            owner, key, _ = self.keys(q, 1)
            self._lists[q] = np.sort(key << self.owner_bits | owner)
        return self._lists[q]

    def segments(self, q: int) -> tuple[np.ndarray, ...]:
        """(owner, key, number in each text) of the runs side by side, sorted within their text."""
        if q not in self._segments:
            owner, key, n = self.keys(q, q)
            self._segments[q] = owner, np.sort(owner << self.key_bits | key) & (1 << self.key_bits) - 1, n
        return self._segments[q]

    def own(self) -> np.ndarray:
        """Keys of the runs of Q characters, sorted by text, with their owner in the first bits, and a last one beyond all."""
        if self._own is None:
            owner, key, n = self.keys(Q, 1)
            self._own = np.sort(np.append(owner << self.key_bits | key, len(n) << self.key_bits))
        return self._own

    def runs(self, i: int) -> np.ndarray:
        """Sorted keys of the runs of Q characters of text i."""
        if i not in self._runs:
            self._runs[i] = np.sort(self.hashed(Q)[self.first[i] : self.first[i] + max(0, self.size[i] - Q + 1)])
        return self._runs[i]

    def near(self, j: np.ndarray, key: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether text j has the key within k, for each j, key and k."""
        low = key + ((j << self.key_bits) - k)
        return self.own()[np.searchsorted(self.own(), low)] <= low + 2 * k


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, n of them, one after the other."""
    at = np.repeat(begin - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return at


def portions(n: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of at most ``most`` items whose n add up to ENTRIES at most, or of one item."""
    total, base = np.concatenate(([0], np.cumsum(n))), 0
    while base < len(n):
        top = max(base + 1, min(base + most, int(np.searchsorted(total, total[base] + ENTRIES, side="right")) - 1))
        yield slice(base, top)
        base = top


def shared_runs(mine: np.ndarray, theirs: np.ndarray) -> int:
    """Runs that both have, as often as both have them."""
    a, n = np.unique(mine, return_counts=True)
    b, m = np.unique(theirs, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def longer_pairs(x: Block, y: Block, strict: bool) -> list[tuple[int, int]]:
    """Numbers of x and y that may be within the distance, the text of x being the longer one (or, if not strict, as long). Both blocks are sorted by length."""
    # the y that fit each x
    k = x.size // EDIT_SHARE
    lo, hi = np.searchsorted(y.size, x.size - k), np.searchsorted(y.size, x.size, side="left" if strict else "right")
    if not (lo < hi).any():
        return []
    q = LONG_Q if x.size[np.argmax(lo < hi)] >= LONG else Q
    owner, key, n = x.segments(q)
    lists, width, order = y.lists(q), len(y.size), np.argsort(key)
    begin, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    by_key, reach = key[order], k[owner[order]]
    begin[order] = np.searchsorted(lists, by_key - reach << y.owner_bits)
    count[order] = np.searchsorted(lists, by_key + reach + 1 << y.owner_bits) - begin[order]
    # a list of more entries than there are texts counts for every text, unread
    long = count > width
    need = n - k - np.bincount(owner[long], minlength=len(n))
    count[long | (lo >= hi)[owner]] = 0
    posts = (lists & (1 << y.owner_bits) - 1).astype(np.int32)
    edge = np.concatenate(([0], np.cumsum(n)))
    entries = np.diff(np.concatenate(([0], np.cumsum(count)))[edge])
    _, apart, n_apart = x.segments(Q)
    edge_apart = np.cumsum(n_apart) - n_apart
    left: list[np.ndarray] = []
    for part in portions(entries, ROWS):
        own = slice(edge[part.start], edge[part.stop])
        cell = np.repeat(np.arange(part.stop - part.start) * width, entries[part])
        cell += posts[ranges(begin[own], count[own])]
        hits = np.bincount(cell, minlength=(part.stop - part.start) * width).reshape(-1, width)[:, lo[part.start] : hi[part.stop - 1]]
        i, j = np.nonzero(hits >= need[part, None])
        i, j = i + part.start, j + lo[part.start]
        left.append(np.stack((i, j))[:, (j >= lo[i]) & (j < hi[i])])
    i, j = np.concatenate(left, axis=1)
    by_text = np.argsort(j)
    i, j = i[by_text], j[by_text]
    found: list[tuple[int, int]] = []
    for some in portions(n_apart[i], len(i)):
        a, b, c = i[some], j[some], n_apart[i[some]]
        has = y.near(np.repeat(b, c), apart[ranges(edge_apart[a], c)], np.repeat(k[a], c))
        passed = np.bincount(np.repeat(np.arange(len(c)), c)[has], minlength=len(c)) >= c - k[a]
        found += [(i, j) for i, j in zip(a[passed].tolist(), b[passed].tolist()) if np.count_nonzero(y.near(j, x.runs(i), k[i])) >= least_shared(x.size[i])]
    return found


def tiles(texts: list[str], room: int) -> list[tuple[np.ndarray, Block]]:
    """The texts by length, as blocks with the numbers of their texts."""
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(size, kind="stable")
    out, base, end = [], 0, np.cumsum(size[order])
    while base < len(order):
        top = max(base + 1, min(base + DENSE, int(np.searchsorted(end, (end[base - 1] if base else 0) + TILE_CHARS, side="right"))))
        out.append((order[base:top], Block([texts[i] for i in order[base:top]], room)))
        base = top
    return out


def block_pairs(xs: list[str], ys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, shared runs) of the pairs of xs and ys that may be within the distance."""
    room = max(map(len, (*xs, *ys)), default=0)
    found: list[tuple[int, int, int]] = []
    others = tiles(ys, room)
    for xi, x in tiles(xs, room):
        for yi, y in others:
            pairs = longer_pairs(x, y, False) + [(i, j) for j, i in longer_pairs(y, x, True)]
            found += [(int(xi[i]), int(yi[j]), shared_runs(x.runs(i) >> x.place_bits, y.runs(j) >> y.place_bits)) for i, j in pairs]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """a, b (numbers of representatives with a train and another member), their texts na, nb and cosine: all pairs that may be within the distance."""
    band = F.floor(F.log(F.col("len").cast("double")) / float(np.log(BAND))).cast("int")
    rows = reps.select("rid", "norm", "tr", "ev", band.alias("band"))
    room = F.least(F.lit(BLOCK), F.greatest(F.lit(1), (F.lit(BLOCK_CHARS) / F.pow(F.lit(BAND), F.col("band") + 1)).cast("int")))
    # a row for each band, of which there are as many as the logarithm of the longest length
    sizes = rows.groupBy("band").agg(F.count(F.when(F.col("tr"), 1)).alias("t"), F.count(F.when(F.col("ev"), 1)).alias("e"))
    sizes = sizes.select("band", F.ceil(F.col("t") / room).cast("int").alias("t"), F.ceil(F.col("e") / room).cast("int").alias("e"))
    x, y = sizes.where("t > 0").select(F.col("band").alias("xband"), "t"), sizes.where("e > 0").select(F.col("band").alias("yband"), "e")
    near = x.withColumn("yband", F.explode(F.sequence(F.col("xband") - REACH, F.col("xband") + REACH)))
    bands = written(near.join(y, "yband").select("xband", "t", "yband", "e"), "p1-bands")

    def side(which: str, own: str, parts: str, others: str, block: str, other: str) -> DataFrame:
        got = rows.where(which).join(F.broadcast(bands), F.col("band") == F.col(own))
        got = got.withColumn(block, F.pmod(F.xxhash64("norm"), F.col(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return got.select(*key, "rid", "norm").toDF(*key, "rid", "norm")  # fresh columns: both sides come from one table

    key = ["xband", "yband", "xblock", "yblock"]
    left, right = side("tr", "xband", "t", "e", "xblock", "yblock"), side("ev", "yband", "e", "t", "yblock", "xblock")

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        if not (p.num_rows and q.num_rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "na": pa.array([], pa.string()), "nb": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})
        xs, ys = p["norm"].to_pylist(), q["norm"].to_pylist()
        i, j, n = block_pairs(xs, ys)
        other = p["rid"].to_numpy()[i] != q["rid"].to_numpy()[j]
        i, j, n = i[other], j[other], n[other]
        runs = np.sqrt([max(1, len(t) - Q + 1) for t in xs])[i] * np.sqrt([max(1, len(t) - Q + 1) for t in ys])[j]
        i, j = pa.array(i), pa.array(j)
        return pa.table({"a": p["rid"].take(i), "b": q["rid"].take(j), "na": p["norm"].take(i), "nb": q["norm"].take(j), "cosine": pa.array(n / runs, pa.float64())})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "a bigint, b bigint, na string, nb string, cosine double")


def near_pairs(cases: DataFrame, key: str = "id", text: str = "text", split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives a, b with distance; members rid, key, split).

    Rows with a null text, null split or a text without letters and digits take no part.
    """
    rows = spread(cases.select(F.col(key).alias("key"), F.col(text).alias("t"), F.col(split).alias("s")))
    rows = rows.select("key", split_name(F.col("s")).alias("split"), fold(F.col("t")).alias("norm")).where("split is not null and norm <> ''")
    train = F.col("split") == "train"
    reps = written(
        rows.groupBy("norm").agg(F.max(train).alias("tr"), F.max(~train).alias("ev")).select(F.monotonically_increasing_id().alias("rid"), "norm", F.length("norm").alias("len"), "tr", "ev"),
        "p1-reps",
    )
    close = candidate_pairs(reps)
    # the banded distance gives -1 beyond the limit
    limit = f"cast(floor(greatest(length(na), length(nb)) / {EDIT_SHARE}) as int)"
    found = written(close.withColumn("distance", F.expr(f"levenshtein(na, nb, {limit})")).where("distance >= 0").select("a", "b", "distance", "cosine"), "p1-pairs")
    same = reps.where("tr and ev").select(F.col("rid").alias("a"), F.col("rid").alias("b"), F.lit(0).alias("distance"), F.lit(1.0).alias("cosine"))
    members = rows.join(reps.select("norm", "rid"), "norm").select("rid", "key", "split")
    return found.unionByName(same), members


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = near_pairs(table(spark, sf_dir, "cases"))
    t = members.where("split = 'train'").select(F.col("rid").alias("a"), F.col("key").alias("x"))
    e = members.where("split <> 'train'").select(F.col("rid").alias("b"), F.col("key").alias("y"))
    got = pairs.join(t, "a").join(e, "b")
    return got.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p1_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split but train and each source: cases, cases with a partner in train, exact ones. Linear: no pair is expanded."""
    cases = table(spark, sf_dir, "cases")
    pairs, members = near_pairs(cases)
    hit = pairs.groupBy(F.col("b").alias("rid")).agg(F.min("distance").alias("nearest"))
    named = cases.select(F.col("id").alias("key"), F.coalesce(source_name(F.col("provenance")), F.lit("unknown")).alias("source"))
    return (
        members.where("split <> 'train'")
        .join(hit, "rid", "left")
        .join(named, "key")
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("cases"), F.count("nearest").alias("overlapping"), F.count(F.when(F.col("nearest") == 0, 1)).alias("exact"))
    )

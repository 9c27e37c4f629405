"""Mixing sources to target shares by Poisson replication.

A source's target is its share of all tokens together; its rate is the target over its own tokens. Each document
gets a count from a Poisson distribution by inversion of a uniform number that is a hash of seed, profile and
document, so a count depends on nothing else and a rerun gives the same mix. Counts are cut at the source's
``max_repeats``; the Poisson mean is raised (bisection) so that the cut mean is the rate. A source whose target is
more than ``max_repeats`` times its tokens cannot reach it: each of its documents comes ``max_repeats``
times. The copies are shuffled globally by a hash of document and copy.

The tables of inversion (profile x source x at most max_repeats + 1 numbers) come from fixed small tables; the
counting and exploding is done in the JVM. Null sources have no target and null or empty texts no tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.runtime import table, written
from lectern.llm.tokens import counted

SEED = 17


def poisson_cdf(mean: float, top: int) -> list[float]:
    """P(count <= k) for k below ``top``."""
    p, c, out = math.exp(-mean), 0.0, []
    for k in range(top):
        c += p
        out.append(c)
        p *= mean / (k + 1)
    return out


def cut_mean(mean: float, top: int) -> float:
    """Mean of min(Poisson, top): the sum of P(count > k) below top."""
    return sum(1 - c for c in poisson_cdf(mean, top))


def inversion(rate: float, top: int) -> list[float]:
    """Thresholds: a uniform number u gives as many copies as thresholds are <= u. Their mean count is min(rate, top)."""
    if top <= 0 or rate <= 0:
        return []
    if rate >= top:
        return [0.0] * top
    lo, hi = 0.0, 1.0
    while cut_mean(hi, top) < rate and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, top) < rate else (lo, mid)
    return poisson_cdf((lo + hi) / 2, top)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens."""
    return counted(table(spark, sf_dir, "documents"), ["doc_id", "source"])


def rates(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """profile, source, target_share, max_repeats, own tokens, target tokens: one row for each target."""
    targets = targets.select("profile", "source", "target_share", "max_repeats")
    own = docs.groupBy("source").agg(F.sum("tokens").alias("own"))
    one = Window.partitionBy(F.lit(1))  # over one row a source, then one row a target
    own = own.withColumn("total", F.sum("own").over(one))
    out = targets.join(own, "source", "left").withColumn("total", F.max("total").over(one))
    return out.select("profile", "source", "target_share", "max_repeats", F.coalesce("own", F.lit(0)).alias("own"), (F.col("target_share") * F.coalesce("total", F.lit(0))).alias("target"))


def replicated(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """profile, source, doc_id, tokens, copies (0 is left out)."""
    docs = docs.select("doc_id", "source", "tokens")
    rows = rates(docs, targets).collect()  # as many rows as the fixed table of targets
    table_ = [(r["profile"], r["source"], inversion(r["target"] / r["own"] if r["own"] else 0.0, int(r["max_repeats"]))) for r in rows]
    cdf = docs.sparkSession.createDataFrame(table_, "profile string, source string, steps array<double>")
    u = (F.xxhash64(F.lit(seed), F.col("profile"), F.col("doc_id")).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    return docs.join(F.broadcast(cdf), "source").withColumn("copies", F.size(F.filter("steps", lambda s: s <= u))).where("copies > 0").drop("steps")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mix in its global order: profile, doc_id, source, copy, tokens."""
    got = replicated(written(sizes(spark, sf_dir), "p8-sizes"), table(spark, sf_dir, "mix_targets"))
    out = got.select("profile", "source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.orderBy("profile", F.xxhash64(F.lit(SEED + 1), "profile", "doc_id", "copy"), "doc_id", "copy")


def mixed(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """The rates with ``mixed``, the tokens that each profile's mix has of each source."""
    got = replicated(docs, targets, seed).groupBy("profile", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    return rates(docs, targets).join(got, ["profile", "source"], "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of which the mix has every document as often as it may be repeated and still less than the target."""
    got = mixed(written(sizes(spark, sf_dir), "p8-sizes"), table(spark, sf_dir, "mix_targets"))
    return got.where((F.col("mixed") == F.col("max_repeats") * F.col("own")) & (F.col("target") > F.col("mixed"))).select("profile", "source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each profile's sources, repetitions and whether the target was out of reach."""
    base = mixed(written(sizes(spark, sf_dir), "p8-sizes"), table(spark, sf_dir, "mix_targets"))
    total = base.groupBy("profile").agg(F.sum("mixed").alias("all"))
    return base.join(total, "profile").select(
        "profile", "source", "target_share", F.round(F.col("mixed") / F.when(F.col("all") > 0, F.col("all")), 6).alias("actual_share"), "mixed",
        F.round(F.col("mixed") / F.when(F.col("own") > 0, F.col("own")), 6).alias("repeats"), (F.col("target") > F.col("max_repeats") * F.col("own")).alias("out_of_reach"),
    )

"""Copies in other formatting: canonical keys counted in a ledger.

Rows of one table are copies if their canonical keys are equal. Null texts are no records; blank ones
(no letter or digit at all) are copies of each other. Copies come out one row per copy, so a group of a
third of all rows stays linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import table, written
from lectern.llm.canonical import fold, json_key
from lectern.llm.ledger import Ledger

#: table: (record key, arrival, canonical form)
RECORDS: dict[str, tuple[str, str, object]] = {
    "evaluation": ("eval_no", "loaded_at", lambda: fold(F.col("sentence"))),
    "session_records": ("rec_no", "loaded_at", lambda: fold(F.col("text"))),
    "raw_records": ("raw_id", "received_at", lambda: json_key(F.col("payload"), ("sha256",))),
}


#: A group of more than one in so many records is hot; there are at most as many hot groups.
HOT = 1000


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, rec_id, arrived (microseconds), key of every record, written once. The origin is part of the key: copies are within one table."""
    out = None
    for origin, (rec, arrived, form) in RECORDS.items():
        text: Column = form()
        part = table(spark, sf_dir, origin).select(
            F.lit(origin).alias("origin"), F.col(rec).alias("rec_id"), F.unix_micros(F.col(arrived).cast("timestamp")).alias("arrived"), F.unhex(F.sha2(F.concat(F.lit(origin), F.lit("\x00"), text), 256)).alias("key")
        )
        out = part if out is None else out.unionByName(part)
    return written(out.where(F.col("key").isNotNull()), "p4-keyed")


def absorbed(records: DataFrame, batches: int = 2, buckets: int | None = None) -> Ledger:
    """A ledger that took the records in batches by time of arrival, those without one last."""
    ledger = Ledger(records.sparkSession, buckets=buckets)
    at = F.col("arrived")
    q = records.select(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    edges = [None, *q, None]
    for lo, hi in zip(edges, edges[1:]):
        part = records
        if lo is not None:
            part = part.where((at >= lo) | at.isNull()) if hi is None else part.where(at >= lo)
        if hi is not None:
            part = part.where(at < hi)
        ledger.absorb(part)
    return ledger


def copies(records: DataFrame, ledger: Ledger) -> DataFrame:
    """origin, keep_id, copy_id: each row that is a copy, beside the one of its group with the smallest number.

    Hot groups, at most ``HOT``, are broadcast, so their rows stay where they are; the others meet in a shuffle in which no
    key has more than one row in ``HOT``.
    """
    total = ledger.rows().agg(F.sum("n")).first()[0] or 0
    groups = ledger.rows().where("n > 1").select("key", "keep_id", "n")
    hot = groups.where(F.col("n") * HOT > total).select("key", F.col("keep_id").alias("hot_id"))
    rows = records.join(F.broadcast(hot), "key", "left")
    rest = rows.where("hot_id is null").join(groups.where(F.col("n") * HOT <= total).select("key", "keep_id"), "key")
    got = rows.where("hot_id is not null").select("origin", F.col("hot_id").alias("keep_id"), "rec_id").unionByName(rest.select("origin", "keep_id", "rec_id"))
    return got.where("rec_id > keep_id").select("origin", "keep_id", F.col("rec_id").alias("copy_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = keyed(spark, sf_dir)
    return copies(r, absorbed(r))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once: origin, keep_id, first_id (the row that arrived first), copies, and for sessions how many stored digests are right, stale or missing."""
    r = keyed(spark, sf_dir)
    s = table(spark, sf_dir, "session_records").select(
        F.lit("session_records").alias("origin"),
        F.col("rec_no").alias("rec_id"),
        F.when(F.col("sha256").isNull(), "missing").when(F.lower(F.trim("sha256")) == F.sha2("text", 256), "right").otherwise("stale").alias("digest"),
    )
    groups = absorbed(r).rows().select("key", "keep_id", F.col("first.id").alias("first_id"), F.col("n").alias("copies"))
    by_key = r.join(s, ["origin", "rec_id"], "left").groupBy("key", "origin").agg(
        *(F.count(F.when(F.col("digest") == d, 1)).alias(f"digest_{d}") for d in ("right", "stale", "missing"))
    )
    return by_key.join(groups, "key").select("origin", "keep_id", "first_id", "copies", "digest_right", "digest_stale", "digest_missing")

"""Acquisition of corpus records: a catalogue of data sets, one screening for each kind, and an all-or-nothing store.

Where the rows come from is a parameter (a relation): nothing is fetched here. A run fails closed - a revision that is missing
or has changed meanwhile, or no record at all, is an error and nothing is stored; reaching a bound of rows or bytes is no
error but is told. Null texts are never records.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import written
from lectern.operators import screening
from lectern.sources import files, sessions

CATALOGUE_DDL = "name string, kind string, status string, records bigint, scope string, purposes array<string>, licence string"
KINDS = ("viewer", "arena", "sessions")


class AcquireError(RuntimeError):
    """A source that must not be used."""


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of data sets, a JSON array or lines; repeated names and unknown kinds are errors."""
    df = spark.read.schema(CATALOGUE_DDL).option("multiLine", True).json(path)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.count(F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), 1)).alias("bad")).first()
    if not r["n"] or r["n"] != r["names"] or r["bad"]:
        raise AcquireError(f"{r['n']} data sets, {r['names']} names, {r['bad']} of an unknown kind")
    return df


def sampled(kind: str, rows: DataFrame, limit: int, max_rows: int = screening.MAX_ROWS, max_bytes: int | None = None, language: str | None = None, screen: Callable[[Column], Column] | None = None, revisions: tuple[str | None, str | None] = ("", "")) -> tuple[DataFrame, DataFrame]:
    """(records, one row about the run) of rows of a kind: at most ``limit`` records of the first ``max_rows`` rows and ``max_bytes``.

    ``rows``: row_no, value for viewer rows, row_index, value for arena rows, source_path, line_no, value for sessions. ``revisions``:
    what the source said of itself before and after.
    """
    screening.bounds(limit, max_rows)
    before, after = revisions
    if before is None or before != after:
        raise AcquireError("the source has no revision, or it changed")
    if kind not in KINDS:
        raise AcquireError(f"no screening for {kind!r}")
    order = {"viewer": ["row_no"], "arena": ["row_index"], "sessions": ["source_path", "line_no"]}[kind]
    size = F.coalesce(F.octet_length(F.encode("value", "UTF-8")), F.lit(0))
    taken = written(screening.within_budget(rows, order, size, max_rows, max_bytes if max_bytes is not None else 1 << 62), "rows")
    if kind == "viewer":
        parsed = screening.parsed_rows(taken)
        all_ = screening.parsed_turns(parsed, language).where("reason is null").select(F.col("row_index").cast("string").alias("source"), F.col("turn_index").cast("bigint").alias("part"), "model", "language", "text", F.col("digest").alias("sha256"))
    elif kind == "arena":
        got = screening.arena_records(taken, None, language, screen)
        all_ = got.select(F.lpad(F.col("row_index").cast("string"), 12, "0").alias("source"), (F.col("turn_index") * 2 + (F.col("side") == "b").cast("int")).cast("bigint").alias("part"), "model", "language", "text", F.col("digest").alias("sha256"))
    else:
        got = sessions.session_records(taken).where((screen or screening.safe_session_text)(F.col("text"))).dropDuplicates(["sha256"])
        all_ = got.select(F.concat_ws("/", "source_path", "message_id").alias("source"), F.col("text_block_index").cast("bigint").alias("part"), "model", F.lit(None).cast("string").alias("language"), "text", "sha256")
    order_ = F.lpad("source", 12, "0") if kind == "viewer" else F.col("source")
    records = written(all_.orderBy(order_, "part").limit(limit), "records")
    n, seen, offered = records.count(), taken.count(), rows.count()
    if not n:
        raise AcquireError("no record passed the screens")
    reason = "limit" if n >= limit else "rows_or_bytes" if seen < offered else "end"
    about = records.sparkSession.createDataFrame([(n, seen, offered, reason)], "records bigint, rows bigint, offered bigint, reason string")
    return records, about


def store(records: DataFrame, root: str, name: str) -> DataFrame:
    """Records and their manifest under root/name, both or neither; an existing target is an error. Returns the manifest."""
    spark = records.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    target, pending = f"{root}/{name}", f"{root}/.pending-{uuid.uuid4().hex}"
    fs = make(root).getFileSystem(spark._jsc.sc().hadoopConfiguration())
    if fs.exists(make(target)):
        raise files.ManifestError(f"{target} exists")
    manifest = files.manifest(records)
    try:
        records.write.parquet(f"{pending}/records")
        files.write_inventory(manifest, f"{pending}/inventory")
        if not fs.rename(make(pending), make(target)):
            raise files.ManifestError(f"{target} could not be made")
    finally:
        fs.delete(make(pending), True)
    return spark.read.json(f"{target}/inventory")

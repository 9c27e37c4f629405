"""Readers and sinks: text files, tables, catalogues, manifests with digests. Writes are exclusive and whole."""

from __future__ import annotations

import os
import re
import stat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The metadata of a source that may be shown.
SHOWN = ("source_url", "revision", "sha256", "bytes", "licence", "pages")
SAFE_PATH = r"^(?!/)(?!.*(?:^|/)\.\.?(?:/|$))[A-Za-z0-9._/-]+$"


class ManifestError(RuntimeError):
    """A manifest or target that must not be used."""


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id, path, text of whole UTF-8 files. Bytes that are no UTF-8 raise when read."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", F.try_validate_utf8(F.decode("content", "UTF-8")).alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    r = spark.read.format(format)
    return (r.schema(schema) if schema else r).load(path)


def write_new(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write where nothing is; an existing target is an error."""
    df.write.format(format).mode("errorifexists").save(path)


def verify(data: Column, sha256: Column, size: Column) -> Column:
    """Length and digest of bytes fit (null where nothing is known)."""
    return (F.octet_length(data) == size) & (F.sha2(data, 256) == F.lower(F.trim(sha256)))


def catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents overlaid with their source's url and digest, sources) of a JSON catalogue."""
    raw = spark.read.option("multiLine", True).json(path)
    sources = raw.select(F.explode("sources").alias("s")).select("s.*")
    docs = raw.select(F.explode("documents").alias("d")).select("d.*")
    s = sources.select("source_path", *(F.col(c).alias(f"source_{c}" if not c.startswith("source_") else c) for c in sources.columns if c != "source_path"))
    return docs.join(s, "source_path", "left"), sources


def shown_metadata(source: DataFrame) -> DataFrame:
    return source.select(*(c for c in source.columns if c in SHOWN))


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of the manifest (path, bytes, sha256) that no present file satisfies."""
    p = present.select(F.col("path").alias("p_path"), F.col("bytes").alias("p_bytes"), F.col("sha256").alias("p_sha"))
    return wanted.join(p, (F.col("path") == F.col("p_path")) & (F.col("bytes") == F.col("p_bytes")) & (F.lower("sha256") == F.lower("p_sha")), "left_anti")


def conflicts(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Present files whose path is wanted but whose bytes differ."""
    p = present.select(F.col("path").alias("p_path"), F.lower("sha256").alias("p_sha"))
    return wanted.join(p, F.col("path") == F.col("p_path")).where(F.col("p_sha") != F.lower("sha256")).select("path")


def unsafe_paths(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce(F.col("path").rlike(SAFE_PATH), F.lit(False)))


def safe_path(root: str, name: str) -> str:
    """A path under root: allow-listed characters, no way up, no link on the way."""
    if not re.match(SAFE_PATH, name):
        raise ManifestError(f"unsafe path {name!r}")
    at = root
    for part in name.split("/"):
        at = os.path.join(at, part)
        if os.path.lexists(at) and stat.S_ISLNK(os.lstat(at).st_mode):
            raise ManifestError(f"link in path {name!r}")
    return at


def manifest(rows: DataFrame, text: str = "text", kind: str = "record") -> DataFrame:
    """path (by content), bytes, sha256, kind of each distinct text."""
    b = F.encode(text, "UTF-8")
    return rows.where(F.col(text).isNotNull()).select(F.sha2(b, 256).alias("sha256"), F.octet_length(b).cast("bigint").alias("bytes")).distinct().select(F.concat(F.lit(f"{kind}/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"), F.lit(".txt")).alias("path"), "bytes", "sha256", F.lit(kind).alias("kind"))


def write_inventory(rows: DataFrame, path: str) -> None:
    """Canonical JSON lines in path order, exclusive; refused if a path is unsafe or two digests claim one path."""
    if not unsafe_paths(rows).isEmpty():
        raise ManifestError("unsafe paths")
    if not rows.groupBy("path").agg(F.count_distinct("sha256").alias("n")).where("n > 1").isEmpty():
        raise ManifestError("conflicting digests")
    cols = sorted(rows.columns)
    rows.orderBy("path").select(F.to_json(F.struct(*cols)).alias("value")).write.mode("errorifexists").text(path)


def selection_line(rows: DataFrame, name: str, limit: int) -> DataFrame:
    return rows.agg(F.format_string(f"{name}: %d of at most {limit} records, %d bytes", F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).alias("line"))

"""Findings over a stream of documents. Rules are per document, so a micro-batch is linted like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import java, spans
from lectern.operators import views as V
from lectern.plans.lint import Options, lint
from lectern.sources.catalogue import Rule

DOCS_DDL = "doc_id bigint, path string, text string, lang string, source string, n_chars bigint, project string, authorship string, model string, fetched_at timestamp_ntz, loaded_at timestamp_ntz"


def documents(spark: SparkSession, folder: str, schema: str = DOCS_DDL, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def lint_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options = Options(), rules: list[Rule] | None = None) -> StreamingQuery:
    """Every micro-batch linted whole and handed to ``sink`` with its number, so that a sink can be idempotent."""
    return docs.writeStream.foreachBatch(lambda batch, n: sink(lint(batch, options, rules), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_by_window(docs: DataFrame, pattern: str, at: str = "loaded_at", late: str = "90 days", width: str = "1 day") -> DataFrame:
    """Windowed matches of one pattern in the prose view: stateless spans, then a watermarked aggregate."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).select("at", "source", F.size(spans(V.prose(V.masked(t)), java(pattern))).alias("n"))
    return rows.groupBy(F.window("at", width), "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("matches"))

"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import table
from lectern.llm import oracle
from lectern.llm.copies import p4_found, p4_records
from lectern.llm.language import p6_found, p6_segments
from lectern.llm.markup import p2_clean, p2_found
from lectern.llm.mixing import p8_found, p8_mix, p8_shares
from lectern.llm.overlap import p1_found, p1_overlaps
from lectern.llm.packing import p7_cover, p7_fill, p7_packing
from lectern.llm.pieces import p9_cover, p9_found, p9_pieces
from lectern.llm.sentences import sentence_units
from lectern.llm.spans import p5_found, p5_removed, p5_shares


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sentence_units(table(spark, sf_dir, "cases").select(F.lit("cases").alias("origin"), F.col("id").alias("rec_id"), "text"), "text", ["origin", "rec_id"])
    e = table(spark, sf_dir, "evaluation").select(F.lit("evaluation").alias("origin"), F.col("eval_no").cast("string").alias("rec_id"), "sentence")
    return c.unionByName(sentence_units(e, "sentence", ["origin", "rec_id"])).drop("unit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        *(p1_found, p1_overlaps, p2_found, p2_clean, p3_found, p4_found, p4_records, p5_found, p5_shares, p5_removed, p6_found, p6_segments),
        *(p7_packing, p7_fill, p7_cover, p8_found, p8_mix, p8_shares, p9_found, p9_pieces, p9_cover),
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"p7_cover": oracle.P7_COVER, "p9_cover": oracle.P9_COVER, "p4_found": oracle.P4_FOUND, "p4_records": oracle.P4_RECORDS, "p5_found": oracle.P5_FOUND, "p5_shares": oracle.P5_SHARES, "p5_removed": oracle.P5_REMOVED}

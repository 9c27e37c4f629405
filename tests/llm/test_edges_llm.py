"""Every training-data query on tables without rows, with nulls, with repeated rows and with columns whose names operators use."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.llm import queries as registered

queries = registered.queries()
KEYS = {"documents": "doc_id", "cases": "id", "evaluation": "eval_no", "corpus_records": "record_id", "session_records": "rec_no", "raw_records": "raw_id"}
FIXED = ("language_names", "mix_targets", "size_limits")
DATA = Path("/root/testdata/sf0.001")


def tables(spark, at: Path, kind: str) -> str:
    """The smallest tables without rows, or with a few: some twice, some null in every column but the key, and columns with names that operators use."""
    for name in (*KEYS, *FIXED):
        t = spark.read.parquet(str(DATA / f"{name}.parquet"))
        if name in KEYS and kind == "empty":
            t = t.limit(0)
        elif name in KEYS:
            k = KEYS[name]
            new = F.concat(F.lit("n"), F.col(k)) if k == "id" else F.col(k) + 10_000_000
            null = t.limit(3).select(*(new.alias(k) if c == k else F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns))
            t = t.limit(12).unionByName(null).unionByName(t.limit(2))
            t = t.withColumns({c: F.lit(1) for c in ("key", "hash", "total", "t", "n", "tokens", "host", "line", "b", "s") if c not in t.columns})
        t.coalesce(1).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("kind", ["empty", "null and twice"])
def test_every_query_on_odd_tables(spark, tmp_path, kind):
    d = tables(spark, tmp_path, kind)
    for name, query in queries.items():
        n = query(spark, d).count()
        assert n >= 0, name

"""An incremental ledger of canonical keys: copies counted batch by batch.

The ledger is a folder of versions. A version holds, for the buckets its batch touched, one row for
each key: how many records bear it, the smallest record number, and the record that arrived first. A new batch is
aggregated by (bucket, key) first - with map-side combining, so a key of a third of all rows costs one
row per task - then joined full-outer against the same buckets of the ledger only, and the sums are
written as the next version of those buckets. Nothing of the ledger is held in memory or at the
driver; only the numbers of the touched buckets (at most ``buckets``) are.

A version becomes visible with Spark's own commit of its folder; a batch that failed half-way leaves
the ledger as it was. A ledger is opened by its path: which version has a bucket's rows is read from the
folders. The number of buckets follows the size of the first batch and stays. Null keys are left out; records without
a time of arrival come after those with one, and among equals the smallest number is first; the same record absorbed twice counts twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import shared_dir, written

SCHEMA = "key binary, n bigint, keep_id bigint, first struct<at:bigint,id:bigint>, bucket int"
#: Buckets of a new ledger: for so many keys of its first batch one, and at least so many.
KEYS, LEAST = 1_000_000, 64
_NEVER = (1 << 63) - 1


class Ledger:
    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self.latest: dict[int, str] = {}
        self.version = 0
        self._open()

    def _fs(self):
        """The file system of the ledger and a maker of its paths."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make(self.path).getFileSystem(self.spark._jsc.sc().hadoopConfiguration()), make

    def _open(self) -> None:
        """The number of buckets, and the last finished version of each."""
        fs, make = self._fs()
        if not fs.exists(make(self.path)):
            return
        names = [x.getPath().getName() for x in fs.listStatus(make(self.path))]
        self.buckets = next((int(x[8:]) for x in names if x.startswith("buckets-")), self.buckets)
        for v in sorted(int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit()):
            self.version, at = v, f"{self.path}/v{v}"
            if fs.exists(make(f"{at}/_SUCCESS")):
                inner = [x.getPath().getName() for x in fs.listStatus(make(at))]
                self.latest.update({int(x[7:]): at for x in inner if x.startswith("bucket=")})

    def bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """The ledger's present rows, of the given buckets."""
        wanted: dict[str, list[int]] = {}
        for b, v in self.latest.items():
            if only is None or b in only:
                wanted.setdefault(v, []).append(b)
        out = self.spark.createDataFrame([], SCHEMA)
        for v, bs in sorted(wanted.items()):
            part = self.spark.read.schema(SCHEMA).parquet(v)
            out = out.unionByName(part.where(F.col("bucket").isin(bs)))
        return out

    def absorb(self, records: DataFrame, key: str = "key", rec: str = "rec_id") -> None:
        """Add a batch of records (a binary key, a record number and perhaps ``arrived``, microseconds)."""
        at = F.coalesce("arrived", F.lit(_NEVER)) if "arrived" in records.columns else F.lit(_NEVER)
        batch = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(rec).alias("keep_id"), F.min(F.struct(at.alias("at"), F.col(rec).alias("id"))).alias("first"))
        batch = written(batch, "p4-batch")  # read for its buckets and for the join
        self.buckets = self.buckets or max(LEAST, -(-batch.count() // KEYS))
        batch = batch.withColumn("bucket", self.bucket(F.col("key")))
        buckets = self.touched(batch)
        if not buckets:
            return
        if any(b in self.latest for b in buckets):
            old = self.rows(buckets)
            joined = batch.alias("b").join(old.alias("o"), (F.col("b.key") == F.col("o.key")) & (F.col("b.bucket") == F.col("o.bucket")), "full_outer")
            both = joined.select(
                F.coalesce("b.key", "o.key").alias("key"),
                (F.coalesce("b.n", F.lit(0)) + F.coalesce("o.n", F.lit(0))).alias("n"),
                F.least("b.keep_id", "o.keep_id").alias("keep_id"),
                F.least("b.first", "o.first").alias("first"),
                F.coalesce("b.bucket", "o.bucket").alias("bucket"),
            )
        else:
            both = batch
        fs, make = self._fs()
        fs.mkdirs(make(f"{self.path}/buckets-{self.buckets}"))
        self.version += 1
        at = f"{self.path}/v{self.version}"
        # one writer per group of buckets: few files, and a later batch reads only the buckets it needs
        both.repartition("bucket").write.partitionBy("bucket").parquet(at)
        self.latest.update({b: at for b in buckets})

    @staticmethod
    def touched(batch: DataFrame) -> list[int]:
        """The buckets of a batch's keys."""
        return [r[0] for r in batch.select("bucket").distinct().collect()]

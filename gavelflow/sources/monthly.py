"""A ledger laid out by month of end, whose merges rewrite the months that they touch.

rows/month=2024-01/... hold the rows, keys/bucket=17/... say in which month each key lies,
so that a merge finds the rows that its batch meets, also where their end has moved, without
reading other months. Scans by end read the months that they name.

A merge stages what it will write, marks the stage as ready, and then replaces partitions;
a merge that dies in between is finished from its stage by the next one. Readers should wait
for that or read again: partitions are replaced one after another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
NO_MONTH = "none"


def month_of(end: Column) -> Column:
    return F.coalesce(F.date_format(end, "yyyy-MM"), F.lit(NO_MONTH))


class MonthlyLedger:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], end: str = "ended_at", buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.end, self.buckets = spark, root.rstrip("/"), keys, end, buckets
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def _read(self, name: str, schema: T.StructType, partition: str) -> DataFrame:
        if not self._fs.exists(self._at(name)):
            return self.spark.createDataFrame([], T.StructType([*schema, T.StructField(partition, T.StringType())]))
        whole = T.StructType([*schema, T.StructField(partition, T.StringType())])
        return self.spark.read.schema(whole).parquet(f"{self.root}/{name}")

    def _index(self, name: str = "keys") -> DataFrame:
        fields = [f for f in self.schema if f.name in self.keys] + [T.StructField("month", T.StringType())]
        return self._read(name, T.StructType(fields), "bucket")

    def months(self) -> DataFrame:
        """All rows, with month."""
        self.finish()
        return self._read("rows", self.schema, "month")

    def scan(self, since: str, through: str) -> DataFrame:
        """Rows that ended from since up to, not at, through; only their months are read."""
        since, through = F.lit(since).cast("timestamp"), F.lit(through).cast("timestamp")
        inside = (F.col(self.end) >= since) & (F.col(self.end) < through)
        named = F.col("month").between(F.date_format(since, "yyyy-MM"), F.date_format(through, "yyyy-MM"))
        return self.months().filter(named & inside).drop("month")

    def merge(self, incoming: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
        """Folds incoming (a row for each key) into the months where its keys lie or will lie;
        returns those months. fold takes and returns rows of the ledger's columns, and treats each key by itself."""
        self.finish()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        incoming.select(*self.schema.names).write.parquet(f"{self.root}/pending/incoming")
        incoming = self.spark.read.schema(self.schema).parquet(f"{self.root}/pending/incoming")
        batch = incoming.select(*self.keys, bucket.alias("bucket"))
        buckets = [r.bucket for r in batch.select("bucket").distinct().collect()]  # BUCKETS at most
        index = self._index().filter(F.col("bucket").isin(buckets))
        met = batch.join(index.select(*self.keys, "month"), self.keys).select("month").distinct()
        months = [r.month for r in met.collect()]  # one row for each month of the ledger at most
        current = self._read("rows", self.schema, "month").filter(F.col("month").isin(months))
        # Rows of other keys in these months stay as they are.
        mine = current.drop("month").join(batch.select(*self.keys), self.keys, "left_semi").select(*self.schema.names)
        folded = fold(mine, incoming).select(*self.schema.names)
        folded.withColumn("month", month_of(F.col(self.end))).write.parquet(f"{self.root}/pending/folded")
        folded = self._read("pending/folded", self.schema, "month")
        moved_to = [r.month for r in folded.select("month").distinct().collect()]
        touched = sorted({*months, *moved_to})
        theirs = self._read("rows", self.schema, "month").filter(F.col("month").isin(touched)).join(batch.select(*self.keys), self.keys, "left_anti")
        theirs.select(*self.schema.names, "month").unionByName(folded).hint("rebalance", "month").write.partitionBy("month").parquet(f"{self.root}/pending/rows")
        kept = index.join(batch.select(*self.keys), self.keys, "left_anti").select(*self.keys, "month", "bucket")
        kept.unionByName(folded.select(*self.keys, "month", bucket.alias("bucket"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/pending/keys")
        self.spark.createDataFrame([(m,) for m in touched], "month string").coalesce(1).write.parquet(f"{self.root}/pending/touched")
        for name in ("rows", "keys"):
            for status in self._fs.listStatus(self._at(f"pending/{name}")):
                if status.isDirectory():
                    self._fs.mkdirs(self._at(f"pending/full/{name}/{status.getPath().getName()}"))
        self._fs.mkdirs(self._at("pending/READY"))
        self.finish()
        return touched

    def _replace(self, name: str, partition: str) -> None:
        """Moves a staged partition to its place; one that was moved before, or is staged empty, is
        told apart by a mark. Files are moved, not written again."""
        staged, place, mark = self._at(f"pending/{name}/{partition}"), self._at(f"{name}/{partition}"), self._at(f"pending/moved/{name}/{partition}")
        if self._fs.exists(mark):
            return
        if self._fs.exists(staged):
            self._fs.delete(place, True)
            self._fs.mkdirs(self._at(name))
            if not self._fs.rename(staged, place):
                raise OSError(f"{staged} can't be moved to {place}")
        elif not self._fs.exists(self._at(f"pending/full/{name}/{partition}")):
            self._fs.delete(place, True)  # no row is left
        self._fs.mkdirs(mark)

    def finish(self) -> None:
        """Puts a stage that is ready in place, as often as it takes; drops one that isn't."""
        if self._fs.exists(self._at("pending/READY")):
            touched = [r.month for r in self.spark.read.schema("month string").parquet(f"{self.root}/pending/touched").collect()]
            for month in touched:
                self._replace("rows", f"month={month}")
            for status in self._fs.listStatus(self._at("pending/keys")) if self._fs.exists(self._at("pending/keys")) else ():
                if status.isDirectory():
                    self._replace("keys", status.getPath().getName())
            # From here on nothing is left to replace: a stage that is gone in part must not be put in place again.
            self._fs.delete(self._at("pending/READY"), True)
        self._fs.delete(self._at("pending"), True)

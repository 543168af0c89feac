"""Tables that grow by steps in the shared folder and outlive the object, the session and lost tasks.

A step writes its tables under a name of its own and is published by one row in the manifest, written last.
Readers see published steps alone, so a step that broke off leaves nothing that counts, and nothing is ever
overwritten. A store opened at a path goes on where the last published step ended.

Defined results: a path without a manifest is an empty store; a step published twice (two writers at
once) raises when it is published or the store is opened.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship, workspace

FEW = 8
MANIFEST = "step int, name string, buckets int"


class Store:
    """Tables ``path/table/step=...``, each optionally parted into ``buckets`` by a hash."""

    def __init__(self, spark: SparkSession, path: str | None = None, kind: str = "store"):
        ship(spark)
        self.spark, self.path = spark, (path or workspace(spark, kind)).rstrip("/")
        self._names: list[str] = []
        self._pending: str | None = None
        self.buckets = 0
        if path:
            self._load()

    def _load(self) -> None:
        try:
            rows = sorted(self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").collect())  # one row per step
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if [r["step"] for r in rows] != list(range(len(rows))):
            raise RuntimeError(f"the store at {self.path} was written by two writers at once")
        self._names = [r["name"] for r in rows]
        self.buckets = rows[0]["buckets"] if rows else self.buckets

    @property
    def steps(self) -> int:
        """Steps published so far."""
        return len(self._names)

    def begin(self) -> None:
        self._pending = f"{self.steps:05d}_{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, table: str, bucket: Column | None = None, gather: bool = True) -> None:
        """Write a table of the step under way; with ``bucket`` one folder per bucket, of several files where a bucket is hot.

        Without ``gather`` each task writes files of its own: fit for one bucket and few tasks, as it saves a shuffle.
        """
        at = f"{self.path}/{table}/step={self._pending}"
        if bucket is None:
            df.write.parquet(at)
        else:
            rows = df.withColumn("bucket", bucket)
            rows = rows.hint("rebalance", F.col("bucket")) if gather else rows
            rows.write.partitionBy("bucket").parquet(at)

    def publish(self) -> None:
        """Make the step under way count, all its tables at once."""
        before = list(self._names)
        self._load()
        if self._names != before:
            raise RuntimeError(f"another writer published step {len(before)} of {self.path}")
        row = self.spark.range(0, 1, 1, 1).select(F.lit(self.steps).cast("int").alias("step"), F.lit(self._pending).cast("string").alias("name"), F.lit(self.buckets).cast("int").alias("buckets"))
        row.write.mode("append").json(f"{self.path}/manifest")
        self._names.append(self._pending or "")
        self._pending = None

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(max(1, self.buckets))).cast("int")

    def _paths(self, table: str, names: list[str]) -> list[str]:
        return [f"{self.path}/{table}/step={n}" for n in names]

    def read(self, table: str, schema: str, touched: list[int] | None = None, *, pending: bool = False, own: bool = False) -> DataFrame:
        """Published rows of ``table``; with ``touched`` the files of those buckets alone.

        ``pending`` adds the step under way, ``own`` reads nothing else.
        """
        names = [] if own else list(self._names)
        if (pending or own) and self._pending:
            names.append(self._pending)
        if not names:
            return self.spark.createDataFrame([], schema)
        columns = [c.split()[0] for c in schema.split(",")]
        parted = self.buckets and touched is not None
        rows = self.spark.read.schema(schema + (", bucket int" if parted else "")).option("basePath", f"{self.path}/{table}").parquet(*self._paths(table, names))
        if parted:
            rows = rows.where(F.col("bucket").isin(touched))
        return rows.select(*columns)

    def touched(self, keys: DataFrame) -> list[int] | None:
        """The buckets that hold any of ``keys`` (key): at most ``buckets`` numbers; None, all, where there are so few that asking costs more."""
        if self.buckets <= FEW:
            return None
        return sorted(r["b"] for r in keys.select(self.bucket(F.col("key")).alias("b")).distinct().collect())


def bucket_count(rows: int, per_bucket: int = 1_000_000, most: int = 4096) -> int:
    """Buckets for a store whose first step brings ``rows`` keys: a power of two, so that each holds some MB."""
    n = 1
    while n < most and n * per_bucket < rows:
        n *= 2
    return n

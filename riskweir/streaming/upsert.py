"""A table of the newest row of every key, kept by a stream: a batch rewrites only the buckets that its keys fall into.

Rows lie in buckets by hash of the key, each in a folder of the batch that wrote it last. What the table is at a time is a small document, bucket to
batch, under the number of its batch. It is written aside and renamed when all of the batch's buckets are complete, so a reader sees one version or the
next, never a part, and a batch that was broken off is simply done again. Old folders stay until :meth:`KeyedTable.vacuum`, for those who still read them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """``order`` says which of two rows of a key is newer; rows that are equal in it are told apart by all their columns. ``buckets`` is fixed for the life of a table: choose it so
    that a bucket is a few hundred megabytes in the end."""

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    # -- files

    def _files(self, spark: SparkSession):
        top = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return top.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, spark: SparkSession, name: str):
        return spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self, spark: SparkSession) -> list[int]:
        """Numbers of all complete versions, rising."""
        files, folder = self._files(spark), self._file(spark, "_versions")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def places(self, spark: SparkSession, version: int | None = None) -> dict[int, int]:
        """Bucket to the batch whose folder has its rows, as of a version or the last one; at most ``buckets`` entries."""
        known = self.versions(spark)
        if version is None:
            version = known[-1] if known else None
        if version not in known:
            return {}
        text = spark.read.text(f"{self.path}/_versions/{version}.json", wholetext=True).first()["value"]
        return {int(b): n for b, n in json.loads(text).items()}

    def _publish(self, spark: SparkSession, version: int, places: dict[int, int]) -> None:
        files = self._files(spark)
        draft, final = self._file(spark, f"_versions/.{version}.draft"), self._file(spark, f"_versions/{version}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        if files.exists(final):  # the same batch, done again after it had been published
            files.delete(final, False)
        if not files.rename(draft, final):
            raise OSError(f"version {version} of {self.path} couldn't be published")

    # -- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, spark: SparkSession, places: dict[int, int], schema) -> DataFrame:
        if not places:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/batch={n}/{BUCKET}={b}" for b, n in sorted(places.items())])

    def newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key; one candidate per key leaves each task."""
        rest = [c for c in rows.columns if c not in (*self.keys, *self.order)]
        found = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("row"))
        return found.select(*[F.col(c) if c in self.keys else F.col(f"row.{c}").alias(c) for c in rows.columns])

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merges a batch into the buckets of its keys. A batch with the number of one that was merged before starts from the version before that."""
        spark = batch.sparkSession
        known = [v for v in self.versions(spark) if v < batch_id]
        before = self.places(spark, known[-1]) if known else {}
        batch = batch.persist()
        try:
            touched = [r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            old = self._rows(spark, {b: n for b, n in before.items() if b in set(touched)}, batch.schema)
            merged = self.newest(old.unionByName(batch)).withColumn(BUCKET, self.bucket())
            merged.repartition(len(touched), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/batch={batch_id}")
            self._publish(spark, batch_id, before | dict.fromkeys(touched, batch_id))
        finally:
            batch.unpersist()

    def read(self, spark: SparkSession, schema, version: int | None = None) -> DataFrame:
        """All rows of one version, the last unless told otherwise: one row per key. Nothing is merged while reading, and what a running stream writes meanwhile isn't seen."""
        return self._rows(spark, self.places(spark, version), schema)

    def lookup(self, spark: SparkSession, schema, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys, from their buckets alone."""
        touched = {r["b"] for r in wanted.select(self.bucket().alias("b")).distinct().collect()}
        places = {b: n for b, n in self.places(spark).items() if b in touched}
        return self._rows(spark, places, schema).join(wanted.select(*self.keys).distinct(), list(self.keys), "left_semi")

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Deletes versions but the last ``keep`` and the folders that none of these needs; gives their number. Safe beside a running stream, which only reads the last one."""
        if keep < 1:
            raise ValueError("the last version is the table; it stays")
        known, files = self.versions(spark), self._files(spark)
        for version in known[:-keep]:
            files.delete(self._file(spark, f"_versions/{version}.json"), False)
        left = known[-keep:]
        needed = {(b, n) for v in left for b, n in self.places(spark, v).items()}
        gone = 0
        for status in (files.listStatus(self._file(spark, "")) if left else []):
            name = status.getPath().getName()
            if not name.startswith("batch=") or int(name.partition("=")[2]) > left[-1]:
                continue
            for part in files.listStatus(status.getPath()):
                own = part.getPath().getName()
                if own.startswith(f"{BUCKET}=") and (int(own.partition("=")[2]), int(name.partition("=")[2])) not in needed:
                    files.delete(part.getPath(), True)
                    gone += 1
        return gone

    def start(self, rows: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Keeps the table by a stream of rows."""
        writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.upsert)
        return (writer.trigger(availableNow=True) if once else writer).start()

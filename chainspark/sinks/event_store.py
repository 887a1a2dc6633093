"""An event table by buckets of the id: an ingest reads and writes only the buckets its ids fall into.

Every change writes its rows under a new version and then, last of all, a manifest of the folders that
count.  Readers take the latest manifest, so a change that fails midway leaves the table as it was.
Writers take turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.sinks.store import cut
from chainspark.sinks.tables import first_of_batch

BUCKETS = 64
#: Folders of one bucket; the next ingest that meets a bucket with more writes it as one.
FOLDERS = 16


class EventStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("event_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _manifests(self) -> list[int]:
        """Versions whose manifest is whole."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v=*/_SUCCESS")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])

    def version(self) -> int:
        return max(self._manifests(), default=0)

    def live(self, version: int | None = None) -> list[tuple[int, int]]:
        """``(bucket, version)`` of the folders that count; at most ``buckets`` times ``FOLDERS`` and one."""
        version = self.version() if version is None else version
        if not version:
            return []
        return [(r.bucket, r.v) for r in self.spark.read.parquet(f"{self.path}/manifest/v={version}").collect()]

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """Stored events, of some buckets or all; None while nothing is stored."""
        folders = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(self.live(version)) if only is None or b in only]
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*folders).drop("v", "bucket")

    def _commit(self, rows: DataFrame, rewritten: set[int]) -> None:
        """``rows`` as the next version: they replace the buckets in ``rewritten`` and come to the others."""
        version = self.version() + 1
        rows = rows.withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        written = self.spark.read.parquet(f"{self.path}/data/v={version}").select("bucket").distinct() if not rows.isEmpty() else rows.select("bucket")
        live = [(b, v) for b, v in self.live() if b not in rewritten] + [(r.bucket, version) for r in written.collect()]
        self._write_manifest(live, version)

    def _write_manifest(self, live: list[tuple[int, int]], version: int) -> None:
        self.spark.createDataFrame(live, "bucket int, v int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def add(self, batch: DataFrame, replace_duplicates: bool = False) -> dict[str, int]:
        """Add a batch (with ``idx``) and count ``received, stored, duplicates``.

        An id that is stored or stands earlier in the batch is a duplicate; with ``replace_duplicates`` the batch's
        first row takes the place of the stored one.  The same batch twice changes nothing.
        """
        received = batch.count()
        first = cut(first_of_batch(batch).withColumn("_bucket", self._bucket()))
        touched = sorted(r[0] for r in first.select("_bucket").distinct().collect())
        stored = self.read(touched)
        if stored is None:
            self._commit(first.drop("_bucket"), set())
            return {"received": received, "stored": first.count(), "duplicates": received - first.count()}
        met = cut(first.join(stored.select("event_id"), "event_id", "left_semi").select("event_id", "_bucket"))
        new = first.join(met.select("event_id"), "event_id", "left_anti")
        fresh = new.count()
        folders = [b for b, _ in self.live()]
        rewritten = {b for b in touched if folders.count(b) >= FOLDERS}
        if replace_duplicates:
            rewritten |= {r[0] for r in met.select("_bucket").distinct().collect()}
        rows = first.drop("_bucket") if replace_duplicates else new.drop("_bucket")
        if rewritten:
            old = self.read(sorted(rewritten))
            rows = old.join(rows.select("event_id"), "event_id", "left_anti").unionByName(rows, allowMissingColumns=True)
        if fresh or rewritten:
            self._commit(cut(rows), rewritten)
        return {"received": received, "stored": fresh, "duplicates": received - fresh}

    def remove(self, condition: Column) -> int:
        """Remove the events that meet a condition and count them; buckets without such an event stay untouched."""
        stored = self.read()
        if stored is None:
            return 0
        gone = F.coalesce(condition, F.lit(False))
        counts = stored.where(gone).groupBy(self._bucket()).agg(F.count(F.lit(1)).alias("n")).collect()
        if counts:
            rewritten = {r.bucket for r in counts}
            self._commit(cut(self.read(sorted(rewritten)).where(~gone)), rewritten)
        return sum(r.n for r in counts)


def of_dataset(dataset_id: str) -> Column:
    """Whether an event's metadata names a dataset."""
    return F.element_at("metadata", F.lit("dataset_id")) == dataset_id

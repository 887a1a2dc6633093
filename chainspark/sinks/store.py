"""Derived tables in the session's shared folder, built once for given inputs and then read."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_BUILT: dict[tuple[str, str], str] = {}
#: Rows of each built table, seen by the pass that wrote it.
_ROWS: dict[tuple[str, str], int] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; only local mode may do without a named one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-cut-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with compressed columns in the shared folder: for wide or large rows, which a checkpoint would keep as they lie in memory."""
    path = f"{shared_folder(df.sparkSession)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of few files dealt over all cores; one of many files as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Store:
    """Tables derived from the files under ``source``; another state of the files is another store."""

    def __init__(self, spark: SparkSession, source: str):
        files = spark.read.format("binaryFile").load(source).select(F.xxhash64("path", "modificationTime", "length").alias("h"))
        state = files.agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/derived/{hashlib.sha256(repr((source, *map(str, state))).encode()).hexdigest()[:16]}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.path(name))
        if key not in _BUILT:
            seen = Observation()
            make().observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self.path(name))
            _BUILT[key], _ROWS[key] = self.path(name), seen.get["n"]
        return self.spark.read.parquet(self.path(name))

    def has(self, name: str) -> bool:
        """Whether a table is built."""
        return (self.spark.sparkContext.applicationId, self.path(name)) in _BUILT

    def rows(self, *names: str) -> DataFrame:
        """``name, n``: how many rows the pass that wrote each table saw; no table is read."""
        app = self.spark.sparkContext.applicationId
        return self.spark.createDataFrame([(name, _ROWS[app, self.path(name)]) for name in names], "name string, n long")

    def files(self, name: str, write: Callable[[str], None]) -> str:
        """A folder of files in another format, written once by ``write(path)``."""
        key = (self.spark.sparkContext.applicationId, self.path(name))
        if key not in _BUILT:
            write(self.path(name))
            _BUILT[key] = self.path(name)
        return self.path(name)

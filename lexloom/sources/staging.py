"""Tables written once because several branches of a plan read them, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and the master is local, a new temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if not base and known.isDefined():
        base = known.get()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Staged:
    """A table written as Parquet; the files last until ``release``, or as long as the driver."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/lexloom-{label}-{uuid.uuid4().hex}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # no plan reads this write's shuffle files again
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        fs, path = self._at()
        fs.deleteOnExit(path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def _at(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def release(self) -> None:
        fs, path = self._at()
        fs.delete(path, True)

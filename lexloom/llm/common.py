"""Helpers that the operators of this subpackage share: shared storage, Arrow access and row packing."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.staging import shared_dir

#: Arrow batches handed to Python hold at most so many rows and bytes, so that long texts stay small in memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

#: Whether Spark removes a query's shuffle files when it ends, rather than when the driver's memory is short.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written under the shared folder, to cut lineage; a lost executor only makes Spark read them again.

    They last as long as the driver, since results may be read at any time; then they are removed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexloom-{label}-{uuid.uuid4().hex}"
        fs, path = self._at()
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Write a table and read it back. The shuffles behind it are removed at once: nothing reads them again."""
        conf, writer = self.spark.conf, df.write.mode("overwrite")
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
        finally:
            conf.set(CLEANUP, before)
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name)).select(*like.columns)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            fs, path = self._at(name)
            fs.delete(path, True)


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, from now on: plans run later than they are made, so it cannot be undone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``df`` with each row in one struct ``row``, beside the keys; no column of df can then clash with a working column."""
    return df.select(F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])

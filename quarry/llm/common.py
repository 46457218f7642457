"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of texts are handed back to the JVM in slices of about this many bytes.
SLICE_BYTES = 4 << 20
#: Texts are hashed together in chunks of about this many bytes.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where all of Spark is on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with a column per entry of ``sums``: the sum of that expression over all rows up to this one in ``order``.

    Rows are dealt by ranges and written with their range's number; each range is summed by itself, and what stands
    before a range is a sum over ranges, of which there are no more than shuffle partitions.
    """
    spark = df.sparkSession
    parts = staged(df.repartitionByRange(partitions(spark), *order).withColumn("__range", F.spark_partition_id()), name)
    per = parts.groupBy("__range").agg(*[F.sum(F.expr(x)).alias(f"__{c}") for c, x in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__range", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.join(F.broadcast(per), "__range")
    return rows.select(*df.columns, *[(F.sum(F.expr(x)).over(w) + F.col(f"__{c}")).alias(c) for c, x in sums.items()])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts have about ``limit`` bytes together; a longer text comes alone."""
    size, start = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            size, start = 0, i
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)

"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.functions.cosines import ship_package


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch, so that long texts do not add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, opened by Spark so that any store it knows will do."""
    bound_batches(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, parts: int) -> Column:
    """crc32 of a key written as text, modulo ``parts`` (a null key counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares; one of this machine only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="meritlens-"))
    return _local[0]


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps never recompute it,
    and a lost executor costs only the tasks that were running."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def labelled_sample(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    parts: int,
    held_out: int,
    max_rows: int,
    max_bytes: int,
) -> list[tuple[int, str, int]]:
    """At most about ``max_rows`` labelled (doc_id, text, label) rows of ``max_bytes`` of text in all,
    outside the held-out fold.

    The choice goes by a hash of doc_id, so it is the same on every run: rows are taken in its order
    as long as their whole texts fit.  Both bounds together bound what reaches the driver.  Of several texts
    of one doc_id the least counts, of several labels the greatest.
    """
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", parts) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = known.count()
    if total == 0:
        return []
    scale = 1 << 30
    share = min(scale, int(scale * max_rows / total) + 1)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).limit(2 * max_rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sizes = texts.withColumn("size", F.octet_length("text")).join(F.broadcast(chosen), "doc_id")
    found = sizes.groupBy("doc_id").agg(F.max("size").alias("size"), F.xxhash64("doc_id").alias("hash")).collect()
    taken, held = [], 0
    for r in sorted(found, key=lambda r: (r.hash, r.doc_id)):
        if held + r.size <= max_bytes:
            taken.append((r.doc_id,))
            held += r.size
    if not taken:
        return []
    wanted = spark.createDataFrame(taken, known.select("doc_id").schema).join(F.broadcast(chosen), "doc_id")
    rows = (
        texts.join(F.broadcast(wanted), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .collect()
    )
    return sorted((r.doc_id, r.text, r.label) for r in rows)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Row ranges of a batch whose texts hold about ``max_bytes`` together (one row at least)."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield start, stop
        start = stop


def texts_of(batch: pa.RecordBatch, column: str, start: int, stop: int) -> list[str]:
    """Texts of a row range; null becomes empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).slice(start, stop - start).to_pylist()]

"""Reading the tables and joining labels to them."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column="doc_id", parts=3):
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def labelled(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, per_class: bool = False) -> DataFrame:
    """A bounded sample of labelled texts: columns text, label.

    The ``max_rows`` rows of the smallest hash of doc_id (of each label if
    ``per_class``) are taken, so that the sample is the same for any order or
    partitioning of the input.  The cut is made on the narrow labels table,
    before texts are joined.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    if per_class:
        a = rows.where("label = 1").orderBy(*order).limit(max_rows)
        rows = a.unionByName(rows.where("label <> 1").orderBy(*order).limit(max_rows))
    else:
        rows = rows.orderBy(*order).limit(max_rows)
    # bounded by max_rows (twice that with per_class), so it can be broadcast
    found = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    # one text for each doc_id, however often it is repeated
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def learned(sample: DataFrame, learn):
    """What ``learn`` makes of a bounded sample (an Arrow table, or None without rows), in one task of an executor.

    Only the result comes to the driver; a lost executor costs the task.
    """

    def run(batches):
        got = [b for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(pa.Table.from_batches(got) if got else None))], pa.binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else learn(None)

"""Tables kept for later steps of one query, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"{tempfile.gettempdir()}/lattica-shared"
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back (its path is ``stored_path``); it is deleted when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; its owner clears the folder
            return


SMALL = 200_000  # rows of a table that may be sent to every task


def sized(table: DataFrame, limit: int = SMALL) -> DataFrame:
    """``table`` with a hint to broadcast it if it has at most ``limit`` rows; meant for written tables, which are cheap to count."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table

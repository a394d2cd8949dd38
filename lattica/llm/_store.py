"""Tables written to the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: one copy that
every executor can read again after another one is lost.  The setting is read
from the session; a folder of our own is only used where it is unset and driver
and executors are one machine (local mode, as in tests).  Anywhere else that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"{tempfile.gettempdir()}/lattica-shared"
    return base.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back; its path is ``stored_path``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`save` that no later plan reads."""
    for t in tables:
        path = getattr(t, "stored_path", None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its owner clears the folder
            return

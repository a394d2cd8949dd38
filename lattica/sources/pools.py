"""C17: immutable, content-addressed pools of candidates, on any file system that Spark reads.

A pool is a folder named by its content: Parquet files, and a manifest that is written
after them and only once.  The id is a hash of what the rows are (an order-free digest,
so files and partitions may lie in any order), the columns, the kind and the settings.
Loading adds the rows up again and refuses a pool that was changed, is not finished, or
isn't what its name says.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources import shared_files as sf

LANES = 8
VERSION = "lattica-pool-1"


class PoolError(ValueError):
    """A pool that is missing, unfinished or changed."""


def row_text(columns: list[str]) -> Column:
    """One text for a row: the columns by name, each value with its length, or a mark for null."""
    parts = []
    for c in sorted(columns):
        v = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.lit(f"{c}="), F.length(v).cast("string"), F.lit(":"), v), F.lit(f"{c}=-")))
    return F.concat_ws("|", *parts) if parts else F.lit("")


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): the sums of eight 32-bit lanes of the rows' SHA-256, so the order plays no part and repeated rows count.

    Values are taken as their text; columns of nested types have to be texts already.
    """
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "binary")]
    if nested:
        raise TypeError(f"make texts of {', '.join(nested)} first")
    h = df.select(F.sha2(row_text(df.columns), 256).alias("h"))
    lane = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = h.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(lane(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(LANES)])
    return sums.select("rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *[f"s{i}" for i in range(LANES)]), 256).alias("digest"))


def _described(df: DataFrame, kind: str, config: dict) -> dict:
    r = table_digest(df).first()
    body = {"version": VERSION, "kind": kind, "config": config, "columns": sorted([f.name, f.dataType.simpleString()] for f in df.schema.fields), "rows": r["rows"], "digest": r["digest"]}
    return body | {"pool_id": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def write_pool(df: DataFrame, root: str, kind: str, config: dict) -> str:
    """Write a pool below ``root`` and return its folder; the same content written again is left as it is.

    The digest is taken from the files themselves.  Without its manifest a folder is no pool, so a writer that stops
    halfway leaves nothing that can be loaded.
    """
    spark = df.sparkSession
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    df.write.parquet(f"{staging}/rows")
    manifest = _described(spark.read.schema(df.schema).parquet(f"{staging}/rows"), kind, config)
    path = f"{root}/{kind}-{manifest['pool_id'][:32]}"
    if sf.exists(spark, f"{path}/manifest.json"):
        load_pool(spark, path)
        sf.delete(spark, staging)
        return path
    if not sf.rename(spark, staging, path):
        raise PoolError(f"{path} is there without a manifest: another writer is at work, or stopped")
    sf.create_once(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True, indent=2))
    return path


def load_pool(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, dict]:
    """The rows of a pool and its manifest, after all has been checked against it."""
    text = sf.read(spark, f"{path}/manifest.json")
    if text is None:
        raise PoolError(f"{path} has no manifest")
    manifest = json.loads(text)
    if kind is not None and manifest["kind"] != kind:
        raise PoolError(f"{path} is a pool of kind {manifest['kind']}, not {kind}")
    rows = spark.read.parquet(f"{path}/rows")
    again = _described(rows, manifest["kind"], manifest["config"])
    if again != manifest or not path.rstrip("/").endswith(f"{manifest['kind']}-{manifest['pool_id'][:32]}"):
        changed = [k for k in manifest if manifest[k] != again.get(k)]
        raise PoolError(f"{path} was changed: {', '.join(changed) or 'its name'}")
    return rows, manifest

"""Scans and sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ScanError(ValueError):
    """A source that can't be read; ``kind`` is missing, not_a_file, empty or unparsable."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"{kind}: {path}")
        self.kind = kind


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema every column is text. Typed errors; bad rows fail the scan."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise ScanError("missing", path)
    status = fs.getFileStatus(p)
    if status.isDirectory():
        raise ScanError("not_a_file", path)
    if status.getLen() == 0:
        raise ScanError("empty", path)
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if not df.columns:
        raise ScanError("unparsable", path)
    return df


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """S3: the first ``n`` rows of a stated order (a bare limit would be arbitrary)."""
    return df.orderBy(*order).limit(n)


def selective_outcomes(df: DataFrame, allowed: DataFrame, id_col: str, outcome: str) -> DataFrame:
    """Id and outcome of the allowed ids only; the scan reads two columns."""
    return df.select(id_col, outcome).join(allowed.select(id_col).distinct(), id_col, "left_semi")


def selective_violations(df: DataFrame, allowed: DataFrame, id_col: str, outcome: str) -> DataFrame:
    """Allowed ids without a row (``missing``), or with an outcome that is null or not finite (``not_finite``)."""
    y = F.col(outcome).cast("double")
    bad = F.col(outcome).isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    got = selective_outcomes(df, allowed, id_col, outcome)
    missing = allowed.select(id_col).distinct().join(df.select(id_col), id_col, "left_anti").select(id_col, F.lit("missing").alias("violation"))
    return missing.unionByName(got.where(bad).select(id_col, F.lit("not_finite").alias("violation")))


def write_fresh(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Never overwrites."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Metric tables are small by construction, so one file."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def to_json_document(document) -> str:
    """Sorted keys, indent 2."""
    return json.dumps(document, sort_keys=True, indent=2) + "\n"


def document_hash(document) -> str:
    """SHA-256 of the canonical JSON of a document."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def discover(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the paths that exists."""
    for path in candidates:
        fs, p = _fs(spark, path)
        if fs.exists(p):
            return path
    return None


def guard_invalid(df: DataFrame, status_col: str = "status", bad: tuple[str, ...] = ("invalid", "superseded", "failed")) -> DataFrame:
    """Raises if the table holds rows of a known-bad status, else returns it."""
    if df.where(F.lower(F.col(status_col)).isin(*bad)).limit(1).count():
        raise ValueError(f"rows of status {bad} must not be read as results")
    return df


def markdown_table(df: DataFrame, rows: int = 30) -> str:
    """The first rows of a report table (a report shows at most ``rows``)."""
    cols = df.columns
    lines = [f"| {' | '.join(cols)} |", f"|{'---|' * len(cols)}"]
    lines += [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in df.limit(rows).collect()]
    return "\n".join(lines) + "\n"


def build_manifest(spark: SparkSession, files: dict[str, str], meta: dict | None = None) -> dict:
    """SHA-256 of every text artifact and of the manifest itself."""
    body = {"meta": meta or {}, "files": {n: hashlib.sha256(read_text(spark, p).encode()).hexdigest() for n, p in sorted(files.items())}}
    return body | {"manifest_hash": document_hash(body)}


def verify_manifest(spark: SparkSession, manifest: dict, files: dict[str, str]) -> list[str]:
    """Names that don't match; ``manifest`` itself if its own hash is wrong."""
    fresh = build_manifest(spark, files, manifest["meta"])
    own = document_hash({k: manifest[k] for k in ("meta", "files")})
    return ([] if own == manifest["manifest_hash"] else ["manifest"]) + sorted(n for n in {*fresh["files"], *manifest["files"]} if fresh["files"].get(n) != manifest["files"].get(n))

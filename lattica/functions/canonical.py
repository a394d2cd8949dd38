"""Canonical forms by a plug-in that sees each distinct value once.

The distinct values of all named columns go to the plug-in in batches, wherever they
are; what it says of each is written as a table, which is then joined back to every
column.  So an expensive toolkit runs once a value and not once a row, and a frequent
value costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.store import kept, sized

MISSING, UNPARSABLE, FAILED = "missing", "unparsable", "plugin_error"
BATCH = 1024


@dataclass(frozen=True)
class Plugin:
    """``run`` maps a list of texts to canonical texts, None for those that it can't read; it runs on the executors."""

    name: str
    version: str
    run: Callable[[Sequence[str]], Sequence[str | None]]

    @property
    def label(self) -> str:
        return f"{self.name}@{self.version}"


def _checked(plugin: Plugin, values: list[str]) -> list[tuple[str | None, str | None, str | None]]:
    """(canonical, error type, error text) of each value; one that makes the plug-in fail is found by itself."""
    try:
        got = list(plugin.run(values))
        if len(got) != len(values):
            raise ValueError(f"{len(got)} results for {len(values)} values")
        return [(c, None, None) if c else (None, UNPARSABLE, None) for c in got]
    except Exception as e:  # any error of a foreign toolkit belongs to its value
        if len(values) == 1:
            return [(None, FAILED, f"{type(e).__name__}: {e}"[:300])]
        half = len(values) // 2
        return _checked(plugin, values[:half]) + _checked(plugin, values[half:])


def dictionary(df: DataFrame, columns: list[str], plugin: Plugin) -> DataFrame:
    """(raw, canonical, valid, error_type, error, plugin): a row for each distinct text of ``columns`` that isn't null or blank."""
    raw = df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias("raw"))
    raw = raw.where("trim(raw) <> ''").distinct()

    def run(batches):
        for batch in batches:
            values = batch.column("raw").to_pylist()
            for i in range(0, len(values), BATCH):
                part = values[i : i + BATCH]
                got = _checked(plugin, part)
                columns_ = [part, [g[0] for g in got], [g[0] is not None for g in got], [g[1] for g in got], [g[2] for g in got], [plugin.label] * len(part)]
                kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds, strict=True)], names=["raw", "canonical", "valid", "error_type", "error", "plugin"])

    return raw.mapInArrow(run, "raw string, canonical string, valid boolean, error_type string, error string, plugin string")


def canonicalise(df: DataFrame, columns: list[str], plugin: Plugin) -> DataFrame:
    """``df`` with ``<column>_canonical``, ``<column>_valid``, ``<column>_error_type`` and ``<column>_error`` for each of ``columns``, and ``canonicaliser``.

    Null and blank values are invalid, of the type ``missing``; no row is lost or repeated.  Columns of those names are replaced.
    """
    new = {f"{c}_{k}" for c in columns for k in ("canonical", "valid", "error_type", "error")} | {"canonicaliser"}
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    table = kept(dictionary(df, columns, plugin), "canonical")
    for c in columns:
        side = sized(table).select(F.col("raw").alias(f"_raw_{c}"), F.col("canonical").alias(f"{c}_canonical"), F.col("valid").alias(f"{c}_valid"), F.col("error_type").alias(f"{c}_error_type"), F.col("error").alias(f"{c}_error"))
        out = out.join(side, F.col(f"`{c}`").cast("string") == F.col(f"_raw_{c}"), "left").drop(f"_raw_{c}")
        out = out.withColumns({f"{c}_valid": F.coalesce(f"{c}_valid", F.lit(False)), f"{c}_error_type": F.when(F.col(f"{c}_valid").isNull(), MISSING).otherwise(F.col(f"{c}_error_type"))})
    return out.withColumn("canonicaliser", F.lit(plugin.label))

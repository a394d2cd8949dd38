"""Declarative role schemas: which columns make up a record, and how they group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

UNKNOWN = "UNKNOWN"


@dataclass(frozen=True)
class RoleSchema:
    """Columns of a typed record.

    substrate and condition roles together identify a cell of the experiment;
    ``product`` is what comes out, ``outcome`` the measured value, ``row_id`` a
    unique id of the row.
    """

    substrate: tuple[str, ...]
    condition: tuple[str, ...]
    outcome: str
    row_id: str
    product: tuple[str, ...] = ()

    @property
    def roles(self) -> tuple[str, ...]:
        return (*self.substrate, *self.condition, *self.product)

    @property
    def cell(self) -> tuple[str, ...]:
        return (*self.substrate, *self.condition)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df

"""Declared metadata of one dataset: its fields, their types and roles, and its keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

# The five attributes every declared field carries.
FIELD_ATTRIBUTES = ("field_name", "field_type", "field_length", "field_desc", "field_dtype")

FIELD_DDL = "struct<" + ",".join(f"{a}:string" for a in FIELD_ATTRIBUTES) + ">"
BUNDLE_DDL = f"struct<file_keys:array<string>,fields:array<{FIELD_DDL}>>"
CATALOG_DDL = "ordinal int," + ",".join(f"{a} string" for a in FIELD_ATTRIBUTES)

# Declared types that mark a field as numeric for display.
NUMERIC_TYPES = ("NUM", "NUMBER", "DECIMAL", "FLOAT", "DOUBLE", "INT", "INTEGER")


@dataclass(frozen=True)
class Field:
    """One declared field; ``role`` is ``D`` for a dimension and ``M`` for a measure."""

    name: str
    type: str = "Char"
    length: str = ""
    desc: str = ""
    role: str = "D"

    @property
    def kind(self) -> str:
        """How the field is profiled: ``Num``, ``Date``, ``Datetime`` or ``Char``."""
        declared = self.type.strip().lower()
        return declared.title() if declared in ("num", "date", "datetime") else "Char"

    @property
    def shown_as_number(self) -> bool:
        return self.role.strip().upper() == "M" or self.type.strip().upper() in NUMERIC_TYPES


@dataclass(frozen=True)
class Catalog:
    """Fields in sidecar order, and the names of the key columns."""

    keys: tuple[str, ...]
    fields: tuple[Field, ...]

    def field(self, name: str) -> Field | None:
        return {f.name: f for f in self.fields}.get(name)

    def has_role(self, name: str, role: str) -> bool:
        found = self.field(name)
        return found is not None and found.role == role

    @classmethod
    def from_row(cls, row: Row) -> "Catalog":
        """Build from a parsed sidecar row with ``file_keys`` and ``fields``."""
        return cls(
            tuple(row["file_keys"] or ()),
            tuple(Field(*(f[a] for a in FIELD_ATTRIBUTES)) for f in row["fields"]),
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        """The catalog as a DataFrame, one row per declared field."""
        rows = [(i, f.name, f.type, f.length, f.desc, f.role) for i, f in enumerate(self.fields)]
        return spark.createDataFrame(rows, CATALOG_DDL)

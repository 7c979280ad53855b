"""Questions answered from declared metadata alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulant.catalog import BUNDLE_DDL, Catalog, Field
from tabulant.functions.display import field_label


def bundle_to_json(parsed: DataFrame) -> DataFrame:
    """Each parsed sidecar as ``(path, bundle)`` with its keys and fields as JSON."""
    return parsed.select("path", F.to_json(F.struct("file_keys", "fields")).alias("bundle"))


def bundle_from_json(stored: DataFrame) -> DataFrame:
    """Back from JSON to ``path, file_keys, fields``."""
    return stored.select("path", F.from_json("bundle", BUNDLE_DDL).alias("b")).select("path", "b.*")


def catalog_to_json(catalog: Catalog) -> dict:
    """The bundle of one dataset as a plain dictionary."""
    fields = [
        {"field_name": f.name, "field_type": f.type, "field_length": f.length, "field_desc": f.desc, "field_dtype": f.role}
        for f in catalog.fields
    ]
    return {"file_keys": list(catalog.keys), "fields": fields}


def catalog_from_json(bundle: dict) -> Catalog:
    fields = (
        Field(f["field_name"], f["field_type"], f["field_length"], f["field_desc"], f["field_dtype"])
        for f in bundle.get("fields", [])
    )
    return Catalog(tuple(bundle.get("file_keys", [])), tuple(fields))


def fields_by_role(catalogs: DataFrame, role: str) -> DataFrame:
    """Dimensions (``D``) or measures (``M``), in sidecar order."""
    return catalogs.where(F.col("field_dtype") == role)


def with_labels(catalogs: DataFrame) -> DataFrame:
    return catalogs.withColumn("label", field_label(F.col("field_name"), F.col("field_desc")))


def search_fields(catalogs: DataFrame, search: str | None) -> DataFrame:
    """Fields whose name contains the text, upper and lower case alike."""
    wanted = (search or "").strip().lower()
    return catalogs.where(F.contains(F.lower("field_name"), F.lit(wanted))) if wanted else catalogs


def visible_columns(catalog: Catalog, chosen: Sequence[str] | None = None, action: str | None = None) -> list[str]:
    """The columns to show: the valid choices, or all; keys are always kept, last if not chosen.

    ``action`` may be ``select_all`` or ``deselect_all``.
    """
    every = sorted({f.name for f in catalog.fields})
    current = [c for c in chosen or () if c in every] or every
    if action == "select_all":
        current = every
    elif action == "deselect_all":
        current = []
    return list(dict.fromkeys([*current, *(k for k in catalog.keys if k in every)]))


def recommended_chart(dimension_type: Column, measure_type: Column) -> Column:
    """Line for dates against numbers, bar for other numbers, else pie."""
    numeric = F.lower(F.coalesce(measure_type, F.lit(""))) == "num"
    dated = F.lower(F.coalesce(dimension_type, F.lit(""))).isin("date", "datetime")
    return F.when(numeric & dated, "Line").when(numeric, "Bar").otherwise("Pie")


def recommend_charts(pairs: DataFrame, catalogs: DataFrame, by: str = "path") -> DataFrame:
    """A chart for every chosen ``(by, dimension, measure)``; unknown fields count as untyped."""
    types = catalogs.select(by, "field_name", "field_type")
    dims = types.select(by, F.col("field_name").alias("dimension"), F.col("field_type").alias("dimension_type"))
    measures = types.select(by, F.col("field_name").alias("measure"), F.col("field_type").alias("measure_type"))
    typed = pairs.join(dims, [by, "dimension"], "left").join(measures, [by, "measure"], "left")
    chart = recommended_chart(F.col("dimension_type"), F.col("measure_type"))
    return typed.select(by, "dimension", "measure", chart.alias("chart"))

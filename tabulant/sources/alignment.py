"""Where declared fields and data columns disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabulant.catalog import Catalog
from tabulant.columns import data_columns


def alignment_warnings(declared: DataFrame, present: DataFrame, by: str = "dataset") -> DataFrame:
    """Warnings for any number of datasets: ``(by, rank, warning)``.

    ``declared`` and ``present`` hold ``(by, name)``. Fields missing in the data come first,
    then columns missing in the metadata, each sorted by name.
    """
    declared, present = declared.select(by, "name").distinct(), present.select(by, "name").distinct()
    absent = declared.join(present, [by, "name"], "left_anti").select(
        by, F.lit(0).alias("side"), "name", F.concat(F.lit("Metadata field missing in data: "), "name").alias("warning")
    )
    extra = present.join(declared, [by, "name"], "left_anti").select(
        by, F.lit(1).alias("side"), "name", F.concat(F.lit("Data column missing in metadata: "), "name").alias("warning")
    )
    # A dataset has at most as many warnings as it has names, so its window stays small.
    rank = F.row_number().over(Window.partitionBy(by).orderBy("side", "name"))
    return absent.unionByName(extra).select(by, rank.alias("rank"), "warning")


def schema_warnings(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Warnings for one dataset: ``(rank, warning)``."""
    spark = df.sparkSession
    declared = spark.createDataFrame([(0, f.name) for f in catalog.fields], "dataset int, name string")
    present = spark.createDataFrame([(0, c) for c in data_columns(df)], "dataset int, name string")
    return alignment_warnings(declared, present).select("rank", "warning")

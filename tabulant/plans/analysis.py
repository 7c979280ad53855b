"""Chart data, statistics and quality for a chosen pair of fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tabulant.catalog import Catalog
from tabulant.functions.display import display_nested, display_scorecard
from tabulant.operators.catalogs import with_labels
from tabulant.operators.charts import chart_data
from tabulant.operators.ordering import key_order
from tabulant.operators.profile import field_stats


@dataclass(frozen=True)
class Analysis:
    chart: DataFrame
    stats: DataFrame
    scorecard: DataFrame
    findings: DataFrame


def recommended_kind(catalog: Catalog, dimension: str, measure: str) -> str:
    """The chart kind suggested by the declared types of two fields."""
    kinds = [f.type.lower() if (f := catalog.field(n)) else "" for n in (dimension, measure)]
    if kinds[1] != "num":
        return "Pie"
    return "Line" if kinds[0] in ("date", "datetime") else "Bar"


def labelled_stats(profiled: DataFrame, catalog: Catalog, names: list[str | None]) -> DataFrame:
    """Chosen profile rows with display labels and formatted values."""
    chosen = field_stats(profiled, names)
    types = {f.name: f.dataType for f in chosen.schema.fields}
    formatted = chosen.select(
        "field_name",
        "stat_type",
        *(display_nested(F.col(c), t).alias(c) for c, t in types.items() if c not in ("field_name", "stat_type")),
    )
    labels = with_labels(catalog.frame(profiled.sparkSession)).select("field_name", "label")
    return formatted.join(labels, "field_name", "left")


def analyse(
    df: DataFrame,
    catalog: Catalog,
    profiled: DataFrame,
    scorecard: DataFrame,
    findings: DataFrame,
    dimension: str,
    measure: str,
    kind: str | None = None,
    color: str | None = None,
) -> Analysis:
    """Everything the analysis of one chart needs; the kind defaults to bar."""
    return Analysis(
        chart_data(df, kind or "Bar", dimension, measure, color, key_order(df, catalog)),
        labelled_stats(profiled, catalog, [dimension, measure, color]),
        display_scorecard(scorecard),
        findings,
    )

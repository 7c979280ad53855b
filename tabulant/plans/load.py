"""Load a delimited file with its sidecar: check, profile, score and store it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabulant.catalog import Catalog
from tabulant.columns import first_row_keys
from tabulant.functions.casts import infer_layouts, with_companions
from tabulant.operators.ordering import key_order, key_sort_status
from tabulant.operators.profile import profile
from tabulant.operators.quality import findings, scorecard
from tabulant.sources.alignment import schema_warnings
from tabulant.sources.delimited import read_delimited
from tabulant.sources.sidecar import load_catalog, sidecar_path
from tabulant.sources.snapshot import Snapshot, write_snapshot
from tabulant.storage import stored


@dataclass(frozen=True)
class Loaded:
    """A stored dataset with everything known about it."""

    catalog: Catalog
    snapshot: Snapshot
    profile: DataFrame
    warnings: DataFrame
    scorecard: DataFrame
    findings: DataFrame
    sort_status: str

    @property
    def rows(self) -> DataFrame:
        return self.snapshot.frame()


def load_and_profile(
    spark: SparkSession,
    path: str,
    top_n: int,
    delimiter: str | None = ",",
    catalog: Catalog | None = None,
    snapshot_path: str | None = None,
    multiline: bool | str = "auto",
    layouts: Mapping[str, str] | None = None,
) -> Loaded:
    """Read, sort by key and store the data once, then profile the stored columns.

    The files are read twice, once to see how they are quoted and once to parse them into a table; dates' layouts, the
    bounds of the sort and the sorted rows come from that table. Typed companions are stored next to the text, and the
    profile, filters and charts all read those.
    """
    declared = catalog or load_catalog(spark, sidecar_path(path))
    parsed = stored(read_delimited(spark, path, delimiter, multiline), "parsed")
    return store_and_profile(parsed, declared, top_n, snapshot_path, layouts)


def store_and_profile(
    raw: DataFrame,
    catalog: Catalog,
    top_n: int,
    snapshot_path: str | None = None,
    layouts: Mapping[str, str] | None = None,
) -> Loaded:
    """Sort, store, profile and score an all-text frame."""
    order = key_order(raw, catalog)
    dated = [f.name for f in catalog.fields if f.kind in ("Date", "Datetime") and f.name in raw.columns]
    chosen = infer_layouts(raw, dated, first_row_keys(raw, catalog.keys), layouts)
    looked_up = [f.name for f in catalog.fields if f.name in raw.columns and (f.role == "D" or f.name in catalog.keys)]
    snapshot = write_snapshot(with_companions(raw, catalog, chosen), order, snapshot_path, looked_up)
    warnings = schema_warnings(raw, catalog)
    profiled = stored(profile(snapshot.table(), catalog, top_n), "profile")
    spark = raw.sparkSession
    return Loaded(
        catalog,
        snapshot,
        profiled,
        warnings,
        scorecard(profiled, warnings),
        findings(profiled, catalog.frame(spark), warnings),
        key_sort_status(raw, catalog),
    )

"""How long intermediate tables stay."""

import os

import pytest
from pyspark.sql import functions as F

from tabulant import storage
from tabulant.catalog import Catalog, Field
from tabulant.plans.load import store_and_profile
from tabulant.sources.snapshot import write_snapshot
from tabulant.storage import TABLES, lifetime, stored, sweep


@pytest.fixture()
def shared(folder, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(folder))
    return folder / TABLES


def left(shared):
    return sorted(p.name for p in shared.iterdir()) if shared.exists() else []


def test_tables_go_with_their_owner(spark, shared, folder):
    rows = spark.range(50).selectExpr("cast(id as string) as k", "repeat('x', 100) || id % 3 as v")
    outside = stored(rows, "outside")
    with lifetime(spark) as owned:
        loaded = store_and_profile(rows, Catalog(("k",), (Field("k"), Field("v"))), 2, str(folder / "given"))
        assert loaded.profile.count() == 3 and loaded.rows.count() == 50
        with lifetime(spark):
            inner = write_snapshot(rows, [F.col("k")])
            assert inner.frame().count() == 50
        assert not os.path.exists(inner.path) and len(owned.paths) > 1
        kept = owned.paths[0]
        owned.keep(kept)
        assert os.path.exists(kept)
    assert left(shared) == sorted([os.path.basename(kept), *(p for p in left(shared) if p.startswith("outside"))])
    assert outside.count() == 50 and (folder / "given").exists()


def test_a_failed_run_leaves_nothing(spark, shared):
    with pytest.raises(Exception, match="broken"), lifetime(spark):
        stored(spark.range(5))
        stored(spark.range(5).select(F.raise_error(F.lit("broken")).alias("x")))
    assert left(shared) == []


def test_removal_goes_on_past_errors(spark, shared, monkeypatch):
    remove = storage._remove

    def refuse_some(spark, path):
        if "bad" in path:
            raise OSError("refused")
        remove(spark, path)

    monkeypatch.setattr(storage, "_remove", refuse_some)
    with pytest.raises(OSError, match="refused"), lifetime(spark) as owned:
        for label in ("good", "bad", "fine"):
            stored(spark.range(2), label)
    assert [p.split("-")[0] for p in left(shared)] == ["bad"] and len(owned.paths) == 1


def test_sweep_takes_only_old_tables_of_the_library(spark, shared):
    assert sweep(spark, 60) == []
    for label in ("old", "new"):
        stored(spark.range(2), label)
    (shared / "someone-elses").mkdir()
    for entry in shared.iterdir():
        if not entry.name.startswith("new"):
            os.utime(entry, (1, 1))
    assert [os.path.basename(p).split("-")[0] for p in sweep(spark, 3600)] == ["old"]
    assert [p.split("-")[0] for p in left(shared)] == ["new", "someone"]

import pytest

from tabulant.catalog import Catalog, Field
from tabulant.operators.catalogs import (
    bundle_from_json,
    bundle_to_json,
    catalog_from_json,
    catalog_to_json,
    recommend_charts,
    search_fields,
    visible_columns,
    with_labels,
)
from tabulant.sources.alignment import schema_warnings
from tabulant.sources.sidecar import (
    explode_catalogs,
    list_files,
    load_catalog,
    missing_sidecars,
    pair_with_sidecars,
    parse_sidecars,
    read_sidecars,
)

KEY_VALUE = """FileKey|station,taken_at
FieldName|station
FieldType|Num
FieldLength|6
FieldDesc|Weather station
FieldDType|D
FieldName|county
FieldType|Char
FieldDesc|Where it stands
FieldName|rain_mm
FieldType|num
FieldLength|7,1
FieldDType|m
"""


def parse(spark, *texts):
    """Parse texts in one go; one row, or one per text."""
    named = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    rows = sorted(parse_sidecars(named).collect(), key=lambda r: int(r.path))
    return rows if len(rows) > 1 else rows[0]


def fields(row):
    return [tuple(f) for f in row.fields]


def test_key_value(spark):
    row = parse(spark, "﻿" + KEY_VALUE)
    assert (row.format, row.status, row.file_keys) == ("keyvalue", "ok", ["station", "taken_at"])
    assert fields(row) == [
        ("station", "Num", "6", "Weather station", "D"),
        ("county", "Char", "", "Where it stands", "D"),
        ("rain_mm", "Num", "7,1", "", "M"),
    ]


def test_key_value_oddities(spark):
    row = parse(
        spark,
        "FieldDesc|before\nFieldName|a\nFieldType|num\nFieldType|date\nnonsense\nOther|x\n"
        "FieldName|\nFieldName|b\nFieldDesc|x|y\nFileKey|a\nFileKey|a, b,,\nFieldName|\n",
    )
    assert (row.status, row.file_keys) == ("ok", ["a", "b"])
    assert fields(row) == [("a", "Date", "", "before", "D"), ("b", "Char", "", "x|y", "D")]


def test_tabular(spark):
    row = parse(
        spark,
        "FieldDesc|FieldName|FieldDType|FieldType|FileKey|FieldLength\n"
        "first|a|m|num||5\n\n"
        "second|b\n"
        "third|c|||b, a|\n",
    )
    assert (row.format, row.status, row.file_keys) == ("tabular", "ok", ["b", "a"])
    assert fields(row) == [
        ("a", "Num", "5", "first", "M"),
        ("b", "Char", "", "second", "D"),
        ("c", "Char", "", "third", "D"),
    ]


def test_compact_with_key_inside_the_first_descriptor(spark):
    row = parse(spark, "SHELF,BOOK|SHELF|Char|3|Level|D,BOOK|Char|50|BOOK|D,PAGES|Num||Base|M\n")
    assert (row.format, row.status, row.file_keys) == ("compact", "ok", ["SHELF", "BOOK"])
    assert fields(row) == [
        ("SHELF", "Char", "3", "Level", "D"),
        ("BOOK", "Char", "50", "BOOK", "D"),
        ("PAGES", "Num", "", "Base", "M"),
    ]


def test_compact_oddities(spark):
    one_key, lost_name, shifted, character, other = parse(
        spark,
        "k,k2|a|Char50|About a|d,b|x,c|number|About c|M",
        "k,a|Char|5|About a|D",
        "k,l,X|Char|5||D",
        "k,l,X|Character|desc|D",
        "k,l,X|big decimal|desc|D",
    )
    assert one_key.file_keys == ["k", "k2"]
    assert fields(one_key) == [("a", "Char", "50", "About a", "D"), ("c", "Num", "", "About c", "M")]
    assert lost_name.file_keys == ["k", "a"] and lost_name.note
    assert fields(lost_name) == [("Char", "5", "", "About a", "D")]
    assert fields(shifted) == [("X", "Char", "", "5", "D")] and shifted.note
    assert fields(character) == [("X", "Char", "acter", "desc", "D")]
    assert fields(other) == [("X", "Big Decimal", "", "desc", "D")]


UNUSABLE = [
    ("", "empty"),
    (" \n\n", "empty"),
    ("a|b|c|d,e|f|g|h", "explicit file keys"),
    ("a|b|c|d,", "at least one field"),
    ("nothing here", "field definitions"),
    ("k,l,a|b|c", "field definitions"),
    ("FieldName|FieldType|FieldLength|FieldDesc|FieldDType|FileKey\n|num|||M|k", "empty FieldName"),
]


def test_unusable(spark):
    texts = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(UNUSABLE)], "path string, text string")
    for row in parse_sidecars(texts).collect():
        assert UNUSABLE[int(row.path)][1] in row.status, row


def test_discovery_and_loading(spark, folder):
    (folder / "a.csv").write_text("x\n1\n")
    (folder / "a.csv_Meta").write_text(KEY_VALUE)
    (folder / "b.csv").write_text("x\n1\n")
    files = list_files(spark, str(folder))
    assert files.count() == 3
    assert {(r.path.rsplit("/", 1)[1], r.found) for r in pair_with_sidecars(files).collect()} == {
        ("a.csv", True),
        ("b.csv", False),
    }
    lost = missing_sidecars(files).first()
    assert lost.error.endswith("b.csv_Meta") and "not found" in lost.error
    assert load_catalog(spark, str(folder / "a.csv_Meta")).field("rain_mm") == Field("rain_mm", "Num", "7,1", "", "M")
    parsed = parse_sidecars(read_sidecars(spark, str(folder / "*_Meta")))
    assert [r.field_name for r in explode_catalogs(parsed).orderBy("ordinal").collect()] == ["station", "county", "rain_mm"]
    assert fields(bundle_from_json(bundle_to_json(parsed)).first()) == fields(parsed.first())
    (folder / "c_Meta").write_text("")
    with pytest.raises(ValueError, match="empty"):
        load_catalog(spark, str(folder / "c_Meta"))
    with pytest.raises(FileNotFoundError, match="Metadata file not found"):
        load_catalog(spark, str(folder / "b.csv_Meta"))


CATALOG = Catalog(("b",), (Field("c", "Date", desc="When"), Field("a", "Num", role="M"), Field("b", desc=" ")))


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, z int, y int")
    assert [r.warning for r in schema_warnings(df, CATALOG).orderBy("rank").collect()] == [
        "Metadata field missing in data: a",
        "Metadata field missing in data: c",
        "Data column missing in metadata: y",
        "Data column missing in metadata: z",
    ]


def test_catalog_helpers(spark):
    assert catalog_from_json(catalog_to_json(CATALOG)) == CATALOG
    assert visible_columns(CATALOG) == ["a", "b", "c"]
    assert visible_columns(CATALOG, ["c", "nope"]) == ["c", "b"]
    assert visible_columns(CATALOG, ["c"], "deselect_all") == ["b"]
    assert visible_columns(CATALOG, ["c"], "select_all") == ["a", "b", "c"]
    frame = CATALOG.frame(spark)
    assert [r.label for r in with_labels(frame).orderBy("ordinal").collect()] == ["C [When]", "A", "B"]
    assert [r.field_name for r in search_fields(frame, " C ").collect()] == ["c"]
    pairs = spark.createDataFrame([(0, "c", "a"), (0, "b", "a"), (0, "a", "b"), (0, "x", "y")], "ds int, dimension string, measure string")
    charts = {(r.dimension, r.measure): r.chart for r in recommend_charts(pairs, frame.selectExpr("0 as ds", "*"), "ds").collect()}
    assert charts == {("c", "a"): "Line", ("b", "a"): "Bar", ("a", "b"): "Pie", ("x", "y"): "Pie"}

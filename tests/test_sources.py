import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tabulant.catalog import Catalog, Field
from tabulant.columns import ORDINAL, data_columns
from tabulant.operators.filters import apply_value_and_range_filters
from tabulant.operators.ordering import number_records
from tabulant.plans.load import load_and_profile
from tabulant.sources.records import split_records
from tabulant.sources.delimited import (
    NULL_TOKENS,
    QUARANTINED,
    RAW,
    quarantine_long_rows,
    read_delimited,
    read_header,
    survey_files,
    unique_headers,
)
from tabulant.sources.snapshot import write_snapshot


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def in_order(df):
    return [tuple(r) for r in df.orderBy(ORDINAL).drop(ORDINAL).collect()]


def test_headers():
    assert unique_headers(["id", "b", "b", None, "b.1", "b"]) == ["id", "b", "b.2", "Unnamed: 3", "b.1", "b.3"]
    assert unique_headers(["ID", "id", "Id.1", "iD"]) == ["ID", "id.2", "Id.1", "iD.3"]
    with pytest.raises(ValueError, match="Reserved"):
        unique_headers(["a", "__tabulant_ordinal__"])


def test_any_other_name_is_data(spark, folder):
    path = write(folder / "a.csv", "start,record_number,__v,ID,id\n1,2,3,4,5\n")
    df = read_delimited(spark, path)
    assert data_columns(df) == ["start", "record_number", "__v", "ID", "id.1"]
    numbered = write_snapshot(df, [F.col("start")]).frame()
    assert [tuple(r) for r in numbered.collect()] == [("1", "2", "3", "4", "5", 1)]
    shown = number_records(df, [F.col("start")])
    assert shown.columns == ["start", "record_number", "__v", "ID", "id.1", "record_number.1"]


def test_files_with_columns_in_other_order(spark, folder):
    data = folder / "data"
    data.mkdir()
    write(data / "1.csv", "a,b\n1,x\n")
    write(data / "2.csv", 'b,a\n"p\nq",2\n')
    write(data / "3.csv", "b,a\ny,3\n")
    assert in_order(read_delimited(spark, str(data))) == [("1", "x"), ("2", "p\nq"), ("3", "y")]
    write(data / "4.csv", "a,c\n4,z\n")
    with pytest.raises(ValueError, match="Other columns"):
        read_delimited(spark, str(data))


def test_quotes_newlines_blank_lines_short_rows_and_mark(spark, folder):
    path = write(
        folder / "a.csv",
        '﻿id,b,b,\n1,"x ""q"" y",z,w\n\n   \n2,"two\nlines",NA,"NA"\n3,short\n6,,,\n',
    )
    df = read_delimited(spark, path)
    assert df.columns[:-1] == ["id", "b", "b.1", "Unnamed: 3"]
    assert [o for _, o, _ in survey_files(spark, path)] == [True]
    assert in_order(df) == [
        ("1", 'x "q" y', "z", "w"),
        ("2", "two\nlines", None, None),
        ("3", "short", None, None),
        ("6", None, None, None),
    ]


@pytest.mark.parametrize("multiline", [True, False, "auto"])
def test_both_readers_agree_on_closed_lines(spark, folder, multiline):
    path = write(folder / "a.csv", 'a|b\n1|"x|y"\n\n  \n2\n3|"say ""hi"""\n')
    df = read_delimited(spark, path, "|", multiline)
    assert in_order(df) == [("1", "x|y"), ("2", None), ("3", 'say "hi"')]
    assert [r.a for r in df.select("a").orderBy("a").collect()] == ["1", "2", "3"]
    assert df.count() == 3


@pytest.mark.parametrize("multiline", [True, False, "auto"])
def test_long_rows_fail_or_are_quarantined(spark, folder, multiline):
    path = write(folder / "a.csv", 'a,b\n1,2\n1,2,3\n4\n5,6,\n"7,7",8\n')
    with pytest.raises(Exception, match="Expected 2 cells"):
        read_delimited(spark, path, ",", multiline).select("a").collect()
    rows = quarantine_long_rows(spark, path, ",", multiline)
    assert [tuple(r) for r in rows.where(QUARANTINED).select(RAW).orderBy(RAW).collect()] == [
        ("1,2,3",),
        ("5,6,",),
    ]
    kept = rows.where(~F.col(QUARANTINED)).select("a", "b", ORDINAL)
    assert in_order(kept) == [("1", "2"), ("4", None), ("7,7", "8")]
    assert rows.count() == 5
    # The same answer when only one data column is asked for.
    assert rows.where(QUARANTINED).select("b").count() == 2


def test_null_tokens_quoted_or_not(spark, folder):
    lines = [f"{i},{t}" for i, t in enumerate(NULL_TOKENS)] + [f'x{i},"{t}"' for i, t in enumerate(NULL_TOKENS)]
    path = write(folder / "a.csv", "k,v\n" + "\n".join(lines) + "\nreal,Null\n")
    rows = read_delimited(spark, path).collect()
    assert len(rows) == 2 * len(NULL_TOKENS) + 1
    assert [(r.k, r.v) for r in rows if r.v is not None] == [("real", "Null")]


def test_mixed_folder_keeps_file_order(spark, folder):
    data = folder / "in dir"
    data.mkdir()
    write(data / "1.csv", "a,b\n1,x\n2,y\n")
    write(data / "2.csv", 'a,b\n3,"p\nq"\n4,z\n')
    write(data / "3.csv", "a,b\n5,w\n")
    df = read_delimited(spark, str(data))
    assert in_order(df) == [("1", "x"), ("2", "y"), ("3", "p\nq"), ("4", "z"), ("5", "w")]


def test_quote_opened_late_in_a_line_is_found(spark, folder):
    path = write(folder / "a.csv", 'a,b\nx"y,"one\ntwo"\n')
    assert [o for _, o, _ in survey_files(spark, path)] == [True]
    assert in_order(read_delimited(spark, path)) == [('x"y', "one\ntwo")]


def test_large_file_is_split_and_keeps_order(spark, folder):
    path = write(folder / "a.csv", "a,b\n" + "".join(f"{i},{'v' * 50}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_delimited(spark, path)
        assert df.rdd.getNumPartitions() > 4
        assert [int(r.a) for r in df.orderBy(ORDINAL).select("a").collect()] == list(range(20000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tab_and_empty_delimiter(spark, folder):
    tabs = write(folder / "t.tsv", "a\tb\n1\t2\n")
    commas = write(folder / "c.csv", "a,b\n1,2\n")
    assert in_order(read_delimited(spark, tabs, "\t")) == [("1", "2")]
    assert in_order(read_delimited(spark, commas, "")) == [("1", "2")]
    assert read_header(spark, commas) == ["a", "b"]


def test_missing_file_is_an_error(spark, folder):
    with pytest.raises(FileNotFoundError, match="Data file not found"):
        read_delimited(spark, str(folder / "none.csv"))


@pytest.fixture()
def small_splits(spark):
    """Splits of a few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_large_files_with_quoted_line_ends_are_split(spark, folder, small_splits, line_end):
    rng = random.Random(5)

    def cell():
        text = "".join(rng.choice(["a", "b", ",", '"', "\n", "\r\n", "\r", " ", "long words "]) for _ in range(rng.randint(0, 40)))
        stray = rng.choice(["5", '5" pipe', 'say "hi" now', ' "z"', 'x"', ""])
        return '"' + text.replace('"', '""') + '"' if rng.random() < 0.7 else stray

    data = folder / "data"
    data.mkdir()
    for name in ("a.csv", "b.csv"):
        rows = [f"{i},{cell()},{cell()}" for i in range(150)]
        rows[70] = '70,"' + "x\n" * 600 + '",end'
        rows[90] = "90,short"
        rows.insert(100, "")
        # Bytes, so that line ends are kept as they are.
        (data / name).write_bytes(line_end.join(["id,p,q", *rows, ""]).encode())
    split = read_delimited(spark, str(data))
    assert spark.read.text(str(data)).rdd.getNumPartitions() > 20
    frames = [pd.read_csv(data / name, dtype="string") for name in ("a.csv", "b.csv")]
    expected = [tuple(None if pd.isna(v) else v for v in r) for frame in frames for r in frame.itertuples(index=False)]
    assert in_order(split) == expected
    assert split.count() == 300


def test_many_splits_meet_their_lines_by_shuffle(spark, folder, small_splits):
    rows = "".join(f'{i},"{"x" * (i % 40)}\n{i}"\n' if i % 3 else f"{i},y\n" for i in range(300))
    path = write(folder / "a.csv", 'a,"b\nc"\n' + rows)
    found = [sorted(split_records(spark, [path], ",", most).collect()) for most in (0, 1000)]
    assert found[0] == found[1] and len(found[0]) == 300
    assert [r.text.split(",")[0] for r in found[0]] == [str(i) for i in range(300)]


def test_text_of_whole_records_moves_nowhere(spark, folder, small_splits):
    path = write(folder / "a.csv", "a,b\n" + '1,"x\ny"\n' * 200)
    plan = split_records(spark, [path])._jdf.queryExecution().optimizedPlan().toString()
    whole = plan.split("MapInArrow", 1)[1].split("Aggregate", 1)[0]
    assert "Repartition" not in whole and "Sort" not in whole and "Window" not in whole


def test_header_longer_than_a_split_is_no_record(spark, folder, small_splits):
    path = write(folder / "a.csv", '\n"' + "long\n" * 200 + '",b\n' + '1,"x\ny"\n' * 50)
    assert sorted(r.text for r in split_records(spark, [path]).collect() if r.text) == ['1,"x\ny"'] * 50


def test_stray_quotes_in_a_split_file(spark, folder, small_splits):
    path = write(folder / "a.csv", 'a,b\n1,x"y\n2,"p\nq"\n' + "3,z\n" * 200)
    rows = in_order(read_delimited(spark, path))
    assert rows[:2] == [("1", 'x"y'), ("2", "p\nq")] and len(rows) == 202


def test_long_rows_in_a_split_file(spark, folder, small_splits):
    path = write(folder / "a.csv", 'a,b\n1,"x\ny",3\n' + "3,z\n" * 200)
    rows = quarantine_long_rows(spark, path)
    assert [r[RAW] for r in rows.where(QUARANTINED).collect()] == ['1,"x\ny",3']
    assert rows.where(~F.col(QUARANTINED)).count() == 200


def scanned(frame):
    """Rows that the scan of a frame gave when it ran."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return rows, plan.metrics().get("numOutputRows").get().value()


def test_snapshots_skip_row_groups_without_a_looked_up_value(spark, folder):
    ids = spark.range(40_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("code"), F.lit("x").alias("kind"))
    catalog = Catalog(("id",), (Field("code"), Field("kind")))
    wanted = [r.code for r in ids.where("id in (7, 39000)").collect()]
    for name, lookups, most in (("with", ["code"], 15_000), ("without", [], 40_000)):
        snapshot = write_snapshot(ids.repartition(8), None, str(folder / name), lookups)
        kept = apply_value_and_range_filters(snapshot.table(), catalog, [("code", wanted)], [])
        rows, read = scanned(kept)
        assert sorted(r.id for r in rows) == [7, 39000]
        assert read <= most if lookups else read == most


def test_loading_parses_its_files_once(spark, folder):
    (folder / "data.csv").write_text("k,d,n\n" + "".join(f"{i:03},2024-01-{i % 28 + 1:02},{i}\n" for i in range(90)))
    catalog = Catalog(("k",), (Field("k"), Field("d", "Date"), Field("n", "Num", role="M")))
    loaded = load_and_profile(spark, str(folder / "data.csv"), 3, catalog=catalog, snapshot_path=str(folder / "kept"))
    (folder / "data.csv").unlink()
    assert loaded.snapshot.row_count == 90
    assert [r.k for r in loaded.rows.orderBy(ORDINAL).limit(2).collect()] == ["000", "001"]
    assert {r.field_name: r.row_count for r in loaded.profile.collect()} == {"k": 90, "d": 90, "n": 90, "__FILEKEY__": 90}

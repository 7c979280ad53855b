import contextlib
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import Observation, functions as F

from tabulant import storage
from tabulant.catalog import Catalog, Field
from tabulant.operators.charts import chart_data
from tabulant.operators.filters import apply_grid_filters
from tabulant.columns import ORDINAL, row_order
from tabulant.operators.median import bracket, exact_medians
from tabulant.operators.options import measure_ranges
from tabulant.operators.ordering import (
    RECORD,
    _leading,
    large_result_guard,
    number_records,
    page,
    rows_between,
    sort_order,
    sort_rows,
)
from tabulant.operators import ordering, profile as profile_module
from tabulant.operators.profile import profile
from tabulant.operators.quality import findings, scorecard
from tabulant.sources.snapshot import open_snapshot, write_snapshot

SHAPES = {
    "uniform": lambda r: r.uniform(-5, 5),
    "heavy": lambda r: r.choice([-1, 1]) * 10 ** r.uniform(-200, 200),
    "ties": lambda r: float(r.randint(0, 3)),
    "half_hot": lambda r: 7.0 if r.random() < 0.5 else r.uniform(0, 1e9),
    "two_values": lambda r: r.choice([1.0, 2.0]),
    "close": lambda r: 1.0 + r.randint(0, 40) * 2.220446049250313e-16,
    "denormal": lambda r: 1e-310 + r.randint(0, 9) * 5e-324,
    "infinite": lambda r: r.choice([float("inf"), r.uniform(-1e308, 1e308), float("-inf"), 3.0]),
}


@pytest.mark.parametrize("wrong", [False, True])
def test_medians_from_brackets_are_exact_even_if_the_brackets_miss(spark, wrong):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), 5.0 if k % 3 else rng.random(), float("inf") if k % 5 else -1.0) for k in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    names = df.columns
    known = {i: (len(rows), min(r[i] for r in rows), max(r[i] for r in rows)) for i in range(4)}
    row = df.agg(*(bracket(F.col(n)).alias(n) for n in names)).first()
    brackets = {i: (known[i][1], known[i][1]) if wrong else row[n] for i, n in enumerate(names)}
    got = exact_medians(df, {i: F.col(n) for i, n in enumerate(names)}, known, brackets=brackets)
    assert got == {i: statistics.median(r[i] for r in rows) for i in range(4)}


@pytest.mark.parametrize("size", [1, 2, 5001, 5002])
def test_medians_are_exact_however_few_values_are_ranked(spark, size):
    rng = random.Random(size)
    rows = [tuple(make(rng) for make in SHAPES.values()) for _ in range(size)]
    df = spark.createDataFrame(rows, ",".join(f"`{n}` double" for n in SHAPES)).repartition(5)
    known = {i: (size, min(c), max(c)) for i, c in enumerate(zip(*rows))}
    got = exact_medians(df, {i: F.col(n) for i, n in enumerate(SHAPES)}, known, ranked_values=7)
    for i, name in enumerate(SHAPES):
        expected = statistics.median(r[i] for r in rows)
        assert got[i] == expected or math.isnan(got[i]) and math.isnan(expected), name


@contextlib.contextmanager
def many_files(spark):
    """Keep small sorts in several partitions, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


CATALOG = Catalog(
    ("k", "t"),
    (Field("k"), Field("t"), Field("n", "Num", role="M"), Field("d", "Date"), Field("w", "Number", role="M"), Field("gone")),
)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t string, n string, d string, w string")


def by_name(df):
    return {r.field_name: r for r in df.collect()}


def test_empty_input(spark):
    rows = by_name(profile(frame(spark, []), CATALOG, 3))
    assert list(sorted(rows)) == ["__FILEKEY__", "d", "k", "n", "t", "w"]
    assert (rows["k"].row_count, rows["k"].null_count, rows["k"].distinct_count, rows["k"].top_values) == (0, 0, 0, [])
    assert (rows["n"].row_count, rows["n"].parse_success_rate, rows["n"]["min"]) == (0, 0.0, None)
    assert (rows["d"].row_count, rows["d"].min_ts) == (0, None)
    assert (rows["__FILEKEY__"].row_count, rows["__FILEKEY__"].uniqueness_ratio) == (0, 0.0)


def test_nulls_bad_values_and_undeclared_types(spark):
    rows = [("a", None, "x", "2024-01-01", "5"), ("a", None, None, None, None), ("b", "z", "-3", "bad", "6"), (None, "z", "1", "2024-02-01", "5")]
    got = by_name(profile(frame(spark, rows), CATALOG, 2, order=[F.col("k").isNull(), F.col("k")]))
    assert [tuple(v) for v in got["t"].top_values] == [("z", 2), (None, 2)]
    assert [tuple(v) for v in got["k"].top_values] == [("a", 2), ("b", 1)]
    assert (got["n"].null_count, got["n"].valid_count, got["n"].parse_success_rate) == (2, 2, 0.5)
    assert (got["n"]["min"], got["n"]["max"], got["n"]["median"]) == (-3.0, 1.0, -1.0)
    assert (got["d"].null_count, got["d"].min_ts, got["d"].max_ts) == (2, "2024-01-01T00:00:00+00:00", "2024-02-01T00:00:00+00:00")
    assert (got["w"].stat_type, got["w"].distinct_count) == ("Char", 2)
    key = got["__FILEKEY__"]
    assert (key.unique_key_count, key.duplicate_key_count) == (3, 1)
    assert [tuple(v) for v in key.top_values] == [("a|<NA>", 2)]


def test_totals_come_with_pages(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id", "id % 7 as m").repartition(6)
    over = {"m": {"filterType": "number", "type": "greaterThan", "filter": 5}}
    none = {"m": {"filterType": "number", "type": "greaterThan", "filter": 50}}
    asked = [(None, 0, 10), (over, 20, 40), (None, 6000, 6010), (none, 0, 10), (None, 3000, 3010), (None, 10, 10)]
    totals = [page(df, model, [{"colId": "m"}], *at, ["id"], 500)[1].collect() for model, *at in asked]
    assert [r[0].row_count for r in totals] == [5000, 714, 5000, 0, 5000, 5000]

    class Rerun(Observation):
        get = {"rows": 9999, "firsts": 7, "parts": 6}

    monkeypatch.setattr(ordering, "Observation", Rerun)
    assert page(df, None, None, 0, 10, ["id"])[1].first().row_count == 5000


@pytest.mark.parametrize("sent", [100_000, 3])
@pytest.mark.parametrize("digests", [None, 7, 1])
def test_keys_of_one_digest_are_told_apart(spark, monkeypatch, sent, digests):
    monkeypatch.setattr(profile_module, "SENT_DIGESTS", sent)
    draw = random.Random(5)
    rows = [(draw.choice([None, "", "a", "b"]), draw.choice([None, "a", "long" * 50]) if i % 3 else f"own{i}") for i in range(200)]
    rows += [("hot", "hot")] * 100
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a string, b string, digest int").repartition(4)
    digest = F.pmod(F.crc32(F.concat_ws("|", "a", "b")), F.lit(digests)) if digests else None
    counts = profile_module.key_counts(df, ["a", "b"], digest)
    expected = Counter(rows)
    others = {(r.k0, r.k1): r.freq for r in counts.others.collect()}
    assert counts.rows == 300 and all(expected[key] == n for key, n in others.items())
    assert {k: n for k, n in others.items() if n > 1} == {k: n for k, n in expected.items() if n > 1}
    assert counts.single + len(others) == len(expected)
    ranked = sorted((-n, *((c is None, c) for c in k)) for k, n in expected.items() if n > 1)[:4]
    shown = [("|".join("<NA>" if c[0] else c[1] for c in k), -n) for n, *k in ranked]
    assert [(r.value, r.freq) for r in profile_module.duplicate_keys(df, ["a", "b"], 4).orderBy("rank").collect()] == shown


def test_keys_that_never_repeat_and_no_rows(spark):
    df = spark.range(50).selectExpr("id as k", "'x' as other")
    counts = profile_module.key_counts(df, ["k"])
    assert (counts.rows, counts.single, counts.others) == (50, 50, None)
    assert profile_module.duplicate_keys(df, ["k"]).collect() == []
    counts = profile_module.key_counts(df.limit(0), ["k"])
    assert (counts.rows, counts.single, counts.others) == (0, 0, None)


def test_no_key_row_when_a_key_column_is_absent(spark):
    catalog = Catalog(("k", "gone"), CATALOG.fields)
    assert "__FILEKEY__" not in by_name(profile(frame(spark, []), catalog, 3))
    assert "__FILEKEY__" not in by_name(profile(frame(spark, []), Catalog((), CATALOG.fields), 3))


STAT = "field_name string, ordinal int, stat_type string, row_count bigint, null_count bigint, parse_success_rate double, min double, max double, mean double, median double, duplicate_key_count bigint"


def quality(spark, rows, fields=(), warned=()):
    stats = spark.createDataFrame(rows, STAT)
    warnings = spark.createDataFrame(list(enumerate(warned, 1)), "rank int, warning string")
    catalogs = Catalog((), tuple(fields)).frame(spark)
    found = [r.finding for r in findings(stats, catalogs, warnings).orderBy("rank").collect()]
    return scorecard(stats, warnings).first(), found


def test_quality_rules(spark):
    score, found = quality(spark, [])
    assert found == ["No major data quality risks detected from quick profile."]
    assert (score.avg_parse_success_pct, score.invalid_parse_pct, score.avg_null_pct) == (100.0, 0.0, 0.0)
    _, found = quality(
        spark,
        [
            ("a", 0, "Num", 10, 4, 0.6, 1.0, 2.0, 1.0, 2.0, None),
            ("b", 1, "Num", 10, 4, 0.6, -1.0, 2000.0, 3.0, 2.0, None),
            ("c", 2, "Num", 10, 4, 0.6, 0.0, 1e9, 5.0, 0.0, None),
            ("e", 3, "Num", 10, 4, 0.6, -9.0, -2.0, -5.0, -5.0, None),
            ("__FILEKEY__", 4, "Key", 10, None, None, None, None, None, None, 0),
        ],
        [Field("a", desc=" "), Field("b", desc="B")],
        ["w"],
    )
    assert found == [
        "Average null ratio exceeds 10%; review missingness patterns.",
        "Type parsing success below 95%; metadata type mismatch likely.",
        "Distribution hint: a appears left-skewed (mean/median gap ratio 0.50).",
        "Outlier hint: b shows wide spread (max/min-style ratio indicator 2,001.00).",
        "1 fields are missing FieldDesc metadata.",
        "w",
    ]


def test_sort_and_page_edges(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, None), (4, "9")], "i int, v string")
    up = [r.i for r in sort_rows(df, [{"colId": "v", "sort": "asc"}], ["i"]).collect()]
    down = [r.i for r in sort_rows(df, [{"colId": "v", "sort": "desc"}], ["i"]).collect()]
    assert (up, down) == ([1, 2, 4, 3], [2, 4, 1, 3])
    rows, total = page(df, None, [{"colId": "v"}], 3, 10, ["i"])
    assert ([(r.record_number, r.i) for r in rows.collect()], total.first().row_count) == ([(4, 3)], 4)
    assert page(df, None, None, 4, 10, ["i"])[0].count() == 0
    deep, _ = page(df, None, [{"colId": "v"}], 1, 3, ["i"], top_rows=1)
    assert sorted((r.record_number, r.i) for r in deep.collect()) == [(2, 2), (3, 4)]


def test_late_rows_need_only_the_first_rows_of_each_partition(spark):
    df = spark.range(5000).selectExpr("id", "(id * 7919) % 5000 as v").repartition(16)
    with many_files(spark):
        got = rows_between(df, [F.col("v").desc(), F.col("id")], 1000, 1100, top_rows=10)
        assert [r.v for r in got.orderBy(RECORD).collect()] == [4999 - i for i in range(1000, 1100)]
        kept = _leading(df, [F.col("v").desc(), F.col("id")], 100)
        assert kept.count() == 1600


def test_record_numbers_over_many_files(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as g").repartition(16)
    with many_files(spark):
        numbered = number_records(df, [F.col("g"), F.col("id")]).collect()
    expected = sorted((r.g, r.id) for r in numbered)
    assert [(r.g, r.id) for r in sorted(numbered, key=lambda r: r[RECORD])] == expected
    assert sorted(r[RECORD] for r in numbered) == list(range(1, 5001))


def test_snapshot_slices_read_few_files(spark, folder):
    with many_files(spark):
        written = write_snapshot(spark.range(1000).repartition(8), [F.col("id")], str(folder / "snap"))
    again = open_snapshot(spark, str(folder / "snap"))
    files = again.starts.orderBy("start").collect()
    assert files == written.starts.orderBy("start").collect() and again.row_count == 1000 and len(files) > 1
    part = again.slice(10, 15)
    assert [r.id for r in part.orderBy("id").collect()] == [10, 11, 12, 13, 14]
    assert len([f for f in part.inputFiles() if "_positions" not in f]) == 1


def test_snapshot_plans_do_not_grow_with_files(spark, folder):
    sizes = []
    for parts in (2, 40):
        rows = spark.range(400).repartition(parts).sortWithinPartitions("id")
        kept = write_snapshot(rows, path=str(folder / f"snap{parts}"))
        assert kept.starts.count() == parts
        assert sorted(r[ORDINAL] for r in kept.frame().collect()) == list(range(1, 401))
        sizes.append(len(kept.frame()._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 20


@pytest.mark.parametrize("appended, renamed", [(False, False), (True, False), (False, True)])
def test_snapshots_of_others(spark, folder, appended, renamed):
    """Folders without a table of positions: several files a task, tasks' numbers that repeat, names without numbers."""
    path = folder / "other"
    spark.range(300).repartition(3).write.option("maxRecordsPerFile", 30).parquet(str(path))
    if appended:
        spark.range(300, 350).repartition(2).write.mode("append").parquet(str(path))
    if renamed:
        for i, file in enumerate(sorted(path.glob("*.parquet"))):
            file.rename(path / f"rows {i:03d}.parquet")
    opened = open_snapshot(spark, str(path))
    rows = 350 if appended else 300
    assert opened.row_count == rows and opened.numbered == (not appended and not renamed)
    found = {r[ORDINAL]: r.id for r in opened.frame().collect()}
    assert sorted(found) == list(range(1, rows + 1)) and sorted(found.values()) == list(range(rows))
    assert {r[ORDINAL]: r.id for r in opened.slice(25, 70).collect()} == {p: found[p] for p in range(26, 71)}


def test_empty_snapshot(spark, folder):
    kept = write_snapshot(spark.range(0), [F.col("id")], str(folder / "none"))
    assert kept.row_count == 0 and kept.frame().collect() == [] and kept.slice(0, 5).collect() == []


def test_guard_fires(spark):
    size = large_result_guard(spark.range(200_001), 50).first()
    assert size.blocked and size.message.startswith("Large result guard active: 200,001 rows x 1 columns. ")
    assert not large_result_guard(spark.range(200_000), 50).first().blocked


def test_typed_columns_with_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double")

    def kept(op, value):
        return apply_grid_filters(df, {"x": {"filterType": "number", "type": op, "filter": value}}).count()

    assert [kept(op, 2) for op in ("greaterThan", "greaterThanOrEqual", "lessThan", "notEqual", "equals")] == [1, 1, 1, 2, 0]
    assert kept("greaterThan", "x") == kept("unknown", 2) == 4


def test_range_texts_and_single_value(spark):
    one = spark.createDataFrame([("5",), ("5.0",), ("bad",)], "x string")
    assert [(r.expression, r.label) for r in measure_ranges(one, "x").collect()] == [("between 5.0 and 5.0", "5 to 5")]
    wide = spark.createDataFrame([("0",), ("2e8",)], "x string")
    first = measure_ranges(wide, "x").orderBy("position").first()
    assert (first.expression, first.label) == ("between 0.0 and 20000000.0", "0 to 20,000,000")
    tiny = spark.createDataFrame([("0",), ("1e-4",)], "x string")
    assert measure_ranges(tiny, "x").orderBy("position").first().expression == "between 0.0 and 1e-05"
    huge = spark.createDataFrame([("0",), ("1e17",)], "x string")
    assert measure_ranges(huge, "x").orderBy("position").first().expression == "between 0.0 and 1e+16"


def test_histogram_bins_are_half_open(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 1.5, 9.0, 10.0)] + [("b", 3.0)], "g string, x double")
    rows = {(r.dimension, r.bin): r["count"] for r in chart_data(df, "histogram", "g", "x").collect()}
    assert rows == {("a", 0): 1, ("a", 1): 2, ("a", 9): 2, ("b", 3): 1}
    same = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, x double")
    assert [(r.bin, r["count"]) for r in chart_data(same, "histogram", "g", "x").collect()] == [(0, 2)]


@pytest.mark.parametrize("top_rows", [5, 40])
def test_late_pages_lie_in_counted_ranges(spark, top_rows):
    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    rows = [(pick("a", "b", "B", None, "", "hot", "hot", "hot"), pick(None, 1.5, float("nan"), float("inf"), rng.random()), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(6)
    last = lambda value: (value is None, value or "")
    for model, key in (
        ([{"colId": "g", "sort": "desc"}], lambda r: (r[0] is None, [-ord(c) for c in (r[0] or "")] + [1], r[2])),
        ([{"colId": "g"}, {"colId": "id", "sort": "desc"}], lambda r: (last(r[0]), [-ord(c) for c in str(r[2])] + [1])),
    ):
        expected = sorted(rows, key=key)
        for start, stop in ((0, 900), (333, 360), (700, 1200), (895, 900), (899, 950)):
            got = rows_between(df, sort_order(df, model, ["id"]), start, stop, top_rows=top_rows).collect()
            assert sorted((r.record_number, r.id) for r in got) == [(k + 1, expected[k][2]) for k in range(start, min(stop, 900))]
        assert rows_between(df, sort_order(df, model, ["id"]), 900, 950, top_rows=top_rows).collect() == []
    # Numbers that are none sort as the largest, nulls behind them.
    number = lambda r: (r[1] is None, math.isnan(r[1] or 0), r[1] if r[1] is not None and not math.isnan(r[1]) else 0.0, r[2])
    order = row_order(df, ["v", "id"])
    got = rows_between(df, order, 500, 640, top_rows=top_rows).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.record_number)] == [r[2] for r in sorted(rows, key=number)[500:640]]


def test_late_page_of_equal_rows(spark):
    df = spark.range(600).selectExpr("1 as a", "'x' as b").repartition(4)
    assert rows_between(df, row_order(df), 500, 520, top_rows=10).count() == 20
    empty = df.limit(0)
    assert rows_between(empty, row_order(empty), 500, 520, top_rows=10).collect() == []


def test_late_page_stores_only_what_it_needs(spark, folder, monkeypatch):
    """The ranges' counts and the page with the ranges around it, and not the rows before them."""
    df = spark.range(50_000).selectExpr("id", "cast(id * 7919 % 50000 as string) as t", "repeat('x', 200) as wide").repartition(8)
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(folder))
    got = rows_between(df, row_order(df, ["t"]), 49_000, 49_010, top_rows=100).collect()
    assert [r.t for r in sorted(got, key=lambda r: r.record_number)] == sorted((str(k) for k in range(50_000)))[49_000:49_010]
    assert sum(f.stat().st_size for f in folder.rglob("*.parquet")) < 200_000


def leading_by_hand(values, top_n):
    counted = Counter(values)
    ranked = sorted(counted.items(), key=lambda item: (-item[1], item[0] is None, (item[0] or "").encode()))
    return [{"value": v, "freq": n} for v, n in ranked[:top_n]], len([v for v in counted if v is not None])


@pytest.mark.parametrize("sent, ranks", [(100_000, 1000), (3, 1000), (100_000, 2), (0, 0)])
def test_long_texts_that_start_alike(spark, monkeypatch, sent, ranks):
    monkeypatch.setattr(profile_module, "SENT_DIGESTS", sent)
    monkeypatch.setattr(profile_module, "TASK_RANKS", ranks)
    start = "\N{GRINNING FACE}é" * 32
    values = [start + f"{i % 40:02d}" * 500 for i in range(100)] + [start] * 3 + [start[:-1]] * 2 + [None] * 3 + ["", "x" * 64, "x" * 65]
    df = spark.createDataFrame([(v, "same") for v in values], "value string, digest string").repartition(5)
    catalog = Catalog((), (Field("value"), Field("digest")))
    for top_n in (1, 7, 60):
        found = {r.field_name: r for r in profile(df, catalog, top_n).collect()}
        expected, distinct = leading_by_hand(values, top_n)
        assert [r.asDict() for r in found["value"].top_values] == expected
        assert (found["value"].row_count, found["value"].null_count, found["value"].distinct_count) == (len(values), 3, distinct)
        assert [r.asDict() for r in found["digest"].top_values] == [{"value": "same", "freq": len(values)}]

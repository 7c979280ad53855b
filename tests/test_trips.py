"""Six taxi trips with a missing key, a repeated one, an unreadable date and fare, from file to outputs."""

import json

import pytest

from tabulant.columns import ORDINAL
from tabulant.functions.casts import NANOSECOND_CLOCK, NUMBER_COMPANION, instant
from tabulant.functions.display import display_measures
from tabulant.operators.charts import chart_data
from tabulant.operators.filters import apply_filters, apply_value_and_range_filters, drill_through
from tabulant.operators.options import dimension_values, measure_ranges
from tabulant.operators.ordering import page_after
from tabulant.operators.profile import profile
from tabulant.operators.quality import findings, scorecard
from tabulant.plans.analysis import analyse, recommended_kind
from tabulant.plans.load import load_and_profile
from tabulant.plans.view import View, ViewSpec, fetch_page
from tabulant.sinks.exports import profile_payload, write_csv, write_tsv_of_frame, write_tsv_of_view
from tabulant.sources.delimited import read_delimited

ROWS = (
    ("A7", "Harbour", "12.25", "2021-03-05"),
    ("B2", "Old Town", "-4", "2021-03-07"),
    ("C9", "Harbour", "30", "soon"),
    ("", "Airport", "8.5", "2021-03-06"),
    ("B2", "Old Town", "-4", "2021-03-07"),
    ("D1", "", "oops", "2021-03-09"),
)
FIELDS = {
    "trip": ("Char", "Trip number", "D"),
    "zone": ("Char", "Where it began", "D"),
    "fare": ("Num", "Price paid", "M"),
    "day": ("Date", "Day of the trip", "D"),
}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("trips")
    lines = [",".join(FIELDS), *map(",".join, ROWS)]
    (folder / "trips.csv").write_text("\n".join(lines) + "\n")
    declared = [f"FieldName|{n}\nFieldType|{t}\nFieldDesc|{d}\nFieldDType|{r}" for n, (t, d, r) in FIELDS.items()]
    (folder / "trips.csv_Meta").write_text("\n".join(["FileKey|trip", *declared]) + "\n")
    return str(folder / "trips.csv")


@pytest.fixture(scope="module")
def trips(spark, path):
    return load_and_profile(spark, path, top_n=5)


@pytest.fixture(scope="module")
def unstored(spark, path):
    return read_delimited(spark, path)


def keyed(df):
    return {r.field_name: r for r in df.collect()}


def test_load(trips, unstored):
    assert trips.catalog.keys == ("trip",)
    assert [(f.name, f.kind, f.role) for f in trips.catalog.fields] == [(n, t, r) for n, (t, _, r) in FIELDS.items()]
    assert trips.sort_status == "Sorted by primary key: trip"
    assert unstored.columns == [*FIELDS, ORDINAL]
    assert [r.trip for r in trips.rows.orderBy(ORDINAL).collect()] == ["A7", "B2", "B2", "C9", "D1", None]


@pytest.mark.parametrize("from_store", [True, False])
def test_profile(trips, unstored, from_store):
    found = keyed(trips.profile if from_store else profile(unstored, trips.catalog, 5))
    fare = found["fare"]
    assert (fare.row_count, fare.null_count, fare.valid_count) == (6, 1, 5)
    assert fare.parse_success_rate == pytest.approx(5 / 6)
    assert (fare["min"], fare["max"], fare["sum"], fare["median"]) == (-4.0, 30.0, 42.75, 8.5)
    assert fare["mean"] == pytest.approx(8.55)
    zone = found["zone"]
    assert (zone.null_count, zone.distinct_count) == (1, 3)
    assert [tuple(v) for v in zone.top_values] == [("Harbour", 2), ("Old Town", 2), ("Airport", 1), (None, 1)]
    day = found["day"]
    assert (day.valid_count, day.min_ts, day.max_ts) == (5, "2021-03-05T00:00:00+00:00", "2021-03-09T00:00:00+00:00")
    key = found["__FILEKEY__"]
    assert (key.row_count, key.unique_key_count, key.duplicate_key_count) == (6, 5, 1)
    assert [tuple(v) for v in key.top_values] == [("B2", 2)]


def test_dates_beyond_a_nanosecond_clock(spark):
    rows = spark.sql("SELECT '9999-12-31' AS t, DATE'9999-12-31' AS d, TIMESTAMP_NTZ'1600-01-01 00:00:00' AS n")
    kept = rows.select(*(instant(rows, c).cast("string") for c in ("t", "d", "n"))).first()
    assert tuple(kept) == ("9999-12-31 00:00:00", "9999-12-31 00:00:00", "1600-01-01 00:00:00")
    assert tuple(rows.select(*(instant(rows, c, bounds=NANOSECOND_CLOCK) for c in ("t", "d", "n"))).first()) == (None,) * 3


def test_quality(spark, trips):
    score = trips.scorecard.first()
    assert (score.avg_parse_success_pct, score.invalid_parse_pct) == (91.67, 8.33)
    assert (score.avg_null_pct, score.duplicate_pk_pct, score.duplicate_key_count) == (16.67, 16.67, 1)
    rules = ["duplicate_keys", "missingness", "parse_success", "outlier"]
    assert [r.rule for r in trips.findings.orderBy("rank").collect()] == rules
    warned = spark.createDataFrame([(i, f"warning {i}") for i in range(1, 41)], "rank int, warning string")
    declared = trips.catalog.frame(spark)
    assert findings(trips.profile, declared, warned).count() == 44
    some = findings(trips.profile, declared, warned, most=6, most_warnings=30).orderBy("rank").collect()
    assert [r.finding for r in some][-2:] == ["warning 1", "warning 2"]
    assert scorecard(trips.profile, warned).first().schema_warning_count == 40


def test_filters(trips, unstored):
    for rows in (unstored, trips.rows):
        kept = lambda dims, measures, rows=rows, **how: apply_filters(rows, trips.catalog, dims, measures, **how).count()
        assert kept({"zone": "^h|port"}, {}) == 3
        assert kept({}, {"fare": "between -4 and 9"}) == 3
        assert kept({"zone": "h.r"}, {"fare": ">20"}) == 1
        assert kept({"zone": "h.r"}, {}, literal=True) == 0
        assert kept({}, {"fare": "cheap"}) == 6
        with pytest.raises(ValueError):
            kept({}, {"fare": "cheap"}, strict=True)
        both = apply_value_and_range_filters(rows, trips.catalog, [("zone", ["Airport", "Old Town"])], [("fare", [(0.0, 9.0)])])
        assert both.count() == 1
        clicked, status = drill_through(rows, "zone", {"label": "Airport"})
        assert (clicked.count(), status) == (1, "Chart click filter applied: zone = Airport")
        assert drill_through(rows, None, {"x": 1})[1] == ""


def test_stored_measures_reach_the_scan(trips):
    plan = apply_filters(trips.snapshot.table(), trips.catalog, {}, {"fare": ">=9"})._jdf.queryExecution().toString()
    name = NUMBER_COMPANION + "fare"
    assert f"PushedFilters: [IsNotNull({name}), GreaterThanOrEqual({name},9.0)]" in plan


def test_view(trips, folder):
    spec = ViewSpec(preview_rows=2, dimension_rows=[("zone", ["Harbour"])], alphabetical=True, visible=["fare", "trip"])
    view = View(trips.rows, trips.catalog, spec)
    assert view.rows.columns == ["day", "fare", "trip", "zone"]
    assert [tuple(r) for r in view.preview().collect()] == [("12.2500", "A7"), ("30", "C9")]
    size = view.counts().first()
    assert (size.total_rows, size.total_columns, size.blocked, size.message) == (2, 4, False, None)
    rows, total = fetch_page(view.snapshot(), start=1, end=5)
    assert (total, [(r.record_number, r.trip) for r in rows.collect()]) == (2, [(2, "C9")])
    view.export_csv(str(folder / "out"), single_file=True)
    (part,) = (folder / "out").glob("part-*")
    assert part.read_text().splitlines() == ["day,fare,trip,zone", "2021-03-05,12.25,A7,Harbour", "soon,30,C9,Harbour"]


def test_pages_of_a_stored_view(trips):
    rows, total = fetch_page(trips.snapshot, start=3, end=5)
    assert total == 6
    assert [(r.record_number, r.trip) for r in rows.orderBy("record_number").collect()] == [(4, "C9"), (5, "D1")]
    model = {"zone": {"filterType": "text", "type": "startsWith", "filter": "o"}}
    rows, total = fetch_page(trips.snapshot, model, [{"colId": "fare", "sort": "desc"}], 1, 2)
    assert total.first().row_count == 2
    assert [(r.record_number, r.fare) for r in rows.collect()] == [(2, "-4")]
    assert fetch_page(trips.snapshot, model, None, 10, 20)[0].count() == 0
    assert fetch_page(trips.snapshot, start=10, end=20)[0].count() == 0
    after = page_after(trips.rows, [{"colId": "zone"}], {"zone": "Harbour", ORDINAL: 1}, 10)
    assert [r.trip for r in after.collect()] == ["C9", "B2", "B2", "D1"]


def test_text_outputs(trips, folder):
    write_tsv_of_view(trips.rows, str(folder / "v"), ["fare", "zone"])
    text = "".join(p.read_text() for p in sorted((folder / "v").glob("part-*")))
    lines = ["FARE\tZONE", "12.25\tHarbour", "-4\tOld Town", "-4\tOld Town", "30\tHarbour", "oops\t", "8.5\tAirport"]
    assert text.splitlines() == lines
    write_tsv_of_view(trips.rows, str(folder / "none"), [])
    assert "".join(p.read_text() for p in (folder / "none").glob("part-*")) == ""
    write_tsv_of_frame(trips.rows.coalesce(1), str(folder / "f"), ["nothing"])
    text = "".join(p.read_text() for p in sorted((folder / "f").glob("part-*")))
    assert text.splitlines()[0] == "TRIP\tZONE\tFARE\tDAY"


def test_csv_quoting_and_nulls(spark, folder):
    rows = spark.createDataFrame([(7, 'a "b" c', " x "), (8, "p,q", None), (9, "up\ndown", "")], "k int, a string, b string")
    write_csv(rows, str(folder / "q"), single_file=True)
    (part,) = (folder / "q").glob("part-*")
    assert part.read_text() == 'k,a,b\n7,"a ""b"" c", x \n8,"p,q",\n9,"up\ndown",\n'


def test_payload(trips):
    got = {r.field_name: json.loads(r.payload) for r in profile_payload(trips.profile).collect()}
    assert set(got["fare"]["metrics"]) == {"row_count", "null_count", "valid_count", "parse_success_rate", "min", "max", "sum", "mean", "median"}
    assert got["fare"]["metrics"]["sum"] == 42.75
    assert got["zone"]["metrics"] == {"row_count": 6, "null_count": 1, "distinct_count": 3}
    assert got["zone"]["top_values"][0] == {"value": "Harbour", "freq": 2}
    assert got["day"]["metrics"]["max"] == "2021-03-09T00:00:00+00:00"
    assert got["__FILEKEY__"]["metrics"]["unique_key_count"] == 5


def test_analysis(trips):
    kinds = [recommended_kind(trips.catalog, a, b) for a, b in (("day", "fare"), ("zone", "fare"), ("zone", "zone"))]
    assert kinds == ["Line", "Bar", "Pie"]
    a = analyse(trips.rows, trips.catalog, trips.profile, trips.scorecard, trips.findings, "zone", "fare")
    assert [tuple(r) for r in a.chart.collect()] == [("Airport", 8.5), ("Harbour", 42.25), ("Old Town", -8.0)]
    stats = {r.label: r for r in a.stats.collect()}
    assert stats["FARE [Price paid]"]["mean"] == "8.5500"
    assert [tuple(v) for v in stats["ZONE [Where it began]"].top_values][:1] == [("Harbour", "2")]
    assert ("Duplicate Pk Pct", "16.6700%") in [tuple(r) for r in a.scorecard.collect()]


def test_options_and_charts(trips):
    assert [r.value for r in dimension_values(trips.rows, "zone").collect()] == ["Airport", "Harbour", "Old Town"]
    assert [r.value for r in dimension_values(trips.rows, "zone", 1).collect()] == ["Airport"]
    ranges = measure_ranges(trips.rows, "fare", 4).orderBy("position").collect()
    assert [(r.low, r.high) for r in ranges] == [(-4.0, 4.5), (4.5, 13.0), (13.0, 21.5), (21.5, 30.0)]
    assert (ranges[0].expression, ranges[0].label) == ("between -4.0 and 4.5", "-4 to 4.5000")
    assert dimension_values(trips.rows, "none").count() == measure_ranges(trips.rows, "none").count() == 0
    line = chart_data(trips.rows, "line", "day", "fare").collect()
    assert [r.measure for r in line] == [12.25, -4.0, -4.0, 30.0, 8.5]
    for kind, message in (("cloud", "Unsupported"), ("scatter", "second dimension"), ("stacked bar", "second dimension")):
        with pytest.raises(ValueError, match=message):
            chart_data(trips.rows, kind, "zone", "fare")
    shown = display_measures(trips.rows.select("trip", "fare"), trips.catalog)
    assert [tuple(r) for r in shown.where("trip = 'A7'").collect()] == [("A7", "12.2500")]


def test_infinite_values(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in ("1", "2", "3", "inf", "-inf")], "k string, v double")
    bins = chart_data(rows, "histogram", "k", "v", bins=2).orderBy("bin").collect()
    assert [(r.bin, r["count"]) for r in bins] == [(-1, 1), (0, 1), (1, 2), (2, 1)]
    assert [(r.bin_low, r.bin_high) for r in bins] == [(-float("inf"),) * 2, (1.0, 2.0), (2.0, 3.0), (float("inf"),) * 2]
    assert [(r.low, r.high) for r in measure_ranges(rows, "v", 1).collect()] == [(1.0, 3.0)]

"""Grid, filters, point-in-time records, cross-section and files, by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import cross as C
from tessera.operators import filters as L
from tessera.operators import grid as G
from tessera.operators import pit as P
from tessera.sources import etl, files

D = [dt.date(2024, 1, i) for i in range(1, 11)]


@pytest.fixture(scope="module")
def panel(spark):
    cal = G.with_positions(spark.createDataFrame([(d,) for d in D], "datetime date"))
    rows = [("A", D[i], float(10 + i), 1.0 if i < 3 else 2.0) for i in (0, 1, 3, 4)] + [("B", D[i], 5.0, 1.0) for i in range(2, 6)]
    daily = spark.createDataFrame(rows, "instrument string, datetime date, close double, factor double").withColumn("open", F.col("close")).withColumn("volume", F.lit(1.0))
    spans = spark.createDataFrame([("m", "A", D[0], D[1]), ("m", "A", D[1], D[4]), ("m", "B", D[4], D[4]), ("st", "A", D[1], D[1])], "market string, instrument string, start date, end date")
    basic = spark.createDataFrame([("A", D[0], None), ("B", D[2], D[5])], "instrument string, list_date date, delist_date date")
    return G.Panel(cal, daily, spans, basic)


def values(df, code="A"):
    return [r[2] for r in df.where(F.col("instrument") == code).orderBy("datetime").collect()]


def test_windows_count_calendar_rows(panel):
    assert values(panel.features({"v": "Mean($close, 2)"}))[:6] == [10, 10.5, 11, 13, 13.5, 14]
    assert values(panel.features({"v": "Ref($close, 1)"}))[:5] == [None, 10, 11, None, 13]


def test_adjustment(panel):
    assert values(panel.with_adjust("hfq").features({"v": "$close"}))[:5] == [10, 11, None, 26, 28]
    assert values(panel.with_adjust("qfq").features({"v": "$close"}))[:5] == [5, 5.5, None, 13, 14]
    assert values(panel.with_adjust("qfq", D[1]).features({"v": "$close"}))[:2] == [10, 11]
    assert values(G.causal_qfq(panel, {"v": "Ref($close, 1)"}))[:5] == [None, 10, 11, None, 13]
    assert values(G.causal_qfq(panel, {"v": "Mean($close, 3) * ($close > 5)"}))[3] == pytest.approx((5.5 + 13) / 2)
    with pytest.raises(ValueError):
        panel.with_adjust("x")


def test_universe_is_applied_to_the_output_only(panel):
    got = panel.features({"v": "Mean($close, 0)"}, panel.universe("m"), D[3], D[4])
    assert values(got) == [pytest.approx(34 / 3), pytest.approx(12)]
    assert panel.universe("m").count() == 6
    with pytest.raises(KeyError):
        panel.universe(["A", "nobody"])
    with pytest.raises(ValueError):
        G.between(panel.calendar, D[2], D[1])
    assert sorted((r.instrument, r.start, r.end) for r in G.spans(panel.universe("m")).collect()) == [("A", D[0], D[4]), ("B", D[4], D[4])]


def test_filters(panel):
    u = panel.universe("m")
    cells = lambda f: sorted((r.instrument, r.datetime.day) for r in L.make_filter(f).apply(panel, u).collect())
    assert cells(L.STFilter()) == [("A", 1), ("A", 3), ("A", 4), ("A", 5), ("B", 5)]
    assert cells(~L.STFilter() | L.NameDFilter("B")) == [("A", 2), ("B", 5)]
    assert cells({"filter_type": "ExpressionFilter", "kwargs": {"expression": "$close > 10"}}) == [("A", 2), ("A", 4), ("A", 5)]
    assert cells(L.ListingDaysFilter(3)) == [("A", 4), ("A", 5)]
    assert cells(L.ListingDaysFilter(2, 3, True)) == [("A", 3), ("A", 4), ("B", 5)]
    with pytest.raises(ValueError):
        L.make_filter({"filter_type": "nothing"})
    with pytest.raises(ValueError):
        L.ExpressionFilter("Ref($close, -1)")


@pytest.fixture(scope="module")
def records(spark):
    rows = [("A", "f", D[1], 202301, 1.0), ("A", "f", D[3], 202302, 2.0), ("A", "f", D[4], 202301, 9.0), ("A", "f", D[6], 202304, 4.0), ("A", "f", D[8], 202304, math.nan)]
    return spark.createDataFrame(rows, "instrument string, field string, ann_date date, period int, value double")


def test_projections(panel, records):
    grid = panel.dense("close").where("instrument = 'A'")
    got = lambda text: [r.v for r in P.project(records, grid, {"v": text}).orderBy("datetime").collect()]
    assert got("P($$f)") == [None, 1, 1, 2, 2, 2, 4, 4, None, None]
    assert got("PRef($$f, -1)") == [None, None, None, 1, 9, 9, None, None, None, None]
    assert got("P(Mean($$f, 2))") == [None, 1, 1, 1.5, 5.5, 5.5, 4, 4, None, None]
    assert got("$close / $$f")[3] == 6.5


def test_records(records):
    snap = {r.period: r.f for r in P.snapshot(records, ["f"], D[8], [202301, 202303, 202304]).collect()}
    assert snap[202301] == 9 and snap[202303] is None and math.isnan(snap[202304])
    more = records.limit(1).withColumn("value", F.lit(5.0)).withColumn("seq", F.lit(1).cast("long"))
    assert {(r.period, r.ann_date): r.value for r in P.write(records, more).collect()}[202301, D[1]] == 5
    with pytest.raises(Exception, match="not a record"):
        P.write(None, more.withColumn("period", F.lit(202305))).collect()
    assert P.resolve(["a.eps", "b.roe"], "eps") == "a.eps"
    with pytest.raises(KeyError):
        P.resolve(["a.eps", "b.eps"], "eps")


def test_preprocessing(spark):
    rows = [(c, D[0], float(v), float(cap), i) for c, v, cap, i in zip("abcdef", (1, 2, 3, 4, 100, 6), (1, 2, 4, 8, 16, 32), "xxxyyy")] + [("a", D[1], 1.0, 1.0, "x"), ("b", D[1], 1.0, 2.0, "x")]
    d = spark.createDataFrame(rows, "instrument string, datetime date, v double, cap double, industry string")
    z = {(r.instrument, r.datetime): r.v for r in C.standardize(d, ["v"]).collect()}
    assert z["a", D[1]] == 0 and sum(v for (c, t), v in z.items() if t == D[0]) == pytest.approx(0)
    w = {r.instrument: r.v for r in C.winsorize(d, ["v"], "mad").where(F.col("datetime") == F.lit(D[0])).collect()}
    assert w["a"] == 1 and w["e"] == pytest.approx(3.5 + 3 * 1.4826 * 2)  # deviations 2.5 1.5 .5 .5 96.5 2.5
    n = {(r.instrument, r.datetime): r.v for r in C.neutralize(d, ["v"]).collect()}
    for names in ("abc", "def"):
        assert sum(n[c, D[0]] for c in names) == pytest.approx(0)
    assert sum(n[c, D[0]] * math.log(r[3]) for c, r in zip("abcdef", rows)) == pytest.approx(0)
    assert n["a", D[1]] is None
    with pytest.raises(Exception, match="unique"):
        C.validate_panel(d.select("instrument", "datetime", "v").unionByName(d.select("instrument", "datetime", "v"))).collect()


def test_evaluation(spark):
    rows = [("f", 1, D[t], c, float(v), None if y is None else float(y)) for t in (0, 1) for c, v, y in zip("abcde", (1, 2, 2, 4, 5), (1, 2, 2, 3, None))]
    d = spark.createDataFrame(rows, "factor string, horizon int, datetime date, instrument string, value double, label double")
    i = C.information(d).collect()
    assert all(r.rank_ic == pytest.approx(1) and 0.9 < r.ic < 1 for r in i)
    ls = C.long_short(d, 0.4).collect()[0]
    assert ls.long_short_return == pytest.approx((3 - 1.5) / 2) and ls.universe_return == 2
    q = C.quantiles(d.drop("horizon", "label"), 4)
    assert sorted((r.instrument, r.quantile) for r in q.where(F.col("datetime") == F.lit(D[0])).collect()) == [("a", 1), ("b", 2), ("c", 2), ("d", 3), ("e", 4)]
    assert {r.turnover for r in C.turnover(q).collect()} == {0.0, None}


def test_files(spark, panel, tmp_path):
    root = f"{tmp_path}/features"
    files.write_bin(panel.daily, panel.calendar, root, "close")
    back = files.read_bin(spark, panel.calendar, f"file://{root}", "close")
    got = {(r.instrument, r.datetime): r.close for r in back.where("close is not null").collect()}
    assert got == {(r.instrument, r.datetime): r.close for r in panel.daily.collect()}
    (tmp_path / "day.txt").write_text("2024-01-01\n2024-01-02\n")
    assert files.read_calendar(spark, f"{tmp_path}/day.txt").count() == 2
    (tmp_path / "m.txt").write_text("a 2024-01-01 2024-01-03\nb 2024-01-05 2024-01-04\n")
    spans = files.read_intervals(spark, f"{tmp_path}/m.txt", "m")
    assert spans.where("instrument = 'A'").head().end == D[2]
    with pytest.raises(Exception, match="not an interval"):
        spans.collect()
    for bad in ("../x", "a/../b", "a b"):
        with pytest.raises(ValueError):
            files.safe_path(bad)


def test_building(spark):
    d = spark.createDataFrame([("A", D[0], 2.0, 1.0), ("B", D[0], 1.0, 2.0)], "instrument string, datetime date, up_limit double, down_limit double")
    with pytest.raises(Exception, match="limits cross"):
        etl.validate_limits(d).collect()
    with pytest.raises(Exception, match="repeated key"):
        etl.require_unique(d.unionByName(d), ["instrument", "datetime"], "limits").collect()
    spans = spark.createDataFrame([("A", "x", D[0], D[4]), ("A", "x", D[5], dt.date(2099, 12, 31)), ("A", "y", D[7], D[8])], "instrument string, industry string, start date, end date")
    cal = G.with_positions(spark.createDataFrame([(x,) for x in D], "datetime date"))
    got = etl.coalesce_intervals(spans.where("industry = 'x'"), cal, ["instrument", "industry"]).collect()
    assert [(r.start, r.end) for r in got] == [(D[0], dt.date(2099, 12, 31))]
    assert [(r.industry, r.start) for r in etl.overlaps(spans).collect()] == [("y", D[7])]

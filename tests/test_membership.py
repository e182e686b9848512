import datetime as dt
import random

import pytest

from tessera.operators import cross, grid, portfolio
from tessera.sources import etl

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]
SPANS = "instrument string, industry string, start date, end date"


@pytest.fixture(scope="module")
def cal(spark):
    return grid.with_positions(spark.createDataFrame([(x,) for x in D], "datetime date"))


def test_overlaps_equal_pairs(spark):
    r = random.Random(3)
    rows = []
    for code in "abcdefgh":
        for _ in range(r.randint(1, 14)):
            a = r.randint(0, 11)
            rows.append((code, r.choice("xyz"), D[a], D[r.randint(a, min(11, a + 4))]))
    want = []
    for code in "abcdefgh":
        mine = sorted((x for x in rows if x[0] == code), key=lambda x: (x[2], x[3], x[1]))
        want += [x for i, x in enumerate(mine) if any(y[1] != x[1] and y[3] >= x[2] for y in mine[:i])]
    got = [tuple(x) for x in etl.overlaps(spark.createDataFrame(rows, SPANS).repartition(3)).select("instrument", "industry", "start", "end").collect()]
    assert sorted(got) == sorted(want) and 10 < len(want) < len(rows)


def test_industry_of_a_day(spark, cal):
    rows = spark.createDataFrame([("A", D[1], 1.0), ("A", D[5], 2.0), ("B", D[1], 3.0)], "instrument string, datetime date, v double")
    spans = spark.createDataFrame([("A", "x", D[0], D[3]), ("A", "y", D[3], D[4])], SPANS)
    got = {(r.instrument, r.datetime): r.industry for r in cross.with_industry(rows, spans, cal).collect()}
    assert got == {("A", D[1]): "x", ("A", D[5]): None, ("B", D[1]): None}
    both = spark.createDataFrame([("A", D[3], 1.0)], "instrument string, datetime date, v double")
    with pytest.raises(Exception, match="two industries of A"):
        cross.with_industry(both, spans, cal).collect()
    with pytest.raises(ValueError):
        cross.with_industry(rows, spans.limit(0), cal)


def test_industry_intervals(spark, cal):
    raw = "instrument string, industry string, in_date date, out_date date"
    basic = spark.createDataFrame([("A", D[2], None), ("B", D[0], D[6])], "instrument string, list_date date, delist_date date")
    rows = [("A", "x", D[0], D[4]), ("A", "y", D[5], None), ("B", "x", D[1], D[3]), ("B", "x", D[4], None), ("C", "x", D[0], None)]
    got = etl.industry_intervals(spark.createDataFrame(rows, raw), basic, cal)
    assert sorted(tuple(r) for r in got.collect()) == [("x", "A", D[2], D[4]), ("x", "B", D[1], D[5]), ("y", "A", D[5], D[11])]
    with pytest.raises(Exception, match="two industries at once"):
        etl.industry_intervals(spark.createDataFrame([*rows, ("A", "z", D[3], D[3])], raw), basic, cal).collect()


def test_aligned_and_scores(spark, cal):
    k = "instrument string, datetime date, "
    pred = spark.createDataFrame([("A", D[0], 1.0), ("A", D[1], float("inf"))], k + "pred double")
    label = spark.createDataFrame([("A", D[1], 2.0), ("A", D[2], 3.0)], k + "label double")
    assert sorted(tuple(r)[1:] for r in cross.aligned(pred, label).collect()) == [(D[0], 1.0, None), (D[1], None, 2.0), (D[2], None, 3.0)]
    universe = spark.createDataFrame([("A", D[0]), ("A", D[0])], k.rstrip(", "))
    score = lambda rows: portfolio.signal_scores(spark.createDataFrame(rows, k + "score double"), universe, cal)
    assert sorted(tuple(r) for r in score([("A", D[0], 1.0), ("A", D[1], 2.0)]).collect()) == [("A", D[0], 1.0), ("A", D[1], None)]
    with pytest.raises(Exception, match="repeats"):
        score([("A", D[0], 1.0), ("A", D[0], 2.0)]).collect()
    with pytest.raises(Exception, match="no trading day"):
        score([("A", dt.date(2023, 1, 1), 1.0)]).collect()


def test_analysis_and_saving(spark, sf, tmp_path):
    from tessera.plans.catalog import queries
    from tessera.sources.driver import events_panel

    tables = cross.factor_analysis(events_panel(spark, sf), {"m": "Mean($close, 3)"}, horizons=(1,), prepare=cross.standardize)
    assert {"daily", "summary", "turnover"} <= tables.keys() and tables["summary"].count() == 1
    from tessera.operators.portfolio import report, save, simulate
    from tessera.plans import portfolio as plans

    rows = simulate(plans.bars(spark, sf), portfolio.topk_weights(plans.scores(spark, sf), 5, 5).selectExpr("'a' AS run", "*"), portfolio.Exchange()).persist()
    save(rows, report(rows), str(tmp_path))
    for name in ("report", "positions", "trades", "orders", "metrics"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/{name}").count() > 0, name
    rows.unpersist()
    assert "signal_scores" in queries()

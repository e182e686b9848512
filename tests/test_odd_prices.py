"""Queries over events some of which have a value of zero, against their SQL."""

import datetime as dt
import math
import random

import duckdb
import pytest

from tessera.plans import catalog


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """30 users on 12 days; single events of zero, two in a row of user 3, and days that begin or end with one."""
    r = random.Random(11)
    path = tmp_path_factory.mktemp("odd")
    rows = []

    def put(user, day, value, kind="click"):
        at = dt.datetime(2024, 1, day, r.randint(0, 23), r.randint(0, 59), r.randint(0, 59))
        rows.append((len(rows), at, user, kind, float(value)))

    single = {(3, 5): 0, (3, 6): 0, (7, 8): 0, (12, 6): 0, (26, 3): 0}
    for user in range(30):
        for day in range(1, 13):
            if (user, day) in single:
                put(user, day, single[user, day])
                continue
            for _ in range(r.randint(0 if user % 5 else 1, 3)):
                put(user, day, r.randint(1, 9000) / 100, r.choice(("click", "error", "view")))
    rows += [(len(rows), dt.datetime(2024, 1, 9), 14, "view", 0.0), (len(rows) + 1, dt.datetime(2024, 1, 10, 23, 59, 59), 21, "view", 0.0), (len(rows) + 2, dt.datetime(2024, 1, 10, 23, 59, 59), 20, "view", 0.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    customers = [(u, f"c{u}", ("BUILDING", "MACHINERY")[u % 2], float(r.randint(-900, 9000))) for u in range(30)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return str(path), con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 3) + 0.0
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def same(spark, odd, name):
    path, con = odd
    got = catalog.queries()[name](spark, path)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    ours, theirs = rows(got.columns, got.collect()), rows(names, rel.fetchall())
    assert sorted(got.columns) == sorted(names) and len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.01e-3) for x, y in zip(a, b)), (a, b)
    return ours


def test_drawdown(spark, odd):
    assert any("NaN" in r for r in same(spark, odd, "drawdown"))


def test_risk_analysis(spark, odd):
    assert "NaN" in same(spark, odd, "risk_analysis")[0]


#: Of labels whose prices are zero, and of limits of zero.
LABELS = ("box_summary", "coverage", "cumulative_gaps", "factor_summary", "forward_returns", "ic", "kde", "long_short_alpha", "long_short_return", "monthly_ic", "net_fee_transform", "performance_metrics")
LIMITS = ("limits_by_daily_join", "limits_validate")
SHARED = ("pred_label_outer", "rank_ic", "rolling_ic", "quantile_returns", "sector_ic", "sector_rank_ic", "sector_quantiles", "risk_sampling", "long_short_precision")


@pytest.mark.parametrize("name", (*LABELS, *LIMITS, *SHARED))
def test_zero_prices(spark, odd, name):
    same(spark, odd, name)


def test_operators_leave_zero_prices_out(spark, odd):
    """By default, as queries without SQL do."""
    import json

    from tessera.operators import cross as C
    from tessera.sources.driver import events_panel

    d = C.forward_returns(events_panel(spark, odd[0]), [1])
    assert d.where("return_1 is not null").count() > 100 and d.where("return_1 <= -1 or isnan(return_1) or return_1 = double('inf')").isEmpty()
    for name in ("performance_p_value", "normal_points", "histogram"):
        values = [v for r in catalog.queries()[name](spark, odd[0]).collect() for v in r if isinstance(v, float)]
        assert values and all(map(math.isfinite, values))
    report = json.loads(catalog.queries()["report_payload"](spark, odd[0]).collect()[0].payload)
    assert all(r["ic_mean"] is not None for r in report["summary"])

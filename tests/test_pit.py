"""Queries of point-in-time records over a small orders table, by hand."""

import datetime as dt
import random

import pytest

from tessera.plans import catalog

ASOF = dt.date(1997, 6, 30)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    r = random.Random(4)
    rows = [(k, r.choice((1, 399, 400, 1499)), r.choice("FOP"), float(r.randint(1, 9999)), dt.datetime(1996, 1, 1) + dt.timedelta(r.randint(0, 800))) for k in range(120)]
    path = tmp_path_factory.mktemp("pit")
    d = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp")
    d.write.parquet(f"{path}/orders.parquet")
    return str(path), rows


def kept(rows):
    """(instrument, field, ann_date, period) to value; the greatest order key stays."""
    out = {}
    for _, cust, status, price, at in sorted(rows):
        q = (at.month - 1) // 3
        out[str(cust), status.lower(), at.date(), (at.year if q else at.year - 1) * 100 + (q or 4)] = price
    return out


def test_records_of_all_customers(spark, orders):
    path, rows = orders
    want = kept(rows)
    got = {(r.instrument, r.field, r.ann_date, r.period): r.value for r in catalog.queries()["pit_dedup_write"](spark, path).collect()}
    assert got == want and {k[0] for k in got} == {"1", "399", "400", "1499"}
    new = {(r.instrument, r.field, r.ann_date, r.period): r.value for r in catalog.queries()["pit_write_update"](spark, path).collect()}
    assert new == {k: -v if k[1] == "o" else v for k, v in want.items()}
    last = {(i, p, f): v for (i, f, d, p), v in sorted(want.items(), key=lambda x: x[0][2]) if d <= ASOF and f in "fo"}
    keys = {k[:2] for k in last}
    snap = {(r.instrument, r.period): (r.f, r.o) for r in catalog.queries()["pit_snapshot"](spark, path).collect()}
    assert snap == {k: (last.get((*k, "f")), last.get((*k, "o"))) for k in keys}
    some = {(r.instrument, r.period): (r.f, r.o) for r in catalog.queries()["pit_snapshot_periods"](spark, path).collect()}
    assert some == {(i, p): (last.get((i, p, "f")), last.get((i, p, "o"))) for i in {k[0] for k in keys} for p in (199601, 199602, 199704)}


def series(last, day, instrument, field):
    """The greatest quarter announced up to a day, and the last value of each quarter."""
    seen = {}
    for (i, f, d, p), v in last:
        if i == instrument and f == field and d <= day:
            seen[p // 100 * 4 + p % 100 - 1] = v
    return max(seen, default=None), seen


def mean(v):
    return sum(v) / len(v) if v else None


def test_projections_on_every_date(spark, orders):
    path, rows = orders
    last = sorted(kept(rows).items(), key=lambda x: x[0][2])
    names = ("pit_p_raw", "pit_bare_field", "pit_pref", "pit_daily_mix", "pit_p_expr", "pit_pref_expr")
    want = {n: {} for n in names}
    for i in {k[0] for k, _ in last}:
        for day in {r[4].date() for r in rows}:
            hi, f = series(last, day, i, "f")
            ho, o = series(last, day, i, "o")
            raw, other = f.get(hi), o.get(ho)
            window = lambda end: mean([v for q, v in f.items() if end - 2 <= q <= end])
            values = (raw, raw, f.get(hi - 1) if f else None, other / raw + raw if f and o else None, window(hi) if f else None, window(hi - 1) if f and hi - 1 >= min(f) else None)
            for n, v in zip(names, values):
                want[n][i, day] = v
    for n in names:
        got = {(r.instrument, r.datetime): r.value for r in catalog.queries()[n](spark, path).collect()}
        assert got.keys() == want[n].keys()
        assert all(got[k] == v if v is None or got[k] is None else abs(got[k] - v) < 1e-3 for k, v in want[n].items()), n


def test_dotted_names_and_one_pass(spark, orders):
    from pyspark.sql import functions as F

    from tessera.operators import pit as P
    from tessera.plans.pit import grid
    from tessera.sources.driver import pit_records

    path, _ = orders
    records, days = pit_records(spark, path), grid(spark, path)
    asked = {"a": "P($$f)", "b": "PRef($$f, -1) + P($$o)"}
    plain = P.project(records, days, asked)
    dotted = P.project(records.withColumn("field", F.concat(F.lit("income."), "field")), days, asked, [f"income.{x}" for x in "fop"])
    assert sorted(plain.collect(), key=str) == sorted(dotted.collect(), key=str)
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    with pytest.raises(KeyError):
        P.project(records, days, asked, ["income.f", "cash.f", "income.o"])

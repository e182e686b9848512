"""The report computes factors, labels and shared tables once, and they are the same."""

import math

import pytest

from tessera.operators import cross as C
from tessera.operators import report as R
from tessera.plans import catalog
from tessera.plans.cross import HORIZONS, NAMES, factors


def test_report_reads_events_once(spark, sf, monkeypatch):
    plans = {}

    def payload(tables, meta):
        plans.update({k: d._jdf.queryExecution().sparkPlan().toString() for k, d in tables.items()})
        return "{}"

    monkeypatch.setattr(R, "payload", payload)
    catalog.queries()["report_payload"](spark, sf)
    assert {"summary", "performance", "sector_ic", "sector_quantiles"} <= plans.keys()
    for name in ("summary", "sector_ic", "sector_quantiles"):
        assert "events.parquet" not in plans[name] and "FileScan" not in plans[name], name


def test_tables_kept_and_carried(spark, sf):
    p, d = factors(spark, sf)
    labels = C.forward_returns(p, HORIZONS)
    one, two = C.analyze(d, NAMES, labels, HORIZONS), C.analyze(d, NAMES, labels, HORIZONS, keep=True, carry=["industry"])
    assert two.keys() - one.keys() == {"rows"} and two["rows"].count() == 4 * d.count()
    for k in one:
        key = [c for c in one[k].columns if c in ("factor", "horizon", "datetime", "quantile", "instrument")]
        a, b = one[k].orderBy(*key).collect(), two[k].orderBy(*key).collect()
        assert len(a) == len(b) and all(x == pytest.approx(y, nan_ok=True, abs=1e-9) if isinstance(x, float) else x == y for r, s in zip(a, b) for x, y in zip(r, s)), k


def test_information_of_values_that_are_not_finite(spark):
    rows = [("a", float(i), y) for i, y in enumerate((1.0, 2.0, math.inf))] + [("b", float(i), math.inf) for i in range(3)] + [("c", 1.0, None)] + [("d", float(i), y) for i, y in enumerate((math.inf, math.nan))]
    got = {r.k: (r.ic, r.rank_ic) for r in C.information(spark.createDataFrame(rows, "k string, value double, label double"), ["k"]).collect()}
    assert math.isnan(got["a"][0]) and got["a"][1] == pytest.approx(1) and got["b"] == got["c"] == (None, None) and math.isnan(got["d"][0]) and got["d"][1] == pytest.approx(1)

"""Report figures by hand and against tables of known values."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import report as R

D = [dt.date(2024, 1, i + 1) for i in range(30)]


def test_student_p_values():
    """Two-sided, from the tables of the distribution; one degree of freedom is the Cauchy distribution."""
    known = [(2.228, 10, 0.05), (1.0, 1, 0.5), (12.706, 1, 0.05), (2.576, 1e6, 0.01), (0.0, 7, 1.0), (2.0, 2, 0.18350342)]
    for t, n, p in known:
        assert R._student_p(np.array([t]), np.array([float(n)]))[0] == pytest.approx(p, abs=2e-4)


def test_normal_points(spark):
    d = spark.createDataFrame([("a", D[i], float(v)) for i, v in enumerate((3, 1, 2, 5, 4))], "factor string, datetime date, ic double")
    got = [(r.rank, r.value, r.expected) for r in R.normal_points(d, "ic", ["factor"]).orderBy("rank").collect()]
    # quantiles at .1, .3, .5, .7, .9 of the standard normal distribution
    want = [-1.2815515655446004, -0.5244005127080407, 0.0, 0.5244005127080407, 1.2815515655446004]
    assert [g[1] for g in got] == [1, 2, 3, 4, 5] and [g[2] for g in got] == pytest.approx(want, abs=1e-8)


def risk(spark, returns, horizon=1):
    d = spark.createDataFrame([("a", D[i], None if r is None else float(r)) for i, r in enumerate(returns)], "factor string, datetime date, mean double")
    return R.risk(d, F.lit(horizon), ["factor"]).collect()[0]


def test_risk(spark):
    r = risk(spark, [0.1, None, -0.5, 0.2], 21)
    assert r.factor_return == pytest.approx(1.1 * 0.5 * 1.2 - 1) and r.max_drawdown == pytest.approx(0.5)
    assert r.annualized_return == pytest.approx((1.1 * 0.5 * 1.2) ** (12 / 3) - 1)
    x = np.array([0.1, -0.5, 0.2])
    assert r.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(12))
    dead = risk(spark, [0.1, -1.0, 5.0])
    assert (dead.factor_return, dead.annualized_return, dead.max_drawdown) == (-1.0, -1.0, 1.0)
    assert risk(spark, [0.1, -1.5])[1:] == (None,) * 4 and risk(spark, [0.1, 0.1]).sharpe is None


def test_performance_of_groups(spark):
    ics = [0.05, -0.05, 0.01, 0.03, None]
    daily = spark.createDataFrame([("a", 2, D[i], x, x) for i, x in enumerate(ics)], "factor string, horizon int, datetime date, ic double, rank_ic double")
    groups = spark.createDataFrame([("a", 2, D[i], i + 1, q, 0.01 * q * (1 if q != 3 else 5)) for i in range(5) for q in (1, 3, 4, 5)], "factor string, horizon int, datetime date, pos int, quantile int, mean double")
    r = R.performance(daily, groups).collect()[0]
    x = np.array(ics[:4])
    assert list(r.asDict())[2:] == list(R.PERFORMANCE) and len(R.PERFORMANCE) == 14
    assert (r.ic_negative_rate, r.ic_positive_rate) == (0.25, 0.5)
    assert r.ic_t_stat == pytest.approx(x.mean() / x.std(ddof=1) * 2)
    # dates 1, 3 and 5 of group 5; group means 1, 15, 4, 5
    assert r.factor_return == pytest.approx(1.05**3 - 1)
    assert r.monotonicity == pytest.approx(np.corrcoef([0, 1, 2, 3], [1, 4, 2, 3])[0, 1])
    net = {q.quantile: q.mean for q in R.net_groups(groups, "standard").collect()}
    assert net[5] == pytest.approx(1.05 * (1 - 0.0003 - 0.001) / 1.0003 - 1)

"""Projections laid out by runs between events, against the ones of a whole grid."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import grid as G
from tessera.operators import pit as P
from tessera.plans import catalog


@pytest.fixture(scope="module")
def tables(spark):
    """Announcements before, between, on and after the days of a calendar with gaps; NaN takes a value back; instrument z has none."""
    r = random.Random(8)
    day = lambda n: dt.date(2023, 3, 1) + dt.timedelta(n)
    rows = {}
    for _ in range(260):
        rows[r.choice("abcd"), r.choice("fo"), day(r.randint(0, 119)), 202200 + r.randint(1, 4)] = math.nan if r.random() < 0.1 else float(r.randint(1, 50))
    for i in "fo":
        rows["e", i, day(200), 202203] = 7.0
    records = spark.createDataFrame([(*k, v) for k, v in rows.items()], "instrument string, field string, ann_date date, period int, value double")
    calendar = G.with_positions(spark.createDataFrame([(day(n),) for n in range(20, 100) if n % 7 < 4 and n not in range(50, 64)], "datetime date"))
    return records, P.Cells(spark.createDataFrame([(i,) for i in "abcdez"], "instrument string"), calendar)


ASKED = {"raw": "P($$f)", "bare": "$$f * 1", "ref": "PRef($$f, -1)", "mix": "P($$o) / P($$f) + PRef($$f, 0)", "mean": "P(Mean($$f, 3))", "early": "PRef(Mean($$f, 3), -1)", "test": "P($$o) > P($$f)"}


def plain(d, names):
    return sorted(((r.instrument, r.datetime, *(r[n] for n in names)) for r in d.collect()), key=str)


@pytest.mark.parametrize("asked", [{k: ASKED[k]} for k in ASKED] + [ASKED, {"window": "Mean(P($$f), 3)"}], ids=[*ASKED, "all", "window"])
def test_runs_and_grid(tables, asked):
    records, cells = tables
    ours, theirs = plain(P.project(records, cells, asked), asked), plain(P.project(records, cells.laid(), asked), asked)
    assert ours == theirs and len(ours) == 6 * cells.calendar.count() and any(x is not None for r in ours for x in r[2:])


def test_no_days(tables):
    records, cells = tables
    assert P.project(records, P.Cells(cells.instruments, cells.calendar.where(F.lit(False))), {"v": "P($$f)"}).isEmpty()


@pytest.mark.parametrize("name", ["pit_daily_mix", "pit_p_expr", "pit_pref_expr", "pit_p_raw", "pit_pref", "pit_bare_field"])
def test_the_grid_does_not_move(spark, sf, name):
    """In the physical plan no exchange and no sort stands above the step that makes rows of runs."""
    lines = catalog.queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = lambda word: next(i for i, x in enumerate(lines) if re.search(rf"\b{word}\b", x))
    assert at("Generate") < at("Window") and not any(re.search(r"Sort|Exchange|Join", x) and "BroadcastNestedLoopJoin" not in x for x in lines[: at("Generate")])

"""Report diagnostics of daily factor results."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.cross import information

#: Fee scenarios, trading cost a side and sell tax.
SCENARIOS = {"none": (0.0, 0.0), "standard": (0.0003, 0.001)}


def net_of_fee(r: Column, cost: float, tax: float) -> Column:
    """A return after buying and selling: an affine change that leaves -1 where it is."""
    keep = (1 - cost - tax) / (1 + cost)
    return (1 + r) * keep - 1


def cumulative(col: str, keys: Sequence[str] = ()) -> Column:
    """Running sum by date; missing where the value is."""
    w = Window.partitionBy(*keys).orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.col(col).isNotNull(), F.sum(col).over(w))


def rolling_mean(col: str, keys: Sequence[str] = (), n: int = 20, least: int = 5) -> Column:
    """Mean of the last n dates, of at least so many values."""
    w = Window.partitionBy(*keys).orderBy("datetime").rowsBetween(1 - n, 0)
    return F.when(F.count(col).over(w) >= least, F.avg(col).over(w))


def monthly(daily: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Mean of each month; every month of every year in between, empty ones too."""
    years = daily.groupBy(*keys).agg(F.min(F.year("datetime")).alias("a"), F.max(F.year("datetime")).alias("b"))
    cells = years.select(*keys, F.explode(F.sequence("a", "b")).alias("year")).select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    mean = daily.groupBy(*keys, F.year("datetime").alias("year"), F.month("datetime").alias("month")).agg(F.avg(col).alias("mean"))
    return cells.join(mean, [*keys, "year", "month"], "left")


def histogram(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """min(30, max(6, int(sqrt(n)))) equal bins from the least to the greatest value, the last one closed."""
    have = df.where(F.col(col).isNotNull())
    shape = have.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.least(F.lit(30), F.greatest(F.lit(6), F.floor(F.sqrt(F.count(F.lit(1)).cast("double"))).cast("int"))).alias("bins"))
    d = have.join(shape, list(keys))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(col) - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(0.0)) * F.col("bins")).cast("int"), F.col("bins") - 1)
    counts = d.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = shape.select(*keys, "lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.col("bins")
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


def box(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    p = F.percentile(col, F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return df.groupBy(*keys).agg(p.alias("p")).select(*keys, *(F.col("p")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))))


def kde(df: DataFrame, col: str, keys: Sequence[str], points: int = 64) -> DataFrame:
    """Gaussian density of bandwidth std * n ** -0.2 at points from 3 bandwidths below to 3 above; constants have none."""
    shape = df.groupBy(*keys).agg(F.stddev_samp(col).alias("sd"), F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
    shape = shape.where("sd > 0").withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = shape.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    grid = grid.withColumn("x", F.col("lo") - 3 * F.col("h") + (F.col("hi") - F.col("lo") + 6 * F.col("h")) * F.col("point") / (points - 1))
    z = (F.col("x") - F.col(col)) / F.col("h")
    d = grid.join(df.where(F.col(col).isNotNull()).select(*keys, col), list(keys))
    return d.groupBy(*keys, "point", "x", "h").agg((F.avg(F.exp(-z * z / 2)) / F.col("h") / math.sqrt(2 * math.pi)).alias("density")).drop("h")


def _normal_inverse(p: np.ndarray) -> np.ndarray:
    """By Newton steps on the error function, from a logistic start."""
    x = np.log(p / (1 - p)) / 1.702
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    for _ in range(12):
        x = x - np.clip((cdf(x) - p) * np.sqrt(2 * np.pi) * np.exp(x * x / 2), -1, 1)
    return x


def normal_points(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Sorted values with the normal quantile of (i + 0.5) / n."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(col).isNotNull()).select(*keys, col, F.row_number().over(w.orderBy(col)).alias("rank"), F.count(F.lit(1)).over(w).alias("n"))

    @F.pandas_udf("double")
    def inverse(p: pd.Series) -> pd.Series:
        return pd.Series(_normal_inverse(p.to_numpy()))

    return d.select(*keys, "rank", F.col(col).alias("value"), inverse((F.col("rank") - 0.5) / F.col("n")).alias("expected"))


def risk_sample(daily: DataFrame, horizon: int, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Dates whose distance from the first is a multiple of the horizon: returns that don't overlap."""
    w = Window.partitionBy(*keys)
    return daily.withColumn("__f", F.min(pos).over(w)).where((F.col(pos) - F.col("__f")) % horizon == 0).drop("__f")


def _student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value by the continued fraction of the incomplete beta function."""

    def one(t: float, v: float) -> float:
        if not (math.isfinite(t) and v > 0):
            return math.nan
        a, b, x = v / 2, 0.5, v / (v + t * t)
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            a, b, x = b, a, 1 - x
        if x <= 0:
            return 0.0 if not flip else 1.0
        front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
        f = 1.0
        for i in range(300, 0, -1):  # the fraction from its far end
            m = i // 2
            if i % 2:
                k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            f = 1 + k / f
        out = front / f
        return 1 - out if flip else out

    return np.array([one(x, y) for x, y in zip(t, df)])


#: The fourteen figures of a factor and horizon, in this order.
PERFORMANCE = (
    "factor_return", "sharpe", "annualized_return", "max_drawdown", "ic_mean", "rank_ic_mean", "ic_std", "ic_ir", "rank_ic_ir",
    "ic_negative_rate", "ic_positive_rate", "ic_t_stat", "ic_p_value", "monotonicity",
)
#: An IC beyond this, up or down, counts in the rates.
NOTABLE = 0.02
YEAR = 252.0


def risk(sampled: DataFrame, horizon: Column, keys: Sequence[str], col: str = "mean", only_finite: bool = True) -> DataFrame:
    """Return, Sharpe ratio, annualised return and greatest drawdown of returns that don't overlap, in order of datetime.

    Missing returns, and those that aren't finite (only_finite), are left out, not filled; a series with a return below -1 has no figures, after one of -1 wealth stays zero."""
    have = sampled.where(F.abs(col) < math.inf if only_finite else F.col(col).isNotNull()).withColumn("__h", horizon)
    w = Window.partitionBy(*keys).orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.min(col).over(w) <= -1
    log = F.sum(F.when(F.col(col) > -1, F.log1p(F.when(F.col(col) > -1, F.col(col))))).over(w)
    d = have.withColumn("__wealth", F.when(lost, F.lit(0.0)).otherwise(F.exp(log)))
    d = d.withColumn("__down", 1 - F.col("__wealth") / F.greatest(F.max("__wealth").over(w), F.lit(1.0)))
    n, year = F.count(F.lit(1)), F.lit(YEAR) / F.max("__h")
    end = F.max_by("__wealth", "datetime")
    sane = lambda c: F.when(F.min(col) >= -1, c)
    return d.groupBy(*keys).agg(
        sane(end - 1).alias("factor_return"), sane(F.try_divide(F.avg(col), F.nullif(F.stddev_samp(col), F.lit(0.0))) * F.sqrt(year)).alias("sharpe"),
        sane(F.pow(end, year / n) - 1).alias("annualized_return"), sane(F.max("__down")).alias("max_drawdown"),
    )


def monotonicity(groups: DataFrame, keys: Sequence[str], value: str = "mean") -> DataFrame:
    """Rank correlation of the groups' order (quantile) and their mean over dates; missing if fewer than two have one, or all are equal."""
    means = groups.groupBy(*keys, "quantile").agg(F.avg(value).alias("__m")).where("__m is not null")
    by = Window.partitionBy(*keys)
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__m"))
    ranked = means.withColumn("__r", F.rank().over(by.orderBy("__m")) + (same - 1) / F.lit(2.0)).withColumn("__q", F.row_number().over(by.orderBy("quantile")).cast("double"))
    return ranked.groupBy(*keys).agg(F.when((F.count("__r") > 1) & (F.max("__r") > F.min("__r")), F.corr("__q", "__r")).alias("monotonicity"))


def performance(daily: DataFrame, groups: DataFrame, keys: Sequence[str] = ("factor", "horizon"), pos: str = "pos", only_finite: bool = True) -> DataFrame:
    """PERFORMANCE of each series. daily: ic and rank_ic of each date; groups: mean, quantile and pos of each date, of which the
    greatest quantile's returns are taken on dates a multiple of the horizon after the first. Values that aren't finite are left out (only_finite)."""
    keys = list(keys)
    valid = lambda c: F.when(F.abs(c) < math.inf, F.col(c)) if only_finite else F.col(c)

    def moments(c: str) -> tuple[Column, Column, Column]:
        x = valid(c)
        return F.avg(x), F.stddev_samp(x), F.count(x)

    (mean, sd, n), (rank_mean, rank_sd, _) = moments("ic"), moments("rank_ic")
    ratio = F.try_divide(mean, F.nullif(sd, F.lit(0.0)))
    beyond = lambda test: F.avg(F.when(valid("ic").isNotNull(), test.cast("double")))
    g = daily.groupBy(*keys).agg(
        mean.alias("ic_mean"), rank_mean.alias("rank_ic_mean"), sd.alias("ic_std"), ratio.alias("ic_ir"), F.try_divide(rank_mean, F.nullif(rank_sd, F.lit(0.0))).alias("rank_ic_ir"),
        beyond(F.col("ic") < -NOTABLE).alias("ic_negative_rate"), beyond(F.col("ic") > NOTABLE).alias("ic_positive_rate"), (ratio * F.sqrt(n.cast("double"))).alias("ic_t_stat"), n.alias("__n"),
    )

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(_student_p(t.fillna(np.nan).to_numpy(float), df.to_numpy(float)))

    g = g.withColumn("ic_p_value", F.when(F.col("ic_t_stat").isNotNull(), p_value("ic_t_stat", (F.col("__n") - 1).cast("double"))))
    first = Window.partitionBy(*keys)
    top = groups.withColumn("__first", F.min(pos).over(first)).withColumn("__top", F.max("quantile").over(first))
    top = top.where((F.col("quantile") == F.col("__top")) & ((F.col(pos) - F.col("__first")) % F.col("horizon") == 0))
    out = g.join(risk(top, F.col("horizon"), keys, only_finite=only_finite), keys, "left").join(monotonicity(groups, keys), keys, "left")
    return out.select(*keys, *PERFORMANCE)


def net_groups(groups: DataFrame, scenario: str) -> DataFrame:
    """Group returns (columns mean and label count kept) after the fees of a scenario: the mean of the transformed is the transformed mean."""
    return groups.withColumn("mean", net_of_fee(F.col("mean"), *SCENARIOS[scenario]))


def sectors(rows: DataFrame, members: DataFrame, keys: Sequence[str] = ("factor", "horizon")) -> dict[str, DataFrame]:
    """sector_ic: means over the dates of IC and rank IC inside each industry; sector_quantiles: label's mean and count
    by industry and quantile, the quantiles being those of the whole market.

    rows: factor, horizon, datetime, instrument, value, label, industry; rows without an industry go. members: factor, datetime, instrument, quantile."""
    have = rows.where("industry is not null")
    daily = information(have, (*keys, "industry", "datetime"))
    of = have.join(members.where("quantile is not null").select("factor", "datetime", "instrument", "quantile"), ["factor", "datetime", "instrument"])
    return {
        "sector_ic": daily.groupBy(*keys, "industry").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.count("ic").alias("dates")),
        "sector_quantiles": of.groupBy(*keys, "industry", "quantile").agg(F.count("label").alias("n"), F.avg("label").alias("mean")),
    }


def pending(horizon: Column, lag: int, size: Column) -> Column:
    """Whether labels of a date (pos, label_count) can't be known yet: they end beyond a calendar of that size and none is there."""
    return (F.col("pos") + lag + horizon > size) & (F.col("label_count") == 0)


def strict(value):
    """A value for JSON: numbers that aren't finite become null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    return [strict(v) for v in value] if isinstance(value, list | tuple) else value


def payload(tables: dict[str, DataFrame], meta: dict) -> str:
    """The report's JSON: meta, and each small result table as rows."""
    rows = {k: [r.asDict(recursive=True) for r in d.collect()] for k, d in tables.items()}
    return json.dumps(strict({"meta": meta, **rows}), default=str, allow_nan=False)


def html(data: str, title: str) -> str:
    """A page that holds the payload; nothing in it can end its script."""
    safe = data.replace("<", "\\u003c")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title.replace("<", "&lt;")}</title></head><body><script type="application/json" id="report">{safe}</script></body></html>'

"""Cross-sectional factor analytics over panels of instrument, datetime and one double column a factor."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expression import finite, no_nan, quotient
from tessera.operators.grid import Day, Panel


def _day():
    return Window.partitionBy("datetime")


def validate_panel(df: DataFrame) -> DataFrame:
    """The panel with NaN and infinities missing; a null or repeated key raises when read."""
    w = Window.partitionBy("instrument", "datetime")
    ok = F.col("instrument").isNotNull() & F.col("datetime").isNotNull() & (F.count(F.lit(1)).over(w) == 1)
    doubles = [c for c, k in df.dtypes if k == "double"]
    d = df.select(*(finite(no_nan(F.col(c))).alias(c) if c in doubles else F.col(c) for c in df.columns)).withColumn("__ok", ok)
    return d.withColumn("instrument", F.when(F.col("__ok"), F.col("instrument")).otherwise(F.raise_error(F.lit("keys of a panel are unique and not null")))).drop("__ok")


def _other(df: DataFrame, factors: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in factors]


def winsorize(df: DataFrame, factors: Sequence[str], method: str = "std", n: float = 3.0, mad_scale: float = 1.4826, ddof: int = 0) -> DataFrame:
    """Each date's values clipped to its mean (std) or median (mad) plus and minus n deviations."""
    if method == "std":
        mid = {f: F.avg(f).over(_day()) for f in factors}
        dev = {f: (F.stddev_pop(f) if ddof == 0 else F.stddev_samp(f)).over(_day()) for f in factors}
        d = df.select("*", *(mid[f].alias(f"__m_{f}") for f in factors), *(F.when(F.count(f).over(_day()) > ddof, dev[f]).alias(f"__d_{f}") for f in factors))
    elif method == "mad":
        # medians are not mergeable: two grouped passes, joined back on the date
        med = df.groupBy("datetime").agg(*(F.percentile(f, F.lit(0.5)).alias(f"__m_{f}") for f in factors))
        d = df.join(med, "datetime")
        mad = d.groupBy("datetime").agg(*((F.percentile(F.abs(F.col(f) - F.col(f"__m_{f}")), F.lit(0.5)) * mad_scale).alias(f"__d_{f}") for f in factors))
        d = d.join(mad, "datetime")
    else:
        raise ValueError(f"no such method: {method}")

    def clip(f: str) -> Column:
        lo, hi = F.col(f"__m_{f}") - n * F.col(f"__d_{f}"), F.col(f"__m_{f}") + n * F.col(f"__d_{f}")
        return F.when(F.col(f"__d_{f}").isNull(), None).when(F.col(f) < lo, lo).when(F.col(f) > hi, hi).otherwise(F.col(f))

    return d.select(*_other(df, factors), *(clip(f).alias(f) for f in factors))


def standardize(df: DataFrame, factors: Sequence[str], ddof: int = 0) -> DataFrame:
    """Each date's z-scores; a constant date gives 0."""

    def z(f: str) -> Column:
        sd = (F.stddev_pop(f) if ddof == 0 else F.stddev_samp(f)).over(_day())
        score = F.when(F.min(f).over(_day()) == F.max(f).over(_day()), F.lit(0.0)).otherwise(F.try_divide(F.col(f) - F.avg(f).over(_day()), sd))
        return F.when((F.count(f).over(_day()) > ddof) & F.col(f).isNotNull(), score)

    return df.select(*_other(df, factors), *(z(f).alias(f) for f in factors))


def neutralize(df: DataFrame, factors: Sequence[str], cap: str = "cap", industry: str = "industry", min_samples: int = 3) -> DataFrame:
    """Residuals of each date's regression on industries and the logarithm of cap.

    Frisch-Waugh: factor and log cap are centred within date and industry, one slope a date is left. Rows
    lacking a positive cap or an industry have no residual; nor has a date of too few samples."""
    out = df
    for f in factors:
        use = F.col(f).isNotNull() & (F.col(cap) > 0) & F.col(industry).isNotNull()
        both = Window.partitionBy("datetime", industry)
        y, x = F.when(use, F.col(f)), F.when(use, F.ln(F.when(F.col(cap) > 0, F.col(cap))))
        d = out.withColumn("__y", y - F.avg(y).over(both)).withColumn("__x", x - F.avg(x).over(both)).withColumn("__u", use).withColumn("__raw", y)
        d = d.withColumn("__first", F.when(F.col("__u") & (F.row_number().over(Window.partitionBy("datetime", industry, "__u").orderBy("instrument")) == 1), 1))
        sxx, sxy = F.sum(F.col("__x") * F.col("__x")).over(_day()), F.sum(F.col("__x") * F.col("__y")).over(_day())
        scale = F.sum(F.col("__raw") * F.col("__raw")).over(_day())
        varied = sxx > 1e-12
        slope = F.when(varied, F.try_divide(sxy, sxx)).otherwise(0.0)
        n, rank = F.count("__y").over(_day()), F.count("__first").over(_day()) + F.when(varied, 1).otherwise(0)
        d = d.select(*out.columns, "__x", "__y", slope.alias("__b"), ((n >= min_samples) & (n > rank)).alias("__ok"), F.sqrt(scale).alias("__norm"))
        r = F.col("__y") - F.col("__b") * F.col("__x")
        r = F.when(F.abs(r) <= 1e-13 * F.col("__norm"), F.lit(0.0)).otherwise(r)
        out = d.select(*_other(out, [f]), F.when(F.col("__ok"), r).alias(f))
    return out


def with_industry(df: DataFrame, spans: DataFrame, calendar: DataFrame, name: str = "industry") -> DataFrame:
    """df with the industry of each row's day, missing outside of all intervals (instrument, that name, start, end).

    Without any interval it raises at once; a row with two industries raises when read."""
    if spans.isEmpty():
        raise ValueError("no industry has an interval")
    on = (F.col("datetime") >= F.col("start")) & (F.col("datetime") <= F.col("end"))
    days = spans.join(F.broadcast(calendar.select("datetime")), on)
    one = days.groupBy("instrument", "datetime").agg(F.min(name).alias("__lo"), F.max(name).alias("__hi"))
    d = df.drop(name).join(one, ["instrument", "datetime"], "left")
    clash = F.raise_error(F.concat_ws(" ", F.lit("two industries of"), "instrument", F.col("datetime").cast("string"))).cast("string")
    return d.withColumn(name, F.when(F.col("__lo") != F.col("__hi"), clash).otherwise(F.col("__lo"))).drop("__lo", "__hi")


def aligned(pred: DataFrame, label: DataFrame, only_finite: bool = True) -> DataFrame:
    """instrument, datetime, pred and label of the days that either side has; values that aren't finite are missing (only_finite)."""
    side = lambda d, c: d.select("instrument", "datetime", (finite(F.col(c)) if only_finite else F.col(c)).alias(c))
    return side(pred, "pred").join(side(label, "label"), ["instrument", "datetime"], "full")


def preprocess(df: DataFrame, factors: Sequence[str], method: str | None = "std", neutral: bool = True, standard: bool = True) -> DataFrame:
    if method:
        df = winsorize(df, factors, method)
    if neutral:
        df = neutralize(df, factors)
    return standardize(df, factors) if standard else df


def forward_returns(panel: Panel, horizons: Sequence[int], price: str = "close", entry_lag: int = 1, positive: bool = True) -> DataFrame:
    """instrument, datetime and return_h: from entry_lag rows ahead over h more, on the whole calendar.

    A price that isn't positive is missing; unless positive, it divides as IEEE does: from zero an infinite return or NaN, to zero -1."""
    if any(not isinstance(h, int) or h < 1 for h in horizons):
        raise ValueError("horizons are positive integers")
    w = Window.partitionBy("instrument").orderBy("pos")
    p = F.when(F.col(price) > 0, F.col(price)) if positive else F.col(price)
    d = panel.dense(price).withColumn("__p", p)
    ret = lambda h: quotient(F.lead("__p", entry_lag + h).over(w), F.lead("__p", entry_lag).over(w)) - 1
    return d.select("instrument", "datetime", *(ret(h).alias(f"return_{h}") for h in horizons))


def long_form(factors: DataFrame, names: Sequence[str], labels: DataFrame | None = None, horizons: Sequence[int] = ()) -> DataFrame:
    """factor, datetime, instrument, value and, with labels, horizon and label: factors and horizons as rows."""
    d = factors.select("instrument", "datetime", *names).unpivot(["instrument", "datetime"], list(names), "factor", "value")
    if labels is None:
        return d
    wide = labels.select("instrument", "datetime", *(F.col(f"return_{h}").alias(str(h)) for h in horizons))
    label = wide.unpivot(["instrument", "datetime"], [str(h) for h in horizons], "horizon", "label").withColumn("horizon", F.col("horizon").cast("int"))
    return d.join(label, ["instrument", "datetime"], "left")


def average_rank(value: Column, keys: Sequence[str]) -> Column:
    """Rank from 1, ties sharing their mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)


def _pearson(xy: str, xx: str, yy: str) -> Column:
    """Of sums of squares and products, within -1 and 1; NaN of values that aren't finite."""
    r = F.try_divide(F.try_divide(F.col(xy), F.sqrt(F.nullif(xx, F.lit(0.0)))), F.sqrt(F.nullif(yy, F.lit(0.0))))
    return F.when(F.isnan(r), r).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def correlation(df: DataFrame, x: str, y: str, keys: Sequence[str], name: str) -> DataFrame:
    """Pearson correlation of each group, of anchored values; missing if either side is constant, NaN if one isn't finite."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("__a", F.col(x) - F.min(x).over(w)).withColumn("__b", F.col(y) - F.min(y).over(w))
    g = d.groupBy(*keys).agg(
        F.regr_sxy("__b", "__a").alias("sxy"), F.regr_sxx("__b", "__a").alias("sxx"), F.regr_syy("__b", "__a").alias("syy"),
        (F.max(x) > F.min(x)).alias("va"), (F.max(y) > F.min(y)).alias("vb"),
    )
    return g.select(*keys, F.when(F.col("va") & F.col("vb"), _pearson("sxy", "sxx", "syy")).alias(name))


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """x, y, r for each ordered pair of columns, over rows that have both; missing if either is constant.

    One pass of partial aggregates: a pair has as many rows as df, so nothing but sums moves."""
    pair = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("u"), F.col(y).alias("v")) for x in names for y in names))).alias("p")
    g = df.select(pair).select("p.*").where("u is not null and v is not null").groupBy("x", "y").agg(
        F.regr_sxy("v", "u").alias("sxy"), F.regr_sxx("v", "u").alias("sxx"), F.regr_syy("v", "u").alias("syy"), ((F.max("u") > F.min("u")) & (F.max("v") > F.min("v"))).alias("varied")
    )
    return g.select("x", "y", F.when(F.col("varied"), _pearson("sxy", "sxx", "syy")).alias("r"))


def _paired(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what _sums reads, all by windows over one exchange by keys: __x, __y (value and label of rows that have both),
    __a, __b (these from their least on), and __rv, __rl (their ranks)."""
    w = Window.partitionBy(*keys)
    d = rows.withColumn("__pair", F.col("value").isNotNull() & F.col("label").isNotNull())
    d = d.withColumn("__rv", average_rank(F.col("value"), [*keys, "__pair"])).withColumn("__rl", average_rank(F.col("label"), [*keys, "__pair"]))
    only = lambda c: F.when(F.col("__pair"), c)
    d = d.withColumn("__x", only(F.col("value"))).withColumn("__y", only(F.col("label")))
    d = d.withColumn("__a", F.col("__x") - F.min("__x").over(w)).withColumn("__b", F.col("__y") - F.min("__y").over(w))
    # twice the ranks, centred, are whole numbers: their sums are exact in any order, and so is a correlation of zero
    middle = F.count("__x").over(w) + 1
    return d.withColumn("__rv", only(2 * F.col("__rv") - middle)).withColumn("__rl", only(2 * F.col("__rl") - middle))


def _sums() -> list[Column]:
    """Aggregates of _paired for _correlations."""
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    varied = lambda x, y: (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return [
        F.regr_sxy("__b", "__a").alias("ixy"), F.regr_sxx("__b", "__a").alias("ixx"), F.regr_syy("__b", "__a").alias("iyy"), varied("__x", "__y").alias("iv"),
        dot("__rv", "__rl").alias("rxy"), dot("__rv", "__rv").alias("rxx"), dot("__rl", "__rl").alias("ryy"), varied("__rv", "__rl").alias("rv"),
    ]


def _correlations() -> list[Column]:
    return [F.when(F.col(f"{s}v"), _pearson(f"{s}xy", f"{s}xx", f"{s}yy")).alias(n) for s, n in (("i", "ic"), ("r", "rank_ic"))]


def information(rows: DataFrame, keys: Sequence[str] = ("factor", "horizon", "datetime")) -> DataFrame:
    """ic and rank_ic of each group, over rows that have value and label; groups without such a row stay, missing. One exchange by keys."""
    return _paired(rows, keys).groupBy(*keys).agg(*_sums()).select(*keys, *_correlations())


def quantiles(rows: DataFrame, q: int = 5, keys: Sequence[str] = ("factor", "datetime")) -> DataFrame:
    """rows with quantile 1..q of the value, ties together; missing on dates of fewer than q distinct values."""
    have = rows.where("value is not null")
    gate = have.groupBy(*keys).agg(F.count_distinct("value").alias("__d"), F.count(F.lit(1)).alias("__n"))
    r = have.withColumn("__r", average_rank(F.col("value"), keys)).join(gate, list(keys))
    group = F.when(F.col("__d") >= q, F.floor((F.col("__r") - 1) * q / F.col("__n")).cast("int") + 1)
    return r.select(*have.columns, group.alias("quantile"))


def long_short(rows: DataFrame, share: float = 0.2, keys: Sequence[str] = ("factor", "horizon", "datetime"), alpha: bool = False) -> DataFrame:
    """Of each group the k = int(n * share) rows of greatest and least value, ties by instrument: half the
    difference of their mean labels, the mean of all labels, and how often they have the right sign (alpha:
    less the group's mean). Missing labels don't change the selection."""
    w = Window.partitionBy(*keys)
    d = rows.where("value is not null").withColumn("__k", F.floor(F.count(F.lit(1)).over(w) * share))
    d = d.withColumn("__top", F.row_number().over(w.orderBy(F.desc("value"), "instrument"))).withColumn("__low", F.row_number().over(w.orderBy("value", "instrument")))
    base = F.avg("label").over(w) if alpha else F.lit(0.0)
    d = d.withColumn("__x", F.col("label") - base)
    top, low = F.col("__top") <= F.col("__k"), F.col("__low") <= F.col("__k")
    picked = lambda c, v: F.avg(F.when(c, v))
    got = d.groupBy(*keys).agg(
        ((picked(top, F.col("label")) - picked(low, F.col("label"))) / 2).alias("long_short_return"),
        picked(top & F.col("label").isNotNull(), (F.col("__x") > 0).cast("double")).alias("long_precision"),
        picked(low & F.col("label").isNotNull(), (F.col("__x") < 0).cast("double")).alias("short_precision"),
    )
    return rows.groupBy(*keys).agg(F.avg("label").alias("universe_return")).join(got, list(keys), "left")


def _lagged_dates(rows: DataFrame, lag: int, keys: Sequence[str]) -> DataFrame:
    """datetime and before: the date lag observed dates earlier. A few ten thousand rows at most."""
    w = Window.partitionBy(*keys).orderBy("datetime") if keys else Window.orderBy("datetime")
    return rows.select(*keys, "datetime").distinct().select(*keys, "datetime", F.lag("datetime", lag).over(w).alias("before"))


def autocorrelation(rows: DataFrame, lag: int = 1) -> DataFrame:
    """factor, datetime, autocorrelation of a date's values with those lag observed dates before."""
    dates = _lagged_dates(rows, lag, ["factor"])
    old = rows.select("factor", F.col("datetime").alias("before"), "instrument", F.col("value").alias("old"))
    pairs = rows.join(F.broadcast(dates), ["factor", "datetime"]).join(old, ["factor", "before", "instrument"]).where("value is not null and old is not null")
    r = correlation(pairs, "value", "old", ["factor", "datetime"], "autocorrelation")
    return dates.select("factor", "datetime").join(r, ["factor", "datetime"], "left")


def turnover(grouped: DataFrame, lag: int = 1) -> DataFrame:
    """factor, datetime, quantile, turnover: the share of a group's members that weren't in it lag dates before."""
    dates = _lagged_dates(grouped, lag, ["factor"])
    now = grouped.where("quantile is not null").select("factor", "datetime", "quantile", "instrument")
    old = now.select("factor", F.col("datetime").alias("before"), "quantile", "instrument", F.lit(1).alias("stayed"))
    had = old.select("factor", "before", "quantile").distinct().withColumn("had", F.lit(1))
    d = now.join(F.broadcast(dates), ["factor", "datetime"]).join(old, ["factor", "before", "quantile", "instrument"], "left").join(had, ["factor", "before", "quantile"], "left")
    return d.groupBy("factor", "datetime", "quantile").agg(F.when(F.max("had") == 1, 1 - F.count("stayed") / F.count(F.lit(1))).alias("turnover"))


def coverage(rows: DataFrame) -> DataFrame:
    """Counts and shares of values, and of values with a label, of each factor, horizon and date."""
    pair = F.count(F.when(F.col("value").isNotNull() & F.col("label").isNotNull(), 1))
    n = F.count(F.lit(1))
    return rows.groupBy("factor", "horizon", "datetime").agg(
        n.alias("universe_count"), F.count("value").alias("factor_count"), pair.alias("pair_count"), (F.count("value") / n).alias("coverage"), (pair / n).alias("pair_coverage")
    )


def quantile_returns(grouped: DataFrame) -> DataFrame:
    """count, mean and std of the labels of each factor, horizon, date and quantile."""
    return grouped.where("quantile is not null").groupBy("factor", "horizon", "datetime", "quantile").agg(F.count("label").alias("count"), F.avg("label").alias("mean"), F.stddev_samp("label").alias("std"))


def summary(daily: DataFrame) -> DataFrame:
    """Over dates: means, deviations, ratios and signs of ic, rank_ic and long_short_return, and coverage."""

    def of(c: str, short: str, ratio: bool) -> list[Column]:
        mean, sd = F.avg(c), F.stddev_samp(c)
        return [
            mean.alias(f"{short}_mean"), sd.alias(f"{short}_std"), *([F.try_divide(mean, F.nullif(sd, F.lit(0.0))).alias(f"{short}_ir")] if ratio else []),
            F.avg((F.col(c) > 0).cast("double")).alias(f"{short}_positive_rate"), F.count(c).alias(f"{short}_count"),
        ]

    return daily.groupBy("factor", "horizon").agg(
        F.count(F.lit(1)).alias("dates"), F.avg("coverage").alias("coverage"), F.avg("pair_coverage").alias("pair_coverage"), F.avg("pair_count").alias("mean_pair_count"),
        *of("ic", "ic", True), *of("rank_ic", "rank_ic", True), *of("long_short_return", "long_short", False),
    )


def daily_table(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """coverage, information and long_short of each factor, horizon and date in one table: all ranks are windows over one
    exchange by these keys, and one aggregation reads them."""
    keys = ["factor", "horizon", "datetime"]
    w = Window.partitionBy(*keys)
    d = _paired(rows, keys).withColumn("__have", F.col("value").isNotNull())
    # places among values
    v = Window.partitionBy(*keys, "__have")
    d = d.withColumn("__top", F.row_number().over(v.orderBy(F.desc("value"), "instrument"))).withColumn("__low", F.row_number().over(v.orderBy("value", "instrument")))
    d = d.withColumn("__k", F.floor(F.count("value").over(w) * share))
    n, pairs = F.count(F.lit(1)), F.count("__x")
    picked = lambda c: F.avg(F.when(F.col("__have") & (F.col(c) <= F.col("__k")), F.col("label")))
    g = d.groupBy(*keys).agg(
        n.alias("universe_count"), F.count("value").alias("factor_count"), pairs.alias("pair_count"), (F.count("value") / n).alias("coverage"), (pairs / n).alias("pair_coverage"),
        *_sums(),
        F.avg("label").alias("universe_return"), ((picked("__top") - picked("__low")) / 2).alias("long_short_return"),
    )

    return g.select(*keys, "universe_count", "factor_count", "pair_count", "coverage", "pair_coverage", *_correlations(), "universe_return", "long_short_return")


def staged(df: DataFrame) -> DataFrame:
    """The same rows, computed once however often they are read: a checkpoint where spark.checkpoint.dir names a shared folder, else kept by Spark."""
    spark = df.sparkSession
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        return df.persist()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint()


def analyze(factors: DataFrame, names: Sequence[str], labels: DataFrame, horizons: Sequence[int], q: int = 5, lag: int = 1, keep: bool = False, carry: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The result tables: daily, quantile_returns, quantile_membership, turnover, autocorrelation, summary.

    Factors and labels are computed once, and all tables read that. keep: so are daily, quantile_returns and quantile_membership,
    for a caller that reads most tables. carry: columns of factors that a further table has, rows (factor, horizon, value, label)."""
    wide = factors.select("instrument", "datetime", *names, *carry).join(labels.select("instrument", "datetime", *(f"return_{h}" for h in horizons)), ["instrument", "datetime"], "left")
    wide = staged(wide)
    single = long_form(wide, names)
    rows = wide.unpivot(["instrument", "datetime", *carry, *(f"return_{h}" for h in horizons)], list(names), "factor", "value")
    pair = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}").alias("label")) for h in horizons))).alias("p")
    own = ("factor", "datetime", "instrument", "value")
    every = rows.select(*own, *carry, pair).select(*own, *carry, "p.*")
    rows = every.drop(*carry)
    once = staged if keep else (lambda d: d)
    daily = once(daily_table(rows))
    member = once(quantiles(single, q))
    grouped = rows.join(member.select("factor", "datetime", "instrument", "quantile"), ["factor", "datetime", "instrument"])
    auto, turn = autocorrelation(single, lag), turnover(member, lag)
    ends = turn.groupBy("factor").agg(F.avg(F.when(F.col("quantile") == q, F.col("turnover"))).alias("top_turnover"), F.avg(F.when(F.col("quantile") == 1, F.col("turnover"))).alias("bottom_turnover"))
    total = summary(daily).join(auto.groupBy("factor").agg(F.avg("autocorrelation").alias("autocorrelation")), "factor", "left").join(ends, "factor", "left")
    tables = {"daily": daily, "quantile_returns": once(quantile_returns(grouped)), "quantile_membership": member, "turnover": turn, "autocorrelation": auto, "summary": total}
    return tables | ({"rows": every} if carry else {})


def save(tables: dict[str, DataFrame], root: str) -> None:
    for name, d in tables.items():
        d.write.mode("overwrite").option("header", True).csv(f"{root}/{name}")


def factor_analysis(panel: Panel, expressions: Mapping[str, str], universe: DataFrame | None = None, start: Day = None, end: Day = None, horizons: Sequence[int] = (1, 5, 20), q: int = 5, lag: int = 1, price: str = "close", entry_lag: int = 1, prepare: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> dict[str, DataFrame]:
    """From expressions to the result tables: values on the universe's days, prepared if asked, against forward returns
    of the whole panel. prepare: of values and factor names, as preprocess is."""
    names = list(expressions)
    values = validate_panel(panel.features(expressions, universe, start, end, causal=True))
    if prepare is not None:
        values = prepare(values, names)
    return analyze(values, names, forward_returns(panel, horizons, price, entry_lag), horizons, q, lag)

"""The panel: calendar, dense instrument x day grid, adjustment, universes and feature queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import expression as E

#: Fields that adjustment multiplies.
PRICES = ("open", "high", "low", "close", "vwap", "pre_close", "up_limit", "down_limit")
#: Fields made of intervals and listing dates where daily has none of that name.
VIRTUAL = ("is_st", "list_days")
Day = date | str | None


def between(df: DataFrame, start: Day = None, end: Day = None, col: str = "datetime") -> DataFrame:
    """Both ends included; an inverted range raises."""
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError("the range ends before it starts")
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(col) <= F.lit(end).cast("date"))


def normal_code(c: Column) -> Column:
    """Upper case; a leading exchange of six digits goes behind them."""
    return F.regexp_replace(F.upper(c), r"^(SH|SZ|BJ)(\d{6})$", "$2.$1")


def with_positions(dates: DataFrame) -> DataFrame:
    """Distinct dates numbered from 1. A calendar has a few ten thousand rows at most, so one task orders it."""
    return dates.select("datetime").where("datetime is not null").distinct().select("datetime", F.row_number().over(Window.orderBy("datetime")).cast("double").alias("pos"))


@dataclass(frozen=True)
class Panel:
    """Tables of a dataset. daily: instrument, datetime and double fields, unique by the first two; factor
    among them where prices can be adjusted. intervals: market, instrument, start, end, closed."""

    calendar: DataFrame
    daily: DataFrame
    intervals: DataFrame | None = None
    basic: DataFrame | None = None
    adjust: str = "none"
    end: Day = None
    extra: Mapping[str, DataFrame] = field(default_factory=dict)

    def with_adjust(self, adjust: str, end: Day = None) -> Panel:
        if adjust not in ("none", "hfq", "qfq"):
            raise ValueError(f"no such adjustment: {adjust}")
        return replace(self, adjust=adjust, end=end)

    @property
    def instruments(self) -> DataFrame:
        return self.daily.select("instrument").distinct()

    def dense(self, *names: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
        """Every instrument on every calendar row from lo to hi, with the fields adjusted as asked for.

        The calendar is small and sent to all tasks; only the fields named reach the scan."""
        cal = self.calendar
        if lo is not None:
            cal = cal.where(F.col("pos") >= lo)
        if hi is not None:
            cal = cal.where(F.col("pos") <= hi)
        adjusted = self.adjust != "none" and any(n in PRICES for n in names)
        read = list(dict.fromkeys([*(n for n in names if n in self.daily.columns), *(["factor"] if adjusted else [])]))
        virtual = [n for n in VIRTUAL if n in names and n not in self.daily.columns]
        missing = [n for n in names if n not in self.daily.columns and n not in virtual]
        if missing:
            raise KeyError(f"no such field: {missing[0]}")
        grid = self.instruments.crossJoin(F.broadcast(cal))
        out = grid.join(self.daily.select("instrument", "datetime", *(E.no_nan(F.col(n).cast("double")).alias(n) for n in read)), ["instrument", "datetime"], "left")
        if "is_st" in virtual:
            inside = members(self.intervals.where("market = 'st'"), cal).select("instrument", "datetime", F.lit(1.0).alias("is_st"))
            out = out.join(inside, ["instrument", "datetime"], "left").fillna(0.0, ["is_st"])
        if "list_days" in virtual:
            listed = self.basic.select("instrument", F.col("list_date").alias("__listed"))
            out = out.join(listed, "instrument", "left").withColumn("list_days", age("__listed")).drop("__listed")
        return adjust_prices(out, self.adjust, [n for n in names if n in PRICES], self.anchors() if self.adjust == "qfq" and adjusted else None)

    def anchors(self) -> DataFrame:
        """The last valid factor of each instrument up to the end."""
        valid = between(self.daily, None, self.end).where(valid_factor("factor"))
        return valid.groupBy("instrument").agg(F.max_by("factor", "datetime").alias("anchor"))

    def universe(self, market: str | Sequence[str] | Mapping[str, Sequence[tuple]] | None = None) -> DataFrame:
        """instrument, datetime and pos of a market's members, a list's, or those of given intervals."""
        if market is None:
            return self.instruments.crossJoin(F.broadcast(self.calendar))
        if isinstance(market, str):
            spans = self.intervals.where(F.col("market") == market).select("instrument", "start", "end")
        elif isinstance(market, Mapping):
            rows = [(k, a, b) for k, v in market.items() for a, b in v if a is not None and b is not None]
            spans = self.calendar.sparkSession.createDataFrame(rows, "instrument string, start string, end string").select("instrument", F.col("start").cast("date"), F.col("end").cast("date"))
        else:
            known = self.instruments.where(F.col("instrument").isin(list(market)))
            if known.count() < len(set(market)):
                raise KeyError("the list has unknown instruments")
            return known.crossJoin(F.broadcast(self.calendar))
        return members(spans, self.calendar)

    def features(self, expressions: Mapping[str, str], universe: DataFrame | None = None, start: Day = None, end: Day = None, causal: bool = False, special=None) -> DataFrame:
        """Expressions on the members' dates of a range; operators see the whole history, members or not.

        Of a finite history only as many calendar rows are read as the expressions reach."""
        trees = {k: E.parse(v) for k, v in expressions.items()}
        if causal:
            for t in trees.values():
                E.check_causal(t)
        names = sorted({n for v in expressions.values() for n in E.fields(v)})
        lo = hi = None
        if start is not None or end is not None:
            left, right = (max(x) for x in zip(*(E.reach(t) for t in trees.values())))
            first, last = between(self.calendar, start, end).agg(F.min("pos"), F.max("pos")).head()
            if first is not None:
                lo = first - left if left < E.INF else None
                hi = last + right
        out = E.evaluate(self.dense(*names, lo=lo, hi=hi), dict(expressions), special=special)
        out = between(out, start, end)
        return out if universe is None else out.join(universe.select("instrument", "datetime"), ["instrument", "datetime"], "left_semi")


def valid_factor(name: str) -> Column:
    return (F.col(name) > 0) & (F.col(name) < E.INF)


def adjust_prices(df: DataFrame, how: str, prices: Sequence[str], anchors: DataFrame | None = None) -> DataFrame:
    if how == "none" or not prices:
        return df
    scale = F.when(valid_factor("factor"), F.col("factor"))
    if how == "qfq":
        df = df.join(anchors, "instrument", "left")
        scale = F.try_divide(scale, F.col("anchor"))
    for p in prices:
        df = df.withColumn(p, F.col(p) * scale)
    return df.drop("anchor")


def members(spans: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar rows inside closed intervals, each once."""
    hit = spans.join(F.broadcast(calendar), (F.col("datetime") >= F.col("start")) & (F.col("datetime") <= F.col("end")))
    return hit.select("instrument", "datetime", "pos").distinct()


def spans(mask: DataFrame) -> DataFrame:
    """Runs of consecutive calendar rows of each instrument as closed intervals: gaps and islands."""
    w = Window.partitionBy("instrument").orderBy("pos")
    runs = mask.select("instrument", "datetime", (F.col("pos") - F.row_number().over(w)).alias("run"))
    return runs.groupBy("instrument", "run").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end")).drop("run")


def causal_qfq(panel: Panel, expressions: Mapping[str, str], start: Day = None, end: Day = None) -> DataFrame:
    """Every date's values with prices relative to the last factor visible on that date.

    An instrument's dates fall into runs of one anchor; a run's history is evaluated with it. Expressions
    need not scale with prices, so results of another anchor cannot be rescaled."""
    names = sorted({n for v in expressions.values() for n in E.fields(v)})
    if not any(n in PRICES for n in names):
        return panel.with_adjust("none").features(expressions, None, start, end, causal=True)
    for v in expressions.values():
        E.check_causal(E.parse(v))
    w = Window.partitionBy("instrument").orderBy("pos")
    base = panel.with_adjust("none").dense(*dict.fromkeys([*names, "factor"]))
    base = base.withColumn("anchor", F.last(F.when(valid_factor("factor"), F.col("factor")), ignorenulls=True).over(w))
    base = base.withColumn("turn", F.when(F.col("anchor").eqNullSafe(F.lag("anchor").over(w)), 0).otherwise(1))
    base = base.withColumn("segment", F.sum("turn").over(w))
    runs = base.groupBy("instrument", "segment").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("anchor").alias("run_anchor"))
    back = max(E.reach(E.parse(v))[0] for v in expressions.values())
    # of the history before a run only what the expressions reach is repeated
    many = base.drop("anchor", "turn", "segment").join(runs, "instrument").where(F.col("pos") <= F.col("hi"))
    many = many if back == E.INF else many.where(F.col("pos") >= F.col("lo") - back)
    scale = F.try_divide(F.when(valid_factor("factor"), F.col("factor")), F.col("run_anchor"))
    for p in (n for n in names if n in PRICES):
        many = many.withColumn(p, F.col(p) * scale)
    many = many.withColumn("instrument", F.struct("instrument", "segment"))
    out = E.evaluate(many, dict(expressions), keep=("pos", "lo"))
    return between(out.where("pos >= lo").withColumn("instrument", F.col("instrument.instrument")).drop("pos", "lo"), start, end)


def is_st(panel: Panel, market: str = "st") -> DataFrame:
    """The dense grid with is_st: inside an interval of that market."""
    inside = panel.universe(market).select("instrument", "datetime", F.lit(True).alias("is_st"))
    grid = panel.instruments.crossJoin(F.broadcast(panel.calendar))
    return grid.join(inside, ["instrument", "datetime"], "left").withColumn("is_st", F.coalesce("is_st", F.lit(False)))


def list_days(panel: Panel) -> DataFrame:
    """The dense grid with list_days, calendar days since listing; an instrument without a listing date raises."""
    grid = panel.instruments.join(panel.basic.select("instrument", "list_date"), "instrument", "left")
    return grid.crossJoin(F.broadcast(panel.calendar)).select("instrument", "datetime", age("list_date").alias("list_days"))


def age(listed: str) -> Column:
    """Calendar days since listing; a row without that date raises when read."""
    return F.datediff("datetime", F.coalesce(listed, F.raise_error(F.concat(F.lit("no list_date: "), "instrument")).cast("date"))).cast("double")

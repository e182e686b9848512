"""Filters of a universe: each tells for every instrument and calendar row whether it stays.

A filter's mask is a frame of instrument, datetime, pos and keep over the rows it is given; filters combine
with &, | and ~. Subclasses of Filter are the extension point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import expression as E
from tessera.operators.grid import Day, Panel

KEYS = ("instrument", "datetime", "pos")


class Filter:
    def mask(self, panel: Panel, rows: DataFrame) -> DataFrame:
        """rows with a boolean column keep."""
        raise NotImplementedError

    def apply(self, panel: Panel, rows: DataFrame) -> DataFrame:
        return self.mask(panel, rows).where(F.coalesce("keep", F.lit(False))).select(*KEYS)

    def __and__(self, other: Filter) -> Filter:
        return Composite("and", self, other)

    def __or__(self, other: Filter) -> Filter:
        return Composite("or", self, other)

    def __invert__(self) -> Filter:
        return Composite("not", self)


class Composite(Filter):
    def __init__(self, how: str, *parts: Filter):
        self.how, self.parts = how, parts

    def mask(self, panel: Panel, rows: DataFrame) -> DataFrame:
        got = [p.mask(panel, rows).select(*KEYS, F.coalesce("keep", F.lit(False)).alias(f"__k{i}")) for i, p in enumerate(self.parts)]
        if self.how == "not":
            return got[0].select(*KEYS, (~F.col("__k0")).alias("keep"))
        both = got[0].join(got[1], list(KEYS))
        return both.select(*KEYS, (F.col("__k0") & F.col("__k1") if self.how == "and" else F.col("__k0") | F.col("__k1")).alias("keep"))


class ExpressionFilter(Filter):
    """Keeps rows where a causal expression is neither missing nor zero; outside start..end all rows."""

    def __init__(self, expression: str, start: Day = None, end: Day = None):
        E.check_causal(E.parse(expression))
        self.expression, self.start, self.end = expression, start, end

    def mask(self, panel: Panel, rows: DataFrame) -> DataFrame:
        value = panel.features({"__v": self.expression}, causal=True)
        kind = dict(value.dtypes)["__v"]
        hold = F.coalesce(F.col("__v") if kind == "boolean" else F.col("__v") != 0, F.lit(False))
        outside = F.lit(False)
        if self.start is not None:
            outside = outside | (F.col("datetime") < F.lit(self.start).cast("date"))
        if self.end is not None:
            outside = outside | (F.col("datetime") > F.lit(self.end).cast("date"))
        return rows.join(value, ["instrument", "datetime"], "left").select(*KEYS, (outside | hold).alias("keep"))


ExpressionDFilter = ExpressionFilter


class MembershipFilter(Filter):
    """Keeps members of another market; with exclude, those that aren't."""

    def __init__(self, market: str, exclude: bool = False):
        self.market, self.exclude = market, exclude

    def mask(self, panel: Panel, rows: DataFrame) -> DataFrame:
        inside = panel.universe(self.market).select("instrument", "datetime", F.lit(True).alias("__in"))
        keep: Column = F.coalesce("__in", F.lit(False))
        return rows.join(inside, ["instrument", "datetime"], "left").select(*KEYS, (~keep if self.exclude else keep).alias("keep"))


class STFilter(MembershipFilter):
    def __init__(self, exclude: bool = True):
        super().__init__("st", exclude)


class IndustryFilter(MembershipFilter):
    def __init__(self, code: str):
        super().__init__(f"industry/{code}")


class NameDFilter(Filter):
    """Keeps instruments whose code begins with what the expression matches."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def mask(self, panel: Panel, rows: DataFrame) -> DataFrame:
        return rows.select(*KEYS, F.col("instrument").rlike(f"^(?:{self.pattern})").alias("keep"))


class TradableFilter(Filter):
    """Keeps rows with positive open, close and volume."""

    def mask(self, panel: Panel, rows: DataFrame) -> DataFrame:
        bars = panel.daily.select("instrument", "datetime", ((F.col("open") > 0) & (F.col("close") > 0) & (F.col("volume") > 0)).alias("__t"))
        return rows.join(bars, ["instrument", "datetime"], "left").select(*KEYS, F.coalesce("__t", F.lit(False)).alias("keep"))


class ListingDaysFilter(Filter):
    """Keeps rows at an age of at least least and at most most days (calendar rows if trading_days), before
    delisting. The listing day has age 0. A missing listing date raises, as does a calendar that begins after one."""

    def __init__(self, least: int = 0, most: int | None = None, trading_days: bool = False):
        self.least, self.most, self.trading_days = least, most, trading_days

    def mask(self, panel: Panel, rows: DataFrame) -> DataFrame:
        basic = panel.basic.select("instrument", "list_date", "delist_date")
        listed = F.coalesce("list_date", F.raise_error(F.concat(F.lit("no list_date: "), "instrument")).cast("date"))
        d = rows.join(basic, "instrument", "left").withColumn("__l", listed)
        if self.trading_days:
            first = panel.calendar.agg(F.min("datetime").alias("__first"))
            d = d.crossJoin(F.broadcast(first)).withColumn("__l", F.when(F.col("__l") >= F.col("__first"), F.col("__l")).otherwise(F.raise_error(F.lit("the calendar begins after a listing")).cast("date")))
            # the row of the first calendar day on or after listing
            cal = panel.calendar.select(F.col("datetime").alias("__d"), F.col("pos").alias("__p"))
            at = basic.join(F.broadcast(cal), F.col("__d") >= F.col("list_date")).groupBy("instrument").agg(F.min("__p").alias("__from"))
            d = d.join(at, "instrument", "left")
            age = F.col("pos") - F.col("__from")
        else:
            age = F.datediff("datetime", "__l")
        keep = (age >= self.least) & (F.col("delist_date").isNull() | (F.col("datetime") < F.col("delist_date")))
        if self.most is not None:
            keep = keep & (age <= self.most)
        return d.select(*KEYS, F.coalesce(keep, F.lit(False)).alias("keep"))


KINDS = {c.__name__: c for c in (ExpressionFilter, MembershipFilter, STFilter, IndustryFilter, NameDFilter, TradableFilter, ListingDaysFilter)} | {"ExpressionDFilter": ExpressionFilter}


def make_filter(config: Filter | dict) -> Filter:
    """From {"filter_type": name, "kwargs": {...}}; the name may stand under "class"."""
    if isinstance(config, Filter):
        return config
    name = config.get("filter_type") or config.get("class")
    if name not in KINDS:
        raise ValueError(f"no such filter: {name}")
    return KINDS[name](**config.get("kwargs", {}))


def pipe(panel: Panel, rows: DataFrame, filters: Sequence[Filter | dict]) -> DataFrame:
    """Rows that every filter keeps, applied in order."""
    for f in filters:
        rows = make_filter(f).apply(panel, rows)
    return rows

"""Building a dataset from raw tables: validation, merging, intervals and financial records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expression import INF

OPEN_END = "2099-12-31"


def fail(text: str, *cols: str) -> Column:
    return F.raise_error(F.concat_ws(" ", F.lit(text), *(F.col(c).cast("string") for c in cols)))


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """df; a repeated key raises when read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    k = keys[0]
    return df.withColumn(k, F.when(n == 1, F.col(k)).otherwise(fail(f"repeated key of {what}:", *keys).cast(df.schema[k].dataType)))


def validate_limits(limits: DataFrame, day: str | None = None, zero: bool = False) -> DataFrame:
    """Keys unique (and all of one day); limits that aren't positive (or zero, if that is asked for) and finite are missing; up below down raises."""
    d = require_unique(limits, ["instrument", "datetime"], "limits")
    if day is not None:
        d = d.withColumn("datetime", F.when(F.col("datetime") == F.lit(day).cast("date"), F.col("datetime")).otherwise(fail("another day:", "instrument").cast("date")))
    clean = lambda c: F.when((F.col(c) >= 0 if zero else F.col(c) > 0) & (F.col(c) < INF), F.col(c))
    d = d.withColumn("up_limit", clean("up_limit")).withColumn("down_limit", clean("down_limit"))
    return d.withColumn("up_limit", F.when(F.coalesce(F.col("up_limit") < F.col("down_limit"), F.lit(False)), fail("limits cross:", "instrument").cast("double")).otherwise(F.col("up_limit")))


def merge_daily(daily: DataFrame, factor: DataFrame, caps: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Bars with factor, capitalisation and limits joined one to one; vwap = amount * 10 / volume.

    Texts that aren't numbers are missing. Keys that repeat on any side raise."""
    keys = ["instrument", "datetime"]
    number = [c for c in daily.columns if c not in keys]
    d = require_unique(daily.select(*keys, *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in number)), keys, "daily")
    for other, what in ((factor, "factor"), (caps, "caps"), (limits, "limits")):
        if other is not None:
            d = d.join(require_unique(other, keys, what), keys, "left")
    return d.withColumn("vwap", F.when(F.col("volume") > 0, F.try_divide(F.col("amount") * 10, F.col("volume"))))


def coalesce_intervals(spans: DataFrame, calendar: DataFrame, keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """Closed intervals laid on the calendar, those that touch or overlap merged; an open end stays open.

    calendar: datetime and pos. Intervals that hold no calendar row vanish."""
    last = calendar.agg(F.max("pos").alias("top"))
    cal = F.broadcast(calendar)
    hit = spans.join(cal, (F.col("datetime") >= F.col("start")) & (F.col("datetime") <= F.col("end")))
    laid = hit.groupBy(*keys, "start", "end").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    w = Window.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = laid.withColumn("turn", F.when(before.isNull() | (F.col("a") > before + 1), 1).otherwise(0))
    d = d.withColumn("island", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = d.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("end").alias("to"))
    m = m.crossJoin(F.broadcast(last))
    day = lambda c, n: calendar.select(F.col("pos").alias(c), F.col("datetime").alias(n))
    m = m.join(F.broadcast(day("a", "start")), "a").join(F.broadcast(day("b", "end")), "b")
    end = F.when((F.col("b") == F.col("top")) & (F.col("to") >= F.lit(OPEN_END).cast("date")), F.lit(OPEN_END).cast("date")).otherwise(F.col("end"))
    return m.select(*keys, "start", end.alias("end"))


def overlaps(spans: DataFrame, group: str = "industry") -> DataFrame:
    """Intervals that begin inside an earlier one of the same instrument but another group.

    Running maxima only: the furthest end so far with its group, and the furthest end of all other groups. The latter is
    the greatest of the ends that another group's stood above, and of those that led before the leading group changed."""
    order = Window.partitionBy("instrument").orderBy("start", "end", group)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct(F.col("end"), F.col(group).alias("g"))
    d = spans.withColumn("__was", F.max(own).over(before))
    d = d.withColumn("__top", F.greatest("__was", own))
    lost = F.when(F.col("__top.g") != F.col(group), F.col("end")).when(F.col("__was.g") != F.col("__top.g"), F.col("__was.end"))
    d = d.withColumn("__next", F.max(lost).over(before))
    other = F.when(F.col("__was.g") != F.col(group), F.col("__was.end")).otherwise(F.col("__next"))
    return d.where(other >= F.col("start")).drop("__was", "__top", "__next")


def industry_intervals(raw: DataFrame, basic: DataFrame, calendar: DataFrame) -> DataFrame:
    """industry, instrument, start and end of classification rows: instrument, industry, in_date and out_date (both ends
    belong to it; without an out_date it stays open).

    Cut to the calendar and to the instrument's listing, instruments that basic lacks go; runs of one industry that
    follow one another are joined. Two industries of an instrument on a trading day raise when read."""
    first, last = calendar.agg(F.min("datetime"), F.max("datetime")).head()
    if first is None:
        raise ValueError("the calendar is empty")
    listed = listing_intervals(basic, first, last).select("instrument", F.col("start").alias("__a"), F.col("end").alias("__b"))
    d = raw.join(listed, "instrument")
    d = d.select("industry", "instrument", F.greatest("in_date", "__a").alias("start"), F.least(F.coalesce("out_date", F.col("__b")), F.col("__b")).alias("end")).where("start <= end")
    # only trading days count, so that one that ends on a Saturday and one that begins on it do not meet
    runs = coalesce_intervals(d, calendar, ("industry", "instrument"))
    twice = overlaps(runs).select("instrument", "start", "end", "industry", F.lit(True).alias("__twice")).distinct()
    out = runs.join(twice, ["instrument", "start", "end", "industry"], "left")
    bad = fail("two industries at once:", "instrument").cast("string")
    return out.select(F.when(F.col("__twice"), bad).otherwise(F.col("industry")).alias("industry"), "instrument", "start", "end")


def listing_intervals(basic: DataFrame, first, last) -> DataFrame:
    """From listing to the day before delisting, within the calendar's ends."""
    a = F.greatest("list_date", F.lit(first).cast("date"))
    b = F.least(F.coalesce(F.date_sub("delist_date", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    return basic.select("instrument", a.alias("start"), b.alias("end")).where(F.col("start") <= F.col("end"))


def snapshots_to_intervals(snapshots: DataFrame, key: str = "index_code") -> DataFrame:
    """Members of each dated snapshot from its day to the day before the next; the last stays open."""
    days = snapshots.select(key, "datetime").distinct()
    nxt = days.withColumn("end", F.coalesce(F.date_sub(F.lead("datetime").over(Window.partitionBy(key).orderBy("datetime")), 1), F.lit(OPEN_END).cast("date")))
    return snapshots.select(key, "datetime", "instrument").distinct().join(nxt, [key, "datetime"]).select(key, "instrument", F.col("datetime").alias("start"), "end")


def build_calendar(exchanges: DataFrame, today) -> tuple[DataFrame, DataFrame]:
    """Open days of any exchange: those up to today, and all of them."""
    days = exchanges.where("is_open = 1").select("datetime").distinct()
    return days.where(F.col("datetime") <= F.lit(today).cast("date")), days


def mixed_date(c: Column) -> Column:
    """Of texts like 20240131, 2024-01-31 or 20240131.0."""
    s = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"))


def listing_snapshot(*parts: DataFrame) -> DataFrame:
    """Listed, delisted and paused instruments together; codes of six digits and an exchange, each once."""
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = d.where(F.col("ts_code").rlike(r"^\d{6}\.(SH|SZ|BJ)$")).dropDuplicates(["ts_code"])
    return d.withColumn("list_date", mixed_date(F.col("list_date"))).withColumn("delist_date", mixed_date(F.col("delist_date")))


def normalize_financial(raw: DataFrame, indicators: Sequence[str], until) -> DataFrame:
    """instrument, field, ann_date, period, value of wide announcements.

    Kept: quarter ends, announced on or after the period's end and up to a date; of one announcement of a
    period the highest update_flag, of which two different ones raise. An indicator without a value is a
    record that takes it back (NaN)."""
    end = F.col("end_date")
    quarter = (F.month(end) % 3 == 0) & (F.last_day(end) == end)
    d = raw.where(quarter & (F.col("ann_date") >= end) & (F.col("ann_date") <= F.lit(until).cast("date")))
    d = d.withColumn("period", F.year(end) * 100 + F.quarter(end)).select("instrument", "ann_date", "period", "update_flag", *indicators).distinct()
    keys = ["instrument", "ann_date", "period"]
    top = d.groupBy(*keys).agg(F.max("update_flag").alias("update_flag"))
    d = d.join(top, [*keys, "update_flag"])
    d = require_unique(d.drop("update_flag"), keys, "announcements")
    return d.unpivot(keys, list(indicators), "field", "value").select("instrument", "field", "ann_date", "period", F.coalesce("value", F.lit(float("nan"))).alias("value"))


def skipped(raw: DataFrame) -> DataFrame:
    """How many announcements precede their period's end, by reason."""
    early = F.when(F.col("ann_date") < F.col("end_date"), "announced_early").when(~((F.month("end_date") % 3 == 0) & (F.last_day("end_date") == F.col("end_date"))), "not_a_quarter")
    return raw.select(early.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def merge_revisions(old: DataFrame, new: DataFrame, keys: Sequence[str], asked: Sequence[str]) -> DataFrame:
    """Cached rows with newly fetched columns: of rows that are in new, the columns asked for come from it, missing ones too."""
    n = new.select(*keys, *(F.col(c).alias(f"__n_{c}") for c in asked), F.lit(True).alias("__new"))
    d = old.join(n, list(keys), "full_outer")
    cols = [F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in asked else F.col(c) for c in old.columns if c not in keys]
    return d.select(*keys, *cols)


def write_daily(daily: DataFrame, path: str) -> None:
    """Parquet by instrument and date, so that a scan of a few instruments skips the rest."""
    daily.repartition("instrument").sortWithinPartitions("instrument", "datetime").write.mode("overwrite").parquet(path)

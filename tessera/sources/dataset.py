"""A dataset folder of files, and the panel that they make.

calendars/day.txt and day_future.txt, instruments/<market>.txt, industry/<industry>.txt, industry_names.json (or
industry/names.csv), stock_basic.csv, features/<instrument>/<field>.day.bin and financial/ (Parquet of records). All
are read by Spark's file readers, so that the folder may lie on any file system that the cluster reads.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expression as E
from tessera.operators import filters as L
from tessera.operators.grid import VIRTUAL, Day, Panel, between, normal_code, with_positions
from tessera.sources import catalogs, files
from tessera.sources.etl import mixed_date


class Dataset:
    """missing: 'nan' (a field that an instrument has no file of is missing) or 'raise'. adjust: of prices.

    Calendars, intervals, basics and the catalog of fields are kept until clear_cache; daily columns are not. Results are
    not sorted: order them where they are shown."""

    def __init__(self, spark: SparkSession, root: str, missing: str = "nan", adjust: str = "hfq"):
        if missing not in ("nan", "raise"):
            raise ValueError("missing is nan or raise")
        if adjust not in ("none", "hfq", "qfq"):
            raise ValueError(f"no such adjustment: {adjust}")
        self.spark, self.root, self.missing, self.adjust = spark, root.rstrip("/"), missing, adjust
        self._kept: dict[str, DataFrame] = {}
        self.calendar()  # a wrong folder is told at once

    def _keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make().persist()
        return self._kept[name]

    def clear_cache(self) -> None:
        """To be called when the files have changed."""
        for d in self._kept.values():
            d.unpersist()
        self._kept.clear()

    def _listed(self, folder: str, glob: str) -> DataFrame | None:
        """path of each file below a folder that fits; None without that folder. Contents are not read."""
        try:
            return self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(f"{self.root}/{folder}").select("path")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _stems(self, folder: str) -> list[str]:
        found = self._listed(folder, "*.txt")
        return [] if found is None else sorted(r.path.rsplit("/", 1)[1].removesuffix(".txt") for r in found.collect())

    def _document(self, folder: str, name: str) -> str | None:
        found = self._listed(folder, name)
        if found is None or found.isEmpty():
            return None
        path = f"{self.root}/{folder}/{name}" if folder else f"{self.root}/{name}"
        return bytes(self.spark.read.format("binaryFile").load(path).select("content").head()[0]).decode("utf-8-sig")

    def calendar(self, start: Day = None, end: Day = None, future: bool = False) -> DataFrame:
        """datetime and pos of the trading days, or of those already fixed for the future too."""
        name = "day_future" if future else "day"

        def make() -> DataFrame:
            d = with_positions(files.read_calendar(self.spark, f"{self.root}/calendars/{name}.txt"))
            if d.isEmpty():
                raise ValueError("the calendar is empty")
            return d

        return between(self._keep(f"calendar/{name}", make), start, end)

    def markets(self) -> list[str]:
        return self._stems("instruments")

    def industries(self) -> list[str]:
        return self._stems("industry")

    def industry_names(self) -> dict[str, str]:
        """Label of each industry; those that the catalog lacks have their code. Read anew at each call."""
        text = self._document("", "industry_names.json") if self._listed("", "industry_names.json") is not None else None
        if text is not None:
            names = catalogs.labels_of_json(text)
        else:
            old = self._document("industry", "names.csv")
            names = {} if old is None else catalogs.labels_of_csv(old)
        return {c: names.get(c.upper(), c) for c in self.industries()}

    def intervals(self) -> DataFrame:
        """market, instrument, start, end of all markets and, as industry/<code>, industries."""

        def make() -> DataFrame:
            d = files.read_intervals(self.spark, f"{self.root}/instruments")
            if not self.industries():
                return d
            return d.unionByName(files.read_intervals(self.spark, f"{self.root}/industry").withColumn("market", F.concat(F.lit("industry/"), "market")))

        return self._keep("intervals", make)

    def stock_basic(self, instruments: Sequence[str] | None = None, fields: Sequence[str] | None = None) -> DataFrame:
        """Today's snapshot with its dates as dates; an instrument that stands twice raises."""

        def make() -> DataFrame:
            d = self.spark.read.option("header", True).csv(f"{self.root}/stock_basic.csv")
            d = d.withColumn("instrument", normal_code(F.col("ts_code")))
            for c in ("list_date", "delist_date"):
                if c in d.columns:
                    d = d.withColumn(c, mixed_date(F.col(c)))
            twice = d.groupBy("instrument").count().where("count > 1").head()
            if twice is not None:
                raise ValueError(f"stands twice: {twice.instrument}")
            return d

        d = self._keep("basic", make)
        if instruments is not None:
            d = d.where(F.col("instrument").isin(list(instruments)))
        return d if fields is None else d.select("instrument", *(f for f in fields if f != "instrument"))

    def _columns(self) -> DataFrame:
        """instrument and field of each daily file."""

        def make() -> DataFrame:
            found = self._listed("features", "*.day.bin")
            if found is None:
                return self.spark.createDataFrame([], "instrument string, field string")
            part = F.split("path", "/")
            return found.select(F.upper(F.element_at(part, -2)).alias("instrument"), F.regexp_replace(F.element_at(part, -1), r"\.day\.bin$", "").alias("field"))

        return self._keep("columns", make)

    def fields(self, kind: str = "daily", instrument: str | None = None) -> list[str]:
        """Names of the fields of a kind (daily, financial, stock_basic), or of those that one instrument has."""
        if kind == "stock_basic":
            return [c for c in self.stock_basic().columns if c != "instrument"]
        if kind not in ("daily", "financial"):
            raise ValueError(f"no such kind: {kind}")
        d = self._columns() if kind == "daily" else self.spark.read.parquet(f"{self.root}/financial")
        if instrument is not None:
            d = d.where(F.col("instrument") == normal_code(F.lit(instrument)))
        return sorted(r.field for r in d.select("field").distinct().collect())

    def panel(self, *names: str, adjust: str | None = None, end: Day = None) -> Panel:
        """The panel with the fields named; instruments are those that have a file of any field."""
        known = set(self.fields())
        real = [n for n in dict.fromkeys(names) if n not in VIRTUAL or n in known]
        unknown = [n for n in real if n not in known]
        if unknown:
            raise KeyError(f"no such field: {unknown[0]}")
        adjust = adjust or self.adjust
        if adjust != "none" and "factor" in known and "factor" not in real:
            real.append("factor")
        have = self._columns()
        if self.missing == "raise" and real:
            lacking = have.where(F.col("field").isin(real)).groupBy("instrument").count().where(F.col("count") == len(real))
            bad = have.select("instrument").distinct().join(lacking, "instrument", "left_anti").head()
            if bad is not None:
                raise FileNotFoundError(f"a field of {bad.instrument} has no file")
        cal = self.calendar()
        everyone = have.select("instrument").distinct()
        if real:
            daily = everyone.join(files.read_bins(self.spark, cal, f"{self.root}/features", real), "instrument", "left")
        else:
            daily = everyone.withColumn("datetime", F.lit(None).cast("date"))
        basic = self.stock_basic() if "list_days" in names else None
        return replace(Panel(cal, daily, self.intervals(), basic).with_adjust(adjust), end=end)

    @staticmethod
    def instruments(market: str = "all", filter_pipe: Sequence[L.Filter | dict] = ()) -> dict:
        """Describes a universe; nothing is read."""
        return {"market": market, "filter_pipe": list(filter_pipe)}

    def universe(self, instruments: str | Sequence[str] | Mapping = "all", start: Day = None, end: Day = None, fields: Sequence[str] = ()) -> DataFrame:
        """instrument, datetime and pos of a market, a list, given intervals or a description; fields: what its filters read."""
        filters: Sequence = ()
        if isinstance(instruments, Mapping) and "market" in instruments:
            instruments, filters = instruments["market"], instruments.get("filter_pipe", ())
        if isinstance(instruments, str) and instruments not in self.markets() and instruments.removeprefix("industry/") not in self.industries():
            raise KeyError(f"no such market: {instruments}")
        p = self.panel(*fields, end=end)
        return between(L.pipe(p, p.universe(instruments), filters), start, end)

    def features(self, instruments, expressions: Mapping[str, str], start: Day = None, end: Day = None, causal: bool = False, adjust: str | None = None) -> DataFrame:
        """Expressions on the days of a universe; see Panel.features."""
        names = sorted({n for v in expressions.values() for n in E.fields(v)})
        p = self.panel(*names, adjust=adjust, end=end)
        return p.features(expressions, self.universe(instruments, start, end), start, end, causal)


_default: Dataset | None = None


def init(spark: SparkSession, root: str, **options) -> Dataset:
    """Makes a dataset the one that current() gives."""
    global _default
    made = Dataset(spark, root, **options)
    if _default is not None:
        _default.clear_cache()
    _default = made
    return made


def current() -> Dataset:
    if _default is None:
        raise RuntimeError("call init first")
    return _default

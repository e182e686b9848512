"""Files: CSV tables, calendars and interval lists as text, daily columns as binary."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.grid import normal_code

_SAFE = re.compile(r"[A-Za-z0-9_.-]+")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share; a temporary one only where none is named."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{(where or f'file://{tempfile.gettempdir()}').rstrip('/')}/{name}"


def safe_path(*parts: str) -> str:
    """Parts joined; none may leave its folder."""
    for p in parts:
        for x in p.split("/"):
            if not _SAFE.fullmatch(x) or x in (".", ".."):
                raise ValueError(f"not a plain name: {p}")
    return "/".join(parts)


def read_table(spark: SparkSession, root: str, path: str, **equals: object) -> DataFrame:
    """A CSV table below a root, all columns as text, with rows whose text equals the values given."""
    d = spark.read.option("header", True).csv(f"{root}/{safe_path(path)}")
    for k, v in equals.items():
        d = d.where(F.col(k) == str(v))
    return d


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """datetime of a file of one ISO date a line; a repeated or unreadable date raises."""
    d = spark.read.text(path).where("trim(value) <> ''").select(F.to_date("value").alias("datetime"))
    bad = d.groupBy("datetime").count().where("count > 1 or datetime is null").head()
    if bad is not None:
        raise ValueError(f"a calendar has each date once: {bad.datetime}")
    return d


def read_intervals(spark: SparkSession, path: str, market: str | None = None) -> DataFrame:
    """market, instrument, start, end of lines 'code start end'; an inverted or incomplete one raises when read.

    Without a market, each file's name is its market."""
    part = F.split(F.trim("value"), r"\s+")
    named = F.lit(market) if market is not None else F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    d = spark.read.text(path, pathGlobFilter=None if market is not None else "*.txt").where("trim(value) <> ''")
    d = d.select(named.alias("market"), normal_code(part[0]).alias("instrument"), F.try_element_at(part, F.lit(2)).cast("date").alias("start"), F.try_element_at(part, F.lit(3)).cast("date").alias("end"))
    good = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") <= F.col("end"))
    return d.select("market", "instrument", F.when(good, F.col("start")).otherwise(F.raise_error(F.concat(F.lit("not an interval: "), "instrument")).cast("date")).alias("start"), "end")


def write_bin(daily: DataFrame, calendar: DataFrame, root: str, field: str) -> None:
    """One little-endian float32 file of an instrument: offset on the calendar, then consecutive values.

    An instrument's days go to one task as they make one file; the root is a folder that all executors share."""
    rows = daily.join(F.broadcast(calendar), "datetime").select("instrument", (F.col("pos") - 1).cast("int").alias("at"), F.col(field).cast("double").alias("value"))

    def put(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        lo, hi = int(pdf["at"].min()), int(pdf["at"].max())
        out = np.full(hi - lo + 2, np.nan, "<f4")
        out[0] = lo
        out[pdf["at"].to_numpy() - lo + 1] = pdf["value"].to_numpy()
        folder = f"{root}/{safe_path(key[0].lower())}"
        os.makedirs(folder, exist_ok=True)
        out.tofile(f"{folder}/{field}.day.bin.tmp{os.getpid()}")
        os.replace(f"{folder}/{field}.day.bin.tmp{os.getpid()}", f"{folder}/{field}.day.bin")
        return pd.DataFrame({"n": [len(pdf)]})

    rows.groupBy("instrument").applyInPandas(put, "n long").agg(F.sum("n")).collect()


def read_bins(spark: SparkSession, calendar: DataFrame, root: str, fields: Sequence[str]) -> DataFrame:
    """instrument, datetime and the fields of binary daily files, read by Spark's own file reader in one pass.

    A file of another size, or one that leaves the calendar, raises."""
    n = calendar.count()

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                v = np.frombuffer(content, "<f4") if len(content) % 4 == 0 else np.zeros(0, "<f4")
                if len(v) < 1 or not v[0] >= 0 or v[0] != int(v[0]) or v[0] + len(v) - 1 > n:
                    raise ValueError(f"not a daily column: {path}")
                code, name = path.split("/")[-2:]
                yield pd.DataFrame({"instrument": code.upper(), "field": name.removesuffix(".day.bin"), "pos": v[0] + 1 + np.arange(len(v) - 1, dtype=float), "value": v[1:].astype(float)})

    glob = "{" + ",".join(safe_path(f) for f in fields) + "}.day.bin"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "content")
    d = files.mapInPandas(decode, "instrument string, field string, pos double, value double")
    value = F.when(~F.isnan("value"), F.col("value"))
    d = d.groupBy("instrument", "pos").agg(*(F.max(F.when(F.col("field") == f, value)).alias(f) for f in fields))
    return d.join(F.broadcast(calendar), "pos").select("instrument", "datetime", *fields)


def read_bin(spark: SparkSession, calendar: DataFrame, root: str, field: str) -> DataFrame:
    return read_bins(spark, calendar, root, [field])

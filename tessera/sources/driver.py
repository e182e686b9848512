"""Panels made of the driver's star schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.grid import Panel, with_positions


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Bars of each user and day, of value / pi so that no rounding meets a tie. factor steps up every ten calendar rows, faster for even users."""
    ev = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") * 0.3183098861837907).alias("value"), "event_type", F.to_date("ts").alias("datetime"))
    at = F.struct("ts", "event_id")
    daily = ev.groupBy(F.col("user_id").cast("string").alias("instrument"), "datetime").agg(
        F.min_by("value", at).alias("open"),
        F.max_by("value", at).alias("close"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.sum("value").alias("amount"),
        F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("error"),
    )
    calendar = with_positions(ev)
    step = F.floor((F.col("pos") - 1) / 10) * F.when(F.col("instrument").cast("long") % 2 == 0, 0.5).otherwise(0.25)
    daily = daily.join(F.broadcast(calendar), "datetime").withColumn("vwap", F.col("amount") / F.col("volume")).withColumn("factor", 1 + step)
    seen = daily.groupBy("instrument").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    members = seen.select(F.lit("all").alias("market"), "instrument", "start", "end")
    st = daily.where("error = 1").select(F.lit("st").alias("market"), "instrument", F.col("datetime").alias("start"), F.col("datetime").alias("end"))
    cust = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("instrument"), "c_mktsegment", "c_acctbal", "c_name")
    industry = seen.join(cust, "instrument").select(F.concat(F.lit("industry/"), "c_mktsegment").alias("market"), "instrument", "start", "end")
    basic = seen.join(cust, "instrument", "left").select("instrument", F.col("c_name").alias("name"), F.col("start").alias("list_date"), F.when(F.col("instrument").cast("long") % 7 == 0, F.date_add("end", 1)).alias("delist_date"))
    cap = cust.select("instrument", F.col("c_acctbal").alias("cap"))
    return Panel(calendar, daily.drop("pos", "error"), members.unionByName(st).unionByName(industry), basic, extra={"cap": cap})


def pit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements: instrument, field, ann_date, period (YYYYQQ), value; the last of equal keys stays."""
    o = read(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    before = F.add_months("d", -3)
    rows = o.select(F.col("o_custkey").cast("string").alias("instrument"), F.lower("o_orderstatus").alias("field"), F.col("d").alias("ann_date"), (F.year(before) * 100 + F.quarter(before)).alias("period"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    from tessera.operators.pit import keep_last

    return keep_last(rows)

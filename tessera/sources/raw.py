"""Raw CSV tables of a download folder, by name and what is asked of them. A missing file raises; nothing is downloaded.

A table is a rule: where its files lie, which of the asked values must equal a column, and which column lies in the
asked range of days. All columns are texts, so that codes keep their zeros.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import safe_path


@dataclass(frozen=True)
class Rule:
    """path: of the asked values in braces. equal: asked name to column. between: column of start_date to end_date.
    rename: the columns read, with their new names; of such a table each row counts once."""

    path: str
    equal: Mapping[str, str] = field(default_factory=dict)
    between: str | None = None
    rename: Mapping[str, str] | None = None


#: Names of tables, and of the files and columns that answer for them.
BY_DAY = ("daily", "adj_factor", "daily_basic", "stock_st", "stk_limit")
RULES = {
    **{t: Rule(t + "/{trade_date}.csv") for t in BY_DAY},
    "index_weight": Rule("index_weight/{index_code}/{start_month}.csv", between="trade_date"),
    "fina_indicator_vip": Rule("financial/fina_indicator/{period_month}.csv", {"period": "end_date"}),
    "stock_basic": Rule("stock_basic.csv", {"list_status": "list_status"}),
    "trade_cal": Rule("trade_cal.csv", {"exchange": "exchange"}, "cal_date"),
    "index_classify": Rule("industry.csv", rename={"l1_code": "index_code", "l1_name": "industry_name"}),
    "index_member_all": Rule("industry.csv", {"l1_code": "l1_code", "is_new": "is_new"}),
}


class RawTables:
    def __init__(self, spark: SparkSession, root: str, rules: Mapping[str, Rule] | None = None):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), {**RULES, **(rules or {})}

    def fetch(self, table: str, fields: str | None = None, **asked: str) -> DataFrame:
        """The rows that fit, with the columns named in fields (comma-joined) that there are, or all of them.

        A table without a rule is the whole of its file. A value that a rule needs and that isn't asked raises."""
        rule = self.rules.get(table, Rule(safe_path(f"{table}.csv")))
        months = {f"{n}_month": asked[k][:6] for n, k in (("start", "start_date"), ("period", "period")) if k in asked}
        d = self.spark.read.option("header", True).csv(f"{self.root}/{safe_path(rule.path.format_map({**asked, **months}))}")
        for name, column in rule.equal.items():
            d = d.where(F.col(column) == F.lit(asked[name]))
        if rule.between is not None:
            d = d.where(F.col(rule.between).between(asked["start_date"], asked["end_date"]))
        if rule.rename is not None:
            d = d.select(*(F.col(a).alias(b) for a, b in rule.rename.items())).distinct()
        return d if fields is None else d.select(*(c for c in fields.split(",") if c in d.columns))

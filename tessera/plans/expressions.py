"""One query for each operator of the expression language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expression import INF
from tessera.plans.catalog import query
from tessera.sources.driver import events_panel

#: The events panel in DuckDB: d observed, cal, ins, g dense.
GRID = """WITH d AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS datetime, first(value * 0.3183098861837907 ORDER BY ts, event_id) AS open,
  last(value * 0.3183098861837907 ORDER BY ts, event_id) AS close, max(value * 0.3183098861837907) AS high, min(value * 0.3183098861837907) AS low, CAST(count(*) AS DOUBLE) AS volume, sum(value * 0.3183098861837907) AS amount,
  max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error FROM events GROUP BY 1, 2),
cal AS (SELECT datetime, CAST(row_number() OVER (ORDER BY datetime) AS DOUBLE) AS pos FROM (SELECT DISTINCT datetime FROM d)),
ins AS (SELECT DISTINCT instrument FROM d),
g AS (SELECT i.instrument, c.datetime, c.pos, d.open, d.high, d.low, d.close, d.volume, d.amount, d.amount / d.volume AS vwap, d.error,
  CASE WHEN d.close IS NOT NULL THEN 1 + floor((c.pos - 1) / 10) * CASE WHEN CAST(i.instrument AS BIGINT) % 2 = 0 THEN 0.5 ELSE 0.25 END END AS factor
  FROM ins i CROSS JOIN cal c LEFT JOIN d ON d.instrument = i.instrument AND d.datetime = c.datetime)"""
WINDOWS = """WINDOW w AS (PARTITION BY instrument ORDER BY pos), w5 AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
e AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def rounded(c: Column, digits: int) -> Column:
    """As DuckDB rounds doubles: the scaled value to a whole number, halves away from zero. (Spark rounds the decimal text.)"""
    y = c * 10.0**digits
    near = F.rint(y)
    whole = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near)
    return F.when(F.abs(y) < INF, whole / 10.0**digits).otherwise(c)


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that two engines' sums agree."""
    return df.select(*(rounded(F.col(c), digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def expression_query(name: str, text: str, sql: str, boolean: bool = False) -> None:
    value = sql if boolean else f"round({sql}, 4)"

    @query(name, f"{GRID} SELECT instrument, datetime, {value} AS value FROM g {WINDOWS}")
    def run(spark, sf_dir):
        return tidy(events_panel(spark, sf_dir).features({"value": text}))


SHIFT = "($close - 7)"
S = "(close - 7)"
POINTWISE = {
    "abs": (f"Abs({SHIFT})", f"abs({S})"),
    "sign": (f"Sign({SHIFT})", f"CAST(sign({S}) AS DOUBLE)"),
    "log": ("Log($close)", "CASE WHEN close > 0 THEN ln(close) END"),
    "exp": ("Exp($close / 100)", "exp(close / 100)"),
    "sqrt": (f"Sqrt({SHIFT})", f"CASE WHEN {S} >= 0 THEN sqrt({S}) END"),
    "power": ("Power($close, 2)", "close * close"),
    "power_missing": ("Power($close, 0) + 1 ** $close", "CAST(2 AS DOUBLE)"),
    "add": ("Add($close, $open)", "close + open"),
    "sub": ("Sub($close, $open)", "close - open"),
    "mul": ("Mul($close, $open)", "close * open"),
    "div": ("Div($close, $volume - 1)", "CASE WHEN volume <> 1 THEN close / nullif(volume - 1, 0) END"),
    "greater": ("Greater($close, 7)", "CASE WHEN close IS NOT NULL THEN greatest(close, 7) END"),
    "less": ("Less($close, $open)", "CASE WHEN close IS NOT NULL THEN least(close, open) END"),
    "if": ("If($close > $open, $high, $low)", "CASE WHEN coalesce(close > open, false) THEN high ELSE low END"),
    "if_missing": ("If($close, 1, 2)", "CASE WHEN close IS NULL OR close <> 0 THEN CAST(1 AS DOUBLE) ELSE 2 END"),
    "clip": ("Clip($close, 3, 11)", "CASE WHEN close IS NOT NULL THEN least(greatest(close, 3), 11) END"),
    "mod": (f"{SHIFT} % 3", f"{S} - floor({S} / 3) * 3"),
    "neg": ("-$close", "-close"),
    "nested_expr": ("Mean(Delta($close, 1) / Ref($close, 1), 5) - 1", "avg(r) OVER w5 - 1"),
}
BOOLEAN = {
    "gt": ("Gt($close, $open)", "coalesce(close > open, false)"),
    "ge": ("$close >= 7", "coalesce(close >= 7, false)"),
    "lt": ("$close < $open", "coalesce(close < open, false)"),
    "le": ("Le($close, 7)", "coalesce(close <= 7, false)"),
    "eq": ("$volume == 1", "coalesce(volume = 1, false)"),
    "ne": ("Ne($volume, 1)", "coalesce(volume <> 1, true)"),
    "and": ("And($close > 7, $volume > 1)", "coalesce(close > 7, false) AND coalesce(volume > 1, false)"),
    "or": ("$close > 7 or $volume != 1", "coalesce(close > 7, false) OR coalesce(volume <> 1, true)"),
    "not": ("~($close > 7)", "NOT coalesce(close > 7, false)"),
    "not_missing": ("Not($close)", "coalesce(close = 0, false)"),
    "isnull": ("IsNull($close)", "close IS NULL"),
    "isinf": ("IsInf(1 / ($volume - 1))", "coalesce(volume = 1, false)"),
    "chained_compare": ("3 < $close <= 11", "coalesce(3 < close, false) AND coalesce(close <= 11, false)"),
}
VARIED = "min({x}) OVER {w} < max({x}) OVER {w}"
ROLLING = {
    "mean": ("Mean($close, {n})", "avg(close) OVER {w}"),
    "sum": ("Sum($close, {n})", "sum(close) OVER {w}"),
    "std": ("Std($close, {n})", "stddev_samp(close) OVER {w}"),
    "var": ("Var($close, {n})", "var_samp(close) OVER {w}"),
    "max": ("Max($close, {n})", "max(close) OVER {w}"),
    "min": ("Min($close, {n})", "min(close) OVER {w}"),
    "med": ("Med($close, {n})", "median(close) OVER {w}"),
    "skew": ("Skew($close, {n})", "CASE WHEN count(close) OVER {w} < 3 THEN NULL WHEN min(close) OVER {w} = max(close) OVER {w} THEN 0 ELSE skewness(close) OVER {w} END"),
    "kurt": ("Kurt($close, {n})", "CASE WHEN count(close) OVER {w} < 4 THEN NULL WHEN min(close) OVER {w} = max(close) OVER {w} THEN -3 ELSE kurtosis(close) OVER {w} END"),
    "count": ("Count($close, {n})", "CAST(count(close) OVER {w} AS DOUBLE)"),
    "wma": ("WMA($close, {n})", "(sum(close * pos) OVER {w} - (min(pos) OVER {w} - 1) * sum(close) OVER {w}) / nullif(sum(CASE WHEN close IS NOT NULL THEN pos END) OVER {w} - (min(pos) OVER {w} - 1) * count(close) OVER {w}, 0)"),
    "quantile": ("Quantile($close, {n}, 0.25)", "quantile_cont(close, 0.25) OVER {w}"),
    "corr": ("Corr($close, $volume, {n})", "CASE WHEN min(close) OVER {w} < max(close) OVER {w} AND min(volume) OVER {w} < max(volume) OVER {w} THEN covar_pop(close, volume) OVER {w} / nullif(stddev_pop(close) OVER {w} * stddev_pop(volume) OVER {w}, 0) END"),
    "cov": ("Cov($close, $volume, {n})", "covar_samp(close, volume) OVER {w}"),
    "rank": ("Rank($volume, {n})", "CASE WHEN volume IS NOT NULL THEN (len(list_filter(list(volume) OVER {w}, lambda v: v < volume)) + (len(list_filter(list(volume) OVER {w}, lambda v: v = volume)) + 1) / 2.0) / count(volume) OVER {w} END"),
    "idxmax": ("IdxMax($volume, {n})", "CASE WHEN count(volume) OVER {w} > 0 THEN CAST(list_position(list(volume) OVER {w}, max(volume) OVER {w}) AS DOUBLE) END"),
    "idxmin": ("IdxMin($volume, {n})", "CASE WHEN count(volume) OVER {w} > 0 THEN CAST(list_position(list(volume) OVER {w}, min(volume) OVER {w}) AS DOUBLE) END"),
    "slope": ("Slope($close, {n})", "CASE WHEN count(close) OVER {w} > 1 THEN covar_pop(close, CASE WHEN close IS NOT NULL THEN pos END) OVER {w} / nullif(var_pop(CASE WHEN close IS NOT NULL THEN pos END) OVER {w}, 0) END"),
    "rsquare": ("Rsquare($close, {n})", "CASE WHEN min(close) OVER {w} < max(close) OVER {w} THEN power(covar_pop(close, CASE WHEN close IS NOT NULL THEN pos END) OVER {w}, 2) / nullif(var_pop(CASE WHEN close IS NOT NULL THEN pos END) OVER {w} * var_pop(close) OVER {w}, 0) END"),
    "resi": ("Resi($close, {n})", "CASE WHEN count(close) OVER {w} > 1 THEN close - avg(close) OVER {w} - covar_pop(close, CASE WHEN close IS NOT NULL THEN pos END) OVER {w} / nullif(var_pop(CASE WHEN close IS NOT NULL THEN pos END) OVER {w}, 0) * (pos - avg(CASE WHEN close IS NOT NULL THEN pos END) OVER {w}) END"),
}

for _k, (_t, _s) in POINTWISE.items():
    if _k != "nested_expr":
        expression_query(_k, _t, _s)
for _k, (_t, _s) in BOOLEAN.items():
    expression_query(_k, _t, _s, True)
for _k, (_t, _s) in ROLLING.items():
    expression_query(_k, _t.format(n=5), _s.format(w="w5"))
    expression_query(f"{_k}_expanding", _t.format(n=0), _s.format(w="e"))
expression_query("ref_past", "Ref($close, 2)", "lag(close, 2) OVER w")
expression_query("ref_future", "Ref($close, -2)", "lead(close, 2) OVER w")
expression_query("ref_first", "Ref($close, 0)", "first_value(close) OVER e")
expression_query("delta", "Delta($close, 1)", "close - lag(close, 1) OVER w")

EMA_SQL = """, v AS (SELECT a.instrument, a.datetime, a.pos, sum(b.close * power(1 - {alpha}, a.pos - b.pos)) / sum(power(1 - {alpha}, a.pos - b.pos)) AS m
  FROM g a JOIN g b ON a.instrument = b.instrument AND b.pos <= a.pos AND b.close IS NOT NULL WHERE a.close IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.instrument, g.datetime, round(last_value(v.m IGNORE NULLS) OVER (PARTITION BY g.instrument ORDER BY g.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value
FROM g LEFT JOIN v ON v.instrument = g.instrument AND v.pos = g.pos"""


@query("ema", GRID + EMA_SQL.format(alpha="CAST(1 AS DOUBLE) / 3"))
def ema(spark, sf_dir):
    return tidy(events_panel(spark, sf_dir).features({"value": "EMA($close, 5)"}))


@query("ema_alpha", GRID + EMA_SQL.format(alpha="CAST(0.25 AS DOUBLE)"))
def ema_alpha(spark, sf_dir):
    return tidy(events_panel(spark, sf_dir).features({"value": "EMA($close, 0.25)"}))


@query("nested_expr", f"""{GRID}, r AS (SELECT *, (close - lag(close, 1) OVER w) / nullif(lag(close, 1) OVER w, 0) AS r FROM g {WINDOWS})
SELECT instrument, datetime, round(avg(r) OVER w5 - 1, 4) AS value FROM r {WINDOWS}""")  # fmt: skip
def nested(spark, sf_dir):
    return tidy(events_panel(spark, sf_dir).features({"value": POINTWISE["nested_expr"][0]}))


@query("factor_momentum", f"""{GRID}, m AS (SELECT instrument, min(datetime) AS a, max(datetime) AS b FROM d GROUP BY 1),
x AS (SELECT instrument, datetime, close * factor AS close, avg(close * factor) OVER w5 AS m5 FROM g {WINDOWS})
SELECT x.instrument, datetime, round(m5 / nullif(close, 0) - 1, 4) AS value FROM x JOIN m ON m.instrument = x.instrument AND datetime BETWEEN a AND b""")  # fmt: skip
def momentum(spark, sf_dir):
    """Five-day mean over the adjusted price, on members' dates."""
    p = events_panel(spark, sf_dir).with_adjust("hfq")
    return tidy(p.features({"value": "Mean($close, 5) / $close - 1"}, p.universe("all")))


@query("history_pruned", f"""{GRID}, x AS (SELECT instrument, datetime, pos, avg(close) OVER w5 AS value FROM g {WINDOWS})
SELECT instrument, datetime, round(value, 4) AS value FROM x WHERE datetime BETWEEN DATE '2024-01-15' AND DATE '2024-01-20'""")  # fmt: skip
def history_pruned(spark, sf_dir):
    """A range of dates: only the rows that the window reaches are laid out."""
    return tidy(events_panel(spark, sf_dir).features({"value": "Mean($close, 5)"}, None, "2024-01-15", "2024-01-20"))

"""Queries of strategies, execution rules, risk and simulated portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expression import quotient
from tessera.operators import portfolio as P
from tessera.plans.catalog import query
from tessera.plans.expressions import GRID, WINDOWS, rounded, tidy
from tessera.sources.driver import events_panel

SCORES = f"{GRID}, s AS (SELECT instrument, datetime, avg(close) OVER w5 AS score FROM g {WINDOWS})"


def scores(spark, sf_dir):
    return events_panel(spark, sf_dir).features({"score": "Mean($close, 5)"}, causal=True)


def bars(spark, sf_dir):
    return events_panel(spark, sf_dir).dense("open", "close", "volume", "factor").drop("pos")


def weights_query(name: str, k: int, n: int) -> None:
    @query(name, f"""{SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS r FROM s WHERE score IS NOT NULL),
    t AS (SELECT datetime FROM cal WHERE (pos - 1) % {n} = 0)
    SELECT datetime, instrument, round(0.95 / count(*) OVER (PARTITION BY datetime), 6) AS weight FROM r JOIN t USING (datetime) WHERE r <= {k}""")  # fmt: skip
    def run(spark, sf_dir):
        return tidy(P.check_weights(P.topk_weights(scores(spark, sf_dir), k, n)), 6)


weights_query("weights_topk", 20, 1)
weights_query("weights_rebalance", 10, 5)

MEAN = f"{GRID}, m AS (SELECT datetime, avg(close / open - 1) AS r FROM g GROUP BY 1)"


def mean_returns(spark, sf_dir):
    d = events_panel(spark, sf_dir).daily.groupBy("datetime").agg(F.avg(quotient(F.col("close"), F.col("open")) - 1).alias("r"))
    return d.select("datetime", (F.col("r") / 50).alias("return"), F.lit("all").alias("run"))


NET = f"{MEAN}, n AS (SELECT datetime, r / 50 AS r, exp(sum(ln(1 + r / 50)) OVER (ORDER BY datetime)) AS net FROM m), k AS (SELECT *, net / greatest(max(net) OVER (ORDER BY datetime), 1) - 1 AS dd FROM n)"


@query("drawdown", f"{NET} SELECT datetime, round(dd, 6) AS drawdown FROM k")
def drawdown(spark, sf_dir):
    from pyspark.sql.window import Window

    d = mean_returns(spark, sf_dir).withColumn("net", F.exp(F.sum(F.log1p("return")).over(Window.partitionBy("run").orderBy("datetime"))))
    return tidy(P.drawdown(d, "net", ["run"]).select("datetime", "drawdown"), 6)


@query("risk_analysis", f"""{NET} SELECT round(exp(sum(ln(1 + r))) - 1, 6) AS total_return, round(power(exp(sum(ln(1 + r))), 252.0 / count(r)) - 1, 4) AS annualized_return,
round(stddev_samp(r) * sqrt(252), 6) AS annualized_volatility, round(avg(r) * 252 / (stddev_samp(r) * sqrt(252)), 4) AS sharpe, round(min(dd), 6) AS max_drawdown, round(avg(CAST(r > 0 AS DOUBLE)), 6) AS win_rate FROM k""")  # fmt: skip
def risk_analysis(spark, sf_dir):
    d = P.risk_analysis(mean_returns(spark, sf_dir), ["run"]).drop("run")
    return d.select(*(rounded(F.col(c), 4 if c in ("annualized_return", "sharpe") else 6).alias(c) for c in d.columns))


PREV = f"""{GRID}, l AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM g),
p AS (SELECT l.*, o.close * CASE WHEN o.factor > 0 AND l.factor > 0 THEN o.factor / l.factor ELSE 1 END AS prev_close FROM l LEFT JOIN g o ON o.instrument = l.instrument AND o.pos = l.lp)"""


@query("previous_close", f"{PREV} SELECT instrument, datetime, round(prev_close, 4) AS prev_close FROM p")
def previous_close(spark, sf_dir):
    return tidy(P.previous_close(bars(spark, sf_dir)).select("instrument", "datetime", "prev_close"))


def _reason(buy: bool) -> str:
    bound, at, name = ("prev_close * 1.1", "open >= prev_close * CAST(1.1 AS DOUBLE) - 1e-8", "limit_up") if buy else ("prev_close * 0.9", "open <= prev_close * CAST(0.9 AS DOUBLE) + 1e-8", "limit_down")
    return f"CASE WHEN NOT coalesce(open > 0 AND volume > 0, false) THEN 'suspended' WHEN NOT coalesce(close > 0, false) THEN 'missing_close' WHEN {bound} IS NULL THEN 'missing_limit_reference' WHEN {at} THEN '{name}' END"


@query("block_reason", f"{PREV} SELECT instrument, datetime, {_reason(True)} AS buy_block, {_reason(False)} AS sell_block FROM p")
def block_reason(spark, sf_dir):
    return P.prepare(bars(spark, sf_dir), P.Exchange(limit_threshold=0.1)).select("instrument", "datetime", "buy_block", "sell_block")


RULES = P.Exchange(cash=100_000.0, lot=1.0, limit_threshold=None)


@query("backtest_weight")
def backtest_weight(spark, sf_dir):
    """Top twenty every five days, the report of each date."""
    w = P.topk_weights(scores(spark, sf_dir), 20, 5).withColumn("run", F.lit("top20"))
    return tidy(P.report(P.simulate(bars(spark, sf_dir), w, RULES)))


def dropout(spark, sf_dir, plans: dict[str, P.Dropout]):
    d = scores(spark, sf_dir).where("score is not null").withColumn("run", F.explode(F.array(*(F.lit(k) for k in plans))))
    return P.simulate(bars(spark, sf_dir), d, RULES, plans)


@query("backtest_dropout")
def backtest_dropout(spark, sf_dir):
    return tidy(P.report(dropout(spark, sf_dir, {"50-5": P.Dropout(50, 5, only_tradable=True)})))


@query("backtest_orders")
def backtest_orders(spark, sf_dir):
    d = dropout(spark, sf_dir, {"20-2": P.Dropout(20, 2)})
    return tidy(d.where("kind = 'order'").select("datetime", "instrument", "side", F.col("quantity").alias("requested"), F.col("price").alias("filled"), F.col("note").alias("status")))


@query("parameter_sweep")
def parameter_sweep(spark, sf_dir):
    """Three configurations side by side: the risk of each."""
    plans = {f"{k}-{n}": P.Dropout(k, n) for k, n in ((20, 2), (50, 5), (100, 10))}
    return tidy(P.risk_analysis(P.report(dropout(spark, sf_dir, plans)), ["run"]))


@query("signal_scores", f"""{SCORES}, m AS (SELECT instrument, min(datetime) AS a, max(datetime) AS b FROM d GROUP BY 1)
SELECT s.instrument, s.datetime, CASE WHEN s.datetime BETWEEN a AND b THEN round(score, 4) END AS score FROM s JOIN m ON m.instrument = s.instrument""")  # fmt: skip
def signal_scores(spark, sf_dir):
    p = events_panel(spark, sf_dir)
    return tidy(P.signal_scores(scores(spark, sf_dir), p.universe("all"), p.calendar))

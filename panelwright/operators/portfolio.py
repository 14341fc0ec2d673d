"""Trade costs, sizes and returns of set-based portfolios. No order book is simulated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions.scalar import ratio
from panelwright.operators.score import top_k

FEE, MIN_FEE, STAMP = 0.0003, 5.0, 0.0005


def trade_cost(size: Column, price: Column) -> Column:
    """Fee of a trade, at least 5; sales (negative size) pay stamp duty too; 0 for no trade."""
    value = F.abs(size) * price
    fee = F.greatest(value * FEE, F.lit(MIN_FEE))
    return F.when(size > 0, fee).when(size < 0, fee + value * STAMP).otherwise(F.lit(0.0))


def lot_size(cash: Column, slots: Column, price: Column, volume: Column) -> Column:
    """Shares to buy in whole lots of 100 with 98 % of a slot's cash, at most 2 % of the traded volume (in lots); 0 if under a lot."""
    budget = F.floor(ratio(cash / slots * 0.98, price) / 100) * 100
    cap = volume * 100 * 0.02
    capped = F.when(budget > cap, F.floor(cap / 100) * 100).otherwise(budget)
    return F.when((price > 0) & (volume > 0) & (budget >= 100), capped).otherwise(F.lit(0)).cast("long")


def cohort_returns(predictions: DataFrame, k: int = 5, cash: float = 1e6) -> DataFrame:
    """(date, gross, net, n): mean forward return of the k best of each date, equal weights, before and after costs.

    Needs code, date, score, target and close. Each position is bought and sold once, for cash / k.
    """
    picks = top_k(predictions.where(F.col("target").isNotNull()), k)
    stake = cash / k
    cost = (trade_cost(stake / F.col("close"), F.col("close")) + trade_cost(-stake * (1 + F.col("target")) / F.col("close"), F.col("close"))) / stake
    return picks.groupBy("date").agg(F.avg("target").alias("gross"), F.avg(F.col("target") - cost).alias("net"), F.count("*").alias("n"))


def portfolio_returns(values: DataFrame, cash: float = 1e6) -> DataFrame:
    """(date, value, ret): change of the account's value; the first date against the initial cash. One row a date."""
    before = F.coalesce(F.lag("value").over(Window.orderBy("date")), F.lit(cash))
    return values.select("date", "value", (ratio(F.col("value"), before) - 1).alias("ret"))


def portfolio_summary(values: DataFrame, cash: float = 1e6) -> DataFrame:
    """(final_value, profit_rate)."""
    last = F.max_by("value", "date")
    return values.agg(last.alias("final_value"), (last / cash - 1).alias("profit_rate"))


def trade_summary(trades: DataFrame, profit: str = "profit") -> DataFrame:
    """(closed, won, win_share, total_profit) of closed trades; the share is 0 without any."""
    n, won = F.count(profit), F.count_if(F.col(profit) > 0)
    return trades.agg(
        n.alias("closed"), won.alias("won"), F.coalesce(F.try_divide(won, n), F.lit(0.0)).alias("win_share"), F.coalesce(F.sum(profit), F.lit(0.0)).alias("total_profit")
    )

"""Scores, picks and advice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def composite_score(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``score``: mean of the ``cs_rank_*`` columns that have a value."""
    columns = [c for c in panel.columns if c.startswith("cs_rank_")] if columns is None else list(columns)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    n = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    return panel.withColumn("score", F.try_divide(total, n.cast("double")))


def batch_score(samples: DataFrame, score: Callable[[np.ndarray], np.ndarray], batch: int = 2048, window: str = "past_values") -> DataFrame:
    """(code, end_date, score): a user's function over batches of windows, an array (batch, bars, features) each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                values = np.stack([np.stack(list(x)) for x in part[window]]).astype(np.float32)
                yield pd.DataFrame({"code": part["code"], "end_date": part["end_date"], "score": np.asarray(score(values), np.float64)})

    return samples.select("code", "end_date", window).mapInPandas(run, "code string, end_date date, score double")


def top_k(predictions: DataFrame, k: int = 5, score: str = "score") -> DataFrame:
    """The k best of each date, ``place`` from 1; ties go to the smaller code."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "code"))
    return predictions.where(F.col(score).isNotNull()).withColumn("place", place.cast("long")).where(F.col("place") <= k)


def advice(picks: DataFrame, regime: str = "regime", pe: str = "pe_ttm") -> DataFrame:
    """``advice`` and a printable ``pe``. All picks stay; a weak score has the last word."""
    text = F.when(F.col("score") < 0.6, "watch").when(F.col(regime) == "Bear", "cautious").otherwise("buy")
    shown = F.when(F.col(pe).isNull() | (F.col(pe) == 0), "-").otherwise(F.regexp_replace(F.format_number(F.col(pe), 2), ",", ""))
    return picks.withColumns({"advice": text, "pe": shown})


def last_n(panel: DataFrame, n: int) -> DataFrame:
    """The last n rows of each code."""
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    return panel.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")

"""Windows of bars as samples for a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType
from pyspark.sql.window import Window

from panelwright.functions.moving import windows
from panelwright.functions.ts import by_code, in_order


def _windows(panel: DataFrame, features: Sequence[str], length: int, keep, label: Column | None, ends: tuple[Column, Column] | None = None) -> DataFrame:
    """Whole windows of ``length`` bars that start at the bars for which ``keep`` (index, bars of the code) holds.

    Positions are those of the rows as given. Features must not be NULL. Tasks go over the bars in order and gather a window at its
    last bar, so no bar becomes several rows. With ``ends`` only windows that end between these dates are made,
    and bars that are in none of them go nowhere.
    """
    rows = panel.withColumns({"_i": F.row_number().over(by_code()) - 1, "_n": F.count("*").over(Window.partitionBy("code"))})
    if ends:
        ahead = F.lead("date", length - 1).over(by_code())
        rows = rows.withColumn("_ahead", ahead).where((F.col("date") <= ends[1]) & (F.col("_ahead").isNull() | (F.col("_ahead") >= ends[0]))).drop("_ahead")
    first = F.col("_i") - (length - 1)  # where the window that ends here starts
    kept = (first >= 0) & keep(first, F.col("_n"))
    if ends:
        kept = kept & F.col("date").between(*ends)
    columns = dict.fromkeys(("code", "date", *features))
    rows = rows.select(*columns, F.coalesce(kept, F.lit(False)).alias("_keep"), *([label.alias("_label")] if label is not None else []))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [("code", kinds["code"]), ("start_date", kinds["date"]), ("end_date", kinds["date"]), ("past_values", ArrayType(ArrayType(FloatType())))]
    schema = StructType([StructField(*f) for f in [*fields, *([("label", kinds["_label"])] if label is not None else [])]])
    return in_order(rows).mapInArrow(windows(list(features), "code", length, label is not None, schema.names), schema)


def training_windows(panel: DataFrame, features: Sequence[str], length: int = 30, stride: int = 5) -> DataFrame:
    """Windows at every ``stride``-th bar of codes with more than ``length`` bars; label at the last bar, 0.5 if NULL.

    The label is ``rank_label`` if there is one, else ``target``.
    """
    label = F.coalesce(F.col("rank_label" if "rank_label" in panel.columns else "target"), F.lit(0.5))
    return _windows(panel, features, length, lambda i, n: (n > length) & (i % stride == 0) & (i + length <= n), label)


def date_split(samples: DataFrame, panel: DataFrame, share: float = 0.9) -> DataFrame:
    """``split``: train for windows that end before the date at ``share`` of the panel's distinct dates, else test."""
    dates = panel.select("date").distinct()
    total = dates.agg(F.floor(F.count("*") * share).alias("at"))
    numbered = dates.withColumn("_k", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    cut = numbered.join(F.broadcast(total), F.col("_k") == F.col("at")).select(F.col("date").alias("_cut"))
    return samples.join(F.broadcast(cut)).withColumn("split", F.when(F.col("end_date") < F.col("_cut"), "train").otherwise("test")).drop("_cut")  # one row


def shuffled(samples: DataFrame, seed: int) -> DataFrame:
    """Random order, for writing."""
    return samples.orderBy(F.xxhash64("code", "end_date", F.lit(seed)))


def dense_windows(panel: DataFrame, features: Sequence[str], start: Column, end: Column, length: int = 30) -> DataFrame:
    """All windows that end in [start, end]."""
    full = _windows(panel, features, length, lambda i, n: i + length <= n, F.col("target") if "target" in panel.columns else None, (start, end))
    return full.where((F.size("past_values") == length) & F.col("end_date").between(start, end))


def latest_windows(panel: DataFrame, features: Sequence[str], length: int = 30) -> DataFrame:
    """The last window of each code that reaches the panel's last date."""
    live = F.max("date").over(Window.partitionBy("code"))
    last = panel.agg(F.max("date").alias("_last"))
    alive = panel.withColumn("_code_last", live).join(F.broadcast(last), F.col("_code_last") == F.col("_last")).drop("_code_last", "_last")  # one row
    return _windows(alive, features, length, lambda i, n: i + length == n, None)


def intraday_windows(bars: DataFrame, features: Sequence[str], length: int = 30, stride: int = 5) -> DataFrame:
    """Windows of intraday bars (code, date as timestamp): starts 0, ``stride``, ... below n - ``length``; label is the target."""
    return _windows(bars, features, length, lambda i, n: (i % stride == 0) & (i < n - length), F.col("target"))


def code_boundaries(panel: DataFrame) -> DataFrame:
    """First rows of each code: where the code differs from the row before in (code, date) order."""
    return panel.withColumn("_k", F.row_number().over(by_code())).where(F.col("_k") == 1).drop("_k")

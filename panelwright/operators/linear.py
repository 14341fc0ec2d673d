"""A linear scorer of windows: least squares over all samples, scored by a column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_bar(window: str = "past_values") -> Column:
    """The features of a window's last bar."""
    return F.element_at(window, -1).cast("array<double>")


def every_bar(window: str = "past_values") -> Column:
    """The features of all bars, one bar after the other."""
    return F.flatten(window).cast("array<double>")


@dataclass(frozen=True)
class LinearScorer:
    """score = intercept + sum of weight · feature."""

    weights: tuple[float, ...]
    intercept: float

    def expression(self, features: Column) -> Column:
        weights = F.array(*(F.lit(w) for w in self.weights))
        return F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.lit(self.intercept), lambda a, x: a + x)

    def score(self, samples: DataFrame, features: Column) -> DataFrame:
        """(code, end_date, score) of each window; NULL where a feature is."""
        return samples.select("code", "end_date", self.expression(features).alias("score"))


def fit_linear(samples: DataFrame, features: Column, label: str = "label", ridge: float = 0.0) -> LinearScorer:
    """Least squares of the label on an array of features (up to 4,096), with an intercept, over rows without NULL.

    Spark adds up the normal equations in one pass; only they reach the driver, where they are solved. ``ridge`` adds a
    penalty on the squared weights as they are. Collinear features are left to an iterative solver.
    """
    rows = samples.select(features.alias("_x"), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))
    rows = rows.select(array_to_vector("_x").alias("features"), "label")
    fitted = LinearRegression(solver="normal", regParam=ridge, standardization=False).fit(rows)
    return LinearScorer(tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))

"""Rolling functions of one series, over bars of a code in date order.

All take a window without a frame, by default that of a code in date order. A rolling value exists only where the window has N
bars and no NULL in them (``full``): Spark's aggregates skip NULL and accept short frames.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from panelwright.functions import moving
from panelwright.functions.scalar import ratio

def by_code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def frame(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_code()).rowsBetween(1 - n, 0)


def so_far(w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_code()).rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, value: Column, *series: Column, w: WindowSpec | None = None) -> Column:
    """``value`` where every series has n values in the last n bars."""
    test = F.lit(True)
    for x in series:
        test = test & (F.count(x).over(frame(n, w)) == n)
    return F.when(test, value)


def ts_mean(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(n, F.avg(x).over(frame(n, w)), x, w=w)


def ts_std(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Sample standard deviation."""
    return full(n, F.stddev_samp(x).over(frame(n, w)), x, w=w)


def ts_sum(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(n, F.sum(x).over(frame(n, w)), x, w=w)


def ts_max(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(n, F.max(x).over(frame(n, w)), x, w=w)


def ts_min(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(n, F.min(x).over(frame(n, w)), x, w=w)


def delay(x: Column, k: int, w: WindowSpec | None = None) -> Column:
    """The value k bars ago; for negative k, -k bars ahead."""
    return (F.lag(x, k) if k >= 0 else F.lead(x, -k)).over(w or by_code())


def delta(x: Column, k: int, w: WindowSpec | None = None) -> Column:
    return x - delay(x, k, w)


def ts_returns(x: Column, k: int = 1, w: WindowSpec | None = None) -> Column:
    return ratio(x, delay(x, k, w)) - 1


def log_return(x: Column, w: WindowSpec | None = None) -> Column:
    return F.ln(ratio(x, delay(x, 1, w)))


def ts_rank(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """(average rank of the last value among the last n - 1) / (n - 1)."""
    values = F.collect_list(x).over(frame(n, w))
    below = F.size(F.filter(values, lambda v: v < x))
    level = F.size(F.filter(values, lambda v: v == x))
    return full(n, (below + (level - 1) / 2) / (n - 1), x, w=w)


def decay_linear(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Mean weighted 1 .. n, the newest bar heaviest."""
    total = sum((delay(x, n - k, w) * k for k in range(1, n)), x * n)
    return full(n, total / (n * (n + 1) / 2), x, w=w)


def ts_corr(x: Column, y: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Pearson correlation; NULL where either series is constant."""
    f = frame(n, w)
    flat = (F.min(x).over(f) == F.max(x).over(f)) | (F.min(y).over(f) == F.max(y).over(f))
    value = ratio(F.covar_pop(x, y).over(f), F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f))
    return full(n, F.when(~flat, value), x, y, w=w)


def ts_cov(x: Column, y: Column, n: int, w: WindowSpec | None = None) -> Column:
    return full(n, F.covar_samp(x, y).over(frame(n, w)), x, y, w=w)


def ts_skew(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Skewness corrected for bias (Spark's is that of the population); NULL on a constant window."""
    f = frame(n, w)
    moving = F.min(x).over(f) < F.max(x).over(f)
    return full(n, F.when(moving, F.skewness(x).over(f) * ((n * (n - 1)) ** 0.5 / (n - 2))), x, w=w)


def ts_kurt(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Excess kurtosis corrected for bias; NULL on a constant window."""
    f = frame(n, w)
    moving = F.min(x).over(f) < F.max(x).over(f)
    return full(n, F.when(moving, ((n + 1) * F.kurtosis(x).over(f) + 6) * ((n - 1) / ((n - 2) * (n - 3)))), x, w=w)


def rolling_zscore(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """(x - mean) / (sample deviation + 1e-9), the current bar included."""
    f = frame(n, w)
    return full(n, (x - F.avg(x).over(f)) / (F.stddev_samp(x).over(f) + 1e-9), x, w=w)


@dataclass(frozen=True)
class Rolling:
    """A moving value for ``with_rolling``.

    Kind is mean, sum, std, max, min, skew, kurt, rank or decay of the last ``n`` values of ``x``, corr or cov of ``x`` and ``y``, or ewm, the exponentially
    weighted mean of ``x`` with ``alpha`` and ``adjust`` as for ``with_ewm``.
    """

    kind: str
    n: int
    x: str
    y: str | None = None
    alpha: float = 1.0
    adjust: bool = False


def in_order(df: DataFrame, by: str = "code", order: str = "date") -> DataFrame:
    """Rows dealt out by a key and sorted within it; nothing moves where they are already."""
    return df.repartition(by).sortWithinPartitions(by, order)


def with_rolling(df: DataFrame, columns: Mapping[str, Rolling], by: str = "code", order: str = "date", ordered: bool = False) -> DataFrame:
    """Add moving values of any window length, each NULL where the window is not full or holds a NULL (or NaN), as the functions above give them.

    A moving frame is added up anew for every bar. Here Spark deals out and sorts the bars, and tasks go over Arrow batches of them, with
    the last bars before a batch kept. The state of the last 1, 2, 4, ... bars is merged from two states of half
    the length, and a window of n bars from those its binary digits name. So the cost of a bar grows with the logarithm of n, all values
    share one sort, and sums of powers are about means, so no digits are lost. A column may be made of an earlier one of ``columns``.

    ``ordered`` says that ``df`` comes from ``in_order``, or this function, with nothing but row-wise steps since.
    """
    rows = df if ordered else in_order(df, by, order)
    return rows.mapInArrow(moving.rolling(columns, by), StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in columns)]))


def with_blocks(df: DataFrame, n: int) -> DataFrame:
    """Add ``_n``, the bar's number in its code, its block of ``n`` bars and its place in the block: ``_block``, ``_at``."""
    df = df.withColumn("_n", cum_count())
    return df.withColumns({"_block": F.floor(F.col("_n") / n), "_at": F.col("_n") % n})


def by_block() -> WindowSpec:
    """Bars of a code in order; windows on its blocks need no sort of their own beside it."""
    return Window.partitionBy("code").orderBy("_block", "date")


def block_zscore(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """``rolling_zscore`` of many columns without NULL, in place, on bars with the blocks of ``with_blocks``.

    A moving frame is added up anew for every bar. Here every window of n bars is the end of one block and the start
    of the next: running sums within blocks, from the value at the block's start so that no digits are lost, give both, at the same
    cost for any n.
    """
    w = Window.partitionBy("code", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    code = by_block()
    df = df.withColumn("_base", F.array(*(F.first(c).over(w) for c in columns)))
    ahead = [F.col(c) - F.col("_base")[i] for i, c in enumerate(columns)]
    df = df.withColumns({"_one": F.array(*(F.sum(x).over(w) for x in ahead)), "_two": F.array(*(F.sum(x * x).over(w) for x in ahead))})
    here = F.struct("_base", "_one", "_two")
    end = F.when(F.col("_at") == n - 1, here)
    df = df.withColumns({"_gone": F.lag(here, n).over(code), "_last": F.last(end, ignorenulls=True).over(code.rowsBetween(Window.unboundedPreceding, -1))})

    def zscore(i: int, c: str) -> Column:
        base, one, two = (F.col(x)[i] for x in ("_base", "_one", "_two"))
        shift, left = F.col("_last._base")[i] - base, (n - 1 - F.col("_at")).cast("double")
        old_one, old_two = (F.col(f"_last.{x}")[i] - F.col(f"_gone.{x}")[i] for x in ("_one", "_two"))
        whole = F.col("_at") == n - 1
        total = F.when(whole, one).otherwise(one + old_one + left * shift)
        squares = F.when(whole, two).otherwise(two + old_two + 2 * shift * old_one + left * shift * shift)
        sd = F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1))
        return F.when(F.col("_n") >= n - 1, (F.col(c) - base - total / n) / (sd + 1e-9))

    return df.withColumns({c: zscore(i, c) for i, c in enumerate(columns)}).drop("_base", "_one", "_two", "_gone", "_last")


def with_rolling_zscore(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """``rolling_zscore`` of many columns without NULL, in place; NULL before ``n`` bars. Same cost for any ``n``."""
    return block_zscore(with_blocks(df, n), columns, n).drop("_n", "_block", "_at")


def cum_sum(x: Column, w: WindowSpec | None = None) -> Column:
    return F.sum(x).over(so_far(w))


def cum_count(w: WindowSpec | None = None) -> Column:
    """0 at the first bar."""
    return F.row_number().over(w or by_code()) - 1


def cum_prod(x: Column, w: WindowSpec) -> Column:
    return F.product(x).over(so_far(w))


def cum_max(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(so_far(w))


def forward_fill(x: Column, w: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over(so_far(w))


def with_ewm(df: DataFrame, columns: Sequence[tuple[str, str, float, bool]], block: int = 64) -> DataFrame:
    """Add exponentially weighted means: (name, series, alpha, adjust) each.

    Without ``adjust``: y0 = x0, then y = (1 - alpha) y' + alpha x. With it: weights (1 - alpha) ** age,
    normalised. Only leading NULLs of the series are supported; they give NULL.

    y is a sum of decayed inputs u. Bars are cut into blocks of ``block``, or more at a small alpha. Within a block the sum is
    d ** i * cumsum(u * d ** -i), which stays in range. The value at a block's end is that of its own
    sum plus the decayed sums of the blocks before (16, so long that d ** (16 * block) < 1e-17), fetched by
    fixed lags; other bars add the decayed value of the last block end. So it takes a few windows on the
    code, in time linear in the bars, at any length of series.
    """
    sizes = {}
    for name, _, alpha, _ in columns:
        d = 1 - alpha
        sizes[name] = max(block, math.ceil(math.log(1e17) / (16 * -math.log(d)))) if 0 < d < 1 else block
    df = df.withColumn("_n", cum_count())
    for size in dict.fromkeys(sizes.values()):
        df = _ewm_blocks(df, [c for c in columns if sizes[c[0]] == size], size)
    return df.drop("_n")


def _ewm_blocks(df: DataFrame, columns: Sequence[tuple[str, str, float, bool]], block: int) -> DataFrame:
    """The means whose blocks have one size, in shared windows. All of these sort by (code, block, date), so one sort serves them."""
    df = df.withColumns({"_block": F.floor(F.col("_n") / block), "_at": (F.col("_n") % block).cast("double")})
    code = Window.partitionBy("code").orderBy("_block", "date")
    so_far_, before = (code.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    in_block = Window.partitionBy("code", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    at, every = F.col("_at"), list(enumerate(columns))
    df = df.withColumns({f"_seen{i}": F.count(series).over(so_far_) for i, (_, series, _, _) in every})

    def decayed(i: int, series: str, alpha: float, adjust: bool) -> Column:
        u = F.coalesce(F.col(series), F.lit(0.0))
        u = u if adjust else F.when(F.col(f"_seen{i}") == 1, u).otherwise(alpha * u)
        return u * F.pow(F.lit(1 - alpha), -at)

    df = df.withColumns({f"_u{i}": decayed(i, *rest) for i, (_, *rest) in every})
    df = df.withColumns({f"_z{i}": F.sum(f"_u{i}").over(in_block) * F.pow(F.lit(1 - alpha), at) for i, (_, _, alpha, _) in every})

    def end(i: int, d: float) -> Column:
        z = F.col(f"_z{i}")
        blocks = sum((F.coalesce(delay(z, block * k, code), F.lit(0.0)) * d ** (block * k) for k in range(1, 17)), z)
        return F.when(at == block - 1, blocks)

    df = df.withColumns({f"_end{i}": end(i, 1 - alpha) for i, (_, _, alpha, _) in every})

    def mean(i: int, alpha: float, adjust: bool) -> Column:
        carried = F.coalesce(F.last(f"_end{i}", ignorenulls=True).over(before), F.lit(0.0))
        y = F.col(f"_z{i}") + F.pow(F.lit(1 - alpha), at + 1) * carried
        seen = F.col(f"_seen{i}")
        return F.when(seen > 0, y * alpha / (1 - F.pow(F.lit(1 - alpha), seen.cast("double"))) if adjust else y)

    df = df.withColumns({name: mean(i, alpha, adjust) for i, (name, _, alpha, adjust) in every})
    return df.drop("_block", "_at", *(f"_{x}{i}" for i, _ in every for x in ("seen", "u", "z", "end")))

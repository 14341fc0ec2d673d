"""Functions over a whole frame in order, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.sources.scratch import materialise

BLOCK = 1 << 16


def with_position(df: DataFrame, order: Sequence[str], name: str = "_at") -> DataFrame:
    """Add the row's number, from 0, in the order of ``order`` (rows equal in it come in any order).

    Rows are dealt out by ranges of the order and numbered within each range; a range starts at the sum of
    the ranges before it. Only these sums, one row a range, meet in one task.
    """
    df = materialise(df)  # Spark reads it twice: for a sample of the order, and to deal it out
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()  # the number of the partition in the upper bits, that of the row in the lower 33
    dealt = materialise(dealt.select("*", F.shiftright(own, 33).alias("_range"), own.bitwiseAND((1 << 33) - 1).alias("_in")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")  # one row a range


def with_halo(df: DataFrame, n: int, at: str = "_at", block: int = BLOCK) -> DataFrame:
    """Blocks of consecutive rows, each led by the last ``n`` - 1 rows of what is before it.

    Adds ``_block`` and ``_own`` (false on the rows that lead). A moving window of ``n`` rows over ``halo_window()``
    has all its rows in the block of its last one; keep the rows with ``_own`` afterwards.
    """
    block = max(block, n)
    mine = F.floor(F.col(at) / block).cast("long")
    lent = F.when(F.col(at) % block > block - n, F.array(F.struct(mine.alias("_block"), F.lit(True).alias("_own")), F.struct((mine + 1).alias("_block"), F.lit(False).alias("_own"))))
    places = F.coalesce(lent, F.array(F.struct(mine.alias("_block"), F.lit(True).alias("_own"))))
    return df.select("*", F.inline(places))


def halo_window(at: str = "_at") -> WindowSpec:
    return Window.partitionBy("_block").orderBy(at)

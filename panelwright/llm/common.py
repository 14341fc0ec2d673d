"""Helpers that several operators share: shared scratch tables and join keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.sources.scratch import materialise, scratch_path, shared_dir

__all__ = ["bit_filter", "boxed", "grouped", "held_by", "materialise", "passes", "scratch_path", "shared_dir"]


def grouped(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """``groupBy(keys)`` with named aggregates, whose result does not count as partitioned by ``keys``.

    A join that follows then exchanges both sides itself, so that adaptive execution may split
    the rows of a hot key on the other side (it leaves alone a side whose partitioning stems from
    an aggregate).
    """
    return (
        df.groupBy(F.struct(*keys).alias("_key"))
        .agg(*(a.alias(name) for name, a in aggregates.items()))
        .select(*(F.col(f"_key.{k}").alias(k) for k in keys), *aggregates)
    )


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """(``doc``, a struct of all columns, and named keys): no name of a column can clash with those of a join."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(k.alias(name) for name, k in keys.items()))


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits with one set for the top bits of each hash in ``column``.

    Its size does not depend on the data, so it may be sent to every task. A filter that fills up only
    lets more rows through to the join it stands before.
    """
    slot = f"shiftrightunsigned({column}, {64 - bits})"
    words = (
        df.groupBy(F.expr(f"shiftright({slot}, 6)").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias("ones"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["ones"].to_numpy()
    return out.view(np.uint64)


def passes(ones: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``hashes`` have their bit set in a ``bit_filter``."""
    slot = hashes >> np.uint64(64 - (len(ones).bit_length() - 1) - 6)
    return (ones[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def held_by(df: DataFrame, keys: DataFrame, column: str, bits: int) -> DataFrame:
    """The rows of ``df`` whose hash in ``column`` stands in ``keys``, and perhaps some others; null is in none.

    While ``keys`` has under an eighth of ``2 ** bits`` rows, a ``bit_filter`` in the tasks spares the
    rows an exchange; beyond, where it would let too much through, it is a semi-join.
    """
    if keys.count() >= 1 << (bits - 3):
        return df.join(grouped(keys, [column], any=F.lit(True)).select(column), column, "left_semi")
    ones = bit_filter(keys, column, bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(column)
            there = hashes.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(there & passes(ones, pc.fill_null(hashes, 0).to_numpy().view(np.uint64))))

    return df.mapInArrow(keep, df.schema)

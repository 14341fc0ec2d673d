"""Exact line deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import grouped, materialise

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer ASCII blanks, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key stands in two or more documents, but for the smallest id holding it.

    Returns doc_id, n_lines (before), n_dropped and kept (the remaining lines joined), a row for
    each row of ``docs``. Keys of under ``min_chars`` code points stay. A document is an id: rows
    with the same id count once, and rows without an id count as one document that sorts last.
    Null or empty text is one empty line. Further columns are ignored.

    Lines are split and hashed once, into a table of 128-bit hashes and positions. Only hashes are
    exchanged to count documents; the smallest and largest id of a hash tell whether two documents hold
    it, so hot lines shrink before the exchange. Texts are exchanged once, to meet the positions to drop.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    lines = (
        texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    lines = materialise(lines)
    shared = (
        grouped(
            lines,
            ["h1", "h2"],
            first=F.min("doc_id"),
            last=F.max("doc_id"),
            nameless=F.max(F.col("doc_id").isNull()),
        )
        .where((F.col("first") < F.col("last")) | (F.col("first").isNotNull() & F.col("nameless")))
        .select("h1", "h2", "first")
    )
    drops = (
        lines.join(shared, ["h1", "h2"])
        .where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"))
        .agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    )
    split = F.split("text", "\n", -1)
    dropped = F.coalesce("drops", F.array().cast("array<int>"))
    spans = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), dropped).alias("after"),
        F.concat(dropped, F.array(F.size(split))).alias("until"),
    )
    runs = F.transform(spans, lambda s: F.slice(split, s["after"] + 2, s["until"] - s["after"] - 1))
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return texts.join(
        drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_hash")), "left"
    ).select(
        "doc_id",
        F.size(split).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )

"""Quality rules: word and line statistics of a document, and how often its lines recur in its host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import boxed, grouped, materialise

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_pos array<int>, line_hash array<long>, line_words array<int>"


def _stats(data: np.ndarray, offsets: np.ndarray) -> list:
    start, end, first = W.find_words(data, offsets, W.UNBLANK)
    n_words = np.diff(first)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = W.per_row(heads[end] - heads[start], first)
    n_symbols = W.per_row(SYMBOLS[data], offsets)

    line_start, line_end, line_row = W.find_lines(data, offsets)
    from_word, to_word = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    full = to_word > from_word
    line_start, line_end, row, from_word, to_word = line_start[full], line_end[full], line_row[full], from_word[full], to_word[full]
    salt = row.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    _, later = W.repeated(W.mix(W.range_hash(data, line_start, line_end) + salt))
    n_dup = np.bincount(row[later], minlength=len(n_words))

    begin, win_row = W.windows(first, WINDOW, len(start))
    hashes = W.range_hash(W.range_hash(data, start, end), begin, begin + WINDOW)
    twice, _ = W.repeated(W.mix(hashes + win_row.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, begin[twice], 1)
    np.add.at(cover, begin[twice] + WINDOW, -1)
    n_repeat = W.per_row(np.cumsum(cover[:-1]) > 0, first)

    line_hash = W.range_hash(W.range_hash(W.LOWER[data], start, end), from_word, to_word)
    pos = (np.flatnonzero(full) - np.searchsorted(line_row, np.arange(len(n_words)))[row]).astype(np.int32)
    at = np.searchsorted(row, np.arange(len(n_words) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (pos, line_hash.view(np.int64), (to_word - from_word).astype(np.int32))]
    return [*(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)), *lists]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, texts = batch.columns
        for begin, end, data, offsets in W.slices(texts):
            columns = [k.slice(begin, end - begin) for k in keys] + _stats(data, offsets)
            names = [*batch.schema.names[:-1], *(c.split()[0] for c in STATS.split(", "))]
            yield pa.RecordBatch.from_arrays(columns, names)


def quality(
    docs: DataFrame,
    max_share: float = 0.02,
    min_docs: int = 10,
    min_left: float = 1 / 3,
    min_words: int = 20,
    max_repeat: int = 30,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Statistics and verdict of each document.

    A normalised line is the sequence of its words (`[^\\x20\\x09-\\x0D]+`) with A-Z lower-cased. A
    line is above the limit if it stands in more than ``min_docs`` and in more than ``max_share`` of
    the distinct texts of its host; copies of one text count once. Such lines are removed; a
    document with less than ``min_left`` of its words left is depleted.

    Returns doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under ``min_words`` words, or over ``max_repeat`` per cent of the words in repeated
    windows of eight), removed_lines (positions from 0), words_left, kept: one row for each row of
    ``docs``. Null text has no words and fails. Null host is the host ''. Ids only label the rows,
    so they may be null or repeat. Further columns are ignored.
    """
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    kind = keys.schema["doc_id"].dataType.simpleString()
    measured = keys.mapInArrow(_measure, f"doc_id {kind}, host string, text_hash long, {STATS}")
    table = materialise(measured.withColumn("row", F.monotonically_increasing_id()))

    texts = grouped(table.select("host", "text_hash").distinct(), ["host"], n_texts=F.count("*"))
    seen = table.select("host", "text_hash", F.explode("line_hash").alias("line")).distinct()
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    above = grouped(
        counts.join(texts, "host").where(F.col("n") > max_share * F.col("n_texts")), ["host", "line"], n=F.max("n")
    )
    zipped = F.explode(F.arrays_zip("line_pos", "line_hash", "line_words")).alias("z")
    lines = table.select("row", "host", zipped).select(
        "row", "host", F.col("z.line_hash").alias("line"), F.col("z.line_pos").alias("pos"), F.col("z.line_words").alias("words")
    )
    removed = (
        lines.join(above, ["host", "line"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("pos")).alias("removed_lines"), F.sum("words").alias("gone"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return table.join(removed, "row", "left").select(
        "doc_id",
        "host",
        "text_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        left.alias("words_left"),
        (~failed & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, without the lines above the limit.

    All columns stay; ``n_chars`` follows the text if there is one.
    """
    verdicts = quality(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits)
    changes = (
        verdicts.where(~F.col("kept") | (F.size("removed_lines") > 0))
        .select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), F.col("kept").alias("_kept"), F.col("removed_lines").alias("_gone"))
        .dropDuplicates(["_id", "_host", "_hash"])
    )
    keys = boxed(docs, id=F.col(id_col), host=F.coalesce(F.col(host_col).cast("string"), F.lit("")), hash=F.xxhash64(text_col))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("hash") == F.col("_hash"))
    kept, old = keys.join(changes, same, "left").where(F.coalesce("_kept", F.lit(True))), F.col("doc").getField(text_col)
    split = F.split(old, "\n", -1)
    spans = F.arrays_zip(F.concat(F.array(F.lit(-1)), "_gone").alias("after"), F.concat("_gone", F.array(F.size(split))).alias("until"))
    runs = F.transform(spans, lambda s: F.slice(split, s["after"] + 2, s["until"] - s["after"] - 1))
    kept = kept.withColumn("new", F.when(F.size("_gone") > 0, F.array_join(F.flatten(runs), "\n")).otherwise(old))
    changed = {text_col: F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("new").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))

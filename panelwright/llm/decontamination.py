"""Benchmark decontamination by winnowed fingerprints.

In every run of ``width - gram + 1`` neighbouring grams the smallest hash (the rightmost, if tied) is
a fingerprint. Two texts that share ``width`` words share such a run, hence a fingerprint at the same
place in it. Document fingerprints meet those of the benchmark in a join, and each hit is extended to
the windows around it, which are compared word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import bit_filter, boxed, grouped, materialise, passes

WIDTH, GRAM = 13, 6
#: Least and most bits of the filter that spares fingerprints the join: 1 MB to 128 MB, sixteen bits for each of the benchmark's.
FILTER_BITS = (23, 30)


def _grams(data: np.ndarray, offsets: np.ndarray):
    data = W.LOWER[data]
    start, end, first = W.find_words(data, offsets, W.ALNUM)
    return data, start, end, first, W.range_hash(data, start, end)


def fingerprints(hashes: np.ndarray, first: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, row) of the fingerprints of all rows; ``hashes`` has the words."""
    begin, _ = W.windows(first, gram, len(hashes))
    grams = np.zeros(len(hashes), np.uint64)
    grams[begin] = W.range_hash(hashes, begin, begin + gram)
    at, row = W.windows(first, width, len(hashes))
    best, where = grams[at], at.copy()
    for k in range(1, width - gram + 1):
        other = grams[at + k]
        lower = other <= best
        best, where = np.where(lower, other, best), np.where(lower, at + k, where)
    new = np.ones(len(where), bool)
    new[1:] = where[1:] != where[:-1]
    return where[new], best[new], row[new]


def _text(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, b: int) -> str:
    return b" ".join(data[start[i] : end[i]].tobytes() for i in range(a, b)).decode("utf-8", "replace")


def _scan(gram: int, width: int, short: tuple[int, ...], bits: np.ndarray):
    """Words of each document, and of its fingerprints those that the benchmark may have."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts_hash, texts = batch.columns
            for lo, hi, data, offsets in W.slices(texts):
                data, start, end, first, hashes = _grams(data, offsets)
                found: list[list] = [[] for _ in range(hi - lo)]
                for where, h, row, n in [(*fingerprints(hashes, first, gram, width), 0), *((*_all(hashes, first, k), k) for k in short)]:
                    hit = passes(bits, h)
                    for at, value, r in zip(where[hit].tolist(), h[hit].view(np.int64).tolist(), row[hit].tolist(), strict=True):
                        a, b = (at, at + n) if n else (max(first[r], at - (width - gram)), min(first[r + 1], at + width))
                        found[r].append({"print": value, "width": n or width, "start": int(a - first[r]), "words": _text(data, start, end, a, b)})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), texts_hash.slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.array(found, HITS)],
                    ["doc_id", "text_hash", "n_words", "hits"],
                )

    return scan


def _all(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin, row = W.windows(first, n, len(hashes))
    return begin, W.range_hash(hashes, begin, begin + n), row


HITS = pa.list_(pa.struct([("print", pa.int64()), ("width", pa.int32()), ("start", pa.int32()), ("words", pa.string())]))
HITS_DDL = "array<struct<print: long, width: int, start: int, words: string>>"


def _index(gram: int, width: int):
    """The benchmark's fingerprints and windows. An item of fewer words than ``width`` is one window."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for lo, hi, data, offsets in W.slices(texts):
                data, start, end, first, hashes = _grams(data, offsets)
                rows: list[tuple] = []
                where, h, row = fingerprints(hashes, first, gram, width)
                rows += [(r, v, None) for r, v in zip(row.tolist(), h.view(np.int64).tolist(), strict=True)]
                begin, row = W.windows(first, width, len(hashes))
                rows += [(r, None, _text(data, start, end, a, a + width)) for a, r in zip(begin.tolist(), row.tolist(), strict=True)]
                for r in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width)).tolist():
                    a, b = first[r : r + 2]
                    one = W.range_hash(hashes, first[r : r + 1], first[r + 1 : r + 2]).view(np.int64)
                    rows.append((r, int(one[0]), _text(data, start, end, a, b)))
                widths = np.minimum(np.diff(first), width)
                at = pa.array([r for r, _, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(at),
                        pa.array([v for _, v, _ in rows], pa.int64()),
                        pa.array([int(widths[r]) for r, _, _ in rows], pa.int32()),
                        pa.array([w for _, _, w in rows], pa.string()),
                    ],
                    ["item_id", "print", "width", "window"],
                )

    return index


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Words of each document inside a window of the benchmark.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. Returns doc_id,
    text_hash, n_words, n_hit, n_items, items (their ids as strings, sorted), contaminated (n_hit > 0
    and share * n_hit >= n_words): a row for each row of ``docs``. Null and empty texts have no words.
    Items without words are ignored; an item without an id counts for n_hit alone; equal ids are one
    item. Document ids may be null or repeat. Further columns are ignored. An empty benchmark hits
    nothing.
    """
    items = materialise(
        benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(
            _index(gram, width), "item_id string, print long, width int, window string"
        )
    )
    prints = items.where(F.col("print").isNotNull()).select("print", "width").distinct()
    prints = materialise(prints)
    bits = bit_filter(prints, "print", min(FILTER_BITS[1], max(FILTER_BITS[0], prints.count().bit_length() + 4)))
    short = tuple(sorted(r.width for r in items.where(F.col("width") < width).select("width").distinct().collect()))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = keys.schema["doc_id"].dataType.simpleString()
    scanned = materialise(
        keys.mapInArrow(_scan(gram, width, short, bits), f"doc_id {kind}, text_hash long, n_words long, hits {HITS_DDL}")
        .withColumn("row", F.monotonically_increasing_id())
    )
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    near = hits.join(prints.withColumnsRenamed({"print": "p", "width": "w"}), (F.col("print") == F.col("p")) & (F.col("width") == F.col("w")), "left_semi")
    parts = F.split("words", " ")
    spread = F.transform(
        F.sequence(F.lit(0), F.size(parts) - F.col("width")),
        lambda i: F.struct((F.col("start") + i).alias("begin"), F.array_join(F.slice(parts, i + 1, F.col("width")), " ").alias("window")),
    )
    spread = near.where(F.size(parts) >= F.col("width")).select("row", "width", F.explode(spread).alias("s"))
    windows = items.where(F.col("window").isNotNull()).select("window", "item_id").distinct()
    known = grouped(windows, ["window"], any=F.lit(True)).select("window")
    found = materialise(spread.select("row", "width", "s.begin", "s.window").join(known, "window", "left_semi"))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            (acc["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["upto"], s["begin"]))).alias("total"),
        ),
    )
    spans = F.collect_set(F.struct("begin", (F.col("begin") + F.col("width")).alias("end")))
    n_hits = found.groupBy("row").agg(spans.alias("spans")).select("row", merged["total"].cast("long").alias("n_hit"))
    listed = found.select("row", "window").distinct().join(windows.where(F.col("item_id").isNotNull()), "window").select("row", "item_id").distinct()
    listed = listed.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    per_doc = n_hits.join(listed, "row", "left")
    n_hit, found_items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return scanned.drop("hits").join(per_doc, "row", "left").select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(found_items).cast("long").alias("n_items"), found_items.alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns."""
    found = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    keys = boxed(docs, id=F.col(id_col), hash=F.xxhash64(text_col))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return keys.join(found, same, "left_anti").select("doc.*")

"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked until their marginals meet the targets.
The ratio of fitted to observed tokens is the weight of a cell; documents are then drawn one by one
with a probability in proportion to it, calibrated so that the expected tokens meet the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import boxed, materialise

MARGINS = ("source", "lang", "topic")
BINS = 256


def _axes(topics: int) -> np.ndarray:
    """Fixed random axes, half as many as topics."""
    return np.random.default_rng(20240101).standard_normal((BINS, (topics + 1) // 2))


def _topics(topics: int):
    axes = _axes(topics)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            for lo, hi, data, offsets in W.slices(texts):
                data = W.LOWER[data]
                start, end, first = W.find_words(data, offsets, W.ALNUM)
                n = np.diff(first)
                slot = np.repeat(np.arange(hi - lo), n) * BINS + (W.range_hash(data, start, end) >> np.uint64(56)).astype(np.int64)
                bag = np.bincount(slot, minlength=(hi - lo) * BINS).reshape(hi - lo, BINS)
                side = np.round((np.sqrt(bag) - np.sqrt(bag).mean(axis=1, keepdims=True)) @ axes, 9)
                best = np.abs(side).argmax(axis=1)
                topic = 2 * best + (side[np.arange(hi - lo), best] < 0)
                topic = np.where(n > 0, np.minimum(topic, topics - 1), -1)
                columns = [k.slice(lo, hi - lo) for k in keys] + [pa.array(n.astype(np.int64)), pa.array(topic.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_tokens", "topic"])

    return assign


def rake(cells: np.ndarray, weights: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, close: float = 1e-9) -> tuple[np.ndarray, float]:
    """(fitted totals, largest miss of a margin as a share of the total): ``cells`` has the index on each margin of every cell, ``weights`` its observed total.

    Each target has a share for each index and is scaled to the total. An index without observed
    tokens is left out and the other shares of its margin grow in proportion. Rounds end when no margin
    misses by more than ``close``; where margins contradict each other a miss remains, and is told.
    """
    off = 0.0
    total, fitted = weights.sum(), weights.astype(np.float64)
    for _ in range(rounds):
        off = 0.0
        for m, target in enumerate(targets):
            have = np.bincount(cells[:, m], fitted, len(target))
            want = np.where(have > 0, target, 0)
            want = want * (total / want.sum()) if want.sum() > 0 else have
            ratio = np.divide(want, have, out=np.zeros(len(have)), where=have > 0)
            off = max(off, float(np.abs(want - have).max(initial=0)))
            fitted = fitted * ratio[cells[:, m]]
        if off <= close * total:
            break
    return fitted, off / total if total > 0 else 0.0


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight) with c such that the expected tokens meet ``budget`` (or all that have weight)."""
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order].astype(np.float64), weight[order].astype(np.float64)
    sure = np.concatenate([[0.0], np.cumsum(t)])[:-1]
    rest = np.cumsum((t * w)[::-1])[::-1]
    for k in range(len(w)):
        if rest[k] <= 0:
            break
        c = (budget - sure[k]) / rest[k]
        if c * w[k] <= 1:
            return np.minimum(1, np.maximum(c, 0) * weight)
    return (weight > 0).astype(np.float64)


def mix(
    docs: DataFrame, targets: dict[str, dict] | None = None, flatten: float = 0.5, budget_share: float = 0.5, topics: int = 8,
    max_cells: int = 1_000_000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """Weight, probability and decision of each document.

    Tokens are words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased). The topic is the
    cell of the document's hashed bag of words in a cross-polytope hash of ``topics`` cells (-1: no
    words), which needs no training and gives alike documents the same topic. ``targets`` names shares
    by margin (``source``, ``lang``, ``topic``) and value, and values that it does not name share
    nothing; a margin that it does not name takes its observed shares to the power ``flatten``.

    Returns doc_id, text_hash, source, lang, topic, n_tokens, weight (fitted over observed tokens of
    the cell), probability, margin_error (share of all tokens by which the fit misses a margin), kept: a row for each row of ``docs``. A document is kept if the hash of its
    id, text and ``seed``, as a number in [0, 1), lies below its probability, so repeated rows share
    one fate. Null source or language is a value of its own, written as ''. Documents without tokens
    have weight 0 and are not kept. Further columns are ignored.

    The driver sees one row a cell and refuses more than ``max_cells`` with an error: name coarser
    sources then.
    """
    spark = docs.sparkSession
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    kind = keys.schema["doc_id"].dataType.simpleString()
    table = materialise(keys.mapInArrow(_topics(topics), f"doc_id {kind}, source string, lang string, text_hash long, n_tokens long, topic int"))
    cells = table.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where(F.col("tokens") > 0)
    rows = sorted(cells.limit(max_cells + 1).collect())
    if len(rows) > max_cells:
        raise ValueError(f"more than {max_cells} cells of {MARGINS}; map the sources to fewer")
    observed = np.array([r.tokens for r in rows], np.float64)
    index, shares = [], []
    for margin in MARGINS:
        values = sorted({r[margin] for r in rows})
        at = {v: k for k, v in enumerate(values)}
        index.append([at[r[margin]] for r in rows])
        have = np.bincount(index[-1], observed, len(values)) if rows else np.zeros(0)
        told = (targets or {}).get(margin)
        shares.append(np.array([float(told.get(v, 0)) for v in values]) if told else have**flatten)
    fit, margin_error = rake(np.array(index, np.int64).reshape(len(MARGINS), -1).T, observed, shares)
    weight = fit / np.maximum(observed, 1)
    probability = calibrate(observed, weight, budget_share * observed.sum())
    fitted = spark.createDataFrame(
        [(*(r[m] for m in MARGINS), float(w), float(p)) for r, w, p in zip(rows, weight, probability, strict=True)],
        "source string, lang string, topic int, weight double, probability double",
    )
    chance = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11)).cast("double") / F.lit(float(1 << 53))
    weight_col, probability_col = (F.coalesce(c, F.lit(0.0)) for c in ("weight", "probability"))
    return table.join(fitted, list(MARGINS), "left").select(
        "doc_id", "text_hash", *MARGINS, "n_tokens",
        F.when(F.col("n_tokens") > 0, weight_col).otherwise(0.0).alias("weight"),
        F.when(F.col("n_tokens") > 0, probability_col).otherwise(0.0).alias("probability"),
        F.lit(margin_error).alias("margin_error"),
        ((F.col("n_tokens") > 0) & (chance < probability_col)).alias("kept"),
    )


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` draws, all columns."""
    drawn = mix(docs, id_col=id_col, text_col=text_col, **options).where("kept")
    drawn = drawn.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).dropDuplicates(["_id", "_hash"])
    keys = boxed(docs, id=F.col(id_col), hash=F.xxhash64(text_col))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return keys.join(drawn, same, "left_semi").select("doc.*")

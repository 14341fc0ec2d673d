"""Hard negatives by inner product, from an R-tree packed by sorting and tiling (STR).

Rows are sorted by label, then by slabs of the widest coordinate, by slabs of the next in these, and by a third;
ties go by a hash. So each run of rows is a tight box, and so is each run of boxes. Tasks read the runs, build the
upper levels, and search them for a block of queries: by the signs of the query, a box's corners give the interval
of its inner products. The box with the highest end is opened first; boxes outside the asked window of scores, or
that end strictly below the k-th best so far, are left closed.

Rows that share vector and label are one class: their scores are equal and the smallest ids come first, so only those
few that can be asked for go into the tree, and queries of one class are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import materialise, scratch_path

#: Rows of a leaf, boxes of a node, leaves that are scored together.
LEAF, FANOUT, AT_ONCE = 64, 16, 16
#: Rows that the coordinates and slabs are chosen from, rows of a partition, and queries, and components of theirs, that are sent to all tasks at once.
SAMPLE, PARTITION, BLOCK, WIDEST = 4096, 8192, 4096, 1 << 22
EXACT = float(1 << 53)


def usable(rows: DataFrame, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, the components as floor(``scale`` * x).

    Rows without id or label, without vector, or with a null or non-finite component take no part. Of rows with one id, the one of
    least label and vector counts.
    """
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vector = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    clean = rows.where(x.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("vector"))
    one = clean.where(F.col("label").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("vec_id", "row.label", "row.vector")


def first_of_class(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids of each vector and label."""
    place = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` written in the order of the tree's leaves, in partitions of about ``PARTITION`` rows."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
    x = _matrix(sample["vector"].combine_chunks(), None)
    wide = np.argsort(-x.var(axis=0), kind="stable")[:3].tolist() if x.size else []
    slabs = max(1, round((n / LEAF) ** (1 / 3)))
    keys = [F.col("label")]
    for k, c in enumerate(wide):
        value = F.coalesce(F.get("vector", F.lit(c)), F.lit(0))
        if k < 2:
            borders = F.array(*(F.lit(int(v)) for v in np.unique(np.quantile(x[:, c], np.arange(1, slabs) / slabs)))).cast("array<long>")
            value = F.size(F.filter(borders, lambda b, v=value: b <= v))
        keys.append(value)
    keys = [k.alias(f"k{i}") for i, k in enumerate([*keys, F.xxhash64("vec_id")])]
    names = [f"k{i}" for i in range(len(keys))]
    dealt = rows.select("*", *keys).repartitionByRange(max(1, -(-n // PARTITION)), *names).sortWithinPartitions(*names)
    return materialise(dealt.drop(*names))


def _matrix(vectors: pa.Array, width: int | None) -> np.ndarray:
    """Vectors as rows of float64, shorter ones with zeros at their ends."""
    at = vectors.offsets.to_numpy() if len(vectors) else np.zeros(1, np.int64)
    size, flat = np.diff(at), vectors.flatten().to_numpy()
    width = int(size.max(initial=0)) if width is None else width
    if (size == width).all():
        return flat.reshape(len(size), width).astype(np.float64)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


@dataclass
class Tree:
    """Boxes over rows in packed order: the leaves first, then each level; ``roots`` has one for each label."""

    x: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_leaves: int
    roots: dict[int, list[int]]

    @classmethod
    def over(cls, x: np.ndarray, ids: np.ndarray, label: np.ndarray) -> Tree:
        new = np.flatnonzero(np.diff(label, prepend=label[0] - 1))
        runs = np.append(new, len(label))
        start = np.concatenate([np.arange(a, b, LEAF) for a, b in zip(runs[:-1], runs[1:], strict=True)])
        lows, highs, starts, ends = [np.minimum.reduceat(x, start)], [np.maximum.reduceat(x, start)], [start], [np.append(start[1:], len(x))]
        of, first, top = label[start], 0, len(start)
        roots: dict[int, list[int]] = {}
        while True:
            new = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
            runs = np.append(new, len(of))
            if len(of) == len(new):
                break
            cut = np.concatenate([np.arange(a, b, FANOUT) for a, b in zip(runs[:-1], runs[1:], strict=True)])
            lows.append(np.minimum.reduceat(lows[-1], cut))
            highs.append(np.maximum.reduceat(highs[-1], cut))
            starts.append(first + cut)
            ends.append(first + np.append(cut[1:], len(of)))
            of, first, top = of[cut], top, top + len(cut)
        for k, one in enumerate(of.tolist()):
            roots.setdefault(one, []).append(first + k)
        return cls(x, ids, *(np.concatenate(p) for p in (lows, highs, starts, ends)), len(start), roots)

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and highest inner product with each row of ``q`` that each box allows."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


@dataclass
class Ask:
    """The best ``k`` rows with scores from ``low`` to ``high``; equal scores by id."""

    k: int
    low: float = -np.inf
    high: float = np.inf
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def floor(self) -> float:
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.floor()) & (scores <= self.high)
        if fits.any():
            scores, ids = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


def search(tree: Tree, q: np.ndarray, least: np.ndarray, most: np.ndarray, roots: list[int], asks: list[Ask]) -> int:
    """Answers ``asks`` for the query ``q`` from the boxes below ``roots``; returns the number of leaves that were scored."""
    queue = [(-most[r], r) for r in roots]
    heapq.heapify(queue)
    seen = 0
    while queue:
        floors = [a.floor() for a in asks]
        lowest, leaves = min(floors), []
        while queue and len(leaves) < AT_ONCE and -queue[0][0] >= lowest:
            box = heapq.heappop(queue)[1]
            if not any(least[box] <= a.high and most[box] >= f for a, f in zip(asks, floors, strict=True)):
                continue
            if box < tree.n_leaves:
                leaves.append(box)
            else:
                for child in range(tree.start[box], tree.end[box]):
                    heapq.heappush(queue, (-most[child], child))
        if not leaves:
            break
        rows = np.concatenate([np.arange(tree.start[b], tree.end[b]) for b in leaves])
        scores, ids = tree.x[rows] @ q, tree.ids[rows]
        for a in asks:
            a.take(scores, ids)
        seen += len(leaves)
    return seen


@dataclass
class Query:
    """A class of queries, with a name and score for each of its asks."""

    name: int
    label: int
    asks: list[tuple[int, Ask]]


def _answers(block: pa.Table, width: int, same: bool, k: int):
    """Rows (query, base, vec_id, score): the best of each task for each ask of the queries in ``block``."""
    q, names, labels = _matrix(block["vector"].combine_chunks(), width), block["query"].to_pylist(), block["label"].to_pylist()
    windows = block["windows"].to_pylist()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [Query(n, label, [(w["base"], Ask(k, w["low"], w["high"])) for w in ws]) for n, label, ws in zip(names, labels, windows, strict=True)]
        for batch in batches:
            if not len(batch):
                continue
            x, ids, label = _matrix(batch.column("vector"), width), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            tree = Tree.over(x, ids, label)
            for lo in range(0, len(queries), 256):
                least, most = tree.intervals(q[lo : lo + 256])
                for i, query in enumerate(queries[lo : lo + 256]):
                    roots = tree.roots.get(query.label, []) if same else [r for one, rs in tree.roots.items() if one != query.label for r in rs]
                    search(tree, q[lo + i], least[i], most[i], roots, [a for _, a in query.asks])
        found = [(n.name, base, a) for n in queries for base, a in n.asks if len(a.ids)]
        for lo in range(0, len(found), 1024):
            part = found[lo : lo + 1024]
            size = [len(a.ids) for _, _, a in part]
            name, base = (np.repeat(np.array([p[j] for p in part], np.int64), size) for j in (0, 1))
            columns = (name, base, np.concatenate([a.ids for *_, a in part]), np.concatenate([a.scores for *_, a in part]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "base", "vec_id", "score"])

    return answer


ANSWERS = "query long, base long, vec_id long, score long"


def _asked(tree: DataFrame, queries: DataFrame, width: int, same: bool, k: int, block: int) -> DataFrame:
    """(query, base, vec_id, score, place) of the best ``k`` rows for each of the ``windows`` (base, low, high) of ``queries`` (query, label, vector).

    Blocks of queries go to all tasks, one block after the other, and each task answers with what is best in its rows.
    """
    spark = tree.sparkSession
    parts = max(1, -(-queries.count() // block))
    path = scratch_path(spark)
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).toArrow()
        tree.mapInArrow(_answers(mine, width, same, k), ANSWERS).write.mode("append").parquet(path)
    best = F.row_number().over(Window.partitionBy("query", "base").orderBy(F.desc("score"), "vec_id"))
    return spark.read.schema(ANSWERS).parquet(path).withColumn("place", best).where(F.col("place") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, window: tuple[int, int] = (30, 90), block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` as from ``usable``.

    A score is the integer inner product with the anchor; higher ones come first, ties by smaller id. An anchor's positives
    are its first ``n_positives`` other rows of the same label. The negatives of a positive are the first ``n_negatives`` rows of other
    labels with ``window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score``; a positive without any has no
    row. Fewer than asked for are all there are. Vectors of unlike length are filled up with zeros. Scores have to stay below 2 ** 53;
    ValueError otherwise. No rows or no anchors give no rows.
    """
    rows = materialise(rows)
    sizes = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))).alias("most")).first()
    width = sizes.width or 0
    if width * float(sizes.most or 0) ** 2 >= EXACT:
        raise ValueError("inner products beyond 2 ** 53")
    block = max(1, min(block, WIDEST // max(width, 1)))
    tree = packed(materialise(first_of_class(rows, max(n_positives + 1, n_negatives))))
    anchors = rows.where(is_anchor)
    classes = materialise(anchors.groupBy("label", "vector").agg(F.min("vec_id").alias("query")))
    anchors = materialise(anchors.join(classes, ["label", "vector"]).select("vec_id", "query"))

    all_scores = F.array(F.struct(F.lit(0).cast("long").alias("base"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    near = materialise(_asked(tree, classes.withColumn("windows", all_scores), width, True, n_positives + 1, block).drop("base", "place"))
    own = anchors.join(near.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), "query").where(F.col("vec_id") != F.col("positive_id"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("positive_score"), "positive_id"))
    own = materialise(own.withColumn("place", place).where(F.col("place") <= n_positives).drop("place"))

    low, high = (F.col("positive_score") * w / 100 for w in window)
    windows = F.struct(F.col("positive_score").alias("base"), F.ceil(low).cast("double").alias("low"), F.floor(high).cast("double").alias("high"))
    wanted = own.select("query", "positive_score").distinct().where(F.ceil(low) <= F.floor(high))
    wanted = wanted.groupBy("query").agg(F.array_sort(F.collect_list(windows)).alias("windows"))  # a class has n_positives + 1 scores at most
    far = materialise(_asked(tree, materialise(classes.join(wanted, "query")), width, False, n_negatives, block))
    return own.join(far.withColumnRenamed("vec_id", "negative_id"), (own["query"] == far["query"]) & (F.col("positive_score") == F.col("base"))).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score")
    )

"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that must stay together. Groups are taken by falling
size, and each goes to the shard with the least load.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.common import materialise, scratch_path

#: Rows that are numbered together, and sizes that the driver holds at a time.
PART_ROWS, CHUNK = 1_000_000, 100_000


def schedule(sizes: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, list[int]]]:
    """Longest processing time over size classes.

    ``sizes`` has (size, number of groups), falling by size. Yields for each size the running
    count of its groups over the shards 0, 1, ...: group number r of that size belongs to the
    first shard whose running count exceeds r. Groups of one size are alike, so only how many of
    them each shard takes matters. These are the counts that popping the heap once a group gives;
    long runs of one size are first filled up to a common level, the rest goes through the heap.
    Ties go to the lower shard.
    """
    loads = [0] * n_shards
    for size, n in sizes:
        took = [0] * n_shards
        if n > 4 * n_shards:
            low, high = min(loads), min(loads) + size * (n + 1)
            while low < high:  # the highest level up to which all starts fit into n groups
                level = (low + high + 1) // 2
                if sum(max(0, (level - x) // size + 1) for x in loads) <= n:
                    low = level
                else:
                    high = level - 1
            took = [max(0, (low - x) // size + 1) for x in loads]
            if sum(took) > n:
                took = [0] * n_shards
        heap = [(x + size * k, shard) for shard, (x, k) in enumerate(zip(loads, took, strict=True))]
        heapq.heapify(heap)
        for _ in range(n - sum(took)):
            load, shard = heap[0]
            took[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        loads = [x + size * k for x, k in zip(loads, took, strict=True)]
        running, cum = 0, []
        for k in took:
            running += k
            cum.append(running)
        yield size, cum


def _planned(sizes: DataFrame, n_shards: int) -> DataFrame:
    """(group_size, upto) by ``schedule``: sizes stream through the driver in falling order, and the plan goes to a shared table in chunks."""
    spark = sizes.sparkSession
    rows = ((r.group_size, r.n) for r in sizes.orderBy(F.desc("group_size")).toLocalIterator())
    plan, path, kind = schedule(rows, n_shards), scratch_path(spark), "group_size long, upto array<long>"
    spark.createDataFrame([], kind).write.parquet(path)
    while chunk := list(islice(plan, CHUNK)):
        spark.createDataFrame(chunk, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into a shard, sizes near equal, equal texts together.

    Returns id, size (UTF-8 bytes plus 1), text_crc32, law (``bytes``), shard, slot (0, 1, ...
    within the shard, by a salt and the id) and grown_shard (null: this law has no growth rule).

    The heap needs the distinct group sizes in falling order, with their numbers of groups: fewer than
    sqrt(2 S) rows if all sizes sum up to S. They stream through the driver, which holds ``CHUNK`` of
    them at a time and writes the plan to a table. Null text: size 1, checksum 0, a group of its own kind, apart from empty
    texts. Null ids and repeated rows are placed like any others. An empty table gives no rows.
    Further columns are ignored.
    """
    text = F.col(text_col)
    base = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"null")).alias("grp"),
        )
    )
    salts = 64 + base.count() // PART_ROWS
    groups = materialise(
        base.groupBy("grp").agg(F.sum("size").alias("group_size")).withColumn("salt", F.pmod(F.xxhash64("grp"), F.lit(salts)).cast("int"))
    )
    parts = materialise(groups.groupBy("group_size", "salt").agg(F.count("*").alias("n")))
    plan = _planned(parts.groupBy("group_size").agg(F.sum("n").alias("n")), n_shards)
    before = Window.partitionBy("group_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(plan, "group_size")
    placed = (
        groups.withColumn("rank", F.row_number().over(Window.partitionBy("group_size", "salt").orderBy("grp")) - 1)
        .join(offsets, ["group_size", "salt"])
        .select("grp", F.size(F.filter("upto", lambda x: x <= F.col("before") + F.col("rank"))).alias("shard"))
    )
    rows = materialise(
        base.join(placed, "grp").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16 * salts)).cast("int"))
    )
    counts = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "grp")) - 1)
        .join(starts, ["shard", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

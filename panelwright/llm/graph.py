"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import grouped, materialise


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for each node of ``links`` (a, b) but the roots.

    Every step keeps the components and moves nodes closer to their root; the steps end when nothing
    moves. Each step writes its links, so the lineage stays short. Loops and repeated links do no harm.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialise(links)
    before, state = None, _state(links)
    while state != before:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = grouped(both, ["u"], least=F.min("v")).select("u", F.least("u", "least").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        least = grouped(large, ["u"], m=F.min("v"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(links)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, join_folded

#: Rows up to which a key may have all of them in one task.
PLAIN_ROWS = 200_000


def _met(rows: DataFrame, folded: DataFrame, key: str, total: int) -> DataFrame:
    """Rows, ``total`` at most, with the folded row of their key, which counts them in ``n``."""
    return rows.join(folded, key) if total <= PLAIN_ROWS else join_folded(rows, folded, key, "n", total)


def connected(spark: SparkSession, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node in links (a, b); the component is its smallest node.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the
    smallest of them, until nothing changes. A round moves no more rows than there are links,
    a node of a thousandth of many links meets its broadcast row, and every round is a written table.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(both, f"{name}-edges-0")
    seen, k = _sum(edges), 0
    while seen[0]:
        k += 1
        ends = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = scratch.save(ends.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-low-{k}")
        large = _met(ends, low, "x", 2 * seen[0]).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.distinct(), f"{name}-large-{k}")
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-low2-{k}")
        small = _met(large, low2, "u", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low2.select("u", F.col("m").alias("v")))
        after = scratch.save(small.distinct(), f"{name}-edges-{k}")
        scratch.drop(f"{name}-edges-{k - 1}", f"{name}-low-{k}", f"{name}-large-{k}", f"{name}-low2-{k}")
        edges, before, seen = after, seen, _sum(after)
        if seen == before:
            break
    # Stars: each node has one edge, to the smallest of its component.
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

"""Connected components by distributed union-find (DataFrame operations only).

Edges are kept as (child, parent) links with parent < child.  One round hooks
every node to the smallest parent known to it or its neighbours (the
"large-star / small-star" pair of steps): stars merge, chains halve, and the
loop ends when a round changes nothing.  Every round is written to the shared
checkpoint folder, so the plan never grows and lost executors cost one round.

Files of links are much smaller than their rows in memory, and Spark goes by
the files: above ``FEW`` links the smallest parents are joined by sort and merge,
never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.llm.common import stored

FEW = 1 << 17              # links up to which Spark may broadcast the smallest parents


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(low if few else low.hint("merge"), "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    low = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = (edges.withColumnRenamed("a", "u").join(low if few else low.hint("merge"), "u")
             .select(F.col("b").alias("a"), F.col("m").alias("b"))
             .filter(F.col("a") != F.col("b")))
    return moved.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one
    orderable type); component is the smallest node reachable.  Self links and
    NULLs are ignored; nodes without an edge do not appear; no edges, no rows."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
                 .distinct())
    seen = None
    for _ in range(max_rounds):
        sig = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if sig["n"] == 0 or (seen is not None and (sig["n"], sig["h"]) == seen):
            break
        seen = (sig["n"], sig["h"])
        few = sig["n"] <= FEW
        now = stored(_small_star(_large_star(now, few), few))
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

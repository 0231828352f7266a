"""Connected components of an edge table, by alternating stars.

Each round hangs every node's larger neighbours on its smallest (large star) and then its smaller
neighbours on the smallest of those (small star); after O(log^2 n) rounds each component is a star
around its smallest node. A round is two partial minima and two joins on the node; edges of a hub
meet its minimum without a shuffle (``join_counted``). The state is written to the shared folder, so
plans stay short and a lost executor re-reads one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import join_counted, written


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each end of ``edges`` (``a long, b long``); the component is its
    smallest node. Loops and repeated edges change nothing; no edges give no rows."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark["n"]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = written(join_counted(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_counted(large, low, ["a"], "n").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = written(small)
        was, mark = mark, _mark(now)
        if was == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

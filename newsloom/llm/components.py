"""Connected components by alternating large-star and small-star rounds; every round is written, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import BROADCAST_ROWS, materialize, merged_if_large

#: A vertex may have a third of all others as neighbours: its edges are dealt over the salts.
SALTS = 16
ROUNDS = 60


def with_least(edges: DataFrame, vertex: str, least: DataFrame, rows: int) -> DataFrame:
    """edges with column m of least (vertex, m), which has `rows` rows at most; many are joined over salts, and by shuffle, since Spark's
    estimate of what it might broadcast doesn't know how often they are repeated."""
    if rows <= BROADCAST_ROWS:
        return edges.join(least, vertex)
    other = "b" if vertex == "a" else "a"
    each = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(merged_if_large(each, rows), [vertex, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex) for the vertices of edges (long columns a and b), the roots left out."""
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(ROUNDS):
        seen = tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = with_least(both, "a", least, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, "a", least, 2 * seen[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        state = materialize(small.distinct(), "edges")
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return state.select(F.col("a").alias("vertex"), F.col("b").alias("component"))

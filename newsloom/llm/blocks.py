"""Comparing all members of a group with each other, whatever its size: groups are cut in blocks of a fixed size, each
pair of blocks is a task of its own, and a task returns counts or a spanning forest, never all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import materialize, merged_if_large

#: Members of a block.
BLOCK = 2048


def block_pairs(rows: DataFrame, group: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """Rows of groups of two and more, once for each pair of blocks (b1 <= b2) that their own block b is part of.

    The sizes are written first: the join with them then has a plain exchange on both sides, which adaptive execution splits
    where one group's rows make a partition too large, or turns into a broadcast where the sizes are few.
    """
    sizes = materialize(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("g")).where("g > 1"), "sizes")
    cut = rows.join(merged_if_large(sizes), group).withColumn("nb", F.ceil(F.col("g") / F.lit(block)).cast("int")).drop("g")
    cut = cut.withColumn("b", F.pmod(F.xxhash64(member), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return cut.withColumn("b1", F.least("b", "other")).withColumn("b2", F.greatest("b", "other")).drop("other", "nb")

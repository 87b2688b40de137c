"""Rules of hosts as a table: of all rules that hold for a host the longest counts. One equi-join, however many rules there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules_for(host: Column) -> Column:
    """array of the rules that can hold for a host, the longest first: itself, then `.` and each of its suffixes (which hold for the
    suffix itself and all under it). Port and user count as part of the host."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    return F.concat(F.array(host), suffixes)


def with_rule(df: DataFrame, host: str, rules: DataFrame, rule: str = "rule") -> DataFrame:
    """df with the columns of rules (a row per rule, `rule` among them) that holds for the host, nulls where none does.

    Only different hosts are spread out and joined; a host with many rows is one row there. Of rules that stand more than once
    the one with the least other columns counts. A null host has no rule.
    """
    others = [c for c in rules.columns if c != rule]
    table = rules.groupBy(F.col(rule).alias("__rule")).agg(F.min(F.struct(*others)).alias("__of"))
    hosts = df.select(F.lower(F.col(host)).alias("__host")).where("__host is not null").distinct()
    spread = hosts.select("__host", F.posexplode(rules_for(F.col("__host"))).alias("__place", "__rule"))
    best = spread.join(table, "__rule").groupBy("__host").agg(F.min_by(F.struct(F.col("__rule").alias(rule), *[F.col("__of")[c].alias(c) for c in others]), "__place").alias("__best"))
    out = df.withColumn("__key", F.lower(F.col(host))).join(best, F.col("__key") == F.col("__host"), "left")
    return out.select(*df.columns, *[F.col("__best")[c].alias(c) for c in (rule, *others)])

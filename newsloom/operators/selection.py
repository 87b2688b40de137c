"""Exact percentiles of any number of values: ranks are found digit by digit, from counts. No task sorts or holds a group's values."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from newsloom.session import shared_dir, ship

#: Bits of a digit: 65,536 counts of a group and a prefix at most.
BITS = 16
MASK = (1 << BITS) - 1


def keyed(values: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order, the least being 0 without its sign; NaN is the greatest, both zeros are one."""
    values = values + 0.0
    values[np.isnan(values)] = np.nan
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)) ^ np.int64(-1 << 63)


def unkeyed(keys: np.ndarray) -> np.ndarray:
    bits = keys ^ np.int64(-1 << 63)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def mapped(df: DataFrame, old: str, new: str, f, kind) -> DataFrame:
    """df with column `new` in place of `old`: f of its numbers."""
    names = df.columns
    at = names.index(old)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = f(np.array(part.column(at).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(values) if i == at else c for i, c in enumerate(part.columns)], names=[new if i == at else c for i, c in enumerate(names)])

    return df.mapInArrow(batches, StructType([StructField(new, kind) if i == at else x for i, x in enumerate(df.schema.fields)]))


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """groups and a column per share: the value at share * (n - 1) among the group's n values in order, between neighbours in proportion.

    Nulls don't count; groups without values have no row. A first pass counts values by their first digit, the next ones by their next
    digit among those that share a wanted value's digits so far: four passes of aggregates over the written numbers, each with BITS
    bits' worth of counts a wanted prefix. All ranks and groups go through them together.
    """
    spark = df.sparkSession
    ship(spark)
    root = f"{shared_dir(spark)}/newsloom-selection-{uuid.uuid4().hex}"
    names = {c: f"g{i}" for i, c in enumerate(groups or [])}
    own = list(names.values())

    def written(out: DataFrame, name: str) -> DataFrame:
        out.write.parquet(f"{root}/{name}")
        return spark.read.schema(out.schema).parquet(f"{root}/{name}")

    numbers = df.select(*[F.col(c).alias(g) for c, g in names.items()], F.col(value).cast("double").alias("x")).where("x is not null")
    rows = written(mapped(numbers, "x", "key", keyed, LongType()), "keys")
    sizes = written(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), "sizes").where("n > 0")
    spot: dict[str, Column] = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in shares.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")) for x in spot.values()])))
    wanted = sizes.select(*own, F.explode(ranks).alias("rank")).withColumn("left", F.col("rank")).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(64 // BITS):
        shift = 64 - BITS * (level + 1)
        wanted = written(wanted, f"wanted-{level}")
        digits = rows.withColumn("digit", F.shiftrightunsigned("key", shift).bitwiseAND(MASK)).withColumn("prefix", F.shiftrightunsigned("key", shift + BITS) if level else F.lit(0).cast("long"))
        if level:
            digits = matched(digits, wanted.select(*own, "prefix").distinct(), [*own, "prefix"], "left_semi")
        counts = digits.groupBy(*own, "prefix", "digit").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*own, "prefix").orderBy("digit"))
        counts = counts.withColumn("upto", upto)
        met = matched(wanted, counts, [*own, "prefix"], "inner").where("left >= upto - c and left < upto")
        wanted = met.select(*own, "rank", (F.col("left") - F.col("upto") + F.col("c")).alias("left"), F.shiftleft("prefix", BITS).bitwiseOR(F.col("digit")).alias("prefix"))
    found = mapped(written(wanted.select(*own, "rank", "prefix"), "found"), "prefix", "x", unkeyed, DoubleType())
    by_rank = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two ranks a share at most
    out = matched(sizes, by_rank, own, "inner")
    at = lambda x: F.element_at("at", x.cast("long"))
    lines = [(at(F.floor(x)) + F.when(F.ceil(x) > F.floor(x), (at(F.ceil(x)) - at(F.floor(x))) * (x - F.floor(x))).otherwise(0.0)).alias(name) for name, x in spot.items()]
    return out.select(*[F.col(g).alias(c) for c, g in names.items()], *lines)


def matched(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joined on keys where null equals null; without keys each has one row or one wanted prefix."""
    b = b.withColumnsRenamed({k: f"{k}__" for k in keys})
    fits = F.lit(True)
    for k in keys:
        fits = fits & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return a.join(b, fits, how).drop(*[f"{k}__" for k in keys])

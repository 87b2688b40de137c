"""What the operators share: the folder all executors see, written tables, bounded Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.batches import BATCH_BYTES, BATCH_ROWS, cut_frames, in_arrow, released, sliced  # noqa: F401
from newsloom.session import shared_dir, ship


def within_bounds(rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Callable:
    """For operators that write tables on their way: while the operator itself runs, Spark's Arrow batches have these bounds; then
    the session's own settings come back. What it returns runs later, under those, and cuts its batches itself (released)."""

    def wrap(operator: Callable) -> Callable:
        @wraps(operator)
        def run(first, *others, **named):
            conf = (first if isinstance(first, SparkSession) else first.sparkSession).conf
            names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
            before = {n: conf.get(n) for n in names}
            try:
                for n, x in names.items():
                    conf.set(n, str(x))
                return operator(first, *others, **named)
            finally:
                for n, x in before.items():
                    conf.set(n, x)

        return run

    return wrap


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/newsloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a join may send to all executors by way of the driver.
BROADCAST_ROWS = 200_000


def merged_if_large(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a side of a join: beyond BROADCAST_ROWS it is merged by shuffle. Spark's own threshold takes the bytes of a file, of which an
    id needs four or five; in the driver's memory its row takes a hundred. Without `rows` a written table is counted, by its footers."""
    return df.hint("merge") if (df.count() if rows is None else rows) > BROADCAST_ROWS else df


def drop_written(spark: SparkSession) -> None:
    """Delete every table that materialize() and the archive writers left in the shared folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(conf)
    if fs.exists(root):
        for status in fs.listStatus(root):
            if status.getPath().getName().startswith("newsloom-"):
                fs.delete(status.getPath(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def key_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def is_integral(df: DataFrame, column: str) -> bool:
    return key_type(df, column) in ("tinyint", "smallint", "int", "bigint")


def need_integral(df: DataFrame, column: str) -> None:
    """For operators whose results are ordered by the key or name a smallest one."""
    if not is_integral(df, column):
        raise TypeError(f"column {column} is {key_type(df, column)}; this operator needs integer keys")

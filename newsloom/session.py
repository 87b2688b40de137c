"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they need no installed copy and no shared path."""
    context = spark.sparkContext
    if getattr(context, "_newsloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="newsloom-")) / "newsloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._newsloom_shipped = True


#: Estimated sizes between which spread() deals rows anew.
SPREAD_LEAST, SPREAD_MOST = 1 << 20, 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df on all cores, where it is so small that it may lie in one row group of one file: for stages whose work far
    exceeds a shuffle of a few MB. Larger tables have files enough and stay as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if SPREAD_LEAST <= size <= SPREAD_MOST else df


def computed_once(df: DataFrame) -> DataFrame:
    """df whose costly columns are computed here, once: filters on them aren't moved below and spelt out again there."""
    return df.withColumn("__once", F.monotonically_increasing_id()).where("__once >= 0").drop("__once")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark knows; none there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, named by spark.checkpoint.dir. Where the session names none, a temporary one on a
    local master; on any other one executors would write to disks of their own, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="newsloom-")
            spark.sparkContext.setCheckpointDir(_local[app])
        folder = _local[app]
    return folder.rstrip("/")

"""Tables by key that batches are merged into: sorted runs of what each batch brought, merged on read and compacted by size. A
batch writes what it brings, a lookup reads the parts that a key can be in."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import delete
from newsloom.sources import schemas

#: Bytes of a part of a run, and of a row group within: parts follow the bytes of their run, whatever the table's.
PART_BYTES, GROUP_BYTES = 64 << 20, 2 << 20
#: So many runs of one size become one; a run is of the next size if it has so many times the bytes. The least size that tells runs apart.
FAN, LEAST_BYTES = 8, 1 << 20
#: Old runs stay readable for the time of so many batches.
KEEP = 3


class Fenced(RuntimeError):
    """A writer whose lease another one has taken over."""


class Folder:
    """The few calls that a table makes to whatever file system holds its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark._jvm
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, start: str) -> list[str]:
        if not self.fs.exists(self.at("")):
            return []
        return sorted(n for s in self.fs.listStatus(self.at("")) if (n := s.getPath().getName()).startswith(start))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file, unless there is one of that name: of several writers one succeeds."""
        try:
            stream = self.fs.create(self.at(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        return not self.fs.exists(self.at(new)) and self.fs.rename(self.at(old), self.at(new))


class Lease:
    """The right to write, for `seconds` from the last sign of life. Each holder has a greater number than those before it; what
    an earlier one still writes is refused by that number."""

    def __init__(self, spark: SparkSession, path: str, owner: str, seconds: int = 1800, clock: Callable[[], float] = time.time):
        self.folder, self.owner, self.seconds, self.clock, self.number = Folder(spark, path), owner, seconds, clock, None

    def last(self) -> tuple[int, int]:
        """The last holder's number and when (milliseconds) it was alive; 0 and 0 before the first."""
        names = self.folder.names("lease-")
        if not names:
            return 0, 0
        return int(names[-1].removeprefix("lease-")), self.folder.fs.getFileStatus(self.folder.at(names[-1])).getModificationTime()

    def acquire(self) -> bool:
        number, alive = self.last()
        if number and number != self.number and self.clock() * 1000 - alive < self.seconds * 1000:
            return False
        if not self.folder.create(f"lease-{number + 1:012d}", self.owner):
            return False  # another one was faster
        self.number = number + 1
        self.renew()
        return True

    def touch(self, at: int) -> None:
        self.folder.fs.setTimes(self.folder.at(f"lease-{self.number:012d}"), at, -1)

    def check(self) -> None:
        if self.number is None or self.last()[0] != self.number:
            raise Fenced(f"{self.owner} no longer holds the lease")

    def renew(self) -> None:
        """A sign of life."""
        self.check()
        self.touch(int(self.clock() * 1000))

    def release(self) -> None:
        """The next writer need not wait."""
        if self.number is not None and self.last()[0] == self.number:
            self.touch(0)
        self.number = None


class Table:
    """Rows by key in runs. merge(rows) makes one row of all of a key's; rows come with `__run`, greater for later batches. Without it
    all rows stay: a log. `also` names a second key that rows can be looked up by.

    A batch that is repeated after a failure finds its own number and does nothing. Runs are written first and named by a manifest
    that is renamed into place, so a writer that dies leaves the table as it was, and what it wrote goes with a later batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "normalized_url", merge: Callable[[DataFrame], DataFrame] | None = None, also: str | None = None, lease: Lease | None = None):
        self.spark, self.schema, self.key, self.merge, self.lease = spark, schema, key, merge, lease
        self.folder, self.columns = Folder(spark, path), [f.name for f in schemas.of(schema)]
        kind = {f.name: f.dataType.simpleString() for f in schemas.of(schema)}
        self.also = also and Table(spark, f"{path}/by-{also}", f"{also} {kind[also]}, {key} {kind[key]}", also, lambda rows: rows.groupBy(also, key).agg(F.max("__run").alias("__run")))
        self.also_key = also

    # --- reading

    def manifest(self) -> dict:
        """batch (-1: none yet), number of the writer's lease, runs (folder, parts, bytes, run)."""
        names = self.folder.names("manifest-")
        return json.loads(self.folder.text(names[-1])) if names else {"batch": -1, "writer": 0, "runs": []}

    def rows_of(self, run: dict, part: int | None = None) -> DataFrame:
        path = f"{self.folder.path}/{run['folder']}" + ("" if part is None else f"/part={part}")
        return self.spark.read.schema(self.schema).parquet(path).withColumn("__run", F.lit(run["run"]).cast("long"))

    def merged(self, rows: list[DataFrame]) -> DataFrame:
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return self.merge(out) if self.merge else out

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        runs = self.manifest()["runs"]
        if len(runs) == 1:
            return self.rows_of(runs[0]).select(self.columns)
        return self.merged([self.rows_of(r) for r in runs]).select(self.columns) if runs else self.empty()

    def lookup(self, value) -> DataFrame:
        """The key's row, if there is one, read from the one part of each run that can hold it; parts are sorted by key, so their
        row groups tell where."""
        h = self.spark.sql("select xxhash64(cast(:v as string)) as h", args={"v": str(value)}).first()["h"]
        rows = [self.rows_of(r, h % r["parts"]) for r in self.manifest()["runs"] if h % r["parts"] in r["filled"]]
        return self.merged([r.where(F.col(self.key) == F.lit(value)) for r in rows]).select(self.columns) if rows else self.empty()

    def lookup_either(self, value) -> DataFrame:
        """One row whose key or second key has this value, if there is one; the key's own first."""
        found = self.lookup(value)
        keys = [r[self.key] for r in self.also.lookup(value).limit(64).collect()] if self.also else []
        for k in keys:
            if k != value:
                found = found.unionByName(self.lookup(k).where(F.col(self.also_key) == F.lit(value)))
        return found.orderBy(F.col(self.key) != F.lit(value), self.key).limit(1)

    # --- writing

    def part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(parts)).cast("int")

    def write_run(self, rows: DataFrame, number: int, parts: int) -> dict | None:
        """A run of rows, sorted by key within parts; None without rows."""
        name = f"run-{uuid.uuid4().hex}"
        dealt = rows.select(*self.columns, self.part(parts).alias("part")).repartition(parts, "part").sortWithinPartitions("part", self.key)
        dealt.write.option("parquet.block.size", GROUP_BYTES).partitionBy("part").parquet(f"{self.folder.path}/{name}")
        filled = sorted(int(s.getPath().getName().removeprefix("part=")) for s in self.folder.fs.listStatus(self.folder.at(name)) if s.getPath().getName().startswith("part="))
        return {"folder": name, "parts": parts, "filled": filled, "bytes": self.folder.size(name), "run": number} if filled else None

    def update(self, new: DataFrame, batch: int) -> None:
        """Merge the rows of a batch; batches come in the order of their numbers."""
        old = self.manifest()
        if old["batch"] >= batch:
            return
        if self.lease:
            self.lease.check()
        arrived = f"new-{uuid.uuid4().hex}"
        new.select(self.columns).write.parquet(f"{self.folder.path}/{arrived}")  # computed once
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{arrived}")
        if self.also:
            self.also.update(rows.select(self.also_key, self.key).where(F.col(self.also_key).isNotNull()).distinct(), batch)
        single = self.merged([rows.withColumn("__run", F.lit(batch).cast("long"))]).select(self.columns)
        run = self.write_run(single, batch, max(1, -(-self.folder.size(arrived) // PART_BYTES)))
        self.commit(batch, self.compacted(old["runs"] + ([run] if run else [])))
        delete(self.spark, f"{self.folder.path}/{arrived}")

    def compacted(self, runs: list[dict]) -> list[dict]:
        """The runs, with FAN neighbours of one size made one until there are fewer of each. A row is written once per size, so all
        writing together grows with the logarithm of the table."""
        size = lambda r: next(i for i in range(64) if r["bytes"] < LEAST_BYTES * FAN**i)
        while True:
            last = size(runs[-1]) if runs else 0
            tail = len(runs)
            while tail and size(runs[tail - 1]) <= last:
                tail -= 1
            if len(runs) - tail < FAN:
                return runs
            some = runs[tail:]
            total = sum(r["bytes"] for r in some)
            whole = self.write_run(self.merged([self.rows_of(r) for r in some]), some[-1]["run"], max(1, -(-total // PART_BYTES)))
            runs = runs[:tail] + ([whole] if whole else [])
            if size(runs[-1]) <= last:
                return runs

    def commit(self, batch: int, runs: list[dict]) -> None:
        old, writer = self.manifest(), self.lease.number if self.lease else 0
        if self.lease:
            self.lease.renew()
        if old["writer"] > (writer or 0):
            raise Fenced(f"writer {writer} comes after {old['writer']}")
        draft = f"draft-{uuid.uuid4().hex}"
        self.folder.create(draft, json.dumps({"batch": batch, "writer": writer, "runs": runs}))
        if not self.folder.rename(draft, f"manifest-{batch:012d}"):
            raise Fenced(f"batch {batch} has been written by another writer")
        names = self.folder.names("manifest-")
        for name in names[:-KEEP]:
            delete(self.spark, f"{self.folder.path}/{name}")
        live = {r["folder"] for name in names[-KEEP:] for r in json.loads(self.folder.text(name))["runs"]}
        for name in [*self.folder.names("run-"), *self.folder.names("draft-")]:
            if name not in live:
                delete(self.spark, f"{self.folder.path}/{name}")


# --- ways to merge ----------------------------------------------------------------------------------------------------------


def latest(key: str, *order: str) -> Callable[[DataFrame], DataFrame]:
    """The last row of a key by `order`; at equal order that of the later batch."""
    return lambda rows: rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order, "__run")).alias("__r")).select("__r.*")


def earliest(key: str, *order: str) -> Callable[[DataFrame], DataFrame]:
    """The first batch's row: later ones are inserted only where the key is absent."""
    return lambda rows: rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct("__run", *order)).alias("__r")).select("__r.*")

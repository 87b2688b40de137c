"""Runs by key: what is written and read, compaction, lookups by two keys, writers that die or come late."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from newsloom.streaming import keyed
from newsloom.streaming.keyed import Fenced, Lease, Table

SCHEMA = "a string, b string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_merged_on_read_whatever_the_runs(spark, tmp_path, monkeypatch):
    """Thirty batches of random keys, compacted on the way, read as a dictionary would hold them; a repeated batch does nothing."""
    monkeypatch.setattr(keyed, "LEAST_BYTES", 4000)
    monkeypatch.setattr(keyed, "PART_BYTES", 3000)
    monkeypatch.setattr(keyed, "FAN", 3)
    t, rng, want = Table(spark, str(tmp_path), SCHEMA, "a", keyed.latest("a", "v"), also="b"), random.Random(1), {}
    for batch in range(12):
        rows = [(f"k{rng.randrange(150)}", f"r{rng.randrange(40)}", batch * 1000 + i) for i in range(rng.choice([1, 60, 200]))]
        t.update(frame(spark, rows), batch)
        want |= {a: (a, b, v) for a, b, v in rows}
        t.update(frame(spark, [("k1", "x", 10**9)]), batch)
    runs = t.manifest()["runs"]
    assert sorted(map(tuple, t.read().collect())) == sorted(want.values())
    assert len(runs) < 9 and max(r["parts"] for r in runs) > 1 and len(glob.glob(f"{tmp_path}/manifest-*")) == 3
    for k in ("k1", "k77", "nothing"):
        assert [tuple(r) for r in t.lookup(k).collect()] == [x for x in want.values() if x[0] == k]
    for r in ("r3", "r39", "k5"):
        got = [tuple(x) for x in t.lookup_either(r).collect()]
        fit = [x for x in want.values() if r in x[:2]]
        assert len(got) == min(1, len(fit)) and set(got) <= set(fit)
    named = {r["folder"] for name in t.folder.names("manifest-") for r in __import__("json").loads(t.folder.text(name))["runs"]}
    assert named == set(t.folder.names("run-")) and not t.folder.names("draft-") and not t.folder.names("new-")


def test_a_small_batch_writes_little(spark, tmp_path):
    """A thousand keys into a table of two million: kilobytes, and a lookup reads one part of each run while the table grows tenfold."""
    def read_for_one_key(rows, path):
        t = Table(spark, path, "a string, v long", "a", keyed.latest("a", "v"))
        t.update(spark.range(rows).selectExpr("concat('key', id) as a", "id as v"), 0)
        before = size(path)
        t.update(spark.range(1000).selectExpr("concat('key', id * 7) as a", "id + 1000000000 as v"), 1)
        assert size(path) - before < 100_000 and t.read().count() == rows
        found = t.lookup("key14")
        assert [r["v"] for r in found.collect()] == [1_000_000_002]
        return before, sum(os.path.getsize(f.removeprefix("file://")) for f in found.inputFiles())

    old = keyed.PART_BYTES
    try:
        keyed.PART_BYTES = 1 << 20
        small, of_small = read_for_one_key(200_000, str(tmp_path / "small"))
        large, of_large = read_for_one_key(2_000_000, str(tmp_path / "large"))
    finally:
        keyed.PART_BYTES = old
    assert large > 8 * small and of_large < 2 * of_small


def test_a_log_keeps_all_rows(spark, tmp_path):
    t = Table(spark, str(tmp_path), SCHEMA, "a")
    for batch in range(3):
        t.update(frame(spark, [("k", "r", batch), ("k", "r", batch)]), batch)
    assert t.read().count() == 6 and t.lookup("k").count() == 6 and t.read().agg(F.max("v")).first()[0] == 2


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    """Killed before the manifest, after compaction: the table is as it was, the next try of the batch succeeds, and leftovers go."""
    monkeypatch.setattr(keyed, "FAN", 2)
    t = Table(spark, str(tmp_path), SCHEMA, "a", keyed.earliest("a", "v"))
    t.update(frame(spark, [("a", "x", 1)]), 0)
    with monkeypatch.context() as m:
        m.setattr(Table, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.update(frame(spark, [("a", "y", 2), ("b", "y", 3)]), 1)
    assert [tuple(r) for r in t.read().collect()] == [("a", "x", 1)] and len(t.folder.names("run-")) == 3
    t.update(frame(spark, [("a", "y", 2), ("b", "y", 3)]), 1)
    assert sorted(map(tuple, t.read().collect())) == [("a", "x", 1), ("b", "y", 3)] and len(t.folder.names("run-")) == 2


def test_a_lease_expires_and_fences(spark, tmp_path):
    now = [1_700_000_000.0]
    first, second = (Lease(spark, str(tmp_path / "lease"), name, clock=lambda: now[0]) for name in ("one", "two"))
    table = lambda lease: Table(spark, str(tmp_path / "t"), SCHEMA, "a", keyed.latest("a", "v"), lease=lease)
    assert first.acquire() and not second.acquire()
    table(first).update(frame(spark, [("a", "x", 1)]), 0)
    now[0] += 1700
    first.renew()
    now[0] += 1700
    assert not second.acquire()  # the sign of life counts
    now[0] += 200
    assert second.acquire()
    with pytest.raises(Fenced):
        table(first).update(frame(spark, [("a", "late", 2)]), 1)
    with pytest.raises(Fenced):
        first.renew()
    table(second).update(frame(spark, [("b", "y", 3)]), 1)
    assert sorted(map(tuple, table(None).read().collect())) == [("a", "x", 1), ("b", "y", 3)]
    second.release()
    assert first.acquire() and not second.acquire()

"""Keyed state and timers, batch by batch, against the same over tables."""

import random
import time
from datetime import datetime, timedelta

import pytest

from newsloom.streaming import stateful as S

START = datetime(2024, 1, 1)
at = lambda ms: START + timedelta(milliseconds=ms)


class Feed:
    """A folder as a stream, given batch by batch, and what came out of the query so far."""

    def __init__(self, spark, path, schema, name):
        self.spark, self.path, self.schema, self.name = spark, str(path), schema, name
        spark.createDataFrame([], schema).write.parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def give(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)


def started(df, name, tmp_path, trigger=None):
    writer = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-checkpoint"))
    return (writer.trigger(processingTime=trigger) if trigger else writer).start()


def until(test, seconds=60):
    """Streams by processing time never run out of batches, so tests wait for what they expect."""
    for _ in range(seconds * 10):
        if test():
            return True
        time.sleep(0.1)
    return False


def state_rows(query):
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def test_pending_url_is_answered_once_in_a_later_batch(spark, tmp_path):
    asks = Feed(spark, tmp_path / "asks", "normalized_url string, at timestamp, known string", "asks")
    log = Feed(spark, tmp_path / "log", "normalized_url string, crawl_status string, updated_at timestamp, seq long", "log")
    query = started(S.pending_answers(asks.stream(), log.stream(), every=300), "pending_out", tmp_path, "100 milliseconds")
    out = lambda: sorted((r["normalized_url"], r["crawl_status"]) for r in spark.table("pending_out").collect())

    try:
        asks.give([("a", at(0), None), ("b", at(0), "analysis_done"), ("c", at(0), None)])
        assert until(lambda: out() == [("b", "analysis_done")])  # known when it was asked for
        log.give([("a", "queued", at(10), 1), ("z", "analysis_done", at(10), 1)])
        asks.give([("a", at(20), None)])  # asking again changes nothing
        time.sleep(1.5)
        assert out() == [("b", "analysis_done")]
        log.give([("a", "content_saved", at(30), 2), ("a", "queued", at(25), 3)])  # the later time counts, whatever the order
        assert until(lambda: len(out()) > 1)
        assert out() == [("a", "content_saved"), ("b", "analysis_done")]
        assert min(r["looks"] for r in spark.table("pending_out").collect() if r["normalized_url"] == "a") >= 2
        log.give([("c", "failed", at(40), 4), ("a", "failed", at(50), 5)])
        assert until(lambda: len(out()) > 2)
        time.sleep(1)
        assert out() == [("a", "content_saved"), ("b", "analysis_done"), ("c", "failed")]
        assert until(lambda: query.lastProgress and state_rows(query) == 0)
    finally:
        query.stop()


def hover_rows():
    rng, rows, clock = random.Random(8), [], {u: 0 for u in range(5)}
    for seq in range(400):
        u = rng.randrange(5)
        clock[u] += rng.choice([0, 20, 150, 200, 201, 350, 1000])
        rows.append((u, f"http://a.com/{seq}", at(clock[u]), seq))
    return rows


def test_hovers_settle_as_in_a_table(spark, tmp_path):
    """Groups that end within a batch, across batches and with the watermark; each gives its last URL, once."""
    schema = "user_id int, url string, ts timestamp, seq long"
    rows = sorted(hover_rows(), key=lambda r: r[2])
    feed = Feed(spark, tmp_path / "hovers", schema, "hovers")
    query = started(S.settled_hovers(feed.stream()), "hovers_out", tmp_path)
    try:
        for i in range(0, len(rows), 100):
            feed.give(rows[i : i + 100])
            query.processAllAvailable()
        feed.give([(99, "later", rows[-1][2] + timedelta(seconds=60), 10_000)])
        query.processAllAvailable()
        query.processAllAvailable()
        got = [(r["user_id"], r["url"], r["settled_at"]) for r in spark.table("hovers_out").collect()]
        hovers = sum(r["hovers"] for r in spark.table("hovers_out").collect())
    finally:
        query.stop()
    want = [tuple(r) for r in S.settled_in(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == sorted(want) and 50 < len(got) < 400 and hovers == 400


def test_cache_hits_expires_and_is_bypassed(spark, tmp_path):
    schema = "key string, at timestamp, seq long, value string, bypass boolean"
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(6)}", at(1000 * i), i, f"v{i}" if rng.random() < 0.3 else None, rng.random() < 0.1) for i in range(1, 300)]
    feed = Feed(spark, tmp_path / "rows", schema, "rows")
    query = started(S.cached(feed.stream(), ttl=60_000), "cache_out", tmp_path, "200 milliseconds")
    asks = 0
    try:
        for i in range(0, len(rows), 100):
            feed.give(rows[i : i + 100])
            asks += sum(r[3] is None for r in rows[i : i + 100])
            assert until(lambda: spark.table("cache_out").count() == asks)
        got = [tuple(r) for r in spark.table("cache_out").collect()]
    finally:
        query.stop()
    want = [tuple(r) for r in S.cached_in(spark.createDataFrame(rows, schema), 60_000).collect()]
    assert sorted(got) == sorted(want) and {r[2] for r in got} == {"hit", "miss", "expired", "bypassed"}


def test_cache_entries_leave_the_state(spark, tmp_path):
    schema = "key string, at timestamp, seq long, value string, bypass boolean"
    feed = Feed(spark, tmp_path / "rows", schema, "rows")
    query = started(S.cached(feed.stream(), ttl=500), "ttl_out", tmp_path, "200 milliseconds")
    try:
        feed.give([("a", at(0), 1, "v", False), ("b", at(1), 2, None, False)])
        assert until(lambda: spark.table("ttl_out").count() == 1)
        time.sleep(1)
        feed.give([("a", at(1), 3, None, False)])  # fresh by its own time, gone by the store's
        assert until(lambda: spark.table("ttl_out").count() == 2)
        assert {r["answer"] for r in spark.table("ttl_out").collect()} == {"miss"}
    finally:
        query.stop()

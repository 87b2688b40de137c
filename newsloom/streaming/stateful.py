"""Streams with state by key and timers: pending URLs that are polled until they are done, hovers that settle, a cache whose
entries expire. Each needs the RocksDB state store (see with_state_store)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.functions.fixed import FINISHED_OR_BLOCKED
from newsloom.session import ship

#: Milliseconds: between two looks at a pending URL, until a hover settles, until a cache entry expires.
POLL_MS, HOVER_MS, TTL_MS = 30_000, 200, 300_000


def with_state_store(spark: SparkSession) -> None:
    """The state store that keyed state and timers need; for sessions that don't name it themselves. Also sends this package to the executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship(spark)


def milliseconds(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


def ordered(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order."""
    return pd.concat(list(frames), ignore_index=True).sort_values(list(by), kind="stable", ignore_index=True)


# --- pending URLs ------------------------------------------------------------------------------------------------------


class Pending(StatefulProcessor):
    """One URL: asked for and not done yet. A timer looks at its latest status every `every` milliseconds until it is a finished one;
    then one row leaves and the state is gone. Asking again in the meantime changes nothing; statuses of URLs that nobody asked for
    leave no state."""

    def __init__(self, every: int, finished: tuple[str, ...]):
        self.every, self.finished = every, finished

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "asked_at timestamp, status string, updated_at timestamp, seq long, looks int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.pending.get() if self.pending.exists() else None
        asked, status, updated, seq, looks = kept or (None, None, None, None, 0)
        for r in ordered(rows, "at", "seq").itertuples():
            if r.asked and asked is None:
                asked = r.at
            if r.status is not None and (updated is None or (r.at, r.seq) >= (updated, seq)):
                status, updated, seq = r.status, r.at, r.seq
        if asked is None:
            return
        if kept is None:
            if status in self.finished:  # known when it is asked for
                yield self.answer(key, asked, status, 0)
                return
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        self.pending.update((asked, status, updated, seq, looks))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked, status, updated, seq, looks = self.pending.get()
        if status in self.finished:
            self.pending.clear()
            yield self.answer(key, asked, status, looks + 1)
            return
        self.pending.update((asked, status, updated, seq, looks + 1))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)

    def answer(self, key, asked, status: str, looks: int) -> pd.DataFrame:
        return pd.DataFrame({"normalized_url": [key[0]], "asked_at": [asked], "crawl_status": [status], "looks": [looks]})

    def close(self) -> None:
        pass


def pending_answers(asked: DataFrame, statuses: DataFrame, every: int = POLL_MS, finished: tuple[str, ...] = tuple(FINISHED_OR_BLOCKED)) -> DataFrame:
    """normalized_url, asked_at, crawl_status, looks: each URL of the stream `asked` (normalized_url, at), once, when its status is a
    finished one; `statuses` is the stream of the status log (normalized_url, crawl_status, updated_at, seq).

    A status that stands in the log before a URL is asked for is joined to `asked` by the caller, as column `known`, if there is one.
    """
    with_state_store(asked.sparkSession)
    known = F.col("known") if "known" in asked.columns else F.lit(None).cast("string")
    rows = asked.select("normalized_url", F.lit(True).alias("asked"), known.alias("status"), F.col("at"), F.lit(-1).cast("long").alias("seq"))
    rows = rows.union(statuses.select("normalized_url", F.lit(False), "crawl_status", "updated_at", "seq"))
    out = "normalized_url string, asked_at timestamp, crawl_status string, looks int"
    return rows.groupBy("normalized_url").transformWithStateInPandas(Pending(every, finished), out, "append", "ProcessingTime")


# --- hovers --------------------------------------------------------------------------------------------------------------


class Hovers(StatefulProcessor):
    """One user: the last hover, until it settles. A hover settles once no other follows within `wait` milliseconds; a later one
    that comes first takes its place and re-arms the timer."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, seq long, url string, hovers long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        settled = []
        armed = milliseconds(pd.Timestamp(last[0])) + self.wait if last else None
        for r in ordered(rows, "at", "seq").itertuples():
            if last and milliseconds(r.at) - milliseconds(pd.Timestamp(last[0])) > self.wait:
                settled.append(last)
                last = None
            if last and (r.at, r.seq) < (pd.Timestamp(last[0]), last[1]):  # came late: the kept one stays the last
                last = (*last[:3], last[3] + 1)
            else:
                last = (r.at, r.seq, r.url, (last[3] if last else 0) + 1)
        due = milliseconds(pd.Timestamp(last[0])) + self.wait
        if due != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(due)
        self.last.update(last)
        if settled:
            yield self.rows(key, settled)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = self.last.get()
            self.last.clear()
            yield self.rows(key, [last])

    def rows(self, key, settled: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(settled), "url": [x[2] for x in settled], "settled_at": [pd.Timestamp(x[0]) for x in settled], "hovers": [x[3] for x in settled]})

    def close(self) -> None:
        pass


def settled_hovers(hovers: DataFrame, user: str = "user_id", url: str = "url", at: str = "ts", seq: str = "seq", wait: int = HOVER_MS, late: str = "1 second") -> DataFrame:
    """user_id, url, settled_at, hovers: the last hover of each group of a user's hovers that follow each other within `wait`
    milliseconds, once the watermark has passed its time and the wait. At equal times the greater seq is the later one."""
    with_state_store(hovers.sparkSession)
    kind = hovers.schema[user].dataType.simpleString()
    rows = hovers.select(F.col(user).alias("user_id"), F.col(url).alias("url"), F.col(at).alias("at"), F.col(seq).cast("long").alias("seq")).withWatermark("at", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Hovers(wait), f"user_id {kind}, url string, settled_at timestamp, hovers long", "append", "EventTime")


# --- a cache -------------------------------------------------------------------------------------------------------------


class Cache(StatefulProcessor):
    """One key: its latest value and when that expires. Expiry is lazy, at the time of the row that asks; the state store drops
    entries by its own clock, one time-to-live after they were written."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "value string, expires_at timestamp", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entry = self.entry.get() if self.entry.exists() else None
        written, out = False, []
        for r in ordered(rows, "at", "seq").itertuples():
            if r.value is not None:
                entry, written = (r.value, r.at + pd.Timedelta(milliseconds=self.ttl)), True
            elif r.bypass:
                out.append((r.seq, "bypassed", None))
            elif entry is None:
                out.append((r.seq, "miss", None))
            elif pd.Timestamp(entry[1]) > r.at:
                out.append((r.seq, "hit", entry[0]))
            else:
                out.append((r.seq, "expired", None))
        if written:
            self.entry.update(entry)
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "seq": [x[0] for x in out], "answer": [x[1] for x in out], "value": [x[2] for x in out]})

    def close(self) -> None:
        pass


def cached(rows: DataFrame, ttl: int = TTL_MS) -> DataFrame:
    """key, seq, answer (hit, miss, expired, bypassed), value for each row that asks. rows: key, at, seq, value (null where the row
    asks, else what it writes) and bypass (whether the asking row wants no cached value)."""
    with_state_store(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    asks = rows.select("key", "at", F.col("seq").cast("long").alias("seq"), "value", F.coalesce("bypass", F.lit(False)).alias("bypass"))
    return asks.groupBy("key").transformWithStateInPandas(Cache(ttl), f"key {kind}, seq long, answer string, value string", "append", "ProcessingTime")


# --- the same over tables --------------------------------------------------------------------------------------------------


def settled_in(hovers: DataFrame, user: str = "user_id", url: str = "url", at: str = "ts", seq: str = "seq", wait: int = HOVER_MS) -> DataFrame:
    """settled_hovers() over a table: the hovers that no other hover of the user follows within the wait."""
    order = Window.partitionBy(user).orderBy(at, seq)
    then = F.lead(at).over(order)
    gap = F.unix_micros(then.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return hovers.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > wait * 1000)).select(F.col(user).alias("user_id"), F.col(url).alias("url"), F.col(at).alias("settled_at"))


def cached_in(rows: DataFrame, ttl: int = TTL_MS) -> DataFrame:
    """cached() over a table: each asking row against the last value written before it."""
    order = Window.partitionBy("key").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("value").isNotNull(), F.struct("value", "at")), ignorenulls=True).over(order)
    seen = rows.withColumn("__last", last).where("value is null")
    alive = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("__last.at").cast("timestamp")) < ttl * 1000
    answer = F.when(F.coalesce("bypass", F.lit(False)), "bypassed").when(F.col("__last").isNull(), "miss").when(alive, "hit").otherwise("expired")
    return seen.select("key", "seq", answer.alias("answer"), F.when(answer == "hit", F.col("__last.value")).alias("value"))

"""State that is merged rather than appended: upserts, sightings, status logs. Plain Parquet has no MERGE; it is a union
and an aggregate per key, written to a new path and swapped by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key by `order`; at equal order an update wins. One aggregate, no sort of a key's rows."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*existing.columns), F.struct(*order, "__new")).alias("__r")).select("__r.*")


def insert_if_absent(existing: DataFrame, updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """existing and the first new row of each key it lacks."""
    first = updates.groupBy(*key).agg(F.min_by(F.struct(*updates.columns), F.struct(*order)).alias("__r")).select("__r.*")
    return existing.unionByName(first.join(existing.select(*key).distinct(), key, "left_anti").select(existing.columns))


def sightings(events: DataFrame, url: str = "url", at: str = "ts") -> DataFrame:
    return events.groupBy(url).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("seen_count"), F.lit(False).alias("crawler_pushed"))


def merge_sightings(state: DataFrame, new: DataFrame, url: str = "url") -> DataFrame:
    """Earliest first, latest last, counts added, pushed once pushed."""
    return state.unionByName(new).groupBy(url).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("seen_count").alias("seen_count"), F.bool_or("crawler_pushed").alias("crawler_pushed"))


def sum_sightings(rows: DataFrame, url: str = "normalized_url") -> DataFrame:
    """merge_sightings() of rows that also have a domain, for stored tables."""
    return rows.groupBy(url).agg(F.max("domain").alias("domain"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("seen_count").alias("seen_count"), F.bool_or("crawler_pushed").alias("crawler_pushed"))


def latest_status(log: DataFrame, key: str = "url", status: str = "status", order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def job_status(df: DataFrame, job: str = "job_id", status: str = "status") -> DataFrame:
    """content_saved if nothing failed, blocked if something was blocked and nothing saved, else partial_done."""
    s = F.col(status)
    counts = df.groupBy(job).agg(F.count_if(s == "content_saved").alias("saved"), F.count_if(s != "content_saved").alias("failed"), F.count_if(s == "blocked").alias("blocked"))
    return counts.withColumn("job_status", F.when(F.col("failed") == 0, "content_saved").when((F.col("blocked") > 0) & (F.col("saved") == 0), "blocked").otherwise("partial_done"))


def last_non_null(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key, each column's last value that isn't null."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def history_with_loss(history: DataFrame, losses: DataFrame, key: str = "epoch", order: str = "step", loss: str = "loss", into: str = "train_loss") -> DataFrame:
    """history with the last loss that the training loop logged in each epoch; null in epochs without one."""
    last = last_non_null(losses, key, order, [loss]).select(key, F.col(loss).alias(into))
    return history.join(last, key, "left")


def numeric_suffix(name: Column) -> Column:
    """The number that ends a checkpoint's name; null without one."""
    return F.regexp_extract(name, r"([0-9]+)$", 1).try_cast("long")


def latest_checkpoint(df: DataFrame, name: str, groups: list[str]) -> DataFrame:
    """Per group the checkpoint with the greatest numeric suffix (checkpoint-10 is later than checkpoint-9); those without one don't count."""
    return df.groupBy(*groups).agg(F.max_by(name, numeric_suffix(F.col(name))).alias(name))


def fresh(df: DataFrame, expires_at: str, now: Column, bypass: bool = False) -> DataFrame:
    """Cache entries that haven't expired; none with bypass."""
    return df.where(F.lit(not bypass) & (F.col(expires_at) > now))

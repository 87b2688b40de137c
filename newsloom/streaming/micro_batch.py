"""Streams: article files as they arrive, sightings, a push-once gate; see stateful for what needs timers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.text_exact import clean_articles
from newsloom.functions.urls import normalize_url
from newsloom.operators.scoring import risk_of, score_articles, stand_in
from newsloom.session import delete
from newsloom.sources import schemas
from newsloom.streaming.keyed import Folder, Lease, Table, latest


def article_files(spark: SparkSession, folder: str, schema: str = schemas.CRAWL_CSV, form: str = "csv", clean: str | None = None) -> DataFrame:
    """Rows of the files in a folder, each file once (the checkpoint remembers which); clean='delete' removes read files."""
    reader = spark.readStream.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.option("cleanSource", clean) if clean else reader).format(form).load(folder)


def analysed(rows: DataFrame, scorer: Callable = stand_in) -> DataFrame:
    """Saved articles, cleaned, scored and rated, under their normalized URL."""
    fetched = F.col("fetched_at") if "fetched_at" in rows.columns else F.lit(None).cast("string")
    saved = rows.where("status = 'content_saved'").select(normalize_url(F.col("url")).alias("normalized_url"), F.col("url").alias("requested_url"), "title", "text", "job_id", fetched.alias("fetched_at"), F.monotonically_increasing_id().alias("seq"))
    cleaned = clean_articles(saved)
    scored = score_articles(cleaned, "normalized_url", "cleaned_content", scorer, carry=("fetched_at", "seq"))
    risk = risk_of(F.col("confidence_level"))
    return scored.select("*", risk["risk_level"].alias("risk_level"), risk["risk_label"].alias("risk_label"))


ANALYSED = "normalized_url string, prediction int, probability_real double, confidence_level string, risk_level int, risk_label string, fetched_at string, batch long, seq long"


def analyses_table(spark: SparkSession, path: str, lease: Lease | None = None) -> Table:
    """Analyses by URL; of several the one that was written last stays, whatever its verdict: the later batch, within a batch the
    later fetch, then the later row."""
    return Table(spark, path, ANALYSED, merge=latest("normalized_url", "batch", "fetched_at", "seq"), lease=lease)


def run_analyses(spark: SparkSession, folder: str, target: Table, checkpoint: str, scorer: Callable = stand_in, once: bool = True, form: str = "csv") -> StreamingQuery:
    """Each micro-batch of article files is analysed and merged into target (analyses_table) by normalized URL. The checkpoint keeps
    each file from being read twice; the target's lease, if it has one, keeps out a second writer."""

    def merge(batch: DataFrame, number: int) -> None:
        target.update(analysed(batch, scorer).withColumn("batch", F.lit(number).cast("long")), number)

    writer = article_files(spark, folder, form=form).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def ask_to_stop(spark: SparkSession, folder: str) -> None:
    """Leave the mark that stopped_at_mark() waits for."""
    Folder(spark, folder).create("stop", "")


def stopped_at_mark(query: StreamingQuery, folder: str, every: float = 0.2) -> None:
    """Wait for the mark in folder, let the running batch end and be merged, and stop. A batch that begins in that moment is cut
    off unmerged: the checkpoint doesn't count it, so the next start takes it up."""
    marks = Folder(SparkSession.active(), folder)
    while query.isActive and not marks.names("stop"):
        time.sleep(every)
    while query.isActive and query.status["isTriggerActive"]:
        time.sleep(every)
    query.stop()
    delete(marks.spark, f"{folder}/stop")


def caught_up(spark: SparkSession, folder: str, target: Table, checkpoint: str, scorer: Callable = stand_in, form: str = "csv") -> int:
    """The last sweep: all files that have arrived by now, then all files once more as a batch, of which only URLs that the table
    lacks are merged. The number of those; 0, unless rows were lost."""
    run_analyses(spark, folder, target, checkpoint, scorer, True, form).awaitTermination()
    files = spark.read.schema(schemas.CRAWL_CSV)
    files = files.option("header", True).option("escape", '"').option("multiLine", True) if form == "csv" else files
    rows = files.format(form).load(folder)
    keyed = rows.where("status = 'content_saved'").withColumn("normalized_url", normalize_url(F.col("url")))
    lost = keyed.join(target.read().select("normalized_url"), "normalized_url", "left_anti")
    count = lost.count()
    if count:
        number = target.manifest()["batch"] + 1
        target.update(analysed(lost, scorer).withColumn("batch", F.lit(number).cast("long")), number)
    return count


def running_sightings(events: DataFrame, url: str = "url", at: str = "ts") -> DataFrame:
    """First and last sight and their number, in update mode."""
    return events.groupBy(url).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("seen_count"))


def push_once(events: DataFrame, url: str = "url", at: str = "ts", within: str = "1 day") -> DataFrame:
    """Each URL passes once within the watermark."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([url])

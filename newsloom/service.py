"""The service's calls over stored tables: each takes and gives DataFrames, whatever the number of URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import rules
from newsloom.functions.fixed import FINISHED_OR_BLOCKED
from newsloom.functions.urls import host_of, normalize_url
from newsloom.operators import lookup, state
from newsloom.operators.scoring import stand_in
from newsloom.session import ship
from newsloom.sources import schemas
from newsloom.streaming import keyed, micro_batch


class Service:
    """Analyses, sightings and a status log under one root; one writer at a time: the holder of the lease, if there is one."""

    def __init__(self, spark: SparkSession, root: str, lease: keyed.Lease | None = None):
        ship(spark)
        self.spark = spark
        self.analyses = keyed.Table(spark, f"{root}/analyses", schemas.ANALYSES, merge=keyed.latest("normalized_url", "analysis_time"), also="requested_url", lease=lease)
        self.sightings = keyed.Table(spark, f"{root}/sightings", schemas.SIGHTINGS, merge=state.sum_sightings, lease=lease)
        self.log = keyed.Table(spark, f"{root}/status", schemas.STATUS_LOG, lease=lease)

    def health(self) -> dict:
        return {"status": "ok", "analyses": self.analyses.read().count(), "urls": self.sightings.read().count()}

    def keyed(self, urls: DataFrame) -> DataFrame:
        return urls.select("url", normalize_url(F.col("url")).alias("normalized_url")).where("normalized_url <> ''").dropDuplicates(["normalized_url"])

    def check_urls_batch(self, urls: DataFrame, now, batch: int, hosts: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(labels, to_fetch): what is known of each URL, and those to hand to a worker, once each. The unknown ones' sightings are merged."""
        labels = lookup.label_map(self.keyed(urls), self.analyses.read(), self.log.read())
        unknown = labels.where("label = 'processing'").select("normalized_url")
        seen = unknown.select("normalized_url", host_of(F.col("normalized_url")).alias("domain"), F.lit(now).cast("timestamp").alias("first_seen_at"), F.lit(now).cast("timestamp").alias("last_seen_at"), F.lit(1).cast("long").alias("seen_count"), F.lit(False).alias("crawler_pushed"))
        old = self.sightings.read()
        to_fetch = unknown.join(old.where("crawler_pushed").select("normalized_url"), "normalized_url", "left_anti").where(rules.is_supported(F.col("normalized_url"), hosts) if hosts else F.lit(True))
        pushed = to_fetch.select("normalized_url", F.lit(True).alias("now_pushed"))
        marked = seen.join(pushed, "normalized_url", "left").withColumn("crawler_pushed", F.coalesce("now_pushed", F.lit(False))).drop("now_pushed")
        self.sightings.update(marked, batch)
        return labels, to_fetch

    def check(self, urls: DataFrame) -> DataFrame:
        found = self.analyses.read().join(self.keyed(urls), "normalized_url", "left_semi")
        return lookup.summary(found)

    def check_one(self, url: str) -> DataFrame:
        """The analysis of one URL, by its normalized or its requested form: two lookups that read what can hold it, not the table."""
        from newsloom.functions.urls import normalized

        found = self.analyses.lookup_either(normalized(url))
        return lookup.summary(found if not found.isEmpty() else self.analyses.lookup_either(url))

    def pipeline_status(self, job: str | None = None) -> DataFrame:
        """job_id, its URLs by latest status, and whether the job is done: no URL of it waits or is worked on."""
        rows = self.log.read().where(F.col("job_id") == job) if job else self.log.read().where("job_id is not null")
        current = rows.groupBy("job_id", "normalized_url").agg(F.max_by("crawl_status", F.struct("updated_at", "seq")).alias("crawl_status"))
        open_ = F.count_if(~F.col("crawl_status").isin(*FINISHED_OR_BLOCKED))
        return current.groupBy("job_id").agg(F.count(F.lit(1)).alias("urls"), open_.alias("open"), F.count_if(F.col("crawl_status") == "analysis_done").alias("analysed"), (open_ == 0).alias("done"))

    def details(self, urls: DataFrame) -> DataFrame:
        """normalized_url, answer and, where it is `found`, the detail view; paywalled URLs get their reason, pages that are no articles are skipped."""
        keyed = self.keyed(urls)
        status = state.latest_status(self.log.read(), "normalized_url", "crawl_status")
        out = keyed.join(lookup.detail(self.analyses.read()), "normalized_url", "left").join(status, "normalized_url", "left")
        url, reason = F.col("normalized_url"), rules.paywall_reason(F.col("normalized_url"))
        blocked = rules.skipped(url) | reason.isNotNull()  # such pages are never looked up
        answer = F.when(F.col("raw_label").isNotNull() & ~blocked, "found").otherwise(lookup.answer_of(url, F.col("crawl_status")))
        return out.withColumn("answer", answer).withColumn("reason", reason)

    def save_urls(self, urls: DataFrame, now, batch: int) -> None:
        """Sightings of URLs that aren't known yet; known ones stay as they are."""
        new = self.keyed(urls).select("normalized_url", host_of(F.col("normalized_url")).alias("domain"), F.lit(now).cast("timestamp").alias("first_seen_at"), F.lit(now).cast("timestamp").alias("last_seen_at"), F.lit(1).cast("long").alias("seen_count"), F.lit(False).alias("crawler_pushed"))
        self.sightings.update(new.join(self.sightings.read().select("normalized_url"), "normalized_url", "left_anti"), batch)

    def unknown_urls(self, status: str | None = None, most: int = 100) -> DataFrame:
        current = state.latest_status(self.log.read(), "normalized_url", "crawl_status")
        return lookup.listing(self.sightings.read().join(current, "normalized_url", "left").fillna("pending", ["crawl_status"]), status, most)

    def mark(self, urls: DataFrame, status: str, now, batch: int, job: str | None = None) -> None:
        """Append a status to the log of each URL."""
        rows = self.keyed(urls).select("normalized_url", F.lit(status).alias("crawl_status"), F.lit(now).cast("timestamp").alias("updated_at"), F.lit(batch).cast("long").alias("seq"), F.lit(job).cast("string").alias("job_id"))
        self.log.update(rows, batch)

    def run_pipeline(self, articles: DataFrame, now, batch: int, scorer: Callable = stand_in) -> None:
        """Clean, score and rate saved articles, and merge the analyses by URL."""
        made = micro_batch.analysed(articles, scorer).withColumns({"analysis_time": F.lit(now).cast("timestamp"), "raw_label": F.col("confidence_level")})
        columns = [(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.of(schemas.ANALYSES)]
        self.analyses.update(made.select(columns), batch)

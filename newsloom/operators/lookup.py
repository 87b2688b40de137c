"""Batch lookups: URLs against analyses and statuses in two joins, whatever their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed as X
from newsloom.functions import rules
from newsloom.functions.text import blank_to_null
from newsloom.functions.urls import host_of
from newsloom.operators.scoring import risk_of
from newsloom.operators.state import latest_status


def label_map(urls: DataFrame, analyses: DataFrame, statuses: DataFrame) -> DataFrame:
    """urls (normalized_url) with label: the analysis's, else by its latest status (at equal times by seq, without one by name): processing,
    analysis_failed, or processing for the unknown. Of analyses of one time the greater label counts, so rows in any order give one answer."""
    label = F.coalesce(blank_to_null(F.col("raw_label")), blank_to_null(F.col("confidence_level")), F.lit("Unknown"))
    known = analyses.groupBy("normalized_url").agg(F.max_by(label, F.struct("analysis_time", label)).alias("found"))
    by_request = analyses.where("requested_url is not null").groupBy(F.col("requested_url").alias("normalized_url")).agg(F.max_by(label, F.struct("analysis_time", label)).alias("asked"))
    status = latest_status(statuses, "normalized_url", "crawl_status", ("updated_at", "seq") if "seq" in statuses.columns else ("updated_at", "crawl_status"))
    joined = urls.join(known, "normalized_url", "left").join(by_request, "normalized_url", "left").join(status, "normalized_url", "left")
    return joined.withColumn("label", F.coalesce("found", "asked", status_label(F.col("crawl_status")))).drop("found", "asked")


def status_label(status: Column) -> Column:
    return F.when(status.isin(*X.FINISHED_OR_BLOCKED), "analysis_failed").otherwise("processing")


def detail(df: DataFrame) -> DataFrame:
    """The detail view of analyses: content by priority, risk filled in from the label where it is missing."""
    label = F.coalesce(blank_to_null(F.col("raw_label")), blank_to_null(F.col("confidence_level")), F.lit("Unknown"))
    content = F.coalesce(*[blank_to_null(F.col(c)) for c in ("raw_content", "content", "cleaned_content", "article_content", "text") if c in df.columns], F.lit(""))
    risk = risk_of(label)
    pick = lambda c: F.coalesce(F.col(c), risk[c]) if c in df.columns else risk[c]
    return df.select("normalized_url", host_of(F.col("normalized_url")).alias("domain"), label.alias("raw_label"), pick("risk_level").alias("risk_level"), pick("risk_label").alias("risk_label"), pick("short_reason").alias("short_reason"), content.alias("content"))


def summary(df: DataFrame, requested: str = "requested_url") -> DataFrame:
    """The thirteen fields of a known analysis; a missing requested URL is the normalized one."""
    label = F.coalesce(blank_to_null(F.col("raw_label")), blank_to_null(F.col("confidence_level")))
    risk = risk_of(F.coalesce(label, F.lit("Unknown")))
    pick = lambda c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    return df.select(
        pick(requested, F.col("normalized_url")).alias("requested_url"), "normalized_url", host_of(F.col("normalized_url")).alias("domain"),
        *[pick(c, risk[c]).alias(c) for c in ("risk_level", "risk_label")], F.lit("recorded").alias("data_status"), F.lit(X.RECORDED_LABEL).alias("data_status_label"),
        pick("short_reason", risk["short_reason"]).alias("short_reason"), F.lit(True).alias("detail_available"), F.lit("url").alias("match_scope"), F.lit("normalized_url").alias("matched_by"),
        (F.col("analysis_time") if "analysis_time" in df.columns else F.lit(None).cast("timestamp")).alias("analysis_time"), label.alias("raw_label"),
    )


def answer_of(url: Column, status: Column) -> Column:
    """What to say of a URL without analysis: a page that is no article, a paywalled one, or not_found()."""
    return F.when(rules.skipped(url), "skipped_non_article").when(rules.paywall_reason(url).isNotNull(), "paywalled").otherwise(not_found(status))


def no_result(df: DataFrame, answer: Column, url: str = "normalized_url") -> DataFrame:
    """The thirteen fields for URLs without analysis, by their answer."""
    given = lambda i, kind: F.coalesce(*[F.when(answer == name, F.lit(values[i]).cast(kind)) for name, values in X.ANSWERS.items()])
    return df.select(
        F.col(url).alias("requested_url"), F.col(url).alias("normalized_url"), host_of(F.col(url)).alias("domain"), given(0, "int").alias("risk_level"), given(1, "string").alias("risk_label"),
        answer.alias("data_status"), given(2, "string").alias("data_status_label"), F.coalesce(given(3, "string"), rules.paywall_reason(F.col(url))).alias("short_reason"), F.lit(False).alias("detail_available"),
        F.lit("none").alias("match_scope"), F.lit("none").alias("matched_by"), F.lit(None).cast("timestamp").alias("analysis_time"), F.lit(None).cast("string").alias("raw_label"),
    )


def not_found(status: Column) -> Column:
    """What to say of a URL without analysis: processing, finished_without_result, analysis_failed or not_recorded."""
    return F.when(status.isNull(), "not_recorded").when(status.isin(*X.IN_FLIGHT), "processing").when(status == "analysis_done", "finished_without_result").when(status.isin(*X.FINISHED_OR_BLOCKED), "analysis_failed").otherwise("processing")


def hover_state(url_in_batch: Column, url_done: Column) -> Column:
    """done, queued (in the batch, to be brought forward) or new."""
    return F.when(url_done, "done").when(url_in_batch, "queued").otherwise("new")


def work_order(urls: DataFrame, order: str) -> DataFrame:
    """Open URLs: hovered ones first, the latest hover before the others; then the batch in its order. Done ones are out."""
    return urls.where("not done").orderBy(F.col("hovered_at").desc_nulls_last(), order)


def listing(df: DataFrame, status: str | None = None, most: int = 100, order: str = "last_seen_at", key: str = "normalized_url") -> DataFrame:
    """The earliest `most` rows, of one status if one is named; 0 means all."""
    out = (df.where(F.col("crawl_status") == status) if status else df).orderBy(order, key)
    return out.limit(most) if most else out

"""Explicit schemas of the tables that the operators exchange."""

from pyspark.sql import types as T

ARTICLES = "url STRING, normalized_url STRING, title STRING, content_id STRING, fetched_at TIMESTAMP, domain STRING, site STRING, text_len INT, crawler STRING"
CONTENTS = "hash STRING, text_hash STRING, markdown STRING, html STRING, text STRING, text_len INT, source_url STRING, updated_at TIMESTAMP"
CRAWL_CSV = "job_id STRING, url STRING, normalized_url STRING, domain STRING, site STRING, title STRING, text STRING, text_len INT, fetched_at STRING, status STRING, error_message STRING"
CRAWL_ROW = CRAWL_CSV + ", is_blocked BOOLEAN, block_reason STRING, proxy_used STRING, attempts INT"
JOB = "job_id STRING, source STRING, created_at STRING, urls ARRAY<STRING>"
SEEDS = (
    "base_url STRING, allow_hosts ARRAY<STRING>, allow_prefixes ARRAY<STRING>, deny_urls ARRAY<STRING>, deny_prefixes ARRAY<STRING>, deny_path_contains ARRAY<STRING>, "
    "allowed_schemes ARRAY<STRING>, formats ARRAY<STRING>, onlyMainContent BOOLEAN, blockAds BOOLEAN, `limit` INT, min_content_len INT, bulk_size INT"
)
ANALYSES = (
    "requested_url STRING, normalized_url STRING, domain STRING, raw_label STRING, confidence_level STRING, risk_label STRING, risk_level INT, short_reason STRING, probability_real DOUBLE, "
    "selected_sentences ARRAY<STRING>, selected_scores ARRAY<DOUBLE>, matched_sentences ARRAY<STRUCT<preprocessed:STRING,matched_text:STRING,matched:STRING,start_index:INT,end_index:INT,"
    "cos_similarity:DOUBLE,span_similarity:DOUBLE,similarity:DOUBLE>>, title STRING, raw_content STRING, content STRING, cleaned_content STRING, analysis_time TIMESTAMP, job_id STRING"
)
SIGHTINGS = "normalized_url STRING, domain STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, seen_count BIGINT, crawler_pushed BOOLEAN"
STATUS_LOG = "normalized_url STRING, crawl_status STRING, updated_at TIMESTAMP, seq BIGINT, job_id STRING"


def of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

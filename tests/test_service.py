from pyspark.sql import functions as F

from newsloom.operators import scoring
from newsloom.service import Service
from newsloom.sources import schemas


def test_round_trip(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    urls = spark.createDataFrame([("http://A.com/1?utm_source=x",), ("http://a.com/1",), ("http://a.com/2",), ("",)], "url string")
    labels, fetch = s.check_urls_batch(urls, "2026-01-01 00:00:00", 1)
    assert {r["normalized_url"]: r["label"] for r in labels.collect()} == {"http://a.com/1": "processing", "http://a.com/2": "processing"}
    row = {"job_id": "j", "url": "http://a.com/1", "text": "some words of one article", "status": "content_saved", "title": "t"}
    articles = spark.createDataFrame([row], "job_id string, url string, text string, status string, title string")
    s.run_pipeline(articles, "2026-01-02 00:00:00", 1)
    s.mark(urls.where("url like '%2'"), "blocked", "2026-01-02 00:00:00", 1)
    labels, fetch = s.check_urls_batch(urls, "2026-01-03 00:00:00", 2)
    got = {r["normalized_url"]: r["label"] for r in labels.collect()}
    assert got["http://a.com/2"] == "analysis_failed" and got["http://a.com/1"] in {n for _, n in scoring.X.BANDS}
    assert fetch.count() == 0 and s.health() == {"status": "ok", "analyses": 1, "urls": 2}
    assert s.check(urls).count() == 1 and [s.check_one(u).count() for u in ("http://A.com/1?utm_source=x", "http://a.com/1", "http://a.com/2")] == [1, 1, 0]
    assert {r["normalized_url"]: r["answer"] for r in s.details(urls).collect()} == {"http://a.com/1": "found", "http://a.com/2": "analysis_failed"}
    assert [r["normalized_url"] for r in s.unknown_urls("blocked").collect()] == ["http://a.com/2"]
    s.save_urls(spark.createDataFrame([("http://a.com/3",), ("http://a.com/1",)], "url string"), "2026-01-04 00:00:00", 3)
    assert s.health()["urls"] == 3
    s.mark(urls, "queued", "2026-01-02 00:00:00", 2, "job")
    s.mark(urls.where("url like '%2'"), "analysis_done", "2026-01-02 00:00:00", 3, "job")
    assert [tuple(r) for r in s.pipeline_status("job").collect()] == [("job", 2, 1, 1, False)]
    s.mark(urls, "blocked", "2026-01-02 00:00:01", 4, "job")
    assert [r["done"] for r in s.pipeline_status().collect()] == [True]


def test_answers_without_analysis(spark, tmp_path):
    """Pages that are no articles are skipped before anything is looked up; paywalled ones come next."""
    s = Service(spark, str(tmp_path))
    urls = spark.createDataFrame([("https://www.mission-tw.com/category/x",), ("https://www.mission-tw.com/article/a/12",), ("https://www.chinatimes.com/album/memberarticles/1",)], "url string")
    assert [r["answer"] for r in s.details(urls).orderBy("normalized_url").collect()] == ["paywalled", "not_recorded", "skipped_non_article"]
    one = s.check(urls)
    assert one.count() == 0 and len(one.columns) == 13


def test_pushed_once(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    urls = spark.createDataFrame([("http://a.com/1",)], "url string")
    first = s.check_urls_batch(urls, "2026-01-01 00:00:00", 1)[1].count()
    assert s.sightings.read().first()["crawler_pushed"]
    assert s.check_urls_batch(urls, "2026-01-01 00:00:01", 2)[1].count() == 0 and s.sightings.read().first()["seen_count"] == 2
    assert first in (0, 1)


def test_small_forms(spark):
    one = spark.range(1)
    r = one.select(
        scoring.score_text(F.lit(0.5)).alias("a"), scoring.score_text(F.lit(12.4)).alias("b"), scoring.duration_text(F.lit(3725.0)).alias("c"), scoring.backoff_seconds(F.lit(9)).alias("d"),
        scoring.best_chunk(F.expr("array(array(0.1D, 0.9D), array(0.2D, 0.8D))")).alias("e"), scoring.weights_by_position(F.expr("array(1, 2, 1)"), F.expr("array(0.5D, -1D, 0.25D)")).alias("f"),
        scoring.without_overlaps(F.expr("array(struct(5 as start, 9 as end), struct(0 as start, 6 as end), struct(6 as start, 7 as end))")).alias("g"), scoring.fake_or_real(F.lit(0)).alias("h"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["h"]) == ("0.500", "12", "1h 2m 5s", 8.0, 1, {1: 0.75}, "fake")
    assert [tuple(x) for x in r["g"]] == [(0, 6), (6, 7)]


def test_schemas():
    for ddl in (schemas.ARTICLES, schemas.CONTENTS, schemas.CRAWL_ROW, schemas.JOB, schemas.SEEDS, schemas.ANALYSES, schemas.SIGHTINGS, schemas.STATUS_LOG):
        assert schemas.of(ddl).fields

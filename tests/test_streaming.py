import time

from pyspark.sql import functions as F

from newsloom.sources import schemas
from newsloom.streaming import micro_batch as M


def articles(spark, ids):
    cells = {"job_id": "j", "normalized_url": "", "domain": "a.com", "site": "a", "title": "", "fetched_at": "", "status": "content_saved", "error_message": ""}
    d = spark.createDataFrame([(i,) for i in ids], "i int")
    made = {**{k: F.lit(v) for k, v in cells.items()}, "url": F.concat(F.lit("http://a.com/"), F.col("i").cast("string")), "text": F.concat(F.lit("some words of article number "), F.col("i").cast("string")), "text_len": F.lit(9)}
    return d.select(*[made[f.name].alias(f.name) for f in schemas.of(schemas.CRAWL_CSV)])


def test_stream_equals_batch(spark, tmp_path):
    target = M.analyses_table(spark, str(tmp_path / "table"))
    for part in ([1, 2, 3], [3, 4], [5]):
        articles(spark, part).write.mode("append").option("header", True).csv(str(tmp_path / "in"))
        M.run_analyses(spark, str(tmp_path / "in"), target, str(tmp_path / "checkpoint")).awaitTermination()
    want = M.analysed(articles(spark, [1, 2, 3, 4, 5])).select("normalized_url", "probability_real", "risk_level")
    got = target.read().select("normalized_url", "probability_real", "risk_level")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5


def test_the_last_written_analysis_stays(spark, tmp_path):
    """Two analyses of one URL in a batch: the later fetch counts, and at equal times the later row, not the kinder score."""
    scorer = lambda text: (0.0, 5.0 if "kind" in text else -5.0, [0.1] * len(text.split()))
    base = articles(spark, [1]).first().asDict()
    rows = [base | {"text": "a kind verdict at first", "fetched_at": "2026-01-01"}, base | {"text": "a harsh verdict later on", "fetched_at": "2026-01-02"}, base | {"url": "http://a.com/2", "text": "a kind verdict"}, base | {"url": "http://a.com/2", "text": "a harsh verdict"}]
    spark.createDataFrame(rows, schemas.CRAWL_CSV).coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    target = M.analyses_table(spark, str(tmp_path / "table"))
    M.run_analyses(spark, str(tmp_path / "in"), target, str(tmp_path / "checkpoint"), scorer).awaitTermination()
    got = {r["normalized_url"]: r["prediction"] for r in target.read().collect()}
    assert got == {"http://a.com/1": 0, "http://a.com/2": 0}


def test_stop_and_catch_up_lose_nothing(spark, tmp_path):
    """Stopped between batches with files unread: the sweep reads them, the reprocess finds nothing new; what is lost it brings back."""
    folder, mark = str(tmp_path / "in"), str(tmp_path / "marks")
    target = M.analyses_table(spark, str(tmp_path / "table"))
    give = lambda ids: articles(spark, ids).coalesce(1).write.mode("append").option("header", True).csv(folder)
    give([1, 2])
    query = M.run_analyses(spark, folder, target, str(tmp_path / "checkpoint"), once=False)
    for _ in range(300):
        if target.manifest()["batch"] >= 0:
            break
        time.sleep(0.1)
    M.ask_to_stop(spark, mark)
    give([3])
    M.stopped_at_mark(query, mark)
    assert not query.isActive and {1, 2} <= {int(r["normalized_url"][-1]) for r in target.read().collect()}
    give([4, 5])
    assert M.caught_up(spark, folder, target, str(tmp_path / "checkpoint")) == 0
    rows = sorted(map(tuple, target.read().drop("batch", "seq").collect()))
    assert len(rows) == 5
    assert M.caught_up(spark, folder, M.analyses_table(spark, str(tmp_path / "other")), str(tmp_path / "checkpoint")) == 5  # all files read, none in this table
    assert sorted(map(tuple, M.analyses_table(spark, str(tmp_path / "other")).read().drop("batch", "seq").collect())) == rows


def test_sightings_stream(spark, tmp_path):
    spark.range(10).selectExpr("concat('u', id % 3) url", "timestamp_seconds(id) ts").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "e"))
    q = M.running_sightings(s).writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["url"], r["seen_count"]) for r in spark.table("seen").collect()) == [("u0", 4), ("u1", 3), ("u2", 3)]


def test_push_once(spark, tmp_path):
    spark.range(10).selectExpr("concat('u', id % 3) url", "timestamp_seconds(id) ts").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "e"))
    q = M.push_once(s).writeStream.format("memory").queryName("pushed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["url"] for r in spark.table("pushed").collect()) == ["u0", "u1", "u2"]

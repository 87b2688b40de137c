import json

import pytest
from pyspark.sql import functions as F

from newsloom.sources import io, schemas


def test_jobs(spark, tmp_path):
    (tmp_path / "j1.json").write_text(json.dumps({"urls": ["http://a", "http://b"], "source": "s"}))
    got = sorted(map(tuple, io.read_jobs(spark, str(tmp_path)).collect()))
    assert got == [("j1", "s", "", "http://a"), ("j1", "s", "", "http://b")]
    (tmp_path / "j2.json").write_text(json.dumps({"job_id": "x"}))
    with pytest.raises(Exception, match="job without a list of urls"):
        io.read_jobs(spark, str(tmp_path)).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", 'a "quoted"\nline', None)], "url string, text string, title string")
    io.write_csv(df, str(tmp_path / "c"), [f.name for f in schemas.of(schemas.CRAWL_CSV)])
    r = io.read_csv(spark, str(tmp_path / "c"), schemas.CRAWL_CSV).first()
    assert (r["url"], r["text"], r["title"], r["job_id"]) == ("u", 'a "quoted"\nline', "", "")


def test_bom(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿text,label\nx,1\n", encoding="utf-8")
    assert io.read_csv_any(spark, str(tmp_path / "b.csv")).columns == ["text", "label"]


def test_page_shapes(spark):
    page = {"html": "<p>" + "word " * 10 + "</p>", "metadata": {"sourceURL": "http://u", "title": "T"}}
    shapes = [json.dumps(page), json.dumps({"data": page}), json.dumps({"markdown": "m", "html": "<html><body></body></html>", "rawHtml": "<p>raw text that is long enough</p>"})]
    df = spark.createDataFrame([(s,) for s in shapes], "j string").select(io.standard_page(F.col("j"), F.lit("http://f")).alias("p")).select("p.*")
    a, b, c = df.collect()
    assert a == b and a["url"] == "http://u" and a["title"] == "T"
    assert c["url"] == "http://f" and c["html"].startswith("<p>raw") and c["markdown"] == "m"


def test_page_lists(spark):
    shapes = ['[{"a":1},{"a":2}]', '{"data":[{"a":1}]}', '{"a":1}']
    got = [len(r[0]) for r in spark.createDataFrame([(s,) for s in shapes], "j string").select(io.pages_of(F.col("j"))).collect()]
    assert got == [2, 1, 1]


def test_sinks_of_articles_and_metrics(spark, tmp_path):
    import glob

    df = spark.createDataFrame([("http://a.com/1", 1), ("http://a.com/2", None)], "url string, n int")
    io.write_csv(df, f"file://{tmp_path}/marked", ["url", "n"], mark=True)
    (first, *_) = sorted(glob.glob(f"{tmp_path}/marked/*.csv"))
    assert open(first, "rb").read().startswith(b"\xef\xbb\xbfurl,n")
    io.write_pages(df, f"file://{tmp_path}/pages")
    assert len(glob.glob(f"{tmp_path}/pages/slug=*")) == 2
    io.write_metrics(df, f"file://{tmp_path}/metrics")
    assert len(glob.glob(f"{tmp_path}/metrics/csv/*.csv")) == len(glob.glob(f"{tmp_path}/metrics/json/*.json")) == 1

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedup, frontier, ingest, lookup, match, metrics, scoring, state


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_keep_first_and_mark_later(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, t string")
    assert rows(dedup.keep_first(df, ["t"], ["id"])) == [(1, "x"), (2, "y")]
    assert rows(dedup.keep_last(df, ["t"], ["id"])) == [(2, "y"), (3, "x")]
    assert rows(dedup.mark_later(df, "t", ["id"]), "id") == [(1, "x"), (2, "y"), (3, None)]
    assert dedup.keep_first(df.limit(0), ["t"], ["id"]).count() == 0


def test_cap(spark):
    df = spark.range(7).select("id", F.lit("h").alias("d"))
    assert [r[0] for r in rows(dedup.cap_per_key(df, ["d"], ["id"], 5))] == [0, 1, 2, 3, 4]


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "1.0", "0", "2", "abc", "", None)], "x string")
    assert [r[0] for r in df.select(ingest.valid_label(F.col("x"))).collect()] == [1, 1, 0, None, None, None, None]


def test_split_shares(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = {(r["y"], r["split"]): r["count"] for r in ingest.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert got == {(0, "train"): 675, (0, "validation"): 38, (0, "test"): 37, (1, "train"): 225, (1, "validation"): 13, (1, "test"): 12}


def test_resolve_column(spark):
    assert ingest.resolve_column(spark.createDataFrame([(1, "a")], "x int, content string")) == "content"
    with pytest.raises(ValueError):
        ingest.resolve_column(spark.range(1))


def test_job_status(spark):
    df = spark.createDataFrame([(1, "content_saved"), (2, "blocked"), (3, "content_saved"), (3, "failed"), (4, "failed")], "job_id int, status string")
    assert {r["job_id"]: r["job_status"] for r in state.job_status(df).collect()} == {1: "content_saved", 2: "blocked", 3: "partial_done", 4: "partial_done"}


def test_sightings(spark):
    e = spark.createDataFrame([("u", 1), ("u", 3), ("u", 2)], "url string, ts int")
    old, new = state.sightings(e.where("ts < 3")), state.sightings(e.where("ts = 3"))
    assert rows(state.merge_sightings(old, new)) == [("u", 1, 3, 3, False)]


def test_upsert(spark):
    a, b = spark.createDataFrame([("k", 1, "old"), ("l", 1, "l")], "k string, ts int, v string"), spark.createDataFrame([("k", 1, "new"), ("m", 0, "m")], "k string, ts int, v string")
    assert rows(state.upsert(a, b, ["k"], ["ts"])) == [("k", 1, "new"), ("l", 1, "l"), ("m", 0, "m")]
    assert rows(state.insert_if_absent(a, b, ["k"], ["ts"])) == [("k", 1, "old"), ("l", 1, "l"), ("m", 0, "m")]


def test_last_non_null(spark):
    df = spark.createDataFrame([(1, 1, "v1", None), (1, 2, None, "v2")], "e int, o int, a string, b string")
    assert rows(state.last_non_null(df, "e", "o", ["a", "b"])) == [(1, "v1", "v2")]


def test_metrics(spark):
    none = spark.createDataFrame([(1, 0), (1, 0)], "y int, p int")
    assert rows(metrics.binary_metrics(none)) == [(0.0, 0.0, 0.0, 0.0)]
    assert rows(metrics.confusion_matrix(none)) == [(0, 0, 0), (1, 2, 0)]
    assert rows(metrics.binary_metrics(none.limit(0))) == [(0.0, 0.0, 0.0, 0.0)]


def test_latency(spark):
    r = metrics.latency_summary(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double"), "v").first()
    assert (r["p50"], r["p75"], r["p90"], r["p95"], r["p99"]) == pytest.approx((2.5, 3.25, 3.7, 3.85, 3.97)) and r["stdev"] == pytest.approx(1.2909944)
    assert metrics.latency_summary(spark.createDataFrame([(1.0,)], "v double"), "v").first()["stdev"] == 0.0


def test_matching():
    from collections import Counter

    assert match.cosine(Counter("xxy"), Counter("xz")) == pytest.approx(0.6325, abs=1e-4)
    assert match.edit_similarity(list("abc"), list("axc")) == pytest.approx(2 / 3)
    assert match.edit_similarity([], []) == 1.0 and match.edit_similarity([], ["a"]) == 0.0
    text = "Alpha beta gamma, delta. The quick brown fox jumps over it!"
    (m,) = match.locate(["quick brown fox"], text)
    assert (m["start_index"], m["end_index"], m["span_similarity"]) == (29, 44, 1.0)
    assert (m["cos_similarity"], m["similarity"]) == (0.6547, 0.8273) and text[29:44] == m["matched_text"]
    (m,) = match.locate(["zzz yyy xxx"], text)
    assert m["matched_text"] is None and m["similarity"] == 0.0
    assert match.locate([], text) == [] and match.locate(["a"], None) == []


def test_group_bounds():
    """Runs follow each other, hold n tokens unless the next segment would make it over 2n, and end as soon as they do."""
    rng = random.Random(5)
    for _ in range(500):
        counts, n = [rng.randint(1, 9) for _ in range(rng.randint(0, 30))], rng.randint(1, 12)
        runs = match.group_bounds(counts, n)
        assert [i for a, b in runs for i in range(a, b)] == list(range(len(counts)))
        for a, b in runs:
            size = sum(counts[a:b])
            assert b == a + 1 or sum(counts[a : b - 1]) < n and size <= 2 * n
            assert size >= n or b == len(counts) or size + counts[b] > 2 * n


def test_best_window_by_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        words, wanted = [rng.choice("abcd") for _ in range(rng.randint(1, 30))], [rng.choice("abcde") for _ in range(rng.randint(1, 9))]
        text = " ".join(words)
        got = match.best_window(wanted, text, 0, len(text))
        if len(words) <= len(wanted):
            assert got == (round(match.edit_similarity(wanted, words), 4), 0, len(text))
            continue
        sizes = range(len(wanted), min(len(words), int(len(wanted) * 1.5)) + 1)
        tried = [(-match.edit_similarity(wanted, words[i : i + k]), k, i) for k in sizes for i in range(len(words) - k + 1)]
        like, k, i = min(tried)
        assert got == (round(-like, 4), 2 * i, 2 * (i + k) - 1)


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.8, 0.7999, 0.6, 0.4, 0.2, 0.1999)], "p double")
    assert [r[0] for r in df.select(scoring.band(F.col("p"))).collect()] == ["Highly Real", "Likely Real", "Likely Real", "Uncertain", "Likely Fake", "Highly Fake"]
    r = spark.range(1).select(scoring.risk_of(F.lit("可能假新聞 (Likely Fake)")).alias("r"), scoring.risk_of(F.lit(None).cast("string")).alias("u"), scoring.temperature_sigmoid(F.lit(3.0)).alias("s")).first()
    assert r["r"]["risk_level"] == 4 and r["u"]["risk_label"] == "未知" and r["s"] == pytest.approx(0.967987, abs=1e-5)


def test_ranks(spark):
    df = spark.createDataFrame([(10.1,), (10.0,), (5.0,), (4.99,), (None,)], "s double")
    assert [r[0] for r in df.select(scoring.absolute_rank(F.col("s"))).collect()] == [1, 2, 2, 3, 0]


def test_windows(spark):
    df = spark.createDataFrame([(900,), (510,), (511,), (0,)], "n int").select(F.expr("CASE WHEN n = 0 THEN array() ELSE transform(sequence(1, n), x -> cast(x as string)) END").alias("t"))
    got = [[(w["start"], w["start"] + len(w["tokens"])) for w in r["w"]] for r in df.select(scoring.token_windows(F.col("t")).alias("w")).collect()]
    assert got == [[(0, 510), (382, 892), (764, 900)], [(0, 510)], [(0, 510), (382, 511)], [(0, 0)]]


def test_scores(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine."), (2, None), (3, " ")], "id int, t string")
    got = {r["id"]: r for r in scoring.score_articles(df, "id", "t").collect()}
    assert got[1]["prediction"] in (0, 1) and got[2]["confidence_level"] == got[3]["confidence_level"] == scoring.UNSCORABLE_LEVEL

    def broken(text):
        raise ValueError("no")

    assert scoring.score_articles(df, "id", "t", broken).where("id = 1").first()["error"] == "ValueError: no"


def test_lookup(spark):
    urls = spark.createDataFrame([(x,) for x in "abcde"], "normalized_url string")
    analyses = spark.createDataFrame([("a", None, "Likely Real", "", 1), ("z", "b", "", "Highly Fake", 1)], "normalized_url string, requested_url string, raw_label string, confidence_level string, analysis_time int")
    statuses = spark.createDataFrame([("c", "crawling", 1), ("d", "blocked", 1)], "normalized_url string, crawl_status string, updated_at int")
    got = {r["normalized_url"]: r["label"] for r in lookup.label_map(urls, analyses, statuses).collect()}
    assert got == {"a": "Likely Real", "b": "Highly Fake", "c": "processing", "d": "analysis_failed", "e": "processing"}


def test_bfs(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(frontier.bfs(spark.createDataFrame([("a",)], "url string"), links, 2)) == [("a", 0), ("b", 1), ("c", 2)]


def test_label_map_ties(spark):
    """Statuses and analyses of one time give one answer, whatever the order of the rows."""
    urls = spark.createDataFrame([("u",), ("w",)], "normalized_url string")
    analyses = [("w", None, "A", "x", 1), ("w", None, "B", "x", 1)]
    log = [("u", "queued", 5, 1), ("u", "failed", 5, 2)]
    for turn in (1, -1):
        a = spark.createDataFrame(analyses[::turn], "normalized_url string, requested_url string, raw_label string, confidence_level string, analysis_time int").coalesce(1)
        s = spark.createDataFrame(log[::turn], "normalized_url string, crawl_status string, updated_at int, seq int").coalesce(1)
        assert {r["normalized_url"]: r["label"] for r in lookup.label_map(urls, a, s).collect()} == {"u": "analysis_failed", "w": "B"}

"""Percentiles by selection, rules by suffix, and a scorer that learns."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import metrics, scoring, selection, suffixes, training
from newsloom.plans import catalog


def test_keys_keep_the_order():
    values = np.array([-np.inf, -1e300, -1.5, -1e-300, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf, np.nan])
    keys = selection.keyed(values.copy()).view(np.uint64)
    assert (np.diff(keys.astype(object)) > 0).all() and selection.keyed(np.array([-0.0])) == selection.keyed(np.array([0.0]))
    assert np.array_equal(selection.unkeyed(selection.keyed(values.copy())), values, equal_nan=True)


def test_percentiles_by_selection(spark):
    """Distinct doubles, ties, one value, a null group, groups without values: what numpy gives."""
    rng = random.Random(5)
    rows = [("many", rng.gauss(0, 1e6)) for _ in range(3000)] + [("ties", float(rng.randrange(3))) for _ in range(200)] + [("one", 7.5), (None, 1.0), (None, 2.0), ("none", None), ("many", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in selection.exact_percentiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == {"many", "ties", "one", None}
    for g, r in got.items():
        values = [x for k, x in rows if k == g and x is not None]
        for name, q in shares.items():
            assert math.isclose(r[name], float(np.quantile(values, q)), rel_tol=1e-12, abs_tol=1e-9)
    whole = selection.exact_percentiles(df, "x", {"p50": 0.5}).first()["p50"]
    assert math.isclose(whole, float(np.median([x for _, x in rows if x is not None])), rel_tol=1e-12)


def test_latency_summary_either_way(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 1.25).alias("x"))
    a, b = (sorted(map(tuple, metrics.latency_summary(df, "x", ["g"], most).collect())) for most in (10**6, 10))
    assert len(a) == 3 and all(x[0] == y[0] and np.allclose(x[1:], y[1:]) for x, y in zip(a, b))


def test_rules_by_suffix(spark):
    """Twenty thousand rules, held against each other one by one; the plan is as long as with three."""
    rng = random.Random(6)
    labels = ["a", "b", "c", "news", "x1"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4))) + rng.choice(["", ".com", ".tw"])
    rules = {rng.choice(["", "."]) + host(): i for i in range(300)} | {f".r{i}.example.com": i for i in range(20_000)}
    hosts = [host() for _ in range(400)] + ["y.r77.example.com", "r78.example.com", "xr78.example.com", "A.COM", "", None]

    def best(h):
        parts = (h or "").lower().split(".")
        if h is None:
            return None, None
        for rule in [h.lower(), *("." + ".".join(parts[i:]) for i in range(len(parts)))]:
            if rule in rules:
                return rule, rules[rule]
        return None, None

    table = spark.createDataFrame(list(rules.items()), "rule string, v int")
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "id int, host string")
    got = suffixes.with_rule(df, "host", table)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, h, *best(h)) for i, h in enumerate(hosts)), key=repr)
    size = lambda x: len(suffixes.with_rule(df, "host", x)._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(table) == size(spark.createDataFrame([("a", 1)], "rule string, v int"))


def test_a_scorer_that_learns(spark):
    """Better than chance by far on what it hasn't seen, the same each time, with a temperature from the grid."""
    rows = catalog.labelled(spark, "/root/testdata/sf0.01").cache()
    model = training.fitted(rows, steps=25)
    again = training.fitted(rows, steps=25)
    assert np.allclose(model.weights, again.weights) and model.step == again.step and 0.5 <= model.temperature <= 5
    held = rows.where("split <> 'train'")
    got = scoring.score_articles(held, "doc_id", "text", model.scorer(), 1.0, carry=("label",)).where("prediction >= 0").toPandas()
    good, bad = got[got.label == 1].probability_real.to_numpy(), got[got.label == 0].probability_real.to_numpy()
    assert len(good) > 5 and len(bad) >= 5 and (good[:, None] > bad).mean() > 0.8
    assert training.fitted(rows.where("label = 1"), steps=3).step == 0
    rows.unpersist()


def test_gradient(spark):
    """The sum over tasks is the derivative of the loss."""
    rows = spark.createDataFrame([("good news today", 1, "train"), ("bad news", 0, "train"), ("good bad", 1, "train"), ("x", 0, "validation")], "text string, label int, split string").repartition(2)
    texts = [(r["text"], r["label"]) for r in rows.where("split = 'train'").collect()]
    weights = np.random.default_rng(1).normal(0, 0.5, training.FEATURES + 1)
    at = [np.flatnonzero(training.features(t)) for t, _ in texts]
    packed = [(bytearray(a.astype("<u2").tobytes()), bytearray(training.features(t)[a].astype("<f4").tobytes()), y, True) for a, (t, y) in zip(at, texts)]
    frame = spark.createDataFrame(packed, "at binary, x binary, y int, train boolean")
    got = dict(training.added(frame, weights, {0: 1.5, 1: 0.75}))

    def loss(w):
        return sum({0: 1.5, 1: 0.75}[y] * (np.logaddexp(0, z := float(training.features(t) @ w[:-1] + w[-1])) - y * z) for t, y in texts)

    assert math.isclose(got[-1], loss(weights), rel_tol=1e-5)
    for i in [int(at[0][0]), int(at[1][-1]), training.FEATURES]:
        step = np.zeros_like(weights)
        step[i] = 1e-5
        assert math.isclose(got[i], (loss(weights + step) - loss(weights - step)) / 2e-5, rel_tol=1e-3, abs_tol=1e-6)


def test_features_are_remembered_by_word():
    """Remembered places give what hashing every word, pair and run of three gives, also when the memory begins anew."""
    import xxhash

    def plain(text):
        words, found = text.lower().split(), np.zeros(training.FEATURES)
        for w in [*words, *map(" ".join, zip(words, words[1:])), *(w[i : i + 3] for w in words for i in range(len(w) - 2))]:
            found[xxhash.xxh3_64_intdigest(w) % training.FEATURES] += 1
        found = np.log1p(found)
        return found / np.sqrt(found @ found)

    for text in ("The cat sat the cat", "a", "x" * 500 + " Ünder 日本語 " * 3):
        assert np.array_equal(training.features(text), plain(text)) and training.word_places("cat")[0] == training.place("cat")
    assert not training.features(None).any()


def test_features_of_many_texts(spark):
    """What features() gives for each, in a fraction of the time."""
    texts = ["The cat sat the cat", "a", "", None, " \n", "x" * 500 + " Ünder 日本語 " * 3, "𝔘𝔫 ab abc", "".join(chr(0x4E00 + i % 3000) for i in range(9000))]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    start = time.perf_counter()
    want = np.array([training.features(t) for t in texts])
    alone = time.perf_counter() - start
    start = time.perf_counter()
    at, x, own = training.features_of(texts)
    assert time.perf_counter() - start < alone / 1.5
    got = np.zeros_like(want)
    got[own, at] = x
    assert np.allclose(got, want, atol=1e-12) and np.array_equal(got > 0, want > 0) and not len(training.features_of([])[0])


def test_ratings_without_reasons(spark):
    """The columns of score_articles that need no explanation, for blank texts too."""
    texts = [None, "", " \n", "good news today", "bad bad news"]
    df = spark.createDataFrame([*enumerate(texts)], "id long, t string")
    model = training.Model(np.random.default_rng(1).normal(0, 2, training.FEATURES + 1), 1, 0.1, 0.8)
    names = "id", "prediction", "probability_real", "confidence_level"
    want = scoring.score_articles(df, "id", "t", model.scorer(), 1.0, carry=("t",)).select(*names, "t").orderBy("id").collect()
    got = scoring.rated_articles(df, "id", "t", model.margins, model.temperature, carry=("t",)).orderBy("id").collect()
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g["probability_real"], w["probability_real"], rel_tol=1e-12)
        assert all(g[c] == w[c] for c in (*names, "t") if c != "probability_real")


def test_python_stages_take_bounded_pieces(spark):
    from newsloom.functions import text_exact
    from newsloom.operators import match

    d = spark.createDataFrame([(1, "some text of words")], "id long, t string")
    s = F.array("t")
    for df in (scoring.score_articles(d, "id", "t"), text_exact.clean_articles(d, "t"), match.located(d, "id", s, F.col("t"))):
        assert "MapInArrow" in df._jdf.queryExecution().toString() and df.count() == 1

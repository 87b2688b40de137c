"""Operators leave the caller's session as it was, and each plan keeps its own bounds."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.llm.queries import queries
from newsloom.llm.work import released, within_bounds

NAMES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def test_settings_stay(spark):
    before = [spark.conf.get(n) for n in NAMES]
    assert queries()["op8_arc_to_warc"](spark, "/root/testdata/sf0.001").count() > 0
    assert [spark.conf.get(n) for n in NAMES] == before


def test_plans_keep_their_bounds(spark):
    """Two plans made before either runs cut what they get as they say, whatever the session says by then."""

    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [len(f)]})

    rows = spark.range(0, 100, 1, 1).withColumn("t", F.repeat(F.lit("x"), F.lit(1000)))
    made = [rows.mapInPandas(released(sizes, *bounds), "n long") for bounds in ((1, 1 << 20), (50, 1 << 20), (1000, 10_000))]
    assert [{r["n"] for r in x.collect()} - {1, 50, 9, 10} for x in made] == [set()] * 3
    assert [max(r["n"] for r in x.collect()) for x in made] == [1, 50, 10] and all(sum(r["n"] for r in x.collect()) == 100 for x in made)


def test_settings_come_back_after_an_error(spark):
    before = [spark.conf.get(n) for n in NAMES]

    @within_bounds(3, 5)
    def operator(df):
        assert [spark.conf.get(n) for n in NAMES] == ["3", "5b"] or [spark.conf.get(n) for n in NAMES] == ["3", "5"]
        raise ValueError

    with pytest.raises(ValueError):
        operator(spark.range(1))
    assert [spark.conf.get(n) for n in NAMES] == before

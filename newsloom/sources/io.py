"""Sources and sinks: CSV and JSON lines with explicit schemas, job and seed files, page responses of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.urls import slug

from newsloom.functions.text import blank_to_null, is_empty_html
from newsloom.sources import schemas

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, schema: str, keep_empty: bool = True) -> DataFrame:
    """CSV with header and quoted line breaks; rows that don't fit are dropped. With keep_empty, empty strings stay empty."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").option("enforceSchema", True)
    df = reader.csv(path)
    strings = [c for c, t in df.dtypes if t == "string"]
    return df.fillna("", strings) if keep_empty else df


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV of unknown columns, all strings; a byte-order mark before the first name is ignored."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def read_collection(spark: SparkSession, path: str, columns: list[str] | None = None, **equal) -> DataFrame:
    """A Parquet table, with equality filters that are set and the columns asked for; both reach the scan."""
    df = spark.read.parquet(path)
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.select(*columns) if columns else df


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def point_lookup(df: DataFrame, url: str, *keys: str) -> DataFrame:
    """One row that has the URL under any of the keys (both forms by default); the filter reaches the scan. Stored tables have a
    lookup that reads less: keyed.Table.lookup() and lookup_either()."""
    hit = F.lit(False)
    for key in keys or ("normalized_url", "requested_url"):
        hit = hit | (F.col(key) == url)
    return df.where(hit).limit(1)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """job_id (the file's stem by default), source, created_at, url: one row per URL. A file without a list of URLs is an error."""
    raw = spark.read.schema(schemas.JOB).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)
    checked = F.when(F.col("urls").isNotNull(), F.col("urls")).otherwise(F.raise_error(F.concat(F.lit("job without a list of urls: "), "file")))
    return raw.select(F.coalesce("job_id", stem).alias("job_id"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("created_at", F.lit("")).alias("created_at"), F.explode(checked).alias("url"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.SEEDS).option("multiLine", True).json(path)
    if df.isEmpty():
        raise ValueError(f"no seeds in {path}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.CRAWL_ROW) -> DataFrame:
    return spark.read.schema(schema).json(path)


def pages_of(response: Column) -> Column:
    """JSON text of each page in a response that is a list, an object with a list in data, or one page."""
    listed = F.from_json(response, "array<string>")
    inner = F.from_json(F.get_json_object(response, "$.data"), "array<string>")
    return F.when(F.startswith(F.ltrim(response), F.lit("[")), listed).when(F.startswith(F.ltrim(F.get_json_object(response, "$.data")), F.lit("[")), inner).otherwise(F.array(response))


def standard_page(page: Column, fallback_url: Column) -> Column:
    """struct(markdown, html, url, title) from the paths on which a response may hold them; an empty shell of HTML gives way to the raw one."""

    def first(*paths: str) -> Column:
        return F.coalesce(*[blank_to_null(F.get_json_object(page, p)) for p in paths])

    at = lambda name: [f"$.{name}", f"$.data.{name}", f"$.content.{name}"]
    html, raw = first(*at("html")), first(*at("rawHtml"))
    return F.struct(
        F.coalesce(first(*at("markdown")), F.lit("")).alias("markdown"),
        F.coalesce(F.when(is_empty_html(html) & raw.isNotNull(), raw).otherwise(html), F.lit("")).alias("html"),
        F.coalesce(first(*at("url"), *at("metadata.sourceURL"), *at("metadata.url")), fallback_url).alias("url"),
        F.coalesce(first(*at("metadata.title"), *at("title")), F.lit("")).alias("title"),
    )


# --- sinks ----------------------------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, columns: list[str], mark: bool = False) -> None:
    """The fixed columns, in order; a missing one and nulls are empty. With mark, each file begins with a byte-order mark."""
    named = lambda c: "\ufeff" + c if mark and c == columns[0] else c
    df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(named(c)) for c in columns]).write.option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_predictions(df: DataFrame, path: str, key: str = "url") -> None:
    """A row per key with its result; the map of a driver's file would not hold a large batch."""
    df.select(key, F.struct(*[c for c in df.columns if c != key]).alias("result")).write.json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metrics table as CSV and as JSON, one file each: metrics are a few rows."""
    df.coalesce(1).write.option("header", True).csv(f"{path}/csv")
    df.coalesce(1).write.json(f"{path}/json")


def write_pages(df: DataFrame, path: str, url: str = "url") -> None:
    """Saved articles as CSV in a folder per URL, named by its slug; rows whose status isn't content_saved are left out."""
    df = df.where("status = 'content_saved'") if "status" in df.columns else df
    df.withColumn("slug", slug(F.col(url))).write.partitionBy("slug").option("header", True).option("escape", '"').csv(path)


def write_documents(df: DataFrame, path: str, by: str = "domain") -> None:
    """Bodies as text, in a folder per domain."""
    df.select(by, F.col("text").alias("value")).write.partitionBy(by).text(path)

"""From crawled articles to the table that is scored: joins, anti-joins, row assembly, counters, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import fixed as X
from newsloom.functions import text as T
from newsloom.operators import frontier

EXPORT_COLUMNS = ("job_id", "url", "normalized_url", "domain", "site", "title", "text", "text_len", "fetched_at", "status", "error_message")


def with_contents(articles: DataFrame, contents: DataFrame, key: str = "content_id") -> DataFrame:
    return articles.join(contents, key, "left")


def unprocessed(articles: DataFrame, analyses: DataFrame) -> DataFrame:
    """Articles of which neither the raw nor the normalized URL has been analysed: two anti-joins against one key set, no OR."""
    keys = analyses.select("url").union(analyses.select("normalized_url")).where("url is not null").distinct()
    out = articles.join(keys, "url", "left_anti")
    return out.join(keys.withColumnRenamed("url", "normalized_url"), "normalized_url", "left_anti").select(articles.columns)


def result_rows(predictions: DataFrame, details: DataFrame, raw: DataFrame, cleaned: DataFrame, titles: DataFrame, key: str = "url") -> DataFrame:
    """Predictions with what else is known of their URL: details, raw_content, cleaned_content (the raw one where there is none) and
    title, empty where unknown. Each table has one row a key; all joins are on the key, so one partitioning serves them."""
    out = predictions
    for other in (details, raw, cleaned, titles):
        out = out.join(other, key, "left")
    raw_text = F.coalesce("raw_content", F.lit(""))
    return out.withColumns({"raw_content": raw_text, "cleaned_content": F.coalesce("cleaned_content", raw_text), "title": F.coalesce("title", F.lit(""))})


def merged_stats(parts: DataFrame, names: list[str]) -> DataFrame:
    """The workers' counters added up, one row; a counter that a worker lacks counts 0, and so does every one without workers."""
    return parts.agg(*[F.coalesce(F.sum(F.col(n)) if n in parts.columns else F.lit(0).cast("long"), F.lit(0)).cast("long").alias(n) for n in names])


def with_row_ids(df: DataFrame, order: str, prefix: str = "d", into: str = "row_id", tie: str | None = None) -> DataFrame:
    """df with prefix and the row's number from 0 by `order` (nulls last), then `tie`: numbers within ranges of the order, plus the rows of the ranges before."""
    rows = frontier.ranged(df, order, tie)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # frontier.RANGES + 1 rows at most
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_last(), *([tie] if tie else []))) - 1 + F.col("__before")
    return rows.join(F.broadcast(before), "__range").select(*df.columns, F.concat(F.lit(prefix), rank.cast("string")).alias(into))


def export_rows(df: DataFrame) -> DataFrame:
    """The fixed columns, with defaults and a status by whether there is text."""
    body = T.blank_to_null(F.col("text"))
    made = {"text": F.coalesce(F.col("text"), F.lit("")), "text_len": F.length(F.coalesce("text", F.lit(""))), "status": F.when(body.isNotNull(), "content_saved").otherwise("failed"), "error_message": F.when(body.isNull(), "empty content").otherwise("")}
    return df.select(*[(made[c] if c in made else F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in EXPORT_COLUMNS])


def valid_label(label: Column) -> Column:
    """0 or 1 from any form of it, else null."""
    n = label.try_cast("double")
    return F.when(n.isin(0.0, 1.0), n.cast("int"))


def resolve_column(df: DataFrame, names=("text", "content", "raw_content", "article")) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {', '.join(names)}")


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[T.blank_to_null(c) for c in columns])


def outcome_counts(df: DataFrame, outcome: Column) -> DataFrame:
    return df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def before_and_after(df: DataFrame, kept: Column) -> DataFrame:
    """before, after, deleted: rows, those that a condition keeps, and the others (null keeps nothing)."""
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after")).withColumn("deleted", F.col("before") - F.col("after"))


def stratified_split(df: DataFrame, key: str, label: str, shares=(0.9, 0.05, 0.05), names=("train", "validation", "test"), seed: int = 42) -> DataFrame:
    """Column split: within each label, rows by a seeded hash of their key get the names in the given shares. A label of
    a third of all rows is one window partition: rank within hash buckets first, so that no task sorts a whole label."""
    bucketed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__b", F.shiftrightunsigned("__h", 56))
    sizes = bucketed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(label)
    sizes = sizes.withColumn("__before", F.sum("__n").over(w.orderBy("__b")) - F.col("__n")).withColumn("__all", F.sum("__n").over(w)).withColumnsRenamed({label: "__l", "__b": "__c"})
    joined = bucketed.join(sizes, (F.col("__b") == F.col("__c")) & F.col(label).eqNullSafe(F.col("__l")))
    rank = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)) + F.col("__before")
    ranked = joined.withColumn("__share", (rank - 1) / F.col("__all"))
    out, upto = None, 0.0
    for name, share in zip(names[:-1], shares):
        upto += share
        out = (out.when if out is not None else F.when)(F.col("__share") < upto, name)
    return ranked.withColumn("split", out.otherwise(names[-1])).select(*df.columns, "split")


def length_stats(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return df.where(T.py_strip(F.col(column)) != "").agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def training_table(df: DataFrame, cleaned: str, label: str, order: list) -> DataFrame:
    """text, label of valid, long enough, distinct articles: labels in {0, 1}, no radio promotion, LEAST_TOKENS tokens, the first of equal texts."""
    from newsloom.operators.dedup import keep_first

    kept = df.withColumn("__label", valid_label(F.col(label))).where(F.col("__label").isNotNull() & (T.py_strip(F.col(cleaned)) != ""))
    kept = kept.where(~T.is_radio_promo(F.col(cleaned)) & (T.mixed_token_count(F.col(cleaned)) >= X.LEAST_TOKENS))
    return keep_first(kept, [cleaned], order).select(F.col(cleaned).alias("text"), F.col("__label").alias("label"))

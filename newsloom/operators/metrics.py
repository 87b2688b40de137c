"""Evaluation and latency metrics as aggregates; classes always appear, with zeros where they have no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.selection import exact_percentiles, matched


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def hits(y: str, p: str, c: int) -> list[Column]:
    t, q = F.col(y) == c, F.col(p) == c
    return [F.count_if(t & q).alias(f"tp{c}"), F.count_if(~t & q).alias(f"fp{c}"), F.count_if(t & ~q).alias(f"fn{c}"), F.count_if(t).alias(f"support{c}")]


def scores(c: int) -> list[Column]:
    tp, fp, fn = (F.col(f"{x}{c}") for x in ("tp", "fp", "fn"))
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(p)).alias("right"), *hits(y, p, 1))
    return totals.select(ratio(F.col("right"), F.col("n")).alias("accuracy"), *scores(1))


def class_report(df: DataFrame, y: str = "y", p: str = "p", classes=(0, 1)) -> DataFrame:
    """One pass over the rows; then a line per class, their plain mean (macro avg) and their mean by support (weighted avg)."""
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[x for c in classes for x in hits(y, p, c)])
    lines = [F.struct(F.lit(str(c)).alias("label"), *scores(c), F.col(f"support{c}").alias("support")) for c in classes]
    per = totals.select("n", F.array(*lines).alias("lines"))
    names = ("precision", "recall", "f1")
    total = lambda name, weight: F.aggregate("lines", F.lit(0.0), lambda a, x: a + x[name] * (x["support"] if weight else F.lit(1.0)))
    macro = F.struct(F.lit("macro avg").alias("label"), *[(total(n, False) / len(classes)).alias(n) for n in names], F.col("n").alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("label"), *[ratio(total(n, True), F.col("n")).alias(n) for n in names], F.col("n").alias("support"))
    return per.select(F.explode(F.concat("lines", F.array(macro), F.array(weighted))).alias("x")).select("x.*")


def macro_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return class_report(df, y, p).where("label = 'macro avg'").select(F.col("precision").alias("macro_precision"), F.col("recall").alias("macro_recall"), F.col("f1").alias("macro_f1"))


def confusion_matrix(df: DataFrame, y: str = "y", p: str = "p", classes=(0, 1)) -> DataFrame:
    """A row per true class, a column pred_<class> per prediction."""
    cells = df.agg(*[F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(f"c{a}_{b}") for a in classes for b in classes])
    rows = [F.struct(F.lit(a).alias("y"), *[F.col(f"c{a}_{b}").alias(f"pred_{b}") for b in classes]) for a in classes]
    return cells.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def nll_grid(df: DataFrame, margin: str, y: str, low: float = 0.5, high: float = 5.0, steps: int = 100, clip: float = 1e-7) -> DataFrame:
    """Mean negative log-likelihood at each temperature of the grid: rows times grid points go into a partial mean per point, so a
    task hands on `steps` rows."""
    grid = [F.struct(F.lit(i).alias("i"), F.lit(low + (high - low) * i / (steps - 1)).alias("temperature")) for i in range(steps)]
    each = df.select(F.col(margin).alias("m"), F.col(y).alias("y"), F.explode(F.array(*grid)).alias("g")).select("m", "y", "g.*")
    p = F.greatest(F.least(1 / (1 + F.exp(-F.col("m") / F.col("temperature"))), F.lit(1 - clip)), F.lit(clip))
    return each.groupBy("i", "temperature").agg(F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p))).alias("nll"))


def best_temperature(grid: DataFrame) -> DataFrame:
    """The first grid point with the least loss."""
    return grid.agg(F.min(F.struct("nll", "i", "temperature")).alias("m")).select("m.i", "m.temperature", "m.nll")


#: Different values of a group that one task may count for its percentiles.
DISTINCT_MOST = 1_000_000


def latency_summary(df: DataFrame, value: str, groups: list[str] | None = None, distinct_most: int = DISTINCT_MOST) -> DataFrame:
    """Count, sum, mean, exact percentiles, extremes and sample deviation (0 for one value).

    Spark's percentile gathers a group's different values in one task. Where a group may have more than `distinct_most` of them
    (looked up first, with a margin for the estimate), percentiles are selected by counts instead, with the same result.
    """
    x, groups = F.col(value), groups or []
    shares = {f"p{q}": q / 100 for q in (50, 75, 90, 95, 99)}
    rows = df.where(x.isNotNull())
    plain = [F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stdev")]
    most = rows.groupBy(*groups).agg(F.approx_count_distinct(x).alias("d")).agg(F.max("d")).first()[0] or 0
    order = [*groups, "n", "total", "mean", *shares, "least", "most", "stdev"]
    if 1.2 * most <= distinct_most:
        return rows.groupBy(*groups).agg(*plain, *[F.percentile(x, F.lit(q)).alias(name) for name, q in shares.items()]).select(order)
    return matched(rows.groupBy(*groups).agg(*plain), exact_percentiles(rows, value, shares, groups), groups, "inner").select(order)


def success_rates(df: DataFrame, status: str, groups: list[str] | None = None) -> DataFrame:
    s = F.col(status)
    saved, blocked = F.count_if(s == "content_saved"), F.count_if(s == "blocked")
    return df.groupBy(*(groups or [])).agg(F.count(F.lit(1)).alias("n"), saved.alias("saved"), blocked.alias("blocked"), (F.count(F.lit(1)) - saved - blocked).alias("failed"), ratio(saved, F.count(F.lit(1))).alias("success_rate"))

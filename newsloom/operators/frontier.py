"""Crawl frontiers over a table of links: breadth-first levels by joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import absolute, anchor_links
from newsloom.session import shared_dir


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst (absolute): the links of each page, each once."""
    found = pages.select(F.col(url).alias("src"), F.explode(anchor_links(F.col(html))).alias("href"))
    return found.select("src", absolute(F.col("src"), F.col("href")).alias("dst")).where("dst is not null").distinct()


#: Ranges of one order that are sorted apart, and the rows by whose places they are cut.
RANGES, CUT_ROWS = 256, 16_384


def ranged(df: DataFrame, order: str, tie: str | None = None) -> DataFrame:
    """df with __range: the order (of any type that has one), then the tie-breaker, cut into ranges; rows whose order is null are in the
    last one. The cuts come from CUT_ROWS rows, the least by hash; they decide how even ranges are, never where a row stands."""
    keys = [order, tie] if tie else [order]
    some = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).where("k0 is not null")
    some = some.orderBy(F.xxhash64(*some.columns), *some.columns).limit(CUT_ROWS).distinct().sort(*some.columns).collect()
    cuts = [some[len(some) * i // RANGES] for i in range(1, RANGES)] if len(some) >= RANGES else some[1:]
    kinds = [df.schema[k].dataType for k in keys]
    marks = F.array(*[F.struct(*[F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(c, kinds))]) for c in cuts])
    own = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    below = F.size(F.filter(marks, lambda c: c <= own)) if cuts else F.lit(0)
    return df.withColumn("__range", F.when(F.col(order).isNull(), RANGES).otherwise(below))


def with_next(df: DataFrame, order: str, value: str, into: str, tie: str | None = None) -> DataFrame:
    """df with the next row's value by `order` (nulls last) and `tie` (nulls first), null in the last row; without a tie-breaker rows of one order stand
    in any order. Each range's last row takes the first value of the next range that has rows."""
    rows = ranged(df, order, tie)
    keys = [order, tie] if tie else [order]
    firsts = rows.groupBy("__range").agg(F.min_by(F.struct(value), F.struct(*keys)).alias("__first"))
    firsts = firsts.select("__range", F.lead("__first").over(Window.orderBy("__range")).alias("__first"))  # RANGES + 1 rows at most
    inner = F.lead(F.struct(value)).over(Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_last(), *keys[1:]))
    step = rows.withColumn("__next", inner).join(F.broadcast(firsts), "__range", "left")
    return step.select(*df.columns, F.coalesce("__next", "__first")[value].alias(into))


def bfs(seeds: DataFrame, links: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """url, depth: what can be reached from seeds (column url) in at most `depth` steps, at its least depth; `cap` is the
    number of visits after which no further level is opened. Each level is written, so that plans stay short."""
    spark = seeds.sparkSession
    root = shared_dir(spark)

    def written(df: DataFrame) -> DataFrame:
        path = f"{root}/newsloom-level-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    level = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for d in range(1, depth + 1):
        step = level.join(links, level.url == links.src).select(F.col("dst").alias("url")).distinct()
        level = written(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty() or cap and seen.count() >= cap:
            break
        seen = seen.unionByName(level)
    return seen


#: Pages taken from the frontier at once; links of one list page, saved articles of one domain and in all, visited and waiting URLs.
ROUND, PER_LIST, PER_DOMAIN, ARTICLES, VISITED, WAITING = 1000, 40, 5, 500, 200_000, 50_000


def seed_links(links: DataFrame, most: int = PER_LIST) -> DataFrame:
    """url, ord: the first `most` links of each list page (src, dst, page: its place among the list pages, ord), each URL once."""
    first = links.groupBy("page", "dst").agg(F.min("ord").alias("ord"))
    some = first.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy("ord"))).where(F.col("r") <= most)
    return some.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("page", "ord")).alias("ord"))


def crawled(seeds: DataFrame, links: DataFrame, pages: DataFrame, batch: int = ROUND, articles: int = ARTICLES, per_domain: int = PER_DOMAIN, visited: int = VISITED, waiting: int = WAITING) -> DataFrame:
    """url, step, outcome (saved, no_content, domain_cap, missing): the URLs in the order in which a frontier gives them.

    The frontier has two ends. Priority links go to its front, so the one found last is the next; others go to its back. A round
    takes `batch` URLs from the front, as if fetched together, then adds their links, page by page. A URL enters once. A domain
    with `per_domain` saved articles gives no more; the crawl ends with `articles` saved, `visited` taken or nothing left; beyond
    `waiting` URLs none is added. With a batch of one this is a plain queue with two ends.

    seeds: url, ord; links: src, dst, priority, ord (see links.page_links; at equal places by dst); pages: url, domain, ok (whether it has content enough).
    A place in the frontier is where a link was found (round, page, place in the page), so nothing is numbered in one task but a
    round's own `batch` URLs; links and pages are computed once and written, then each round is.
    """
    spark = seeds.sparkSession
    root = f"{shared_dir(spark)}/newsloom-frontier-{uuid.uuid4().hex}"
    schemas = {"visited": "url string, step long, outcome string, domain string"}

    def table(name: str) -> DataFrame:
        return spark.read.schema(schemas[name]).parquet(f"{root}/{name}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("append").parquet(f"{root}/{name}")
        schemas.setdefault(name, df.schema)
        return table(name)

    links, pages = written(links.select("src", "dst", "priority", "ord"), "links"), written(pages.select("url", "domain", "ok"), "pages")
    place = Window.orderBy("ord")
    start = seeds.groupBy("url").agg(F.min("ord").alias("ord")).orderBy("ord").limit(waiting)
    start = start.select("url", F.lit(False).alias("front"), F.lit(-1).alias("round"), F.lit(0).cast("long").alias("page"), (F.row_number().over(place) - 1).cast("long").alias("ord"))
    queued = written(start, "queued")  # all that ever entered: `visited` + `waiting` URLs at most
    entered = queued.count()
    turned = lambda c: F.when(F.col("front"), -F.col(c)).otherwise(F.col(c))
    order = [~F.col("front"), turned("round"), turned("page"), turned("ord"), F.when(F.col("front"), F.col("url")).desc(), "url"]
    done = saved = number = 0
    while saved < articles and done < visited:
        before = table("visited") if done else spark.createDataFrame([], schemas["visited"])
        waits = queued.join(before.select("url"), "url", "left_anti") if done else queued
        top = waits.orderBy(*order).limit(min(batch, visited - done))
        top = top.withColumn("step", (F.row_number().over(Window.orderBy(*order)) + F.lit(done)).cast("long")).select("url", "step")
        counts = before.where("outcome = 'saved'").groupBy("domain").agg(F.count(F.lit(1)).alias("base"))
        met = top.join(pages, "url", "left").join(counts, "domain", "left")
        good = F.coalesce("ok", F.lit(False)).cast("int")
        earlier = F.coalesce(F.sum(good).over(Window.partitionBy("domain").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("base", F.lit(0))
        met = met.withColumn("outcome", F.when(F.col("ok").isNull(), "missing").when(earlier >= per_domain, "domain_cap").when(F.col("ok"), "saved").otherwise("no_content"))
        so_far = F.coalesce(F.sum((F.col("outcome") == "saved").cast("int")).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(saved)
        taken = written(met.withColumn("so_far", so_far).where(F.col("so_far") < articles).select("url", "step", "outcome", "domain"), "visited").where(F.col("step") > done)
        size, now = taken.agg(F.count(F.lit(1)), F.count_if(F.col("outcome") == "saved")).first()
        if not size:
            break
        done, saved = done + size, saved + now
        room = max(0, waiting - (entered - done))
        if room:
            found = F.broadcast(taken.where("outcome in ('saved', 'no_content')")).join(links, taken.url == links.src).select("dst", "step", F.col("priority").alias("front"), links.ord.cast("long").alias("ord"))
            first = found.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("step", (~F.col("front")).alias("back"), "ord")).alias("m"))
            new = first.join(queued.select("url"), "url", "left_anti").select("url", (~F.col("m.back")).alias("front"), F.lit(number).alias("round"), F.col("m.step").alias("page"), F.col("m.ord").alias("ord"))
            queued = written(new.orderBy("page", ~F.col("front"), "ord", "url").limit(room), "queued")
            entered = queued.count()
        number += 1
    return table("visited").select("url", "step", "outcome") if done else spark.createDataFrame([], "url string, step long, outcome string")

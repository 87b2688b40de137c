"""Links in their context on fixed pages; the frontier against a queue with two ends."""

import random
from collections import Counter, deque

import pytest

from newsloom.functions import links as L
from newsloom.operators import frontier
from newsloom.plans import catalog

PAGE = """<html><body><header><div><div><nav><a href="/nav">Home</a></nav></div></div></header>
<div id=far><div><div><div><p>text <a href="/deep">four steps below</a></p></div></div></div><h3>相關新聞</h3></div>
<section><h2>延伸閱讀</h2><ul><li><a href="/one">One</a><li><a href=/two>Two</a></ul></section>
<p><a href="/own">熱門文章 own text</a><script>var x = "相關文章";</script> <a>no address</a> <a href=" ">blank</a></p>
<p>unclosed <a href="/late">late<br></a><p>更多新聞 in the next paragraph</body></html>"""


def test_links_in_context():
    found = {href: priority for href, priority, _ in L.links_in_context(PAGE)}
    assert found == {"/nav": False, "/deep": False, "/one": True, "/two": True, "/own": True, "/late": True}
    assert [i for _, _, i in L.links_in_context(PAGE)] == list(range(6)) and L.links_in_context(None) == []
    near = "<div><b>Read <i>more here</i></b><a href=x>x</a></div>"
    assert L.links_in_context(near, ("more here",))[0][1] and L.links_in_context(near, ("read more",))[0][1] and not L.links_in_context(near, ("readmore",))[0][1]


def test_page_links(spark):
    """Each link once, a priority one if any of its places says so, at its first place of that kind; the page itself is left out."""
    html = "<aside><nav><section><p><a href='/b'>b</a></p></section></nav></aside><div><h2>相關新聞</h2><a href='/b'>b</a><a href='/c#x'>c</a><a href='http://s.com/a'>self</a></div><p><a href='/d'>d</a><a href='mailto:x'>m</a></p>"
    html = html.replace("<p><a href='/d'>", "<main><main><main><p><a href='/d'>")
    rows = spark.createDataFrame([("http://s.com/a", f"<section><article><main>{html}</main></article></section>"), ("http://s.com/e", None)], "url string, html string")
    got = sorted(map(tuple, L.page_links(rows).collect()))
    assert [(d, o) for _, d, p, o in got if d.endswith("/d")] == [("http://s.com/d", 4)] and ("http://s.com/a", "http://s.com/b", True, 1) in got
    assert {d for _, d, _, _ in got} == {"http://s.com/b", "http://s.com/c", "http://s.com/d"}


def queue(seeds, links, pages, batch, articles, per_domain, visited, waiting):
    """(url, step, outcome) by a deque: a round takes `batch` from the front, then adds its links page by page."""
    front, queued, out, saved, by_domain = deque(), set(), [], 0, Counter()
    for u in seeds:
        if u not in queued and len(front) < waiting:
            queued.add(u)
            front.append(u)
    while front and saved < articles and len(out) < visited:
        fetched = []
        for _ in range(batch):
            if not front or saved >= articles or len(out) >= visited:
                break
            url = front.popleft()
            domain, ok = pages.get(url, (None, None))
            outcome = "missing" if ok is None else "domain_cap" if by_domain[domain] >= per_domain else "saved" if ok else "no_content"
            if outcome == "saved":
                saved, by_domain[domain] = saved + 1, by_domain[domain] + 1
            out.append((url, len(out) + 1, outcome))
            if outcome in ("saved", "no_content"):
                fetched.append(url)
        for url in fetched:
            own = sorted(links.get(url, []), key=lambda x: (not x[1], x[2], x[0]))
            for dst, priority, _ in own:
                if dst not in queued and len(front) < waiting:
                    queued.add(dst)
                    (front.appendleft if priority else front.append)(dst)
    return out


@pytest.mark.parametrize(("batch", "articles", "per_domain", "visited", "waiting"), [(1, 8, 3, 14, 99), (5, 99, 4, 999, 999), (4, 15, 99, 30, 12)])
def test_frontier_is_a_queue_with_two_ends(spark, batch, articles, per_domain, visited, waiting):
    rng = random.Random(batch)
    urls = [f"http://d{i % 4}.com/{i}" for i in range(60)]
    pages = {u: (u.split("/")[2], rng.random() < 0.8) for u in urls[:50]}
    links = {u: [(v, rng.random() < 0.3, i) for i, v in enumerate(rng.sample(urls, rng.choice([0, 2, 6])))] for u in urls}
    seeds = rng.sample(urls, 6)
    frames = (
        spark.createDataFrame([(u, i) for i, u in enumerate([*seeds, seeds[0]])], "url string, ord int"), spark.createDataFrame([(u, *x) for u, own in links.items() for x in own], "src string, dst string, priority boolean, ord int"),
        spark.createDataFrame([(u, *x) for u, x in pages.items()], "url string, domain string, ok boolean"),
    )
    got = frontier.crawled(*frames, batch, articles, per_domain, visited, waiting)
    want = queue(seeds, links, pages, batch, articles, per_domain, visited, waiting)
    assert [tuple(r) for r in got.orderBy("step").collect()] == want and len(want) > 8


def test_frontier_computes_links_and_pages_once(spark):
    """Not again in every round: the tasks that make them are counted."""
    runs = {n: spark.sparkContext.accumulator(0) for n in ("links", "pages")}

    def counted(df, name):
        def batches(frames):
            runs[name].add(1)
            yield from frames

        return df.coalesce(1).mapInPandas(batches, df.schema)

    urls = [f"http://d{i}.com/" for i in range(6)]
    links = spark.createDataFrame([(a, b, False, 0) for a, b in zip(urls, urls[1:])], "src string, dst string, priority boolean, ord int")
    pages = spark.createDataFrame([(u, u, True) for u in urls], "url string, domain string, ok boolean")
    got = frontier.crawled(spark.createDataFrame([(urls[0], 0)], "url string, ord int"), counted(links, "links"), counted(pages, "pages"), 1)
    assert [r["url"] for r in got.orderBy("step").collect()] == urls
    assert {n: a.value for n, a in runs.items()} == {"links": 1, "pages": 1}


def test_seed_links(spark):
    rows = [("l1", f"u{i % 60}", 0, i) for i in range(80)] + [("l2", "u3", 1, 0), ("l2", "v", 1, 1)]
    got = frontier.seed_links(spark.createDataFrame(rows, "src string, dst string, page int, ord int"), 40)
    assert [r["url"] for r in got.orderBy("ord").collect()] == [*(f"u{i}" for i in range(40)), "v"]


def test_frontier_query(spark):
    """The whole query on its tables against the deque."""
    sf = "/root/testdata/sf0.001"
    seeds, links, pages = catalog.frontier_tables(spark, sf)
    by = {}
    for r in links.collect():
        by.setdefault(r["src"], []).append((r["dst"], r["priority"], r["ord"]))
    want = queue([r["url"] for r in seeds.orderBy("ord").collect()], by, {r["url"]: (r["domain"], r["ok"]) for r in pages.collect()}, frontier.ROUND, frontier.ARTICLES, frontier.PER_DOMAIN, frontier.VISITED, frontier.WAITING)
    got = catalog.QUERIES["frontier_crawl"](spark, sf)
    assert [tuple(r) for r in got.orderBy("step").collect()] == want and len({x[2] for x in want}) > 1

"""Links of a page with what stands around them: one pass over the HTML with a stack of open elements."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed as X
from newsloom.functions.urls import crawl_form, is_http
from newsloom.session import ship

#: Elements around an anchor, itself included, whose text may name a section of related articles.
HOPS = 4
_void = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_unread = frozenset("script style template".split())
#: What an opening tag closes, where the page leaves the end tag out.
_closes = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_blocks = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_holders = frozenset("ul ol dl table select".split())


class _Tree(HTMLParser):
    """Texts in order; for each anchor its address and the stretches of texts of itself and the elements around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.starts: list[int] = [0]
        self.ends: list[int | None] = [None]
        self.open: list[tuple[str, int]] = [("", 0)]  # the document itself
        self.anchors: list[tuple[str, list[int]]] = []
        self.unread = 0

    def end_last(self) -> None:
        tag, node = self.open.pop()
        self.ends[node] = len(self.texts)
        self.unread -= tag in _unread

    def handle_starttag(self, tag, attrs):
        closed = (*_closes.get(tag, ()), *(("p",) if tag in _blocks else ()))
        while len(self.open) > 1 and self.open[-1][0] in closed and self.open[-1][0] not in _holders:
            self.end_last()
        node = len(self.starts)
        self.starts.append(len(self.texts))
        self.ends.append(len(self.texts) if tag in _void else None)
        around = [node, *(n for _, n in reversed(self.open))][:HOPS]
        if tag == "a" and (href := (dict(attrs).get("href") or "").strip()):
            self.anchors.append((href, around))
        if tag not in _void:
            self.open.append((tag, node))
            self.unread += tag in _unread

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open[1:]):
            while self.open[-1][0] != tag:
                self.end_last()
            self.end_last()

    def handle_data(self, data):
        if not self.unread and (text := " ".join(data.split())):
            self.texts.append(text)


def links_in_context(html: str | None, keywords: tuple[str, ...] = X.PRIORITY_SECTIONS) -> list[tuple[str, bool, int]]:
    """(address, priority, position) of every anchor: one is a priority link if a keyword stands in its own text or in that of one
    of the elements around it, HOPS in all."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    while tree.open:
        tree.end_last()
    words = [k.lower() for k in keywords]
    low = [t.lower() for t in tree.texts]
    hits = [0]
    for t in low:
        hits.append(hits[-1] + any(w in t for w in words))
    spread = [w for w in words if " " in w]  # those may begin in one text and end in the next
    known: dict[int, bool] = {}

    def named(node: int) -> bool:
        if node not in known:
            i, j = tree.starts[node], tree.ends[node]
            known[node] = hits[j] > hits[i] or bool(spread) and any(w in " ".join(low[i:j]) for w in spread)
        return known[node]

    return [(href, any(map(named, around)), i) for i, (href, around) in enumerate(tree.anchors)]


def page_links(pages: DataFrame, url: str = "url", html: str = "html", keywords: tuple[str, ...] = X.PRIORITY_SECTIONS) -> DataFrame:
    """src, dst (absolute, crawl form), priority, ord: each link of a page once, the page itself left out. A link that stands in both
    kinds of places is a priority link; ord is its first place among those of its kind. Pages with one URL are one."""
    ship(pages.sparkSession)

    @F.pandas_udf("array<struct<dst:string,priority:boolean,ord:int>>")
    def found(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        out = []
        for base, body in zip(urls, bodies):
            rows = []
            for href, priority, i in links_in_context(body, keywords):
                try:
                    rows.append({"dst": crawl_form(urljoin(base or "", href)), "priority": priority, "ord": i})
                except ValueError:
                    continue  # no address at all
            out.append(rows)
        return pd.Series(out)

    links = pages.select(F.col(url).alias("src"), F.explode(found(F.col(url), F.col(html))).alias("x")).select("src", "x.*")
    links = links.where(is_http(F.col("dst")) & (F.col("dst") != F.col("src")))
    best = links.groupBy("src", "dst").agg(F.min(F.struct((~F.col("priority")).alias("late"), "ord")).alias("m"))
    return best.select("src", "dst", (~F.col("m.late")).alias("priority"), "m.ord")


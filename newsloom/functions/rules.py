"""URL rules: allow and deny lists with reasons, article URLs by host, paywalled prefixes. Rule tables have a fixed, small size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed as X
from newsloom.functions.urls import host_of, path_of


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def host_matches(host: Column, rule: str) -> Column:
    """A rule with a leading dot holds for the host itself and all under it."""
    return (host == rule[1:]) | F.endswith(host, F.lit(rule)) if rule.startswith(".") else host == rule


def allow_reason(url: Column, *, schemes=("http", "https"), hosts=(), deny_urls=(), deny_prefixes=(), deny_fragments=(), allow_prefixes=()) -> Column:
    """ok, or why not; tests in order: scheme, host (a leading dot stands for a whole site), denied URL, prefix, path fragment,
    allowed prefixes (if any)."""
    scheme = F.lower(F.regexp_extract(url, r"^([^:/?#]+):", 1))
    path = F.lower(path_of(url))
    out = F.when(~scheme.isin(*schemes), "filtered: scheme not allowed").when(~any_of(host_matches(host_of(url), h) for h in hosts), "offsite").when(url.isin(*deny_urls) if deny_urls else F.lit(False), "denied: exact URL")
    out = out.when(any_of(F.startswith(url, F.lit(p)) for p in deny_prefixes), "denied: prefix").when(any_of(F.contains(path, F.lit(x)) for x in deny_fragments), "denied: path fragment")
    if allow_prefixes:
        out = out.when(~any_of(F.startswith(url, F.lit(p)) for p in allow_prefixes), "filtered: not in allow-prefixes")
    return out.otherwise("ok")


def is_article(url: Column, rules=X.ARTICLE_RULES) -> Column:
    """Whether a URL is an article's by its host's rule; hosts without one pass. A list of rules of one's own is a variant."""
    host, path = host_of(url), path_of(url)
    out = None
    for rule, must, mustnt in rules:
        fits = F.regexp_like(path, F.lit(must)) & (~F.regexp_like(path, F.lit(mustnt)) if mustnt else F.lit(True))
        out = (out.when if out is not None else F.when)(host_matches(host, rule), fits)
    setn = (F.lower(path) == "/news.aspx") & F.regexp_like(url, F.lit(r"\?(?:[^#]*&)?(?:NewsID|newsid|newsID)=\d+(?:[&#]|$)"))
    return out.when(host == "www.setn.com", setn).otherwise(True)


def is_frontier_article(url: Column, deny=("/list", "/tag", "/search", "/login")) -> Column:
    """The stricter variant: denied substrings and the root never pass, an unlisted host needs a path segment, the China Times eight digits."""
    path = path_of(url)
    rules = tuple((h, r"\d{8,}" if h == "www.chinatimes.com" else m, n) for h, m, n in X.ARTICLE_RULES)
    listed = any_of(host_matches(host_of(url), h) for h, _, _ in rules) | (host_of(url) == "www.setn.com")
    return ~any_of(F.contains(F.lower(url), F.lit(d)) for d in deny) & ~path.isin("", "/") & is_article(url, rules) & (listed | F.regexp_like(path, F.lit("/[^/]+")))


def paywall_reason(url: Column) -> Column:
    host, path = host_of(url), F.lower(path_of(url))
    out = None
    for rule, prefix, reason in X.PAYWALLED:
        out = (out.when if out is not None else F.when)((host == rule) & F.startswith(path, F.lit(prefix)), F.lit(reason))
    return out


def skipped(url: Column) -> Column:
    """Whether a page of the host that is asked for articles alone is none: such pages are neither fetched nor analysed."""
    return (host_of(url) == X.ARTICLES_ONLY[0]) & ~F.regexp_like(path_of(url), F.lit(X.ARTICLES_ONLY[1]))


def domain_class(url: Column) -> Column:
    """trusted (no need to fetch), refused (not news) or open; refusal wins."""
    host = host_of(url)
    return F.when(host.isin(*X.REFUSED_HOSTS), "refused").when(host.isin(*X.TRUSTED_HOSTS), "trusted").otherwise("open")


def is_supported(url: Column, hosts) -> Column:
    """Whether a worker may fetch it: an allowed host (or one under an allowed .suffix), not refused, and an article."""
    return any_of(host_matches(host_of(url), h) for h in hosts) & (domain_class(url) != "refused") & is_article(url)


def same_site(a: Column, b: Column) -> Column:
    return host_of(a) == host_of(b)

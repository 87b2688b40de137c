"""Cleaning steps whose exact meaning is Python's: loops to a fixed point, entities, Unicode classes. Arrow-batched."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsloom.batches import in_arrow
from newsloom.functions import fixed as X
from newsloom.session import spread

I, S = re.I, re.I | re.S
_dateline_steps = [re.compile(p, f) for p, f in ((X.GENERIC_DATELINE, I), (X.CITY_DATE_DATELINE, I), (X.CITY_DATELINE, I), (X.BYLINE, 0), (X.LEADING_QUOTES, 0), (X.LEADING_DASH, 0))]
_opening = [re.compile(X.CORRECTION), re.compile(X.LEADING_QUOTES), re.compile(X.REPEAT_AGENCY, I)]
_safety, _dash = re.compile(X.SAFETY_NET, I), re.compile(X.LEADING_DASH)


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def without_dateline(text: str) -> str:
    """Corrections, quotes, datelines and bylines at the beginning, as long as one more goes; then a short stretch up to an agency."""
    text = text.strip()
    for step in _opening:
        text = step.sub("", text)
    before = None
    while text != before:
        before = text
        for step in _dateline_steps:
            text = step.sub("", text)
    return squeezed(_dash.sub("", _safety.sub("", text, count=1)))


def without_social(text: str) -> str:
    for pattern in (X.URL, X.BARE_DOMAIN, X.HANDLE, X.PICTURE_LINK, X.PHOTO_BY):
        text = re.sub(pattern, " ", text, flags=I)
    return squeezed(text)


def without_tail(text: str) -> str:
    for marker, most in [*((m, 0) for m in X.TAIL_MARKERS), (X.LATE_MARKER, 1)]:
        found = re.search(marker, text, I)
        if found:
            late = found.start() / max(len(text), 1) >= X.TAIL_SHARE
            return squeezed(text[: found.start()] if late else re.sub(marker, " ", text, count=most, flags=I))
    return squeezed(text)


def without_markup(text: str) -> str:
    """Entities resolved, elements and scripts out; empty if it still looks like code; characters outside the kept class give way to spaces."""
    text = unescape(text)
    for pattern in (X.SCRIPT_ELEMENT, X.STYLE_ELEMENT, X.TAG):
        text = re.sub(pattern, " ", text, flags=S)
    if any(h in text.lower() for h in X.SCRIPT_HINTS):
        for pattern in X.SCRIPT_STRETCHES:
            text = re.sub(pattern, " ", text, flags=I)
    low = text.lower()
    hints, words, symbols = sum(h in low for h in X.SCRIPT_HINTS), len(re.findall(X.CODE_WORD, low)), len(re.findall(X.CODE_SYMBOL, low))
    if hints >= 3 or hints >= 2 and symbols >= 8 or words >= 4 and symbols >= 10:
        return ""
    return squeezed(re.sub(X.NOT_KEPT, " ", text))


def token_count(text: str) -> int:
    return len(re.findall(X.HAN, text)) + len(re.findall(X.LATIN_TOKEN, text))


def cleaned(text: str | None, cut_read_more: bool) -> str:
    """The whole chain of cleaning steps, in order."""
    t = (text or "").replace("\u200b", "").replace("\xa0", " ").strip()
    t = without_social(without_dateline(t))
    t = re.sub(rf"\b{X.AGENCIES}\b", "[AGENCY]", t, flags=I)
    t = squeezed(re.sub(X.SAID_ON, " ", t, flags=I))
    t = without_markup(without_tail(t))
    for pattern, needs in zip(X.BOILERPLATE, X.BOILERPLATE_NEEDS):
        if needs in t.casefold():
            t = re.sub(pattern, " ", t, flags=I)
    t = squeezed(" ".join(s for s in re.split(r"(?<=[.!?])\s+", squeezed(t)) if not re.search(X.DID_NOT_RESPOND, s, I)))
    if cut_read_more:
        t = re.sub(X.READ_MORE, "", t, flags=S).strip()
    t = re.sub(X.SOURCE_LINK_TAIL, "", t, flags=S).strip()
    for pattern in X.SITE_NAMES:
        t = re.sub(pattern, " ", t, flags=I)
    return squeezed(t).lower()


MODES = ("train", "pipeline", "inference")


def clean_articles(df: DataFrame, text: str = "text", label: str | None = None, mode: str = "pipeline", into: str = "cleaned_content") -> DataFrame:
    """df with the cleaned text in column `into`.

    train: the read-more tail goes where the label is 0. pipeline: it stays, unless a label column is named.
    inference: it always goes, and texts that are empty, radio promotion or under five tokens become null.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    kept = [f for f in df.schema.fields if f.name != into]
    schema = StructType([*kept, StructField(into, StringType())])

    def clean(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces:
            found = [cleaned(t.as_py(), c.as_py()) for t, c in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.string())], names=schema.names)

    cut = F.lit(True) if mode == "inference" else F.coalesce(F.col(label) == 0, F.lit(False)) if label else F.lit(False)
    out = in_arrow(spread(df).select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias("__text"), cut.alias("__cut")), clean, schema)
    if mode == "inference":
        from newsloom.functions.text import is_radio_promo, mixed_token_count

        fit = (F.col(into) != "") & ~is_radio_promo(F.col(into)) & (mixed_token_count(F.col(into)) >= X.LEAST_TOKENS)
        out = out.withColumn(into, F.when(fit, F.col(into)))
    return out


def dateline_clean(column):
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else without_dateline(t))

    return clean(column)


def markup_clean(column):
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else without_markup(t))

    return clean(column)


# --- main text of a page -------------------------------------------------------------------------------------------

_void = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_silent = frozenset("script style noscript template".split())


class _Paragraphs(HTMLParser):
    """Texts of <p> with the share of their characters inside links; noisy nodes and all after a related-articles heading are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.skip = self.links = 0
        self.cut_depth: int | None = None
        self.paragraph: list[str] | None = None
        self.in_links: list[str] = []
        self.found: list[tuple[str, float]] = []
        self.lines: list[str] = []
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        noisy = tag in _silent or bool(re.search(X.NODE_NOISE, " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "aria-label") or k.startswith("data-")), re.I))
        if tag in _void:
            return
        if tag == "p" and self.paragraph is not None:
            self.close_paragraph()
        self.stack.append((tag, noisy))
        self.skip += noisy
        self.links += tag == "a"
        if tag == "p":
            self.paragraph, self.in_links = [], []
        if tag in ("h2", "h3"):
            self.heading = []

    def handle_endtag(self, tag):
        if tag == "p":
            self.close_paragraph()
        if tag not in [t for t, _ in self.stack]:
            return
        if tag in ("h2", "h3") and self.heading is not None:
            if self.cut_depth is None and any(w in "".join(self.heading) for w in X.RELATED_HEADINGS):
                self.cut_depth = len(self.stack) - 1  # until the heading's parent ends
            self.heading = None
        while self.stack:
            last, noisy = self.stack.pop()
            self.skip -= noisy
            self.links -= last == "a"
            if self.cut_depth is not None and len(self.stack) < self.cut_depth:
                self.cut_depth = -1
            if last == tag:
                break

    def handle_data(self, data):
        if self.heading is not None:
            self.heading.append(data)
        if self.skip or (self.cut_depth is not None and self.cut_depth >= 0):
            return
        if self.paragraph is not None:
            self.paragraph.append(data)
            if self.links:
                self.in_links.append(data.strip())
        self.lines += [x.strip() for x in data.split("\n") if x.strip()]

    def close_paragraph(self):
        if self.paragraph is not None:
            total = "".join(self.paragraph).strip()
            share = min(1.0, (len(" ".join(self.in_links)) + 1) / (len(total) + 1)) if total else 1.0
            self.found.append((squeezed(total), share))
            self.paragraph = None


def kept_paragraph(p: str) -> bool:
    return len(p) >= X.PARAGRAPH_LEAST and not re.search(X.PARAGRAPH_NOISE, p, re.I) and (len(p) >= X.PARAGRAPH_SURE or bool(re.search(X.SENTENCE_END, p)))


def main_text(html: str | None) -> str:
    """Paragraphs that read like an article's; where there are none, such lines."""
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close()
    parser.close_paragraph()
    kept = [p for p, share in parser.found if share <= X.LINK_SHARE and kept_paragraph(p)]
    return "\n".join(kept or [x for x in parser.lines if kept_paragraph(x)])


def main_text_of(column):
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return extract(column)

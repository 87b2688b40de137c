"""Text cleaning and extraction as native column expressions. Regular expressions are Java's; (?U) gives \\s and \\b Python's meaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed as X


#: Python's white space, and what of it isn't a blank: Java tests the first ones by bits and leaves at the range for other letters.
PY_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"


def py_strip(t: Column) -> Column:
    """Python's strip(): all Unicode white space at both ends."""
    return F.btrim(t, F.lit(PY_SPACES))


def normalize_space(t: Column) -> Column:
    """One blank for each run of white space. The single blanks between words, most of all runs, are no match."""
    return py_strip(F.regexp_replace(F.regexp_replace(t, ODD_SPACE, " "), " {2,}", " "))


def zero_width_fix(t: Column) -> Column:
    return py_strip(F.replace(F.replace(t, F.lit("\u200b"), F.lit("")), F.lit("\xa0"), F.lit(" ")))


def blank_to_null(t: Column) -> Column:
    return F.when(py_strip(t) != "", t)


def social_strip(t: Column) -> Column:
    """URLs, bare domains, handles, picture links and photo credits (to the end of their line) give way to a space."""
    for pattern in (X.URL, X.BARE_DOMAIN, X.HANDLE, X.PICTURE_LINK):
        t = F.regexp_replace(t, f"(?iU){pattern}", " ")
    return normalize_space(F.regexp_replace(t, f"(?id){X.PHOTO_BY}", " "))


def agency_mask(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?iU)\b{X.AGENCIES}\b", "[AGENCY]")


def said_on_strip(t: Column) -> Column:
    return normalize_space(F.regexp_replace(t, f"(?iU){X.SAID_ON}", " "))


def trailing_marker_cut(t: Column) -> Column:
    """The first marker of the list that occurs: a tail from 0.7 of the length on goes, else all of that marker; without one, likewise the first `via:`."""
    low = F.lower(t)

    def cut(marker: str, once: bool) -> Column:
        at = F.instr(low, marker) - 1
        gone = F.regexp_replace(t, f"(?i){marker}", " ")
        if once:
            gone = F.concat(F.substring(t, F.lit(1), at), F.lit(" "), F.substr(t, at + 1 + len(marker)))
        return F.when(at / F.greatest(F.length(t), F.lit(1)) >= X.TAIL_SHARE, F.substring(t, F.lit(1), at)).otherwise(gone)

    out = F.when(F.contains(low, F.lit(X.LATE_MARKER)), cut(X.LATE_MARKER, True)).otherwise(t)
    for marker in reversed(X.TAIL_MARKERS):
        out = F.when(F.contains(low, F.lit(marker)), cut(marker, False)).otherwise(out)
    return normalize_space(out)


def mixed_token_count(t: Column) -> Column:
    """Han characters and Latin tokens."""
    return F.regexp_count(t, F.lit(X.HAN)) + F.regexp_count(t, F.lit(X.LATIN_TOKEN))


def hint_count(t: Column) -> Column:
    low = F.lower(t)
    return reduce(lambda a, h: a + F.contains(low, F.lit(h)).cast("int"), X.SCRIPT_HINTS, F.lit(0))


def code_word_count(t: Column) -> Column:
    return F.regexp_count(F.lower(t), F.lit(f"(?i){X.CODE_WORD}"))


def code_symbol_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(X.CODE_SYMBOL))


def is_script_text(t: Column) -> Column:
    """Whether what remains looks like code, by hints, code words and symbols."""
    hints, words, symbols = hint_count(t), code_word_count(t), code_symbol_count(t)
    return (hints >= 3) | ((hints >= 2) & (symbols >= 8)) | ((words >= 4) & (symbols >= 10))


def boilerplate_strip(t: Column) -> Column:
    """A pattern that may begin anywhere runs only on texts that hold its words: it would else look ahead from every character."""
    for pattern, needs in zip(X.BOILERPLATE, X.BOILERPLATE_NEEDS):
        out = F.regexp_replace(t, f"(?id){pattern}", " ")
        t = F.when(F.contains(F.lower(t), F.lit(needs)), out).otherwise(t) if pattern.startswith(".") else out
    return normalize_space(t)


def drop_did_not_respond(t: Column) -> Column:
    sentences = F.split(t, r"(?U)(?<=[.!?])\s+")
    return normalize_space(F.array_join(F.filter(sentences, lambda s: ~F.regexp_like(s, F.lit(f"(?iU){X.DID_NOT_RESPOND}"))), " "))


def read_more_cut(t: Column) -> Column:
    return py_strip(F.regexp_replace(t, f"(?is){X.READ_MORE}", ""))


def source_link_cut(t: Column) -> Column:
    return py_strip(F.regexp_replace(t, f"(?is){X.SOURCE_LINK_TAIL}", ""))


def site_name_strip(t: Column) -> Column:
    return normalize_space(reduce(lambda c, p: F.regexp_replace(c, f"(?iU){p}", " "), X.SITE_NAMES, t))


def is_radio_promo(t: Column) -> Column:
    low = F.lower(t)
    return reduce(lambda a, w: a | F.contains(low, F.lit(w)), X.RADIO_PROMO, F.lit(False))


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags give way to a space."""
    t = html
    for element in (X.SCRIPT_ELEMENT, X.STYLE_ELEMENT, r"<noscript\b.*?</noscript>"):
        t = F.regexp_replace(t, f"(?is){element}", " ")
    return normalize_space(F.regexp_replace(t, X.TAG, " "))


def visible_length(html: Column) -> Column:
    return F.coalesce(F.length(html_to_text(html)), F.lit(0))


def is_empty_html(html: Column, least: int = 20) -> Column:
    squeezed = F.lower(F.regexp_replace(html, r"(?U)\s+", ""))
    return F.coalesce(squeezed.isin("", *X.EMPTY_SHELLS) | (visible_length(html) < least), F.lit(True))


def markdown_to_text(md: Column) -> Column:
    """Markup goes, the words of links, pictures, headings, quotes and lists stay."""
    return normalize_space(reduce(lambda c, s: F.regexp_replace(c, *s), X.MARKDOWN_STEPS, md))


def body_of_markdown(md: Column) -> Column:
    """Running text alone: headings, quotes, list items and rules go, and all from a related-articles heading on."""
    s = reduce(lambda c, x: F.regexp_replace(c, *x), X.BODY_SPANS, md)
    lines = F.filter(F.transform(F.split(s, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), py_strip), lambda x: x != "")
    heading = lambda x: F.regexp_like(x, F.lit(X.MD_HEADING_LINE))
    related = lambda x: heading(x) & reduce(lambda a, w: a | F.contains(x, F.lit(w)), X.RELATED_HEADINGS, F.lit(False))
    stop = F.array_position(F.transform(lines, related), F.lit(True))
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    s = F.array_join(F.filter(kept, lambda x: ~heading(x) & ~F.regexp_like(x, F.lit(X.MD_OTHER_LINE))), "\n")
    s = reduce(lambda c, x: F.regexp_replace(c, *x), X.BODY_ENDS, s)
    return py_strip(s)


#: X.INLINE_URL in any case, behind the three characters that begin it.
ANY_URL = f"(?i)(?=[hw][tw][tw])(?:{X.INLINE_URL})"
#: The words of X.LINE_NOISE, and those that can arise where lines are joined by a blank.
NOISE_WORDS = X.LINE_NOISE.strip("()").split("|")
JOINED_NOISE = f"(?i){'|'.join(w for w in NOISE_WORDS if ' ' in w)}"


def url_share(line: Column) -> Column:
    """Characters of URLs over the line's length."""
    found = F.regexp_extract_all(line, F.lit(f"({ANY_URL})"), 1)
    return F.aggregate(found, F.lit(0), lambda a, u: a + F.length(u)) / F.greatest(F.length(line), F.lit(1))


def is_noise_line(line: Column) -> Column:
    """Whether the line holds a word of X.LINE_NOISE, in any case (a long s is an s, as for Python). A search per word is a fraction
    of the alternation's cost, which Java tries branch by branch at every character; Han words are looked for in lines with such text."""

    def holds(low: Column, words: list[str]) -> Column:
        return reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False))

    words = list(dict.fromkeys(w.lower() for w in NOISE_WORDS))
    words = [w for w in words if not any(v != w and v in w for v in words)]  # cookies: found by cookie
    latin, han = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    low = F.replace(F.lower(line), F.lit("\u017f"), F.lit("s"))
    # an array of one: low is computed once for all words
    return F.exists(F.array(low), lambda x: holds(x, latin) | ((F.octet_length(x) > F.length(x)) & holds(x, han)))


def strict_body(t: Column) -> Column:
    """Lines, then sentences, without notices, link lists and scraps. Once noisy lines and URLs have gone, a sentence can hold
    noise only across the blank that joins two lines, and no URL."""
    lines = F.filter(F.transform(F.split(t, "\n"), py_strip), lambda x: (F.length(x) >= 15) & ~is_noise_line(x) & (url_share(x) < X.URL_SHARE))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, f"(?U){X.BODY_BULLETS}", ""), f"(?i){X.BODY_READ_ON}", ""))
    blob = F.regexp_replace(F.array_join(F.filter(lines, lambda x: py_strip(x) != ""), " "), ANY_URL, " ")
    # the blob holds no line end, so that one can part its sentences
    sentences = F.transform(F.split(F.regexp_replace(blob, rf"({X.BODY_SENTENCE_MARK})(?U:\s)+", "$1\n"), "\n"), py_strip)
    sentences = F.filter(sentences, lambda x: (F.length(x) >= 8) & ~F.regexp_like(x, F.lit(JOINED_NOISE)))
    return normalize_space(F.array_join(sentences, " "))


def frontier_body(t: Column) -> Column:
    """The lighter body filter: lines without notices, of 20 characters and more, with one URL at most; bullets and URLs go."""
    lines = F.filter(F.transform(F.split(t, "\n"), py_strip), lambda x: (F.length(x) >= 20) & ~is_noise_line(x) & (F.regexp_count(x, F.lit(ANY_URL)) < 2))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, f"(?U){X.BODY_BULLETS}", ""), ANY_URL, " "))
    return normalize_space(F.array_join(lines, " "))


def keep_paragraph(p: Column, least: int = X.PARAGRAPH_LEAST) -> Column:
    s = py_strip(p)
    return (F.length(s) >= least) & ~F.regexp_like(s, F.lit(f"(?i){X.PARAGRAPH_NOISE}")) & ((F.length(s) >= X.PARAGRAPH_SURE) | F.regexp_like(s, F.lit(X.SENTENCE_END)))


def keyword_cut(t: Column, words=X.CUT_WORDS, from_start: bool = True) -> Column:
    """The text before the earliest of the words; without from_start, a word at the very beginning doesn't count."""
    at = F.array_min(F.filter(F.array(*[F.instr(t, w) for w in words]), lambda p: p > (0 if from_start else 1)))
    return F.when(at.isNotNull(), py_strip(F.substring(t, F.lit(1), at - 1))).otherwise(py_strip(t))


def short_run_cut(t: Column, run: int = 3, short: int = 30) -> Column:
    """Words (split at blanks) up to a run of short ones without a closing mark; the run itself goes."""
    words = F.filter(F.transform(F.split(t, " "), py_strip), lambda w: w != "")
    is_short = lambda w: (F.length(w) < short) & ~reduce(lambda a, m: a | F.endswith(w, F.lit(m)), X.CLOSERS, F.lit(False))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a, w):
        n = F.when(is_short(w), a["n"] + 1).otherwise(0)
        out = F.concat(a["out"], F.array(w))
        cut = F.slice(out, F.lit(1), F.size(out) - run)
        return F.when(a["done"], a).otherwise(F.struct(F.when(n >= run, cut).otherwise(out).alias("out"), n.alias("n"), (n >= run).alias("done")))

    return F.aggregate(words, start, step, lambda a: F.array_join(a["out"], " "))


def agency_frame_strip(t: Column) -> Column:
    return py_strip(F.regexp_replace(py_strip(F.regexp_replace(t, f"(?m){X.AGENCY_FOOTER}", "")), X.AGENCY_HEADER, ""))


def pick_content(md: Column, html: Column) -> Column:
    return F.coalesce(blank_to_null(md), html, F.lit(""))


def select_body(html_text: Column, md: Column) -> Column:
    """HTML text first, then the Markdown's body; then the strict filter."""
    return strict_body(F.coalesce(blank_to_null(html_text), body_of_markdown(md), F.lit("")))


def block_reason(html: Column, md: Column, error: Column, host: Column, any_case: bool = False) -> Column:
    """Why a fetch was refused, or null: by its error, then a page signature, then too little text on a page with markup."""
    err = F.lower(F.coalesce(error, F.lit("")))
    out = None
    for word, reason in X.BLOCK_ERRORS:
        out = (out.when if out is not None else F.when)(F.contains(err, F.lit(word)), F.lit(reason))
    out = out.when(F.contains(err, F.lit("timeout")) | F.contains(err, F.lit("timed out")), F.lit("connection_timeout"))
    out = out.when(F.contains(err, F.lit("connection")) & F.contains(err, F.lit("refused")), F.lit("connection_refused"))
    page = F.concat(F.coalesce(html, F.lit("")), F.coalesce(md, F.lit("")))
    seen = F.lower(page) if any_case else page
    out = out.when(py_strip(page) == "", F.lit(None))
    for sign in X.BLOCK_SIGNATURES:
        out = out.when(F.contains(seen, F.lit(sign.lower() if any_case else sign)), F.lit(f"block_signature:{sign[:40]}"))
    few = F.when(host == X.STRICT_HOST, X.SOFT_BLOCK_STRICT).otherwise(X.SOFT_BLOCK_LENGTH)
    soft = (visible_length(html) > 0) & (visible_length(html) < few) & (F.length(html) > 500)
    return out.when(soft, F.lit("suspected_soft_block"))


def is_block_status(status: Column) -> Column:
    return status.isin(*X.BLOCK_STATUS)


def sentence_marks(t: Column) -> Column:
    return F.regexp_count(t, F.lit(X.SENTENCE_END))

"""Worked cases of the cleaning steps, native and exact."""

import time

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import text_exact as E


def native(spark, step, value):
    return spark.createDataFrame([(value,)], "t string").select(step(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("WASHINGTON (Reuters) - The bill passed.", "The bill passed."),
        ("LONDON, Jan. 5 (AP) — Text here.", "Text here."),
        ("the statement (AP) said so", "said so"),
        ("By John Smith and Jane Doe - Markets fell.", "Markets fell."),
        ("東京（AP）text", "東京（AP）text"),
        ("By By By By onnd. onnd.", "By By By By onnd. onnd."),
        ("LONDON, Jan. 5 (AP) - By John Smith and Jane Doe - By By By onnd.", "By By By onnd."),
        ("By As en ieosdo la llta.", "By As en ieosdo la llta."),
        ("By As", "By As"),
        ("By A It.\nAs en la.", "By A It. As en la."),
        ("By John Smith in New York — Markets fell.", "Markets fell."),
        ("By John Smith and Jane Doe\nMarkets fell.", "Markets fell."),
        ("By John Smith in New York\nLONDON (Reuters) - Markets fell.", "Markets fell."),
        ("LONDON, Jan. 5 (AP) - By John Smith and Jane Doe - By As en ieosdo.", "By As en ieosdo."),
        ("", ""),
    ],
)
def test_dateline(text, want):
    assert E.without_dateline(text) == want


CASES = [
    (T.social_strip, E.without_social, "See https://a.com/x and @bob now", "See and now"),
    (T.social_strip, E.without_social, "Photo by Ann Lee and all the rest of the text", ""),
    (T.agency_mask, None, "AFP and Reuters say", "[AGENCY] and [AGENCY] say"),
    (T.said_on_strip, None, "He said on Monday morning that", "He that"),
    (T.trailing_marker_cut, E.without_tail, "a" * 70 + " via: someone", "a" * 70),
    (T.trailing_marker_cut, E.without_tail, "via: " + "a" * 70, "a" * 70),
    (T.trailing_marker_cut, E.without_tail, "Image via x. " + "b" * 90, "x. " + "b" * 90),
    (T.boilerplate_strip, None, "Done. (Reporting by A; Editing by B)", "Done."),
    (T.boilerplate_strip, None, "X had no editorial involvement in its creation or production. Rest.", "Rest."),
    (T.drop_did_not_respond, None, "A said no. X did not immediately respond to calls. B left.", "A said no. B left."),
    (T.read_more_cut, None, "body read more at: x", "body"),
    (T.source_link_cut, None, "body [ 10:30 GMT ] -- source link: x", "body"),
    (T.site_name_strip, None, "On 21WIRE.TV now", "On now"),
    (T.zero_width_fix, None, " a\xa0​\tb ", "a \tb"),
    (T.normalize_space, None, "a\xa0 \tb\n", "a b"),
    (T.html_to_text, None, "<script>x()</script>Hello <b>you</b>", "Hello you"),
    (T.markdown_to_text, None, "# Head\n> q\n- [a](http://b) `c` ![d](e)", "Head q a c d"),
    (T.body_of_markdown, None, "# Head\nText **bold** here.\n> q\n- item\n## 延伸閱讀\ngone", "Text bold here."),
    (T.keyword_cut, None, "body 延伸閱讀 rest ETtoday", "body"),
    (T.agency_frame_strip, None, "（中央社記者甲台北1日電）內文。（編輯：乙）1150513", "內文。"),
    (T.short_run_cut, None, "One. two three four five", "One."),
]


@pytest.mark.parametrize(("step", "exact", "text", "want"), CASES)
def test_steps(spark, step, exact, text, want):
    assert native(spark, step, text) == want
    if exact:
        assert exact(text) == want


def test_markup():
    assert E.without_markup("<script>x()</script>Hello &amp; bye") == "Hello bye"
    assert E.without_markup("var a; function b(){ return null; } try{ break; } catch(e){}") == ""


def test_tokens(spark):
    assert native(spark, T.mixed_token_count, "我們 love AI-2 news") == 5 == E.token_count("我們 love AI-2 news")


def test_null_stays_null(spark):
    for step in (T.normalize_space, T.social_strip, T.html_to_text, T.strict_body, T.body_of_markdown):
        assert native(spark, step, None) is None


def test_modes(spark):
    df = spark.createDataFrame([(0, "enough words to be kept read more at: x", 0), (1, "enough words to be kept read more at: x", 1), (2, "social rejects club and more words here", 1), (3, None, 0)], "id int, text string, label int")
    got = {r["id"]: r["c"] for r in E.clean_articles(df, label="label", mode="train", into="c").collect()}
    assert got == {0: "enough words to be kept", 1: "enough words to be kept read more at: x", 2: "social rejects club and more words here", 3: ""}
    got = {r["id"]: r["c"] for r in E.clean_articles(df, mode="inference", into="c").collect()}
    assert got == {0: "enough words to be kept", 1: "enough words to be kept", 2: None, 3: None}


def test_main_text():
    p = "This is a long enough paragraph of running text, with a full stop at its end."
    page = f"<body><nav class='menu-nav'><p>{p}</p></nav><p>{p}</p><p><a href=x>{p}</a></p><p>short.</p><div><h2>延伸閱讀</h2><p>{p}</p></div></body>"
    assert E.main_text(page) == p
    assert E.main_text(None) == ""


def test_block_reasons(spark):
    df = spark.createDataFrame([("x", "http 403"), ("Access Denied", ""), ("<p>" + "<b></b>" * 100 + "few words of text</p>", ""), ("", "")], "html string, error string")
    got = [r["r"] for r in df.select(T.block_reason(F.col("html"), F.lit(""), F.col("error"), F.lit("a.com")).alias("r")).collect()]
    assert got == ["http_403", "block_signature:Access Denied", "suspected_soft_block", None]


def test_main_text_fixed_rows():
    """Paragraphs that read like an article's, by length, marks, links, noise and what stands before; lines where there are none."""
    from newsloom.functions.text_exact import main_text

    long = "This paragraph is long enough to be kept whatever its end may be, since it has more than eighty characters in it"
    short = "Short but closed by a full stop."
    page = f"""<html><div class="top sidebar"><p>{long} in a sidebar.</p></div><p>{long}</p><p>{short}</p><p>No end and short here too</p><p>tiny.</p>
<p><a href=x>{long} but all of it is a link.</a></p><p>Please accept cookies on this page, thank you very much indeed.</p><script><p>{long}</p></script>
<div><h2>延伸閱讀</h2><p>{long} after a related heading.</p></div><p>A last paragraph outside, which is closed.</p></html>"""
    assert main_text(page).split("\n") == [long, short, "A last paragraph outside, which is closed."]
    assert main_text(f"<div>{long}</div><div>x</div>") == long and main_text("") == "" and main_text(None) == ""


def test_strict_body_keeps_to_one_pass(spark):
    """A run of blanks costs its length, not its square; every word of the noise is still found, also where two lines are joined."""
    from newsloom.functions import fixed as X

    native(spark, T.strict_body, "warm")
    begun = time.monotonic()
    assert native(spark, T.strict_body, "a line of words" + " " * 100_000 + "and others after it.") == "a line of words and others after it."
    assert time.monotonic() - begun < 15
    words = [v for w in X.LINE_NOISE.strip("()").split("|") for v in (w, w.upper())]
    rows = spark.createDataFrame([(f"A line with x{w}x in it\nAnother line stays.", w) for w in words], "t string, w string")
    assert rows.where(T.strict_body(F.col("t")) != "Another line stays.").collect() == []
    assert native(spark, T.strict_body, "One sentence stays. All there is to read\n2 more lines follow here; the last one stays") == "One sentence stays. the last one stays"
    assert native(spark, T.strict_body, "Kept,\tas it  is:\u3000more！ \x1c so is this\n- www.a.b/c (a link of a line that is long enough for it, I think)") == "Kept, as it is: so is this (a link of a line that is long enough for it, I think)"


def test_normalize_space_takes_python_s(spark):
    import unicodedata

    marks = [chr(c) for c in range(1, 0x3100) if unicodedata.category(chr(c)) != "Cn"]
    text = "".join(f"{c} {c}{c}x " for c in marks)
    assert native(spark, T.normalize_space, text) == " ".join(text.split())

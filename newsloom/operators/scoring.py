"""Scores, bands and risks; a pluggable scorer; the sentences that explain a score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.batches import BATCH_BYTES, BATCH_ROWS, in_arrow
from newsloom.functions import fixed as X
from newsloom.session import ship, spread

RESULT = "prediction int, probability_real double, confidence_level string, best_chunk_index int, selected_sentences array<string>, selected_scores array<double>, T_used double, error string"
FAILED_LEVEL = "不確定 (Uncertain)"
UNSCORABLE_LEVEL = "無法分析"


def temperature_sigmoid(margin: Column, t: float = X.TEMPERATURE) -> Column:
    return 1 / (1 + F.exp(-margin / F.lit(t)))


def band(p: Column) -> Column:
    """Five levels; a cut point belongs to the level above it."""
    out = None
    for least, name in X.BANDS[:-1]:
        out = (out.when if out is not None else F.when)(p >= least, name)
    return F.when(p.isNotNull(), out.otherwise(X.BANDS[-1][1]))


def hard_class(p: Column) -> Column:
    return F.when(p >= 0.5, 1).otherwise(0)


def risk_of(label: Column, unknown=X.UNKNOWN_RISK) -> Column:
    """struct(risk_level, risk_label, short_reason): the first level whose name the label holds."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    risk = lambda x: F.struct(F.lit(x[0]).alias("risk_level"), F.lit(x[1]).alias("risk_label"), F.lit(x[2]).alias("short_reason"))
    out = None
    for name, *rest in X.RISKS:
        out = (out.when if out is not None else F.when)(F.contains(low, F.lit(name)), risk(rest))
    return out.otherwise(risk(unknown))


def absolute_rank(score: Column) -> Column:
    return F.when(score.isNull(), 0).when(score > 10, 1).when(score >= 5, 2).otherwise(3)


def dimension_weights(w1: Column, w0: Column, mode: str = "margin_positive") -> Column:
    """Weight of each classifier dimension: margin_positive, pred_positive or abs_margin."""
    f = {"margin_positive": lambda a, b: F.greatest(a - b, F.lit(0.0)), "pred_positive": lambda a, b: F.greatest(a, F.lit(0.0)), "abs_margin": lambda a, b: F.abs(a - b)}[mode]
    return F.zip_with(w1, w0, f)


def top_mean(scores: Column, k: int = X.TOP_TOKENS) -> Column:
    """Mean of the k greatest (of all, if fewer)."""
    top = F.slice(F.sort_array(scores, asc=False), 1, k)
    return F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.least(F.lit(k), F.size(scores)))


def top_two_margin(values: Column) -> Column:
    """Greatest minus second greatest, 0 with fewer than two."""
    s = F.sort_array(values, asc=False)
    return F.when(F.size(values) < 2, 0.0).otherwise(F.greatest(F.get(s, 0) - F.get(s, 1), F.lit(0.0)))


def masked_max(values: Column, mask: Column) -> Column:
    """struct(value, position) of the greatest value where the mask is 1, the first of equal ones; null if none."""
    pairs = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("value"), (-i).alias("neg"), F.get(mask, i).alias("on"))), lambda s: s["on"] == 1)
    best = F.array_max(F.transform(pairs, lambda s: F.struct(s["value"].alias("value"), s["neg"].alias("neg"))))
    return F.when(best.isNotNull(), F.struct(best["value"].alias("value"), (-best["neg"]).alias("position")))


def relative_top(scores: Column, share: float = X.RELATIVE_SHARE, most: int = X.TOP_SENTENCES) -> Column:
    s = F.sort_array(scores, asc=False)
    return F.slice(F.filter(s, lambda x: x >= share * F.get(s, 0)), 1, most)


def token_windows(tokens: Column, size: int = X.WINDOW - X.SPECIALS, overlap: int = X.OVERLAP) -> Column:
    """array of struct(start, tokens): windows of `size`, each `overlap` before the end of the last; one for an empty list."""
    step = size - overlap
    last = F.greatest(F.ceil((F.size(tokens) - size) / F.lit(step)), F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: i * step)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, F.lit(size)).alias("tokens")))


def padded(tokens: Column, size: int, pad: str = "[PAD]") -> Column:
    """struct(tokens, mask): filled up to size."""
    missing = F.greatest(F.lit(size) - F.size(tokens), F.lit(0))
    return F.struct(F.concat(tokens, F.array_repeat(F.lit(pad), missing)).alias("tokens"), F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), missing)).alias("mask"))


# --- scoring --------------------------------------------------------------------------------------------------------


def stand_in(text: str) -> tuple[float, float, list[float]]:
    """(z_fake, z_real, score of each token): a deterministic stand-in by hashes. It has no accuracy; it exercises what follows."""
    values = [int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") / 2**32 for w in text.lower().split()]
    z = float(np.mean(values)) if values else 0.5
    return 4 * (0.5 - z), 4 * (z - 0.5), [max(0.0, v - 0.5) for v in values]


def explaining(words: list[str], scores: list[float]) -> list[tuple[str, float]]:
    """Sentences of at least eight tokens with the mean of their seven best token scores; positive ones, the best three first.

    A mark ends a sentence that is long enough, unless it is the dot of an abbreviation of one or two letters; the rest
    counts if it is long enough. Without any, the whole text with score 0.
    """
    done, own = [], []
    for i, w in enumerate(words):
        own.append(i)
        bare = w.rstrip(X.SENTENCE_MARKS)
        if w[-1] in X.SENTENCE_MARKS and len(own) >= X.SENTENCE_TOKENS and not (w[-1] == "." and bare.isalpha() and len(bare) <= 2):
            done.append(own)
            own = []
    if len(own) >= X.SENTENCE_TOKENS:
        done.append(own)
    rated = [(" ".join(words[i] for i in s), float(np.mean(sorted((scores[i] for i in s), reverse=True)[: X.TOP_TOKENS]))) for s in done]
    best = sorted((r for r in rated if r[1] > 0), key=lambda r: -r[1])[: X.TOP_SENTENCES]
    return best or [(" ".join(words), 0.0)]


def result_of(text: str | None, scorer: Callable, t: float) -> tuple:
    if text is None or not text.strip():
        return -1, 0.5, UNSCORABLE_LEVEL, -1, [], [], t, None
    try:
        z_fake, z_real, scores = scorer(text)
        p = float(1 / (1 + np.exp(-(z_real - z_fake) / t)))
        level = next(name for least, name in X.BANDS if least is None or p >= least)
        words = text.split()
        step = X.WINDOW - X.SPECIALS - X.OVERLAP
        starts = range(0, max(1, len(words) - X.OVERLAP), step)
        chunk = max(range(len(starts)), key=lambda i: (sum(scores[starts[i] : starts[i] + X.WINDOW - X.SPECIALS]), -i))
        part = slice(starts[chunk], starts[chunk] + X.WINDOW - X.SPECIALS)
        chosen = explaining(words[part], scores[part])
        return int(p >= 0.5), p, level, chunk, [s for s, _ in chosen], [round(x, 4) for _, x in chosen], t, None
    except Exception as e:  # one bad article is a row of its own, not the end of the batch
        return -1, 0.5, FAILED_LEVEL, -1, [], [], t, f"{type(e).__name__}: {e}"


def score_articles(df: DataFrame, key: str, text: str, scorer: Callable = stand_in, t: float = X.TEMPERATURE, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the result columns and those to carry along, one row per input row; scorer(text) gives two logits and a score per
    blank-separated token."""
    names = ["k", *(c.split()[0] for c in RESULT.split(", ")), *(f"c{i}" for i in range(len(carry)))]

    def batches(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64(), pa.string()
        for b in pieces:
            rows = [result_of(x.as_py(), scorer, t) for x in b.column(1)]
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *found, *b.columns[2:]], names=names)

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]))
    kind = lambda c: df.schema[c].dataType.simpleString()
    scored = in_arrow(rows, batches, ", ".join([f"k {kind(key)}", RESULT, *[f"c{i} {kind(c)}" for i, c in enumerate(carry)]]))
    return scored.withColumnsRenamed({"k": key} | {f"c{i}": c for i, c in enumerate(carry)})


def rated_articles(df: DataFrame, key: str, text: str, margins: Callable[[list], np.ndarray], t: float, carry: tuple[str, ...] = (), rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """key, prediction, probability_real, confidence_level and the columns to carry along, as score_articles has them, without what
    explains a score; margins(texts) gives the difference of the two logits for many texts at once."""
    names = ["k", "margin", *(f"c{i}" for i in range(len(carry)))]

    def batches(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces:
            texts = b.column(1).to_pylist()
            blank = np.array([x is None or not x.strip() for x in texts], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(margins(texts), pa.float64(), mask=blank), *b.columns[2:]], names=names)

    given = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]))
    kind = lambda c: df.schema[c].dataType.simpleString()
    found = in_arrow(given, batches, ", ".join([f"k {kind(key)}", "margin double", *[f"c{i} {kind(c)}" for i, c in enumerate(carry)]]), rows, size)
    p, none = temperature_sigmoid(F.col("margin"), t), F.col("margin").isNull()
    made = F.when(none, -1).otherwise(hard_class(p)), F.when(none, 0.5).otherwise(p), F.when(none, UNSCORABLE_LEVEL).otherwise(band(p))
    out = [x.alias(c) for c, x in zip(("prediction", "probability_real", "confidence_level"), made)]
    return found.select(F.col("k").alias(key), *out, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


# --- small forms ------------------------------------------------------------------------------------------------------


def best_chunk(attention: Column) -> Column:
    """Position of the chunk that the others attend to most: the first greatest column sum of a square matrix (array of rows)."""
    sums = F.transform(F.sequence(F.lit(0), F.size(attention) - 1), lambda j: F.aggregate(attention, F.lit(0.0), lambda a, row: a + F.get(row, j)))
    return F.when(F.size(attention) > 0, F.array_position(sums, F.array_max(sums)) - 1).otherwise(-1).cast("int")


def token_frequencies(tokens: Column) -> Column:
    """array of struct(token, n), each token once, in order of first occurrence: the older scorer's token weights."""
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.size(F.filter(tokens, lambda x: x == t)).alias("n")))


def weights_by_position(positions: Column, weights: Column) -> Column:
    """Map from token position to the sum of the positive weights of the dimensions it won."""
    pairs = F.filter(F.arrays_zip(positions.alias("p"), weights.alias("w")), lambda s: s["w"] > 0)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda s: s["p"])), lambda p: F.struct(p, F.aggregate(F.filter(pairs, lambda s: s["p"] == p), F.lit(0.0), lambda a, s: a + s["w"]))))


def score_at(weights: Column, position: Column) -> Column:
    return F.coalesce(F.try_element_at(weights, position), F.lit(0.0))


def without_overlaps(ranges: Column) -> Column:
    """Ranges (struct start, end) by position; one that begins before the last kept one's end is left out."""
    empty = F.filter(ranges, lambda r: F.lit(False))
    ordered = F.array_sort(ranges)
    return F.aggregate(ordered, empty, lambda kept, r: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= r["start"]), F.concat(kept, F.array(r))).otherwise(kept))


def kept_ranges(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """key, start, end: without_overlaps() for keys with any number of ranges. Rows come sorted by key and place, and only the
    last kept end is remembered; ranges with nulls are left out."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, till = None, None
        for f in frames:
            keep = np.zeros(len(f), bool)
            for i, (k, a, b) in enumerate(zip(f["k"], f["a"], f["b"])):
                if k != owner or till <= a:
                    owner, till, keep[i] = k, b, True
            yield f[keep]

    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(start).alias("a"), F.col(end).alias("b")).where("k is not null and a is not null and b is not null")
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    sorted_rows = rows.repartition("k").sortWithinPartitions("k", "a", "b")
    return sorted_rows.mapInPandas(batches, fields).withColumnsRenamed({"k": key, "a": start, "b": end})


def older_score(margin: Column) -> Column:
    """The older scorer's probability: its own temperature, two decimals."""
    return F.round(temperature_sigmoid(margin, X.OLD_TEMPERATURE), 2)


def highlighted(sentences: Column, colours: tuple[str, ...] = ("first", "second", "third")) -> Column:
    """The best sentences (struct score, text; ties in order) with a colour by rank."""
    numbered = F.transform(sentences, lambda s, i: F.struct((-s["score"]).alias("neg"), i.alias("i"), s["text"].alias("text"), s["score"].alias("score")))
    best = F.slice(F.array_sort(numbered), 1, len(colours))
    palette = F.array(*[F.lit(c) for c in colours])
    return F.transform(best, lambda s, i: F.struct(s["text"].alias("text"), s["score"].alias("score"), F.get(palette, i).alias("colour")))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(8.0), F.pow(F.lit(2.0), attempt - 1))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.when(whole >= 3600, F.format_string("%dh %dm %ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)).when(whole >= 60, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%ds", whole))


def score_text(score: Column) -> Column:
    """Three decimals within 0 to 1, whole numbers beyond."""
    return F.when(score.between(0, 1), F.format_string("%.3f", score)).otherwise(F.format_string("%d", F.floor(score + 0.5).cast("long")))


def fake_or_real(prediction: Column) -> Column:
    return F.when(prediction == 1, "real").when(prediction == 0, "fake")

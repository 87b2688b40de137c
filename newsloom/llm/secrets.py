"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near its hits, embedded checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

from newsloom.llm.work import key_type, released, text_or_empty
from newsloom.session import ship

#: Kinds, in the order that decides between spans with one start.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?<![A-Za-z0-9])(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run of HEX_LEAST hexadecimal digits holds this many overlapping grams of four.
GRAM = 4
GRAMS_IN_ROW = HEX_LEAST - GRAM + 1
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for gram in product("0123456789abcdef", repeat=GRAM):
        a.add_word("".join(gram), (2, GRAM))
    for word in WORDS:
        a.add_word(word, (0, len(word)))
    a.add_word("akia", (1, 4))
    for word in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
        a.add_word(word, (3, 4))
    a.add_word("npm_", (4, 4))
    a.make_automaton()
    return a


def base62_crc(body: str) -> str:
    """The six-digit checksum that ends a token of the checked kinds: CRC-32 of the thirty characters before it."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, ordered by start, then kind. Offsets are code points, end exclusive."""
    spans: list[tuple[int, int, int]] = []
    done = [0, 0, 0]  # per base kind, where the last match ended: matches don't overlap
    run_start = run_end = -2
    for end, (kind, length) in automaton().iter(lowered(text)):
        start = end + 1 - length
        if kind == 2:
            if end != run_end + 1:
                run_start = start
            run_end = end
            if end - run_start + 1 >= HEX_LEAST and run_start >= done[2]:
                stop = run_start
                # the whole run in lower or upper case; only its lower-case stretches can match
                while stop < len(text) and text[stop] in "0123456789abcdefABCDEF":
                    stop += 1
                spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run_start, stop) if m.end() - m.start() >= HEX_LEAST]
                done[2] = stop
        elif kind == 0:
            if start >= done[0] and (m := ASSIGN.match(text, start)):
                done[0] = m.end()
                if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                    spans.append((start, 0, m.end()))
        elif kind == 1:
            if start >= done[1] and (m := ACCESS.match(text, start)):
                done[1] = m.end()
                if m.end() - start >= ACCESS_LEAST:
                    spans.append((start, 1, m.end()))
        elif (m := CHECKED.match(text, start)) and base62_crc(m[2]) == m[3]:
            spans.append((start, kind, m.end()))
    return sorted(spans)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by [SECRET]; overlapping spans count as one."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, spans (array of kind, start, end), redacted (the text without its secrets).

    A null text counts as empty and has no spans; a null key stays null; repeated rows give repeated results; other
    columns are ignored, whatever their names; an empty table gives an empty one. Texts of any length are read whole.
    """
    ship(docs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [scan(t) for t in frame["t"]]
            yield pd.DataFrame({"k": frame["k"], "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], "redacted": [redacted(t, x) for t, x in zip(frame["t"], found)]})

    rows = docs.select(docs[key].alias("k"), text_or_empty(text).alias("t"))
    return rows.mapInPandas(released(batches), f"k {key_type(docs, key)}, spans array<struct<kind:string,start:long,end:long>>, redacted string").withColumnRenamed("k", key)


def redact_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets of column text replaced, and n_spans (in place of a column of that name, in letters of any case).

    A null text stays null with no spans; nulls elsewhere, repeated rows and other columns stay as they are; an empty
    table gives an empty one. Texts of any length are read whole.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.select(*[docs[c] for c in docs.columns if c.lower() != "n_spans"])
    names = [*rows.columns, "n_spans"]
    at = names.index(text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at).to_pylist()
            found = [scan(t) if t else [] for t in texts]
            new = pa.array([redacted(t, x) if x else t for t, x in zip(texts, found)], pa.string())
            columns = [new if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(map(len, found)), pa.int32())], names=names)

    return rows.mapInArrow(released(batches), StructType([*rows.schema.fields, StructField("n_spans", IntegerType())]))

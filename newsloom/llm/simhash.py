"""Document fingerprints: SimHash with weighted words, and permuted block tables that find all fingerprints within a
Hamming radius."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.blocks import block_pairs
from newsloom.llm.sharding import LOW, RANGES_MOST, as_arrays, bucket_of, splitters
from newsloom.llm.work import key_type, materialize, need_integral, released, text_or_empty, within_bounds
from newsloom.session import ship

BITS = 256
WORDS64 = BITS // 64
#: Fingerprints that differ in at most RADIUS bits agree in one of RADIUS + 1 blocks at least.
RADIUS = 7
BLOCKS = RADIUS + 1
#: Odd multipliers that spread one word hash over the fingerprint's 64-bit parts: multiples of the golden ratio's fraction.
SPREAD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (1 << 64) - 1 for i in range(WORDS64)], np.uint64)
#: Characters of scripts written without blanks: Thai, Lao, Burmese, Khmer, Han, Kana and what lies between.
NO_BLANKS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
RUNS = re.compile(f"{NO_BLANKS.pattern}+|[^{NO_BLANKS.pattern[1:]}+")
#: Bytes of text aimed at in one range of neighbouring documents (more, where that gave over RANGES_MOST ranges).
RANGE_BYTES = 16 << 20


def terms_of(text: str) -> Counter:
    """How often each term of the lower-cased text occurs: words between blanks; in scripts without blanks, pairs of neighbouring characters."""
    words = text.lower().split()
    if not text.isascii() and NO_BLANKS.search(text):
        cut = []
        for word in words:
            for run in RUNS.findall(word):
                cut += [run] if len(run) < 3 or not NO_BLANKS.match(run) else [run[i : i + 2] for i in range(len(run) - 1)]
        words = cut
    return Counter(words)


def weight_of(term: str, times: int) -> int:
    """Its length class (long words tell more than short ones) times one more than the logarithm of its frequency.

    How many documents hold a term doesn't count: a text's fingerprint would change with the corpus around it, and
    fingerprints of two tables could not be compared.
    """
    n = len(term)
    return (1 if n <= 3 else 2 if n <= 6 else 3) * times.bit_length()


def fingerprint(text: str) -> bytes:
    """Each distinct term votes with its weight on each bit; a tie and an empty text give 0."""
    terms = terms_of(text)
    if not terms:
        return bytes(BITS // 8)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    h = h[:, None] * SPREAD
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    weights = np.fromiter(map(weight_of, terms, terms.values()), np.int64, len(terms))
    votes = np.zeros(BITS, np.int64)
    for w in np.unique(weights).tolist():
        bits = np.unpackbits(h[weights == w].view(np.uint8), axis=1)
        for first in range(0, len(bits), 255):  # sums of 255 rows fit in a byte
            votes += w * np.add.reduce(bits[first : first + 255], axis=0, dtype=np.uint8).astype(np.int64)
    return np.packbits(2 * votes > weights.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fp, edited_fp, next_fp: each document with the next by ascending key (the last with the first).

    Documents move once, compressed, to ranges of neighbouring keys; a range's first document also goes to the range
    before. Null keys come first; rows with one key are ordered by a hash of their text; a null text counts as empty.
    """
    spark = docs.sparkSession
    need_integral(docs, key)
    body = text_or_empty(text)
    order = (F.coalesce(docs[key].cast("long"), F.lit(LOW)).alias("h"), F.xxhash64(body).alias("k"))
    narrow = materialize(docs.select(*order, (F.octet_length(body).cast("long") + 64).alias("size")), "order")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    parts = min(RANGES_MOST, max(1, -(-total // RANGE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 65536)))
    cuts, _ = splitters(narrow, parts, 1, 0.1, 0.1) if parts > 1 else ([], [])
    shared = spark.sparkContext.broadcast(as_arrays(cuts))

    def firsts_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.assign(p=bucket_of(f["h"].to_numpy(), f["k"].to_numpy(), *shared.value)).sort_values(["p", "h", "k"])
            yield f.groupby("p", as_index=False).first()[["p", "h", "k"]]

    least = narrow.select("h", "k").mapInPandas(released(firsts_of), "p long, h long, k long").groupBy("p").agg(F.min(F.struct("h", "k")).alias("m"))
    firsts = sorted((r["p"], r["m"]["h"], r["m"]["k"]) for r in least.collect())  # one row per range, RANGES_MOST at most
    before = spark.sparkContext.broadcast({(h, k): firsts[i - 1][0] for i, (_, h, k) in enumerate(firsts)})  # the first one's is the last range
    ship(docs.sparkSession)
    kind = key_type(docs, key)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(3).compress
        for f in frames:
            p = bucket_of(f["h"].to_numpy(), f["k"].to_numpy(), *shared.value).astype(np.int32)
            f = f.assign(p=p, tail=0, z=[pack(t.encode()) for t in f["t"]]).drop(columns="t")
            also = [(i, before.value[x]) for i, x in enumerate(zip(f["h"], f["k"])) if x in before.value]
            tails = f.iloc[[i for i, _ in also]].assign(p=np.array([q for _, q in also], np.int32), tail=1)
            yield pd.concat([f, tails])[["p", "tail", "h", "k", "id", "z"]]

    moved = docs.select(*order, docs[key].alias("id"), body.alias("t")).mapInPandas(released(dealt), f"p int, tail int, h long, k long, id {kind}, z binary")
    moved = moved.repartition(parts, "p").sortWithinPartitions("p", "tail", "h", "k")

    def paired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        last = None  # the row whose successor hasn't come yet: range, key, text, fingerprint
        for f in frames:
            rows = []
            for p, tail, i, z in zip(f["p"], f["tail"], f["id"], f["z"]):
                text = unpack(z).decode()
                print_ = fingerprint(text)
                if last is not None and last[0] == p:
                    edited = edited_text(last[2], text)
                    rows.append((last[1], len(last[2]), hashlib.sha256(edited.encode()).hexdigest(), last[3], fingerprint(edited), print_))
                last = None if tail else (p, i, text, print_)
            yield pd.DataFrame(rows, columns=["id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"])

    return moved.mapInPandas(released(paired), f"id {kind}, n_chars long, edited_sha256 string, fp binary, edited_fp binary, next_fp binary")


def near_counts(prints: DataFrame, salts: int = 16) -> DataFrame:
    """fp, n_near: for each distinct fingerprint in column fp, the other rows within RADIUS bits (equal ones among them).

    BLOCKS tables hold each distinct fingerprint under one of its blocks. A pair counts in the first table where its
    blocks agree, so no pair counts twice; large buckets are compared block by block. Fingerprints near none but their
    equals are left to their count. Null fingerprints are near nothing and come out as one row; no rows give none.
    """
    ship(prints.sparkSession)
    spark = prints.sparkSession
    distinct = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    width = BITS // BLOCKS // 8
    tables = distinct.where("fp is not null").select("fp", "n", F.posexplode(F.array(*[F.substring("fp", 1 + i * width, width) for i in range(BLOCKS)])).alias("i", "v"))
    def compared(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        i, _, b1, b2 = key
        bits = np.frombuffer(b"".join(f["fp"]), np.uint64).reshape(len(f), WORDS64)
        blocks = np.frombuffer(b"".join(f["fp"]), f"u{width}").reshape(len(f), BLOCKS)
        n, own, found = f["n"].to_numpy(np.int64), f["b"].to_numpy(), np.zeros(len(f), np.int64)
        others = np.flatnonzero(own == b2)
        for x in np.flatnonzero(own == b1):
            hit = others[(np.bitwise_count(bits[others] ^ bits[x]).sum(1) <= RADIUS) & ~(blocks[others, :i] == blocks[x, :i]).any(1)]
            hit = hit[hit != x]
            found[x] += n[hit].sum()
            if b1 != b2:
                found[hit] += n[x]
        at = np.flatnonzero(found)
        return pd.DataFrame({"fp": f["fp"].iloc[at], "more": found[at]})

    near = block_pairs(tables, ["i", "v"], "fp").groupBy("i", "v", "b1", "b2").applyInPandas(compared, "fp binary, more long").groupBy("fp").agg(F.sum("more").alias("more"))
    return distinct.join(near, "fp", "left").select("fp", F.when(F.col("fp").isNull(), F.lit(0)).otherwise(F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"))


@within_bounds()
def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next, n_near: one row per input row.

    n_near counts the other rows whose fingerprint lies within RADIUS bits. A null text counts as empty: fingerprint 0.
    Null keys and repeated rows are kept (see with_next); keys that are no integers are refused; other columns are
    ignored; an empty table gives an empty one; a lone document is its own next.
    """
    rows = materialize(with_next(docs, key, text), "prints")
    # copies may hold a third of all rows: rows are dealt over the salts, each fingerprint's count is repeated for them
    counts = near_counts(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "edited_sha256"), F.lit(salts)).cast("int"))
    same = lambda a, b: F.lit(1.0) - sum((F.bit_count(F.conv(F.substring(F.hex(a), 1 + 8 * i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(F.hex(b), 1 + 8 * i, 8), 16, 10).cast("long"))) for i in range(BITS // 32)), F.lit(0)) / F.lit(float(BITS))
    return salted.join(counts, ["fp", "salt"]).select(
        F.col("id").alias(key), "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        same("fp", "edited_fp").alias("near_edited"), same("fp", "next_fp").alias("near_next"), "n_near",
    )

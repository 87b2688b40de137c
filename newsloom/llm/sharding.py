"""Sharding by histogram sort: exact bytes below candidate boundaries are counted again and again until every
splitter meets its tolerance; then the rows move once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import is_integral, materialize

#: Probes per interval and round, and of all intervals in one round at most (an interval still gets LEAST_PROBES).
PROBES, PROBES_MOST, LEAST_PROBES = 31, 1 << 18, 3
#: Rows that one task ranks aimed at, and ranges that are ranked at most.
RANK_ROWS, RANGES_MOST = 1 << 18, 1 << 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def as_arrays(keys: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([x[i] for x in keys], np.int64) for i in (0, 1))


def bucket_of(h: np.ndarray, k: np.ndarray, ph: np.ndarray, pk: np.ndarray) -> np.ndarray:
    """For each key (h, k): how many of the ascending probes (ph, pk) are at or below it."""
    out, end = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    tied = np.flatnonzero(end > out)
    if len(tied):  # where a probe has the same first half, the second half of the key decides
        for value in np.unique(h[tied]):
            at = tied[h[tied] == value]
            first, last = out[at[0]], end[at[0]]
            out[at] = first + np.searchsorted(pk[first:last], k[at], "right")
    return out


def counted(rows: DataFrame, probes: list[tuple[int, int]]) -> dict[int, tuple]:
    """Per bucket between probes: bytes, rows, and the least and greatest h and k. At most one row per bucket reaches the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(as_arrays(probes))

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ph, pk = shared.value
        for f in frames:
            f = f.assign(b=bucket_of(f["h"].to_numpy(), f["k"].to_numpy(), ph, pk))
            yield f.groupby("b", as_index=False).agg(bytes=("size", "sum"), n=("size", "size"), h0=("h", "min"), h1=("h", "max"), k0=("k", "min"), k1=("k", "max"))

    parts = rows.select("h", "k", "size").mapInPandas(part, "b long, bytes long, n long, h0 long, h1 long, k0 long, k1 long")
    merged = parts.groupBy("b").agg(F.sum("bytes"), F.sum("n"), F.min("h0"), F.max("h1"), F.min("k0"), F.max("k1"))
    return {r[0]: tuple(r[1:]) for r in merged.toPandas().itertuples(index=False, name=None)}


def between(lo: tuple[int, int], hi: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n keys spread evenly in (lo, hi]; keys are compared as pairs."""
    a, b = ((x[0] - LOW << 64) + (x[1] - LOW) for x in (lo, hi))
    found = sorted({a + (b - a) * i // (n + 1) for i in range(1, n + 1)} | {b} - {a})
    return [((x >> 64) + LOW, (x & (1 << 64) - 1) + LOW) for x in found if x > a]


def splitters(rows: DataFrame, parts: int, main: int, tolerance: float, loose: float) -> tuple[list[tuple[int, int]], list[int]]:
    """parts - 1 ascending keys that cut the bytes evenly, and the rows below each.

    Every main-th splitter is refined until the bytes below it are within tolerance of a main part of the target, or no
    row lies between its bounds; the others may be off by loose of a small part.
    """
    return refined(lambda probes: counted(rows, probes), parts, main, tolerance, loose)


def refined(count, parts: int, main: int, tolerance: float, loose: float) -> tuple[list[tuple[int, int]], list[int]]:
    """splitters() over count(probes), the buckets between probes. Between rounds only the keys around a target are kept,
    so the driver's work and memory follow the number of parts, not the rows."""
    all_of = count([]).get(0)
    if all_of is None:
        return [], []
    total, n, h0, h1, k0, k1 = all_of
    start = (h0, k0 if h0 == h1 else LOW)
    end = (h1, k1) if h0 == h1 else (h1, HIGH)
    # keys with the bytes and rows below each (a row below a key is smaller than it), and the bounds of the rows up to the next key
    keys, below, under = [start, (end[0], end[1] + 1) if end[1] < HIGH else (HIGH, HIGH)], [0, total], [0, n]
    gaps: list[tuple | None] = [(h0, h1, k0, k1), None]
    number = np.arange(1, parts)
    targets = total * number / parts
    allowed = np.where(number % main == 0, tolerance * total * main / parts, loose * total / parts)
    while True:
        bytes_below = np.array(below, np.float64)
        j = np.searchsorted(bytes_below, targets, "right") - 1
        up = np.minimum(j + 1, len(keys) - 1)
        near = np.minimum(np.abs(bytes_below[j] - targets), np.abs(bytes_below[up] - targets))
        intervals = [i for i in np.unique(j[near > allowed]).tolist() if gaps[i]]
        own = set(keys)
        want: set[tuple[int, int]] = set()
        probes = min(PROBES, max(LEAST_PROBES, PROBES_MOST // max(1, len(intervals))))
        for i in intervals:
            g0, g1, c0, c1 = gaps[i]
            lo, hi = keys[i], keys[i + 1]
            if g0 == g1:  # one text: only the second half of the key can cut it
                lo, hi = max(lo, (g0, c0)), min(hi, (g0, c1))
            else:
                lo, hi = max(lo, (g0, LOW)), min(hi, (g1, HIGH))
            want.update(between(lo, hi, probes))
        want -= own
        if not want:
            break
        stay = set(np.unique(np.concatenate([j, up])).tolist())
        asked = sorted(want | {keys[i] for i in stay if 0 < i < len(keys) - 1})
        got = count(asked)
        edges, nb, nn = [keys[0], *asked, keys[-1]], 0, 0
        keys, below, under, gaps = edges, [], [], []
        for b in range(len(edges)):
            below.append(nb)
            under.append(nn)
            found = got.get(b)
            gaps.append(found[2:] if found else None)
            if found:
                nb, nn = nb + found[0], nn + found[1]
    if not parts > 1:
        return [], []
    nearest = np.where(np.abs(bytes_below[up] - targets) < np.abs(bytes_below[j] - targets), up, j)
    # of keys with equal bytes below, the first
    nearest = np.searchsorted(bytes_below, bytes_below[nearest], "left")
    return [keys[i] for i in nearest], [under[i] for i in nearest]


def shard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, pieces: int | None = None, tolerance: float = 0.0005, loose: float = 0.25) -> DataFrame:
    """Law `bytes`: key, size, text_crc32, law, shard, slot, grown_shard; one row per input row.

    Rows are ordered by (hash of text, key), so equal texts are neighbours and share a shard, but where a boundary has
    to cut them: a group of any size is cut by its keys. The bytes of a shard miss their share by at most tolerance of a
    shard, or by one row where a row is larger than that. Each shard is ranked in `pieces` ranges, by default 32 or as
    many as keep RANK_ROWS rows a range, so no task gets a whole shard. A null text has size 1 and the checksum of no
    bytes; null keys sort first; keys that are no integers are ordered by a hash; repeated rows are rows of their own,
    next to each other; other columns are ignored; an empty table gives an empty one. When more rows than a shard's
    tolerance share text and key, they can't be cut and stay together.
    """
    body = F.coalesce(docs[text], F.lit("")).cast("binary")
    number = docs[key].cast("long") if is_integral(docs, key) else F.when(docs[key].isNotNull(), F.xxhash64(docs[key].cast("string")))
    rows = materialize(docs.select(docs[key].alias("id"), F.xxhash64(body).alias("h"), F.coalesce(number, F.lit(LOW)).alias("k"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("crc")), "sizes")
    if pieces is None:
        pieces = max(32, min(RANGES_MOST // shards, -(-rows.count() // (shards * RANK_ROWS))))
    cuts, below = splitters(rows, shards * pieces, pieces, tolerance, loose)
    offsets = np.array([0, *below], np.int64)
    base = offsets - offsets[np.arange(len(offsets)) // pieces * pieces]
    shared = rows.sparkSession.sparkContext.broadcast((*as_arrays(cuts), base))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ph, pk, base = shared.value
        for f in frames:
            piece = bucket_of(f["h"].to_numpy(), f["k"].to_numpy(), ph, pk)
            yield f.assign(piece=piece.astype(np.int32), base=base[piece])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    ranked = rows.mapInPandas(placed, f"{fields}, piece int, base long").selectExpr("*", "row_number() over (partition by piece order by struct(h, k, size)) - 1 as r")
    shard = F.floor(F.col("piece") / F.lit(pieces)).cast("int")
    return ranked.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), shard.alias("shard"), (F.col("r") + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

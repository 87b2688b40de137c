"""Byte-level BPE encoding and decoding with a rank queue: a hierarchical bitmap over merge ranks, a bucket of
linked-list positions per rank, find-first-set for the next rank, stale entries skipped."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from newsloom.llm.work import key_type, released, text_or_empty
from newsloom.session import ship, spread

#: Encoded pre-tokens a Python worker keeps, in two generations: beyond, the older one is forgotten and encoded again when met.
PIECES_KEPT = 800_000
#: Bits of a token number in a packed pair.
BITS = 17
#: Longer pre-tokens aren't kept.
KEPT_CHARS = 64

def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Buckets of entries by rank under a three-level bitmap of 64-bit words."""

    def __init__(self):
        self.top, self.mid, self.low, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, entry: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            bucket.append(entry)
            return
        self.buckets[rank] = [entry]
        w, v = rank >> 6, rank >> 12
        self.low[w] = self.low.get(w, 0) | 1 << (rank & 63)
        self.mid[v] = self.mid.get(v, 0) | 1 << (w & 63)
        self.top |= 1 << v

    def first(self) -> int:
        """The least rank with a bucket, -1 if there is none: find-first-set on each level."""
        top = self.top
        if not top:
            return -1
        v = (top & -top).bit_length() - 1
        m = self.mid[v]
        w = v << 6 | (m & -m).bit_length() - 1
        low = self.low[w]
        return w << 6 | (low & -low).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        w, v = rank >> 6, rank >> 12
        self.low[w] &= ~(1 << (rank & 63))
        if not self.low[w]:
            self.mid[v] &= ~(1 << (w & 63))
            if not self.mid[v]:
                self.top &= ~(1 << v)
        return self.buckets.pop(rank)


class Encoder:
    """BPE by ranks. pairs maps two token numbers, packed in one integer, to the number of their concatenation, which is
    also their merge rank. An entry of the queue is a position and the two numbers it had there, packed likewise."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        ranks = self.ranks
        self.pairs = {a << BITS | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.text = {str(r): t for t, r in ranks.items()}
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token numbers of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.merged([piece])[0]

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Token numbers of several pre-tokens, all in one linked list with barriers between them: one queue serves all."""
        byte, pairs = self.byte, self.pairs
        ids: list[int] = [-1]  # a token number at each live position, -1 at a barrier, -2 where merged away
        for p in pieces:
            ids += [byte[b] for b in p]
            ids.append(-1)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, low = RankQueue(), (1 << BITS) - 1
        push, get, buckets = queue.push, pairs.get, queue.buckets

        def offer(r: int, entry: int) -> None:
            if r in buckets:
                buckets[r].append(entry)
            else:
                push(r, entry)

        a = ids[0]
        for i, b in enumerate(ids[1:]):
            if a >= 0 and b >= 0 and (r := get(pair := a << BITS | b)) is not None:
                offer(r, i << 2 * BITS | pair)
            a = b
        while (rank := queue.first()) >= 0:
            entries = queue.take(rank)
            if len(entries) > 1:
                entries.sort()  # leftmost first
            for at, entry in enumerate(entries):
                i = entry >> 2 * BITS
                if ids[i] != entry >> BITS & low:
                    continue  # stale: the position was merged
                j = after[i]
                if ids[j] != entry & low:
                    continue  # stale: its right neighbour was merged
                k = after[j]
                ids[i], ids[j] = rank, -2
                after[i], before[k] = k, i
                lower = False
                h = before[i]
                if (a := ids[h]) >= 0 and (r := get(pair := a << BITS | rank)) is not None:
                    offer(r, h << 2 * BITS | pair)
                    lower = r < rank
                if (b := ids[k]) >= 0 and (r := get(pair := rank << BITS | b)) is not None:
                    offer(r, i << 2 * BITS | pair)
                    lower |= r < rank
                if lower:  # a better pair has come up: it goes first, the rest of this bucket waits
                    for entry in entries[at + 1 :]:
                        offer(rank, entry)
                    break
        out, own = [], None
        i = 0
        while i < n:
            if ids[i] == -1:
                if own is not None:
                    out.append(own)
                own = []
            else:
                own.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> str:
        """Decimal token numbers joined by one space. What is new in the text goes through one queue."""
        pieces = self.split(text)
        new, old = self.new, self.old
        values = list(map(new.get, pieces))
        if None in values:
            bare: dict[str, bytes] = {}
            fresh: dict[str, str] = {}
            for p, v in zip(pieces, values):
                if v is None and p not in fresh:
                    v = old.get(p)
                    if v is not None:
                        fresh[p] = v
                    elif (whole := self.ranks.get(raw := p.encode())) is not None:
                        fresh[p] = str(whole)
                    else:
                        bare[p] = raw
            if bare:
                for p, ids in zip(bare, self.merged(list(bare.values()))):
                    fresh[p] = " ".join(map(str, ids))
            values = [fresh[p] if v is None else v for p, v in zip(pieces, values)]
            if len(new) + len(fresh) > PIECES_KEPT // 2:
                self.new, self.old = new, old = {}, new
            new.update(fresh if len(text) < KEPT_CHARS else {p: v for p, v in fresh.items() if len(p) <= KEPT_CHARS})
        return " ".join(values)

    def decode(self, ids: str) -> bytes:
        """The bytes of decimal token numbers joined by one space."""
        return b"".join(map(self.text.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal numbers joined by one space), decoded_sha256: one row per input row.

    A null text counts as empty: no tokens. Null keys stay null, repeated rows give repeated results, other columns
    are ignored, an empty table gives an empty one. Very long pre-tokens cost n log n at most in the queue.
    """
    ship(docs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        for frame in frames:
            rows = []
            for ids in map(bpe.encode, frame["t"]):
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(k=frame["k"])[["k", "n_tokens", "ids_sha256", "decoded_sha256"]]

    rows = spread(docs.select(docs[key].alias("k"), text_or_empty(text).alias("t")))
    return rows.mapInPandas(released(batches), f"k {key_type(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)

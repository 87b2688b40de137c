"""Context-tree weighting: the next byte as eight binary decisions, each with a tree over the bytes before it. A node mixes the
Krichevsky-Trofimov estimate of its own counts with its children's, half and half beforehand, so every depth counts.

The counts of all training texts are gathered by context, in parts of the tree; each block of documents asks each part for
its own contexts only and is scored where the answers meet it. No task and no driver holds the whole tree or the whole vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from newsloom.llm.work import in_arrow, materialize
from newsloom.session import spread

#: Bytes before the next one that the tree sees; with the next byte a gram is a 48-bit number, the latest context byte first.
DEPTH = 5
#: Depths below this one lie in one part of the tree whole; those above are at most 1 + 256 + 65,536 contexts of 255 decisions, whatever the corpus.
CUT = 3
#: Stands before a text and after it; no UTF-8 text holds this byte.
EDGE = b"\xff"
#: Text bytes of a block of documents; positions that are looked at together; grams that are merged together.
BLOCK_BYTES, SLICE, MERGED = 32 << 20, 1 << 19, 1 << 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U = np.uint64
PARTED = "kind string, block long, part int, payload binary"


# --- grams and words of texts --------------------------------------------------------------------------------------


def grams_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, place of its text in the list) of every byte of every text and of the texts' ends, slice by slice, ordered by both."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + DEPTH + 1
    data = np.frombuffer(b"".join([EDGE * DEPTH + t + EDGE for t in texts]), np.uint8)
    ends = np.cumsum(sizes)
    for first in range(DEPTH, len(data), SLICE):
        last = min(len(data), first + SLICE)
        keys = np.zeros(last - first, U)
        for back in (*range(1, DEPTH + 1), 0):
            keys = keys << U(8) | data[first - back : last - back]
        at = np.arange(first, last)
        owner = np.searchsorted(ends, at, "right")
        inside = at - (ends - sizes)[owner] >= DEPTH
        keys = np.sort(keys[inside] << U(16) | owner[inside].astype(U))
        yield keys >> U(16), (keys & U(0xFFFF)).astype(np.int64)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of the tree that a gram's latest CUT context bytes lie in."""
    return (((grams >> U(8 * (DEPTH + 1 - CUT))) * U(0x9E3779B97F4A7C15)) >> U(33)).astype(np.int64) % parts


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and a number (64 bits) for each."""
    steps = np.diff(keys, prepend=U(0))
    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (steps, n))
    return len(keys).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(pa.decompress(data[4:], 16 * size, codec="zstd", asbytes=True), np.uint8).reshape(2, 8, size)
    steps, n = (np.ascontiguousarray(x.T).reshape(-1) for x in raw)
    return np.cumsum(steps.view(U)), n.view(kind)


def words_packed(words: list[bytes], n: list[int]) -> bytes:
    raw = np.array(n, "<i8").tobytes() + b"\n".join(words)
    return len(n).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def words_unpacked(data: bytes) -> tuple[list[bytes], list[int]]:
    size = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[12:], int.from_bytes(data[4:12], "little"), codec="zstd", asbytes=True)
    return raw[8 * size :].split(b"\n"), np.frombuffer(raw[: 8 * size], "<i8").tolist()


class Merged:
    """Grams with their training counts, gathered with bounded overlap."""

    def __init__(self):
        self.keys, self.n, self.more = np.zeros(0, U), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.more.append((keys, n))
        if sum(len(k) for k, _ in self.more) > MERGED:
            self.whole()

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.more:
            self.keys, self.n = added(*map(np.concatenate, zip((self.keys, self.n), *self.more)))
            self.more = []
        return self.keys, self.n


# --- the tree --------------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    low = x.copy()
    for i in range(1, 8):
        low *= x + i
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov estimate of so many zeros and ones; 0 for none."""
    a, b = zeros.astype(float), ones.astype(float)
    return np.where(a + b > 0, log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi), 0.0)


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A node's weighted probability (logarithm), the weight of its own estimate, and that estimate of a one; below: the sum of its
    children's logarithms."""
    own = log_kt(zeros, ones)
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700))), (ones + 0.5) / (zeros + ones + 1)


class Level:
    """The nodes of one depth: for each of the eight decisions, sorted node keys (context, then the bits so far) and their counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n, self.nodes, self.of, self.zeros, self.ones = keys, n, [], [], [], []
        for k in range(8):
            node = keys >> U(8 - k)
            at = runs(node)
            one = (keys >> U(7 - k)) & U(1)
            ones = np.add.reduceat(n * one.astype(np.int64), at) if len(at) else n
            self.nodes.append(node[at])
            self.of.append(np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys)))))
            self.zeros.append((np.add.reduceat(n, at) if len(at) else n) - ones)
            self.ones.append(ones)


def without_last(node: np.ndarray, bits: int) -> np.ndarray:
    """The node a context byte shorter: the last byte before the `bits` low bits goes."""
    return node >> U(8 + bits) << U(bits) | node & U((1 << bits) - 1)


class Subtree:
    """The tree over grams (zero counts included) from depth DEPTH up to CUT."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys = keys
        self.levels, self.up = [Level(keys, n)], []
        for _ in range(CUT, DEPTH):
            shorter, place = np.unique(without_last(self.levels[-1].keys, 8), return_inverse=True)
            self.up.append(place)
            self.levels.append(Level(shorter, np.bincount(place, self.levels[-1].n, len(shorter)).astype(np.int64) if len(place) else n))
        self.logs: list[list[np.ndarray]] = [[log_kt(z, o) for z, o in zip(self.levels[0].zeros, self.levels[0].ones)]]
        self.mix: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for deep, level in zip(self.levels, self.levels[1:]):
            made = [weighted(level.zeros[k], level.ones[k], np.bincount(np.searchsorted(level.nodes[k], without_last(deep.nodes[k], k)), self.logs[-1][k], len(level.nodes[k]))) for k in range(8)]
            self.logs.append([m[0] for m in made])
            self.mix.append([m[1:] for m in made])

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of depth CUT - 1 (context * 256 + decision) with their counts and the sum of their children's logarithms in this part."""
        top, out = self.levels[-1], []
        for k in range(8):
            short = without_last(top.nodes[k], k)
            node = (short >> U(k)) << U(8) | U(1 << k) | short & U((1 << k) - 1)
            out.append((node.astype(np.int64), top.zeros[k], top.ones[k], self.logs[-1][k]))
        node, zeros, ones, logs = map(np.concatenate, zip(*out))
        keys, place = np.unique(node, return_inverse=True)
        total = lambda x: np.bincount(place, x, len(keys)) if len(place) else np.zeros(0)
        return keys, total(zeros).astype(np.int64), total(ones).astype(np.int64), total(logs)

    def log10s(self, tops: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its context; tops: keys, weights, estimates and counts of the depths
        CUT - 1 to 0. A decision that no training text met in a context says nothing: the mixture begins at the deepest one that is known."""
        total = np.zeros(len(self.keys))
        for k in range(8):
            one = (self.keys >> U(7 - k)) & U(1) > 0
            chosen = lambda p: np.where(one, p, 1 - p)
            at = self.levels[0].of[k]
            zeros, ones = self.levels[0].zeros[k][at], self.levels[0].ones[k][at]
            p, known, place = chosen((ones + 0.5) / (zeros + ones + 1)), zeros + ones > 0, np.arange(len(self.keys))
            for up, level, mix in zip(self.up, self.levels[1:], self.mix):
                place = up[place]
                at = level.of[k][place]
                weight = np.where(known, mix[k][0][at], 1)
                p = weight * chosen(mix[k][1][at]) + (1 - weight) * p
                known = level.zeros[k][at] + level.ones[k][at] > 0
            bits = (self.keys >> U(8 - k)) & U((1 << k) - 1) | U(1 << k)
            for depth, (keys, weights, estimate, count) in zip(range(CUT - 1, -1, -1), tops):
                at = np.searchsorted(keys, ((self.keys >> U(8 * (DEPTH + 1 - depth))) << U(8) | bits).astype(np.int64))
                weight = np.where(known, weights[at], 1)
                p = weight * chosen(estimate[at]) + (1 - weight) * p
                known = count[at] > 0
            total += np.log10(p)
        return total


def tops_of(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """keys (context * 256 + decision), weights, estimates and counts of the depths CUT - 1 to 0, from the whole counts of the first one."""
    out = []
    for depth in range(CUT - 1, -1, -1):
        logs, weight, estimate = weighted(zeros, ones, below)
        out.append((keys, weight, estimate, zeros + ones))
        if depth:
            short = keys >> 16 << 8 | keys & 255
            keys, place = np.unique(short, return_inverse=True)
            zeros, ones, below = (np.bincount(place, x, len(keys)) if len(place) else np.zeros(0) for x in (zeros, ones, logs))
    return out


# --- the jobs ----------------------------------------------------------------------------------------------------------


def blocks_of(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """kind, block, part, payload, written: documents as they lie, in blocks of BLOCK_BYTES, and each block's grams and words with
    their training counts, cut by part."""
    name = F.coalesce(docs[key].cast("string"), F.lit(""))
    rows = spread(docs.select(docs[key].alias("k"), (F.crc32(name.cast("binary")) % 7 == 2).alias("held"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("t")))
    size_most = BLOCK_BYTES

    def cut(block: int, grams: Merged, words: dict[bytes, int]) -> Iterator[tuple]:
        keys, n = grams.whole()
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order], part[order]
        at = runs(part)
        for i, j in zip(at, np.append(at[1:], len(part))):
            yield "gram", block, int(part[i]), packed(keys[i:j], n[i:j])
        own: dict[int, list[bytes]] = {}
        for w in sorted(words):
            own.setdefault(xxhash.xxh3_64_intdigest(w) % parts, []).append(w)
        for p, some in own.items():
            yield "word", block, p, words_packed(some, [words[w] for w in some])

    def framed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["kind", "block", "part", "payload"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, grams, words = TaskContext.get().partitionId() << 32, 0, Merged(), {}
        for b in batches:
            texts = [t.translate(LOWER) for t in b.column(2).to_pylist()]
            trained = ~b.column(1).to_numpy(zero_copy_only=False)
            for keys, owner in grams_of(texts):
                at = runs(keys)
                grams.add(keys[at], np.add.reduceat(trained[owner].astype(np.int64), at) if len(at) else at)
            for t, train in zip(texts, trained.tolist()):
                for w in [*t.split(), b""]:  # no word is empty: that one is the end
                    words[w] = words.get(w, 0) + train
            sink = pa.BufferOutputStream()
            whole = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["k", "held", "t"])
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(whole)
            yield framed([("text", block, None, sink.getvalue().to_pybytes())])
            size += sum(map(len, texts))
            if size >= size_most:
                yield framed(list(cut(block, grams, words)))
                block, size, grams, words = block + 1, 0, Merged(), {}
        yield framed(list(cut(block, grams, words)))

    return materialize(in_arrow(rows, blocked, PARTED), "blocks")


def columns_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def by_part(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    return rows.repartition(parts, "kind", "part").sortWithinPartitions("kind", "part", *order)


def totals(blocks: DataFrame, parts: int) -> DataFrame:
    """kind, part, payload, roots, tokens, types, written: what all blocks together hold of each part."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), group in groupby(columns_in(batches), lambda r: r[:2]):
            roots, tokens, types = None, 0, 0
            if kind == "gram":
                whole = Merged()
                for r in group:
                    whole.add(*unpacked(r[2]))
                payload = packed(*whole.whole())
                roots = b"".join(x.astype(t).tobytes() for x, t in zip(Subtree(*whole.whole()).roots(), ("<i8", "<i8", "<i8", "<f8")))
            else:
                count: dict[bytes, int] = {}
                for r in group:
                    for w, n in zip(*words_unpacked(r[2])):
                        count[w] = count.get(w, 0) + n
                payload = words_packed(list(count), list(count.values()))
                tokens, types = sum(count.values()), sum(n > 0 for n in count.values())
            arrays = [pa.array([x], t) for x, t in zip((kind, part, payload, roots, tokens, types), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "part", "payload", "roots", "tokens", "types"])

    asked = by_part(blocks.where("kind <> 'text'").select("kind", "part", "payload"), parts)
    return materialize(in_arrow(asked, summed, "kind string, part int, payload binary, roots binary, tokens long, types long", 64), "parts")


def tops(parts: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """The depths above CUT, added up over the parts: 65,536 * 255 nodes of the first of them at most."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (roots,) in columns_in(batches):
            size = len(roots) // 32
            arrays = [pa.array(np.frombuffer(roots, t, size, 8 * size * i)) for i, t in enumerate(("<i8", "<i8", "<i8", "<f8"))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "zeros", "ones", "below"])

    rows = in_arrow(parts.where("kind = 'gram'").select("roots"), nodes, "node long, zeros long, ones long, below double", 8)
    found = rows.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    order = np.argsort(found["node"].to_numpy())
    return tops_of(*(found[c].to_numpy()[order] for c in ("node", "zeros", "ones", "below")))


def answers(blocks: DataFrame, whole: DataFrame, shared, parts: int) -> DataFrame:
    """kind, block, payload: for each block's grams their log10 probabilities, for its words their training counts."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, _), group in groupby(columns_in(batches), lambda r: r[:2]):
            keys = values = count = None
            for _, _, block, payload in group:
                if block is None:  # the part's totals come first
                    if kind == "gram":
                        keys, n = unpacked(payload)
                        values = Subtree(keys, n).log10s(shared.value)
                    else:
                        count = dict(zip(*words_unpacked(payload)))
                    continue
                if kind == "gram":
                    own, _ = unpacked(payload)
                    out = packed(own, values[np.searchsorted(keys, own)])
                else:
                    own, _ = words_unpacked(payload)
                    out = words_packed(own, [count[w] for w in own])
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([block], pa.int64()), pa.array([out], pa.binary())], names=["kind", "block", "payload"])

    asks = blocks.where("kind <> 'text'").select("kind", "part", "block", "payload")
    rows = whole.select("kind", "part", F.lit(None).cast("long").alias("block"), "payload").union(asks)
    return in_arrow(by_part(rows, parts, "block"), answered, "kind string, block long, payload binary", 64)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row per input row.

    Learns from the rows whose crc32(key as text) mod 7 is not 2. score is log10 of the tree's probability of the whole text, A-Z in
    lower case, with its end; base_score that of its words and its end by smoothed frequencies. Contexts that no training text has
    say nothing: the mixture then begins at the longest known one. A null text counts as
    empty, a null key as an empty name and stays null; rows that repeat each other each count; other columns are ignored; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks_of(docs, key, text, parts)
    whole = totals(blocks, parts)
    n, types = (x or 0 for x in whole.agg(F.sum("tokens"), F.sum("types")).first())
    found = answers(blocks, whole, spark.sparkContext.broadcast(tops(whole)), parts)
    met = found.select("block", "kind", "payload").union(blocks.where("kind = 'text'").select("block", "kind", "payload"))
    met = met.repartition(parts, "block").sortWithinPartitions("block", F.col("kind") == "text")  # the answers come before the texts
    floor = -np.log10(n + types + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(columns_in(batches), lambda r: r[0]):
            grams: list[tuple[np.ndarray, np.ndarray]] = []
            count: dict[bytes, int] = {}
            for _, kind, payload in group:
                if kind == "gram":
                    grams.append(unpacked(payload, np.float64))
                elif kind == "word":
                    count |= zip(*words_unpacked(payload))
                else:
                    if len(grams) > 1:
                        keys, values = map(np.concatenate, zip(*grams))
                        order = np.argsort(keys)
                        grams = [(keys[order], values[order])]
                    yield rated(pa.ipc.open_stream(payload).read_next_batch(), *grams[0], count)

    def rated(b: pa.RecordBatch, keys: np.ndarray, values: np.ndarray, count: dict[bytes, int]) -> pa.RecordBatch:
        texts = b.column(2).to_pylist()
        score = np.zeros(len(texts))
        for own, owner in grams_of(texts):
            at = runs(own)
            each = np.repeat(values[np.searchsorted(keys, own[at])], np.diff(np.append(at, len(own))))
            score += np.bincount(owner, each, len(texts))
        tokens = [[*t.split(), b""] for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        c = np.fromiter((count[w] for own in tokens for w in own), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(tokens)), sizes)
        base = np.bincount(owner, np.log10(c + 1.0) + floor, len(tokens))
        known = np.bincount(owner, c > 0, len(tokens)).astype(np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        columns = [b.column(0), b.column(1), pa.array(sizes), pa.array(known), pa.array(np.full(len(texts), n, np.int64)), pa.array(base), pa.array(score), pa.array(-score * np.log2(10) / size)]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    fields = [StructField("k", docs.schema[key].dataType), StructField("held_out", BooleanType()), *[StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[StructField(c, DoubleType()) for c in ("base_score", "score", "bits_per_byte")]]
    return in_arrow(met, scored, StructType(fields), 64).withColumnRenamed("k", key)

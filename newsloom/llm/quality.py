"""Quality classifier: a byte-level convolutional network in numpy. Learned filters run over overlapping chunks that
cover the whole document; each chunk is max-pooled, and the pooled chunks are combined into one probability."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsloom.llm.work import key_type, released, text_or_empty
from newsloom.session import ship, spread

#: Filters, bytes under one filter, stride; bytes of a chunk and how far the next one starts.
FILTERS, KERNEL, STRIDE = 16, 6, 1
CHUNK, STEP = 256, 224
#: Training rows and their bytes at most (rows by hash of their key, as many of each label), epochs, batch, rate, decay.
TRAIN_ROWS, TRAIN_BYTES = 2000, 8 << 20
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.02, 1e-4
#: Small samples are gone through more often, for this many steps at least and this many epochs at most.
STEPS_LEAST, EPOCHS_MOST = 600, 60
ACCEPT = 0.7
#: Chunks in one numpy call.
CHUNKS_AT_ONCE = 512
OFFSETS = np.arange(0, CHUNK - KERNEL + 1, STRIDE)


@dataclass
class Network:
    """w: kernel x 256 x filters; c: filter biases; v: weights of the mean and the maximum over chunks; b: bias."""

    w: np.ndarray
    c: np.ndarray
    v: np.ndarray
    b: np.ndarray

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        w = rng.normal(0, 0.1, (KERNEL, 256, FILTERS)).astype(np.float32)
        return Network(w, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def pairs(self) -> np.ndarray:
        """The filters over two bytes at a time: kernel / 2 x 65536 x filters."""
        return np.stack([(self.w[i][:, None] + self.w[i + 1][None]).reshape(-1, FILTERS) for i in range(0, KERNEL, 2)])


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with padding, the start of each chunk, and each text's first chunk; a text has one chunk at least."""
    parts, starts, firsts, at = [], [], [], 0
    for t in texts:
        n = max(1, -(-(len(t) - CHUNK) // STEP) + 1)
        firsts.append(len(starts))
        starts += range(at, at + n * STEP, STEP)
        size = (n - 1) * STEP + CHUNK
        parts.append(t.ljust(size, b"\0"))
        at += size
        # the next text starts after this one's padding
    return np.frombuffer(b"".join(parts), np.uint8), np.array(starts, np.int64), np.array(firsts, np.int64)


def pooled(net: Network, tables: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest filter response in each chunk, not below 0, and where it is."""
    two = data[:-1].astype(np.int32) << 8 | data[1:]
    best, place = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int64)
    for first in range(0, len(starts), CHUNKS_AT_ONCE):
        at = starts[first : first + CHUNKS_AT_ONCE, None] + OFFSETS
        r = tables[0][two[at]]
        for i in range(1, KERNEL // 2):
            r += tables[i][two[at + 2 * i]]
        top = r.argmax(1)
        best[first : first + len(at)] = np.take_along_axis(r, top[:, None], 1)[:, 0]
        place[first : first + len(at)] = starts[first : first + CHUNKS_AT_ONCE, None] + OFFSETS[top]
    return np.maximum(best + net.c, 0), place


def pooled_only(net: Network, tables: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    two = data[:-1].astype(np.uint16) << 8 | data[1:]
    best = np.empty((len(starts), FILTERS), np.float32)
    for first in range(0, len(starts), CHUNKS_AT_ONCE):
        at = starts[first : first + CHUNKS_AT_ONCE, None] + OFFSETS
        r = tables[0][two[at]]
        for i in range(1, KERNEL // 2):
            r += tables[i][two[at + 2 * i]]
        best[first : first + len(at)] = r.max(1)
    return np.maximum(best + net.c, 0)


def combined(net: Network, chunks: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of label 1, the features (mean and maximum of the pooled chunks), chunks per text."""
    counts = np.diff(np.append(firsts, len(chunks)))
    x = np.hstack([np.add.reduceat(chunks, firsts) / counts[:, None], np.maximum.reduceat(chunks, firsts)])
    return 1 / (1 + np.exp(-np.clip(x @ net.v + net.b[0], -30, 30))), x, counts


def scores(net: Network, texts: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, starts, firsts = chunked(texts)
    return combined(net, pooled_only(net, net.pairs() if tables is None else tables, data, starts), firsts)[0].astype(np.float64)


def train(texts: list[bytes], labels: np.ndarray, prior: float = 0.5, seed: int = 5) -> Network:
    """Adam on the log loss, label 1 with the weight `prior` in all. The gradient of a maximum goes to where it was found."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    labels = labels.astype(np.float64)
    rate = np.clip(labels.mean(), 0.02, 0.98) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():  # nothing to tell apart: the share of label 1, smoothed
        net.v[:] = 0
        net.b[0] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        return net
    weight = np.where(labels == 1, prior / rate, (1 - prior) / (1 - rate))
    params = [net.w, net.c, net.v, net.b]
    m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    epochs = max(EPOCHS, min(EPOCHS_MOST, -(-STEPS_LEAST * BATCH // len(texts))))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate_now = RATE * (1 - epoch / epochs)
        for first in range(0, len(order), BATCH):
            at = order[first : first + BATCH]
            data, starts, firsts = chunked([texts[i] for i in at])
            chunks, place = pooled(net, net.pairs(), data, starts)
            p, x, counts = combined(net, chunks, firsts)
            d = ((p - labels[at]) * weight[at] / len(at)).astype(np.float32)
            owner = np.repeat(np.arange(len(at)), counts)
            is_max = chunks == x[owner, FILTERS:]
            g = d[owner, None] * (net.v[:FILTERS] / counts[owner, None] + net.v[FILTERS:] * is_max / np.maximum(np.add.reduceat(is_max, firsts)[owner], 1))
            g = (g * (chunks > 0)).astype(np.float32)
            gw = np.zeros_like(net.w)
            filters = np.broadcast_to(np.arange(FILTERS), g.shape)
            for i in range(KERNEL):
                np.add.at(gw[i], (data[place + i], filters), g)
            grads = [gw + DECAY * net.w, g.sum(0), x.T.astype(np.float32) @ d + DECAY * net.v, np.array([d.sum()])]
            t += 1
            for param, grad, a, b in zip(params, grads, m, s):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                param -= (rate_now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def held_out(key: Column) -> Column:
    """Rows from which no label is learnt."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """A network trained on at most TRAIN_ROWS labelled keys and TRAIN_BYTES bytes, whole texts each.

    Half of the keys at most have one label, those first by a hash of their key; the labels' shares among all rows weight
    them. Where a key has several texts, the one with the smallest hash stands for it. Texts are taken in the order of the
    hash until the bytes are used up; one text may have a quarter of them at most. Rows of held_out(), without key, with
    another label than 0 and 1 or with both take no part. Without any such row the network gives 0.5 to every text.
    """
    known = labels.select(labels[key].alias("k"), labels[label].alias("y")).where("k is not null and y in (0, 1)").where(~held_out(F.col("k")))
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    counts = dict(tuple(r) for r in known.groupBy("y").count().collect())
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    rank = F.xxhash64("k", F.lit("train"))
    chosen = known.where("y = 0").orderBy(rank).limit(TRAIN_ROWS // 2).union(known.where("y = 1").orderBy(rank).limit(TRAIN_ROWS // 2))
    # the sample is bounded, so it may be sent to all readers of the texts: one text a key, sizes first, then as many texts as fit
    body = docs.select(docs[key].alias("k"), text_or_empty(text).alias("t"))
    one = body.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.octet_length("t").alias("n"))).alias("s"), F.first("y").alias("y"))
    rows = [r for r in one.collect() if r["s"]["n"] <= TRAIN_BYTES // 4]  # TRAIN_ROWS rows at most
    listed = sorted((hash_of(r["k"]), r["k"], r["s"]["h"], r["s"]["n"], r["y"]) for r in rows)
    sizes = np.cumsum([x[3] for x in listed])
    taken = {x[1]: x for x in listed[: int(np.searchsorted(sizes, TRAIN_BYTES, "right"))]}
    if not taken:
        return train([], np.zeros(0), prior)
    wanted = docs.sparkSession.createDataFrame([(k, h) for k, (_, _, h, _, _) in taken.items()], f"k {key_type(docs, key)}, h long")
    found = body.withColumn("h", F.xxhash64("t")).join(F.broadcast(wanted), ["k", "h"]).groupBy("k").agg(F.min("t").alias("t")).collect()
    sample = sorted((taken[r["k"]], r["t"]) for r in found)
    return train([t.encode() for _, t in sample], np.array([x[4] for x, _ in sample]), prior)


def hash_of(key) -> int:
    import zlib

    return zlib.crc32(f"order {key}".encode())


def score_documents(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted: one row per input row; the score depends on the text alone.

    A null text counts as empty, which has a score like any other text. A null key is held out of nothing. Repeated
    rows get repeated results; other columns are ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = net.pairs()
        for f in frames:
            yield pd.DataFrame({"k": f["k"], "score": scores(net, [t.encode() for t in f["t"]], tables)})

    rows = spread(docs.select(docs[key].alias("k"), text_or_empty(text).alias("t"))).mapInPandas(released(batches), f"k {key_type(docs, key)}, score double")
    return rows.select(F.col("k").alias(key), F.coalesce(held_out(F.col("k")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def score_rows(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with column score (in place of one of that name, in letters of any case), from the text alone: a null text counts
    as empty; nulls elsewhere, repeated rows and other columns stay as they are; an empty table gives an empty one."""
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() != "score"]

    return docs.select(*columns).mapInArrow(released(with_scores(net, columns, text)), StructType([*docs.select(*columns).schema.fields, StructField("score", DoubleType())]))


def with_scores(net: Network, columns: list[str], text: str):
    import pyarrow as pa

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pairs()
        for part in parts:
            texts = [(t or "").encode() for t in part.column(columns.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(net, texts, tables))], names=[*columns, "score"])

    return batches

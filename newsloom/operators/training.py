"""A scorer that learns: logistic regression over hashed words and neighbours, by gradients that are added up over the rows. The best
checkpoint by held-out loss stays; its temperature comes from the grid."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.batches import in_arrow
from newsloom.operators import metrics
from newsloom.session import shared_dir, ship, spread

#: Features, steps at most, steps without a better held-out loss before it ends, rate, decay.
FEATURES, STEPS, PATIENCE, RATE, DECAY = 1 << 12, 60, 6, 0.5, 1e-4


#: Places of words' and pairs' features that a worker remembers; beyond, it begins anew.
REMEMBERED = 1 << 16
_of_word: dict[str, np.ndarray] = {}
_of_pair: dict[tuple[str, str], int] = {}


def place(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w) % FEATURES


def word_places(w: str) -> np.ndarray:
    """The features of a word and of its runs of three characters; its own comes first."""
    found = _of_word.get(w)
    if found is None:
        if len(_of_word) >= REMEMBERED:
            _of_word.clear()
        found = np.array([place(w), *(place(w[i : i + 3]) for i in range(len(w) - 2))], np.int16)
        if len(w) <= 64:
            _of_word[w] = found
    return found


def pair_place(pair: tuple[str, str]) -> int:
    found = _of_pair.get(pair)
    if found is None:
        if len(_of_pair) >= REMEMBERED:
            _of_pair.clear()
        found = place(" ".join(pair))
        if len(pair[0]) + len(pair[1]) <= 64:
            _of_pair[pair] = found
    return found


def features(text: str | None) -> np.ndarray:
    """The weight of each feature: words, neighbouring pairs and runs of three characters by hash, damped counts, of length one."""
    words = (text or "").lower().split()
    pairs = np.fromiter(map(pair_place, zip(words, words[1:])), np.int64, max(0, len(words) - 1))
    found = np.log1p(np.bincount(np.concatenate([pairs, *map(word_places, words)]), minlength=FEATURES))
    norm = np.sqrt(found @ found)
    return found / norm if norm else found


#: Texts and bytes of them whose features are counted together.
TEXTS, TEXT_BYTES = 128, 1 << 20


def runs_of_three(whole: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, feature) of each run of three characters without a blank; a run is hashed once however often it occurs."""
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(int(code.max(initial=0)) + 1, bool)
    seen[code] = True
    letters, a = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
    inside = code != 32
    at = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:])
    n = len(letters)
    key = (a[at] * n + a[at + 1]) * n + a[at + 2]
    if n**3 <= 1 << 22:
        some = np.zeros(n**3, bool)
        some[key] = True
        found, which = np.flatnonzero(some), np.cumsum(some)[key] - 1
    else:
        found, which = np.unique(key, return_inverse=True)
    name = [chr(c) for c in letters.tolist()]
    places = [place(name[k // (n * n)] + name[k // n % n] + name[k % n]) for k in found.tolist()]
    return at, np.array(places, np.int64)[which]


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, weight, number of the text) of all that isn't zero in features() of each text, by text and feature."""
    words = [(t or "").lower().split() for t in texts]
    count = [len(w) for w in words]
    hashes = [xxhash.xxh3_64_intdigest(x) for w in words for x in w]
    pairs = [xxhash.xxh3_64_intdigest(x) for w in words for x in map(" ".join, zip(w, w[1:]))]
    joined = [" ".join(w) for w in words]
    at, runs = runs_of_three(" ".join(joined))
    row = np.arange(len(texts))
    of_run = np.repeat(row, [len(j) + 1 for j in joined])[at]
    cells = [np.array(hashes, np.uint64).astype(np.int64) % FEATURES + np.repeat(row, count) * FEATURES, np.array(pairs, np.uint64).astype(np.int64) % FEATURES + np.repeat(row, [max(0, n - 1) for n in count]) * FEATURES, runs + of_run * FEATURES]
    counts = np.bincount(np.concatenate(cells), minlength=len(texts) * FEATURES)
    cell = np.flatnonzero(counts)
    x, own = np.log1p(counts[cell]), cell // FEATURES
    return cell % FEATURES, x / np.sqrt(np.bincount(own, x * x, len(texts)))[own], own


@dataclass
class Model:
    """weights (the last is the bias), the step they come from, its held-out loss, and the temperature."""

    weights: np.ndarray
    step: int
    loss: float
    temperature: float = 1.0

    def margin(self, text: str | None) -> float:
        return float(features(text) @ self.weights[:-1] + self.weights[-1])

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """margin() of each text."""
        at, x, own = features_of(texts)
        return np.bincount(own, x * self.weights[at], len(texts)) + self.weights[-1]

    def scorer(self) -> Callable:
        """For scoring.score_articles: two logits, and for each word how much it speaks for label 1."""
        t, words = self.temperature, self.weights

        def score(text: str) -> tuple[float, float, list[float]]:
            z = self.margin(text) / t
            return -z / 2, z / 2, [float(max(0.0, words[word_places(w)[0]])) for w in text.lower().split()]

        return score


def fitted(rows: DataFrame, text: str = "text", label: str = "label", split: str = "split", steps: int = STEPS) -> Model:
    """Learns from the rows whose split is `train`, stops by those whose split is `validation` (labels 0 and 1; other rows are left out).

    A step is one job: each task adds up the gradient of its rows, Spark adds up the tasks', and FEATURES + 1 numbers reach the
    driver. The same rows give the same model up to rounding, however they lie. Without rows of both labels the scores are even.
    """
    spark = rows.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/newsloom-training-{uuid.uuid4().hex}"
    chosen = spread(rows.where(F.col(label).isin(0, 1) & F.col(split).isin("train", "validation")).select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), (F.col(split) == "train").alias("train")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x, own = features_of(b.column(0).to_pylist())
            till = np.append(0, np.cumsum(np.bincount(own, minlength=b.num_rows)))
            packed = [pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((till * v.itemsize).astype("<i4")), pa.py_buffer(v)]) for v in (at.astype("<u2"), x.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([*packed, b.column(1), b.column(2)], names=["at", "x", "y", "train"])

    in_arrow(chosen, read, "at binary, x binary, y int, train boolean", TEXTS, TEXT_BYTES).write.parquet(path)
    table = spark.read.schema("at binary, x binary, y int, train boolean").parquet(path)
    share = {r["y"]: r["n"] for r in table.where("train").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights, squares, best = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8), None
    if len(share) < 2:
        return Model(weights, 0, float(np.log(2)))
    total = sum(share.values())
    balance = {y: total / (2 * n) for y, n in share.items()}
    for step in range(steps):
        sums = dict(added(table, weights, balance))
        loss = sums[-2] / max(1.0, sums[-3]) if sums.get(-3) else sums[-1] / total
        if best is None or loss < best.loss - 1e-5:
            best = Model(weights.copy(), step, loss)
        elif step - best.step >= PATIENCE:
            break
        gradient = np.array([sums.get(i, 0.0) for i in range(FEATURES + 1)]) / total + DECAY * np.append(weights[:-1], 0)
        squares += gradient**2
        weights = weights - RATE * gradient / np.sqrt(squares)
    best.temperature = temperature(table, best)
    return best


def held(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a column of binaries as they lie there, and how many each holds."""
    _, till, data = column.buffers()
    till = np.frombuffer(till, "<i4")[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, kind, (int(till[-1]) - int(till[0])) // size, int(till[0])) if data and till[-1] > till[0] else np.empty(0, kind)
    return values, np.diff(till) // size


def sparse(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, row) of all that a batch of rows (at, x, ..) holds."""
    at, sizes = held(b.column(0), "<u2")
    return at.astype(np.int64), held(b.column(1), "<f4")[0].astype(float), np.repeat(np.arange(len(sizes)), sizes)


def added(table: DataFrame, weights: np.ndarray, balance: dict[int, float]) -> list[tuple[int, float]]:
    """(feature, gradient), and under -1 and -2 the training and the held-out loss, under -3 the held-out weight."""
    shared = table.sparkSession.sparkContext.broadcast(weights)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, g, more = shared.value, np.zeros(FEATURES + 1), np.zeros(3)
        for b in batches:
            at, x, own = sparse(b)
            y, train = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            z = np.bincount(own, x * w[at], b.num_rows) + w[-1]
            weight = np.array([balance.get(v, 1.0) for v in y.tolist()])
            loss = weight * (np.logaddexp(0, z) - y * z)
            off = np.where(train, weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y), 0.0)
            g[:-1] += np.bincount(at, off[own] * x, FEATURES)
            g[-1] += off.sum()
            more += loss[train].sum(), loss[~train].sum(), weight[~train].sum()
        yield pa.RecordBatch.from_arrays([pa.array([*range(FEATURES + 1), -1, -2, -3]), pa.array(np.append(g, more))], names=["i", "g"])

    rows = in_arrow(table, summed, "i long, g double", TEXTS).groupBy("i").agg(F.sum("g").alias("g"))
    return [(r["i"], r["g"]) for r in rows.collect()]  # FEATURES + 4 rows


def temperature(table: DataFrame, model: Model) -> float:
    """The grid's best temperature on the held-out rows, or on all where none are held out."""
    shared = table.sparkSession.sparkContext.broadcast(model.weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            at, x, own = sparse(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.bincount(own, x * w[at], b.num_rows) + w[-1], pa.float64()), b.column(2)], names=["margin", "y"])

    apart = table.where("not train")
    some = table if apart.isEmpty() else apart
    return float(metrics.best_temperature(metrics.nll_grid(in_arrow(some, margins, "margin double, y int", TEXTS), "margin", "y")).first()["temperature"])

"""Embedding near-dedup: an exact metric range join. Pivots cut the unit sphere into cells; the triangle inequality says
which vectors near a boundary also go to a neighbouring cell; cells are joined on their own, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.components import components
from newsloom.llm.work import materialize, need_integral, released, within_bounds
from newsloom.session import ship

THRESHOLD = 0.95
#: Vectors per pivot aimed at, and pivots at most (all of them reach the driver).
CELL_ROWS, PIVOTS_MOST = 8192, 4096
#: Rows of a block: a vector goes to as many tasks as its cell has blocks, a task holds two blocks. They grow with the root of the number of vectors.
BLOCK_LEAST, BLOCK_MOST, BLOCK_GROWTH = 1024, 16384, 16
#: Rows compared at a time within a block.
STRIPE = 512


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def cells_of(u: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and (vector, cell) of its replicas.

    A vector x at home in q and any partner at home in p lie on two sides of the hyperplane between p and q, so x is
    within the radius of that hyperplane: (|x - p|^2 - |x - q|^2) / (2 |p - q|). A pair is joined in the cell of the
    smaller number, so x goes to smaller cells only.
    """
    apart = np.maximum(np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0)), 1e-12)
    homes, xs, cells = [], [], []
    for first in range(0, len(u), STRIPE):
        cosine = u[first : first + STRIPE] @ pivots.T
        home = cosine.argmax(1)
        margin = (cosine[np.arange(len(home)), home][:, None] - cosine) / apart[home]
        x, cell = np.nonzero((margin <= radius + 1e-9) & (np.arange(len(pivots)) < home[:, None]))
        homes.append(home)
        xs.append(x + first)
        cells.append(cell)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (homes, xs, cells))


def each_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for j below counts[i], for every i."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def linked_counts(ids: np.ndarray, v: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row: rows linked with it (weighted by n) among pairs left x right, and the least position reachable so.

    Single precision decides where it can't be wrong, double precision the rest; pairs aren't kept.
    """
    u64 = unit(v)
    u = u64.astype(np.float32)
    slack = (v.shape[1] + 16) * 1.2e-7
    raw = v.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    found, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    same = left is right
    for first in range(0, len(left), STRIPE):
        rows = left[first : first + STRIPE]
        others = right[first:] if same else right
        s = u[rows] @ u[others].T
        hit = s >= threshold - slack
        if same:  # each pair once: the upper triangle
            hit[:, : len(rows)] = np.triu(hit[:, : len(rows)], 1)
        a, b = np.nonzero(hit & (s < threshold + slack))
        if len(a):
            x, y = rows[a], others[b]
            exact = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y])
            hit[a, b] = exact >= threshold
        some = np.flatnonzero(hit.any(1))
        if len(some):
            found[rows[some]] += hit[some] @ n[others]
            found[others] += hit[some].T @ n[rows[some]]
            for i in some:
                group = np.append(others[hit[i]], rows[i])
                labels = np.unique(label[group])
                if len(labels) > 1:
                    label[np.isin(label, labels)] = labels[0]
    return found, label


@within_bounds(4096)
def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links (other rows with cosine >= threshold), component_id, kept: one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null
    key; their component is their key, and they are kept. Equal vectors are one vertex from the start. Vectors of
    different lengths aren't compared. Rows that share a key are one vertex of a component. Keys that are no integers are
    refused. Other columns are ignored; an empty table gives an empty one.
    """
    need_integral(vectors, key)
    ship(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, v in zip(f["id"], f["v"]):
                v = None if v is None or pd.isna(k) else np.asarray(v, dtype=np.float64).astype(kind)
                good = v is not None and len(v) and np.isfinite(v).all() and np.isfinite(w := float(np.dot(v.astype(np.float64), v.astype(np.float64)))) and w > 0
                out.append(v.tobytes() if good else None)
            yield pd.DataFrame({"id": f["id"].astype("Int64"), "v": out})

    rows = materialize(vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v")).mapInPandas(released(packed), "id long, v binary"), "vectors")
    good = rows.where("v is not null")
    distinct = materialize(good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct")
    results = None
    for (width,) in sorted(tuple(r) for r in distinct.select(F.octet_length("v").alias("w")).distinct().collect()):
        part = joined(distinct.where(F.octet_length("v") == width), kind, threshold)
        results = part if results is None else results.union(part)
    out = rows
    if results is not None:
        results = materialize(results, "links")
        edges = results.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        labels = components(edges)
        links = results.groupBy("id").agg(F.sum("links").alias("links"))
        each = distinct.join(links, "id", "left").join(labels, distinct.id == labels.vertex, "left")
        each = each.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", distinct.id).alias("component_id"))
        # copies of one vector may be a third of all rows: they are dealt over salts
        each = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(each, ["v", "salt"], "left")
    else:
        out = rows.withColumn("n_links", F.lit(0)).withColumn("component_id", F.col("id"))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(vectors.schema[key].dataType).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def joined(distinct: DataFrame, kind: str, threshold: float) -> DataFrame:
    """id, links, root: per distinct vector and pair of blocks, the rows linked with it and the smallest id reachable there."""
    radius = float(np.sqrt(2 - 2 * threshold))
    count = distinct.count()
    wanted = min(PIVOTS_MOST, max(1, -(-count // CELL_ROWS)))
    chosen = distinct.orderBy(F.xxhash64("v"), "v").limit(wanted).select("v").collect()  # PIVOTS_MOST at most
    pivots = unit(np.array([np.frombuffer(r["v"], kind) for r in chosen]))
    apart = [i for i in range(len(pivots)) if not i or (pivots[:i] @ pivots[i]).max() < 1 - 1e-9]
    pivots = pivots[apart]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            home, _, cell = cells_of(unit(np.frombuffer(b"".join(f["v"]), kind).reshape(len(f), -1)), pivots, radius)
            cells = range(len(pivots))
            yield pd.DataFrame({"cell": cells, "home": np.bincount(home, minlength=len(pivots)), "copies": np.bincount(cell, minlength=len(pivots))})

    sizes = distinct.select("v").mapInPandas(released(counted), "cell int, home long, copies long").groupBy("cell").agg(F.sum("home"), F.sum("copies")).collect()
    block = min(BLOCK_MOST, max(BLOCK_LEAST, int(BLOCK_GROWTH * count**0.5)))
    blocks = np.zeros((len(pivots), 2), np.int64)
    for cell, home, copies in sizes:
        blocks[cell] = -(-home // block), -(-copies // block)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.frombuffer(b"".join(f["v"]), kind).reshape(len(f), -1)
            home, x, cell = cells_of(unit(v), pivots, radius)
            ids = f["id"].to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            # a cell's own vectors meet its own blocks and the replicas' blocks; a replica meets the cell's own blocks
            nh, nc = blocks[home].T
            own = (spread % np.maximum(nh, 1).astype(np.uint64)).astype(np.int64)
            i, j = each_of(nh + nc)
            tasks = [np.column_stack([home[i], np.minimum(own[i], j), np.maximum(own[i], j), own[i]])]
            h, r = blocks[cell].T
            b = h + (spread[x] % np.maximum(r, 1).astype(np.uint64)).astype(np.int64)
            k, j = each_of(h)
            tasks.append(np.column_stack([cell[k], j, b[k], b[k]]))
            out = f.iloc[np.concatenate([i, x[k]])].reset_index(drop=True)
            out[["cell", "b1", "b2", "b"]] = np.concatenate(tasks).astype(np.int32)
            yield out[["cell", "b1", "b2", "b", "id", "n", "v"]]

    def compared(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        v = np.frombuffer(b"".join(f["v"]), kind).reshape(len(f), -1)
        ids, n, b = f["id"].to_numpy(), f["n"].to_numpy(np.int64), f["b"].to_numpy()
        b1, b2 = f["b1"].iloc[0], f["b2"].iloc[0]
        left = np.flatnonzero(b == b1)
        found, label = linked_counts(ids, v, n, left, left if b1 == b2 else np.flatnonzero(b == b2), threshold)
        at = np.flatnonzero(found)
        return pd.DataFrame({"id": ids[at], "links": found[at], "root": ids[label[at]]})

    tasks = distinct.select("id", "n", "v").mapInPandas(released(dealt), "cell int, b1 int, b2 int, b int, id long, n long, v binary")
    return tasks.groupBy("cell", "b1", "b2").applyInPandas(compared, "id long, links long, root long")

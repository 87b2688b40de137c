"""MinHash near-dedup by chosen-path set similarity join: independent trees branch documents by selected minwise
tokens, small nodes are compared exhaustively, links are confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.blocks import block_pairs
from newsloom.llm.components import components
from newsloom.llm.work import BROADCAST_ROWS, key_type, materialize, merged_if_large, need_integral, released, text_or_empty, within_bounds
from newsloom.session import ship, spread

SHINGLE = 5
#: Linked from this Jaccard similarity on, in hundredths.
PERCENT = 75
#: Minwise tokens of a set, and trees. A node keeps one token of its own choice, and a second one in SECOND of the
#: cases: 1 / 0.75 branches on average. A pair of similarity s stays together in one more level with odds that follow
#: p -> 1 - (1 - s p) (1 - s p / 3): at 0.75, twelve trees miss one pair in 9,000 at depth 4 and one in 260 at depth 8.
TOKENS, TREES, DEPTH = 128, 12, 4
SECOND = 1 / 3
#: Nodes with more members branch again, down to DEEPEST; what is still larger there is compared block by block.
NODE_MOST, DEEPEST = 2048, 8
#: Estimates below this are no candidates: four standard deviations under the threshold.
ESTIMATE = 0.60
#: Full sets of one block, when what links have left apart is compared once more.
SETS_AT_ONCE = 512
#: Links of one document that are confirmed in one place.
LINKS_AT_ONCE = 256
MASK = (1 << 64) - 1
#: Odd multipliers and masks from one generator with a fixed seed.
RNG = np.random.default_rng(75)
PLACE = RNG.integers(0, MASK, SHINGLE, np.uint64, endpoint=True) | np.uint64(1)
TIMES = RNG.integers(0, MASK, TOKENS, np.uint64, endpoint=True) | np.uint64(1)
FLIP = RNG.integers(0, MASK, TOKENS, np.uint64, endpoint=True)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's shingles of five words (of the whole sequence, if it is shorter).

    bytes.lower() and bytes.split() take A-Z and the six ASCII blanks, as asked.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    n = len(h) - SHINGLE + 1
    return np.unique(mixed(sum(h[i : i + n] * PLACE[i] for i in range(SHINGLE))))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least value of the set under each of TOKENS hash functions, cut to 16 bits."""
    least = np.full(TOKENS, MASK, np.uint64)
    for first in range(0, len(s), 512):
        least = np.minimum(least, ((s[first : first + 512, None] ^ FLIP) * TIMES).min(0))
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each token, sixteen tokens to a word: enough to estimate similarity."""
    low = (sig & 15).astype(np.uint64).reshape(len(sig), TOKENS // 16, 16)
    return (low << np.arange(0, 64, 4, dtype=np.uint64)).sum(2, dtype=np.uint64)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    x = many ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    agree = TOKENS - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1)
    return (agree / TOKENS - 1 / 16) / (15 / 16)  # unequal tokens agree in four bits once in sixteen


def branch(node: np.ndarray, member: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, member): the tokens that a node selects depend on the node alone; each child is named by node, token and value."""
    r = mixed(node)
    first = (r % np.uint64(TOKENS)).astype(np.int64)
    also = np.flatnonzero((r >> np.uint64(32)) < np.uint64(int(SECOND * 2**32)))
    second = (mixed(r[also]) % np.uint64(TOKENS)).astype(np.int64)
    fresh = second != first[also]
    also, second = also[fresh], second[fresh]
    node, member, token = np.concatenate([node, node[also]]), np.concatenate([member, member[also]]), np.concatenate([first, second])
    value = sig[member, token].astype(np.uint64) | token.astype(np.uint64) << np.uint64(16)
    return mixed(node * np.uint64(0x9E3779B97F4A7C15) + value + np.uint64(1)), member


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_shingles, s1, s2 (128-bit hash of the set), sig (minwise tokens; null for an empty set): one row per input row."""
    ship(docs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t in f["t"]:
                s = shingles(t)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((len(s), (d >> 64) - (1 << 63), (d & MASK) - (1 << 63), minwise(s).tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=["n_shingles", "s1", "s2", "sig"]).assign(id=f["id"])[["id", "n_shingles", "s1", "s2", "sig"]]

    rows = spread(docs.select(docs[key].alias("id"), text_or_empty(text).alias("t")))
    return rows.mapInPandas(released(batches), f"id {key_type(docs, key)}, n_shingles long, s1 long, s2 long, sig binary")


def tree_nodes(sets: DataFrame) -> DataFrame:
    """node, id: where the sets (id, sig) stand at depth DEPTH of every tree."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sig = np.frombuffer(b"".join(f["sig"]), np.uint16).reshape(-1, TOKENS)
            ids = f["id"].to_numpy()
            for tree in range(TREES):
                member = np.arange(len(ids))
                node = np.full(len(ids), mixed(np.array([tree + 1], np.uint64))[0])
                for _ in range(DEPTH):
                    node, member = branch(node, member, sig)
                yield pd.DataFrame({"node": node.view(np.int64), "id": ids[member]})

    return sets.select("id", "sig").mapInPandas(released(batches), "node long, id long")


def deeper(members: DataFrame, sets: DataFrame) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sig = np.frombuffer(b"".join(f["sig"]), np.uint16).reshape(-1, TOKENS)
            node, member = branch(f["node"].to_numpy().view(np.uint64), np.arange(len(f)), sig)
            yield pd.DataFrame({"node": node.view(np.int64), "id": f["id"].to_numpy()[member]})

    return members.join(sets, "id").select("node", "id", "sig").mapInPandas(released(batches), "node long, id long")


def small_nodes(sets: DataFrame) -> DataFrame:
    """node, id: members of the nodes to compare. Nodes of more than NODE_MOST sets branch again until DEEPEST."""
    nodes, done = materialize(tree_nodes(sets), "nodes"), []
    for depth in range(DEPTH, DEEPEST + 1):
        # written, so that adaptive execution can split the semi-joins where one node's rows make a partition too large
        sizes = materialize(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("g")).where("g > 1"), "node-sizes")
        if depth == DEEPEST or sizes.agg(F.max("g")).first()[0] is None or sizes.where(F.col("g") > NODE_MOST).isEmpty():
            done.append(nodes)
            break
        sizes = merged_if_large(sizes)
        done.append(nodes.join(sizes.where(F.col("g") <= NODE_MOST), "node", "left_semi"))
        nodes = materialize(deeper(nodes.join(sizes.where(F.col("g") > NODE_MOST), "node", "left_semi"), sets), "nodes")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[int]:
    """Positions of the pairs (a, b) that join different trees when taken in this order."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in order:
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            parent[x] = y
            out.append(int(i))
    return out


def by_group(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work(frame) -> (a, b) for the rows of each group of keys; groups are small, so many share one Python call."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship(rows.sparkSession)

    def framed(found: list) -> pd.DataFrame:
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []  # of the last group, which may go on in the next batch
        for f in frames:
            own = f[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), len(f)]
            found = []
            for i, j in zip(cuts, cuts[1:]):
                if parts and (parts[-1][keys].iloc[-1].to_numpy() != own[i]).any():
                    found.append(work(pd.concat(parts, ignore_index=True)))
                    parts = []
                parts.append(f.iloc[i:j])
            yield framed(found)
        if parts:
            yield framed([work(pd.concat(parts, ignore_index=True))])

    return rows.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInPandas(released(batches), schema)


def candidates(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: likely pairs of sets that share a node: those of one hub, the member most alike to the others, and a spanning
    forest, the likeliest first. So two pairs per member at most, and what is likely connected stays connected."""
    rows = block_pairs(members, ["node"], "id", NODE_MOST).join(sets.select("id", "sig4"), "id").select("node", "b1", "b2", "b", "id", "sig4")

    def work(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, own = f["id"].to_numpy(), f["b"].to_numpy()
        sig = np.frombuffer(b"".join(f["sig4"]), np.uint64).reshape(len(f), -1)
        b1, b2 = f["b1"].iloc[0], f["b2"].iloc[0]
        right = np.flatnonzero(own == b2)
        found = []
        for x in np.flatnonzero(own == b1):
            y = right[right > x] if b1 == b2 else right
            e = estimates(sig[x], sig[y])
            y, e = y[e >= ESTIMATE], e[e >= ESTIMATE]
            found.append((np.full(len(y), x), y, e))
        if not found:
            return ids[:0], ids[:0]
        a, b, e = map(np.concatenate, zip(*found))
        hub = (np.bincount(a, e, len(f)) + np.bincount(b, e, len(f))).argmax()
        take = np.union1d(forest(len(f), a, b, np.argsort(-e, kind="stable")), np.flatnonzero((a == hub) | (b == hub))).astype(np.int64)
        return ids[a[take]], ids[b[take]]

    return by_group(rows, ["node", "b1", "b2"], work, "a long, b long").distinct()


def left_apart(clusters: DataFrame, labels: DataFrame, sets: DataFrame, full: DataFrame) -> DataFrame:
    """a, b: links between different components (labels) within a cluster of likely pairs (clusters), on full sets.

    Sets outside a block's largest component meet all the others of the block pair; links found on the way join
    components, so no more links come out than sets went in, and pairs are never rows.
    """
    c = F.coalesce(labels.component, F.col("id"))
    clusters, labels = merged_if_large(clusters), merged_if_large(labels)
    rows = full.select("id").join(clusters, full.id == clusters.vertex, "left").select("id", F.coalesce("component", "id").alias("cluster"))
    rows = rows.join(labels, rows.id == labels.vertex, "left").select("id", "cluster", c.alias("c"))
    several = materialize(rows.groupBy("cluster").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("cluster"), "several")
    rows = materialize(rows.join(merged_if_large(several), "cluster", "left_semi"), "apart")
    rows = block_pairs(rows, ["cluster"], "id", SETS_AT_ONCE).join(sets.select("id", "sig4"), "id").join(full, "id").select("cluster", "b1", "b2", "b", "id", "c", "sig4", "s")

    def work(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, own = f["id"].to_numpy(), f["b"].to_numpy()
        group = np.unique(f["c"].to_numpy(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(f["sig4"]), np.uint64).reshape(len(f), -1)
        sizes = np.array([len(x) // 8 for x in f["s"]])
        starts = np.append(0, np.cumsum(sizes))
        words, code = np.unique(np.frombuffer(b"".join(f["s"]), np.uint64), return_inverse=True)
        here = np.zeros(len(words), bool)
        b1, b2 = f["b1"].iloc[0], f["b2"].iloc[0]
        largest = np.bincount(group).argmax()
        a, b = [], []
        for x in np.flatnonzero(group != largest):
            y = np.flatnonzero((group != group[x]) & ((own != own[x]) if b1 != b2 else True))
            y = y[estimates(sig[x], sig[y]) >= ESTIMATE]
            if not len(y):
                continue
            here[code[starts[x] : starts[x + 1]]] = True
            for i in y:
                if group[i] != group[x]:
                    shared = int(np.count_nonzero(here[code[starts[i] : starts[i + 1]]]))
                    if 100 * shared >= PERCENT * (sizes[x] + sizes[i] - shared):
                        a.append(ids[x])
                        b.append(ids[i])
                        group[group == group[i]] = group[x]
            here[code[starts[x] : starts[x + 1]]] = False
        return np.array(a, np.int64), np.array(b, np.int64)

    return by_group(rows, ["cluster", "b1", "b2"], work, "a long, b long")


def full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """id, s: the full shingle sets (as bytes) of the documents whose ids are wanted."""
    rows = docs.select(docs[key].alias("id"), text_or_empty(text).alias("t"))
    many = wanted.count()
    side = F.broadcast(wanted) if many <= BROADCAST_ROWS else merged_if_large(wanted, many)
    ship(docs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "s": [shingles(t).tobytes() for t in f["t"]]})

    return rows.join(side, "id", "left_semi").mapInPandas(released(batches), "id long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets are similar enough. A document with many pairs is dealt out in lots of LINKS_AT_ONCE."""
    # written, so that adaptive execution can split the joins where a hub's pairs make a partition too large
    degree = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("g")), "degree")
    degree = merged_if_large(degree)
    both = pairs.join(degree.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(degree.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    # x is the end with more pairs: its set is sent once per lot, the other's once per pair
    turned = both.select(F.when(F.col("ga") >= F.col("gb"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("ga") >= F.col("gb"), F.col("b")).otherwise(F.col("a")).alias("y"), F.ceil(F.greatest("ga", "gb") / F.lit(LINKS_AT_ONCE)).cast("int").alias("lots"))
    turned = turned.withColumn("lot", F.pmod(F.xxhash64("y"), F.col("lots")).cast("int"))
    heads = turned.select("x", "lot").distinct().join(sets, F.col("x") == sets.id).select("x", "lot", F.lit(None).cast("long").alias("y"), "s")
    rows = heads.union(turned.join(sets, turned.y == sets.id).select("x", "lot", "y", "s"))
    partitions = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(partitions, "x", "lot").sortWithinPartitions("x", "lot", F.col("y").asc_nulls_first())
    ship(pairs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for f in frames:
            out = []
            for x, y, s in zip(f["x"], f["y"], f["s"]):
                s = np.frombuffer(s, np.uint64)
                if pd.isna(y):
                    head = s
                    continue
                shared = len(np.intersect1d(head, s, assume_unique=True))
                if 100 * shared >= PERCENT * (len(head) + len(s) - shared):
                    out.append((x, int(y)))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.mapInPandas(released(batches), "a long, b long")


@within_bounds()
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """key, n_shingles, component_id, kept: one row per input row.

    Equal sets are one vertex from the start, so exact copies cost one row each. Likely pairs of the others come from
    the nodes of the trees, a hub's and a spanning forest's per node, and are confirmed on full sets. What these links
    leave apart within a cluster of likely pairs is then compared outright, so a link that no such pair stands for is
    found too. A null text counts as empty; an empty set links with nothing and is its own component.
    A null key has no component and is kept. Rows that share a key are one vertex. Keys that are no integers are refused.
    Other columns are ignored; an empty table gives an empty one.
    """
    need_integral(docs, key)
    rows = materialize(signatures(docs, key, text), "signatures")
    linked = rows.where("n_shingles > 0 and id is not null").select("s1", "s2", F.col("id").cast("long").alias("id"), "sig")
    sets = linked.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.min("sig").alias("sig"))

    def shortened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sig = np.frombuffer(b"".join(f["sig"]), np.uint16).reshape(-1, TOKENS)
            yield f.assign(sig4=[x.tobytes() for x in nibbles(sig)])

    sets = materialize(sets.mapInPandas(released(shortened), "s1 long, s2 long, id long, sig binary, sig4 binary"), "sets")
    pairs = materialize(candidates(small_nodes(sets), sets), "pairs")
    # whoever has a likely partner is in a hub's or a forest's pair: from here on, only their sets count
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    full = materialize(full_sets(docs, key, text, wanted).dropDuplicates(["id"]), "full")
    links = materialize(confirmed(pairs, full), "links")
    labels = components(links)
    more = materialize(left_apart(components(pairs), labels, sets, full), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    # a component may span many sets, and a set many documents: documents are dealt over the salts of their set
    labels = merged_if_large(labels)
    found = sets.join(labels, sets.id == labels.vertex, "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.drop("sig").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    joined = salted.join(found, ["s1", "s2", "salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", F.col("id").cast("long")))
    return joined.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

"""Ranked lexical search: postings in shards of documents, in compressed rows (a row per term) with integer impacts computed
beforehand. A query adds its terms one at a time to a dense accumulator of each shard; the shards' best are merged."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.work import in_arrow, materialize, need_integral
from newsloom.session import spread

TOP = 20
#: Rows and bytes of text of a shard; a longer text is a shard of its own.
SHARD_ROWS, SHARD_BYTES = 8192, 8 << 20
#: Queries are answered in blocks of about this many different terms of items: what is broadcast at once.
TERMS_AT_ONCE = 200_000
#: Bytes of a text in UTF-8: letters and digits of ASCII in lower case and all else that isn't ASCII stay, the rest is a blank.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
SHARD = "ids binary, nulls binary, terms binary, starts binary, docs binary, impacts binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case; null has none."""
    return text.translate(FOLD).split() if text else []


def postings(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, where each one's postings start (and the last ends), the documents of all postings (ascending within a term), how
    often each holds the term, and each document's number of terms."""
    each = [terms_of(t) for t in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    code = {term: i for i, term in enumerate(dict.fromkeys(chain.from_iterable(each)))}
    flat = np.fromiter(map(code.__getitem__, chain.from_iterable(each)), np.int64, int(sizes.sum()))
    keys, times = np.unique(flat * len(each) + np.repeat(np.arange(len(each)), sizes), return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(code) + 1) * len(each))
    return list(code), starts, keys % max(len(each), 1), times, sizes


def impact(times: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that stands `times` times in a document of `sizes` terms is worth before its weight; 64-bit integers, except
    for the product of three counts, which may pass them and is exact in Python's."""
    most = int(sizes.max()) if len(sizes) else 0
    scaled = 25 * n_docs * sizes // n_terms if 25 * n_docs * most < 1 << 63 else np.array([25 * n_docs * int(n) // n_terms for n in sizes], np.int64)
    return 1_000_000_000 * times // (1000 * times + 12 * (75 + scaled))


@dataclass
class Index:
    """shards: written rows of SHARD; lexicon: written rows (term, df); n_docs: documents with a term; n_terms: all their terms."""

    shards: DataFrame
    lexicon: DataFrame
    n_docs: int
    n_terms: int
    key_type: str


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents: one pass for the counts that a weight or an impact needs, one that writes the shards.

    Documents stay where they are: a shard holds what one piece of a partition brings, and no row moves. Only counts of terms are
    shuffled, added up per piece and per task before. A null text has no terms; a document without terms is in no count and never
    found. Rows that share a key are found one by one; a null key is kept. Keys that are no integers are refused.
    """
    need_integral(docs, key)
    rows = spread(docs.select(docs[key].cast("long").alias("k"), docs[text].cast("binary").alias("t")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, starts, _, _, sizes = postings(b.column(1).to_pylist())
            found = [b"", *terms]  # no term is empty: that row holds the numbers of documents and of their terms
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array([int(np.count_nonzero(sizes)), *np.diff(starts).tolist()], pa.int64()), pa.array([int(sizes.sum()), *[0] * len(terms)], pa.int64())], names=["term", "df", "total"])

    counts = in_arrow(rows, counted, "term string, df long, total long", SHARD_ROWS, SHARD_BYTES).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    lexicon = materialize(counts, "lexicon")
    n_docs, n_terms = lexicon.where("term = ''").agg(F.sum("df"), F.sum("total")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, starts, at, times, sizes = postings(b.column(1).to_pylist())
            if not terms:
                continue
            ids = b.column(0)
            worth = impact(times, sizes[at], n_docs, n_terms).astype("<i4")  # below a million
            row = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False), b"\n".join(terms), starts.astype("<i4"), at.astype("<i4"), worth]
            yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in row], names=["ids", "nulls", "terms", "starts", "docs", "impacts"])

    shards = materialize(in_arrow(rows, indexed, SHARD, SHARD_ROWS, SHARD_BYTES), "shards")
    return Index(shards, lexicon.where("term <> ''").select("term", "df"), n_docs, n_terms, docs.schema[key].dataType.simpleString())


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best(scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` greatest positive scores; equal ones by id, null ones last. What ties with the last place is
    kept until the ids decide."""
    at = np.flatnonzero(scores > 0)
    if len(at) > most:
        own = scores[at]
        at = at[own >= own[np.argpartition(-own, most - 1)[most - 1]]]
    return at[np.lexsort((ids[at], nulls[at], -scores[at]))[:most]]


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", most: int = TOP) -> DataFrame:
    """key, rank, doc_id, score: the `most` best documents of every item, fewer if fewer score above 0.

    Items are answered in blocks that a broadcast holds; each block meets every shard where it lies, a task keeps the best of
    all its shards, and the tasks' best are merged. A null or empty item, and one without known terms, finds nothing; items that
    share a key are answered one by one, under that key; a null key is kept; other columns are ignored; an empty table gives an empty one.
    """
    spark = items.sparkSession
    asked = materialize(items.select(F.monotonically_increasing_id().alias("q"), items[key].alias("item"), items[text].cast("binary").alias("t")), "items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, term.decode(), n) for q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for term, n in Counter(terms_of(t)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["q", "term", "times"])

    wanted = materialize(in_arrow(asked.select("q", "t"), terms, "q long, term string, times long").join(index.lexicon, "term"), "item-terms")
    blocks = max(1, -(-wanted.count() // TERMS_AT_ONCE))
    number = F.pmod(F.xxhash64("q"), F.lit(blocks))
    found = None
    for block in range(blocks):
        asks: dict[int, list[tuple[bytes, int]]] = {}
        for r in wanted.where(number == block).toLocalIterator():
            asks.setdefault(r["q"], []).append((r["term"].encode(), r["times"] * weight(r["df"], index.n_docs)))
        part = answered(index.shards, spark.sparkContext.broadcast(asks), most)
        part = part if blocks == 1 else materialize(part, "found")
        found = part if found is None else found.union(part)
    first = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    return ranked.join(asked.select("q", "item"), "q").select(F.col("item").alias(key), "rank", F.col("doc_id").cast(index.key_type).alias("doc_id"), "score")


def answered(shards: DataFrame, shared, most: int) -> DataFrame:
    """q, doc_id, score: the best of each task's shards for the queries that `shared` holds (q -> terms and their weights)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, kept = shared.value, {}
        for b in batches:
            for ids, nulls, terms, starts, docs, impacts in zip(*(c.to_pylist() for c in b.columns)):
                ids, nulls, starts, docs = np.frombuffer(ids, "<i8"), np.frombuffer(nulls, bool), np.frombuffer(starts, "<i4"), np.frombuffer(docs, "<i4")
                impacts = np.frombuffer(impacts, "<i4").astype(np.int64)
                place = {t: i for i, t in enumerate(terms.split(b"\n"))}
                for q, pairs in asks.items():
                    scores = np.zeros(len(ids), np.int64)
                    for term, w in pairs:
                        if (i := place.get(term)) is not None:
                            own = slice(starts[i], starts[i + 1])
                            scores[docs[own]] += w * impacts[own]  # a document stands once in a term's row
                    at = best(scores, nulls, ids, most)
                    if len(at):
                        own = scores[at], nulls[at], ids[at]
                        own = tuple(map(np.concatenate, zip(kept[q], own))) if q in kept else own
                        at = best(*own, most)
                        kept[q] = tuple(x[at] for x in own)
        if kept:
            scores, nulls, ids = map(np.concatenate, zip(*kept.values()))
            q = np.repeat(np.fromiter(kept, np.int64, len(kept)), [len(x[0]) for x in kept.values()])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=nulls), pa.array(scores)], names=["q", "doc_id", "score"])

    return in_arrow(shards, scored, "q long, doc_id long, score long", 1)


def ranked_documents(docs: DataFrame, items: DataFrame, most: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: build_index() over docs, then search() for items."""
    return search(build_index(docs), items, most=most)


ORACLE_SQL = r"""
WITH fold AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
     words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM fold),
     tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
     size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
     total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
     asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     ask AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
     hit AS (SELECT item_id, doc_id, times * CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS s
             FROM ask JOIN df USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total),
     scored AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM hit GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored
QUALIFY rank <= 20
"""

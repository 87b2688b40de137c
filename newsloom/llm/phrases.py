"""Collocations: contiguous phrases grown from the left, prefix by prefix. Words and pairs are counted first; then the
occurrences of every frequent pair are projected to what follows them, dealt out by pair, and extended to the right depth-first."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.work import in_arrow, materialize
from newsloom.session import spread

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text whose words are counted at once.
TEXT_BYTES = 8 << 20
#: Occurrences that one task extends at once. Pairs with more (PAIRS_SPLIT of them at most, whatever the corpus) are dealt over several.
GROUP_ROWS, PAIRS_SPLIT = 50_000, 65_536
#: The filters of frequent words and pairs have 2**FILTER_BITS bits, whatever the corpus: once full they let more through, never less.
FILTER_BITS = 26
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: A-Z in lower case; a tab is a blank; marks and line ends part pieces.
FOLD = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 10))
COUNTED = "lang string, phrase string, n long"


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words, after b"\\n" for a piece's end, and all words of all texts by their place in that list."""
    words = list(filter(None, b"\n".join(texts).translate(FOLD).replace(b"\n", b" \n ").split(b" ")))
    code = {w: i for i, w in enumerate(dict.fromkeys([b"\n", *words]))}
    return list(code), np.fromiter(map(code.__getitem__, words), np.int64, len(words))


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found.setdefault(lang, []).append(text)
    yield from found.items()


def hashes_of(lang: str, words: list[bytes]) -> np.ndarray:
    own = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, own) for w in words), np.uint64, len(words))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbours from theirs."""
    return a * ODD[0] + (b ^ (b >> np.uint64(29))) * ODD[1]


def bits_of(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places in a filter of 2**size bits."""
    h = h ^ (h >> np.uint64(32))
    for odd in ODD:
        yield (h * odd) >> np.uint64(64 - size)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for x in bits_of(h, 5 + len(bits).bit_length()):
        found &= (bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) > 0
    return found


def filter_of(phrases: DataFrame) -> np.ndarray:
    """The bits of the words or pairs in phrases (lang, phrase): set in tasks, joined by slot; 2**(FILTER_BITS - 6) numbers reach the driver at most."""
    size = FILTER_BITS

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.zeros(0, np.uint64)]
            for lang, texts in by_lang(b):
                words = [t.split(b" ") for t in texts]
                for n in (1, 2):
                    own = [w for w in words if len(w) == n]
                    h = [hashes_of(lang, [w[i] for w in own]) for i in range(n)]
                    parts += bits_of(h[0] if n == 1 else paired(*h), size)
            x = np.unique(np.concatenate(parts))
            slots, at = np.unique(x >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (x & np.uint64(63)), at) if len(at) else at.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    rows = in_arrow(phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")), marked, "slot long, bits long", 1 << 16)
    found = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def framed(columns: list[tuple], fields: str) -> pa.RecordBatch:
    """A batch of parts, each a lang and a list (of bytes or numbers) for every other column."""
    kinds = [f.split() for f in fields.split(", ")]
    arrays = [pa.array([lang for lang, own, *_ in columns for _ in range(len(own))], pa.string())]
    for i, (_, kind) in enumerate(kinds[1:], 1):
        whole = [x for part in columns for x in part[i]]
        arrays.append(pa.array(whole, pa.int64()) if kind == "long" else pa.array(whole, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in kinds])


def summed(rows: DataFrame, least: int) -> DataFrame:
    """Counts added up by phrase; those below `least` go, but for the rows without words, which hold a lang's total."""
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(f"n >= {int(least)} or phrase = ''")


def word_counts(rows: DataFrame) -> DataFrame:
    """The counts of words, and under the phrase '' the number of all words of each lang; one row per piece of a partition and word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for lang, texts in by_lang(b):
                words, ids = coded(texts)
                n = np.bincount(ids, minlength=len(words)).tolist()
                out.append((lang, [b"", *words[1:]], [sum(n[1:]), *n[1:]]))
            yield framed(out, COUNTED)

    return in_arrow(rows, counted, COUNTED, 1 << 20, TEXT_BYTES)


def pair_counts(rows: DataFrame, shared) -> DataFrame:
    """The counts of neighbours that both are frequent words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for lang, texts in by_lang(b):
                words, ids = coded(texts)
                good = has(shared.value, hashes_of(lang, words))
                good[0] = False
                at = np.flatnonzero(good[ids[:-1]] & good[ids[1:]])
                keys, n = np.unique(ids[at] * len(words) + ids[at + 1], return_counts=True)
                a, b2 = (keys // len(words)).tolist(), (keys % len(words)).tolist()
                out.append((lang, [words[x] + b" " + words[y] for x, y in zip(a, b2)], n.tolist()))
            yield framed(out, COUNTED)

    return in_arrow(rows, counted, COUNTED, 1 << 20, TEXT_BYTES)


PROJECTED = "lang string, prefix string, rest string, n long"


def projections(rows: DataFrame, shared) -> DataFrame:
    """lang, prefix (a frequent pair), rest (the one to three words that follow an occurrence, as far as neighbours are frequent pairs), n: equal ones of a piece once."""

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for lang, texts in by_lang(b):
                words, ids = coded(texts)
                h = hashes_of(lang, words)
                link = np.zeros(len(ids) + LONGEST, bool)
                inside = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                link[inside] = has(shared.value, paired(h[ids[inside]], h[ids[inside + 1]]))
                at = np.flatnonzero(link[:-1] & link[1:])
                runs = np.zeros((len(at), LONGEST), np.int64)
                runs[:, :3] = ids[at[:, None] + np.arange(3)]
                more = np.ones(len(at), bool)
                for i in range(3, LONGEST):
                    more &= link[at + i - 1]
                    runs[more, i] = ids[at[more] + i]
                if len(runs):
                    order = np.lexsort(runs.T)
                    runs = runs[order]
                    first = np.flatnonzero(np.append(True, (runs[1:] != runs[:-1]).any(1)))
                    n = np.diff(np.append(first, len(runs)))
                    each = runs[first].tolist()
                    out.append((lang, [words[r[0]] + b" " + words[r[1]] for r in each], [b" ".join([words[x] for x in r[2:] if x]) for r in each], n.tolist()))
            yield framed(out, PROJECTED)

    return in_arrow(rows, projected, PROJECTED, 1 << 20, TEXT_BYTES)


def extended(prefix: bytes, flat: np.ndarray, words: list[bytes], at: np.ndarray, ends: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[bytes, int]]:
    """(phrase, count) of every phrase with `least` occurrences that continues the prefix, depth-first. `at` points at the next
    word of each occurrence in flat, `ends` behind its last one; n says how often each occurrence stands."""
    live = np.flatnonzero(at < ends)
    if not len(live):
        return
    nexts = flat[at[live]]
    order = np.argsort(nexts, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(nexts[order]) > 0))
    totals = np.add.reduceat(n[live[order]], cuts)
    for i in np.flatnonzero(totals >= least).tolist():
        own = live[order[cuts[i] : cuts[i + 1] if i + 1 < len(cuts) else None]]
        phrase = prefix + b" " + words[flat[at[own[0]]]]
        yield phrase, int(totals[i])
        yield from extended(phrase, flat, words, at[own] + 1, ends[own], n[own], least)


def grown(projected: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n: phrases of three words and more. A task for each prefix; one with so many occurrences that they don't fit
    a task is split by what follows, and the parts' counts, however small, are added up."""
    total = pairs.agg(F.sum("n")).first()[0] or 0
    share = max(GROUP_ROWS, -(-total // PAIRS_SPLIT))  # fewer than PAIRS_SPLIT pairs exceed it
    parts = -(-share // GROUP_ROWS)
    hot = pairs.where(f"n > {share}").select("lang", F.col("phrase").alias("prefix"), (F.ceil(F.col("n") / share) * parts).cast("int").alias("splits"))
    dealt = projected.join(F.broadcast(hot), ["lang", "prefix"], "left").withColumn("splits", F.coalesce("splits", F.lit(parts)))
    dealt = dealt.withColumn("split", F.pmod(F.xxhash64("rest"), F.col("splits")).cast("int")).select("lang", F.col("prefix").cast("binary").alias("prefix"), "split", "splits", F.col("rest").cast("binary").alias("rest"), "n")
    count = int(projected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(count, "lang", "prefix", "split").sortWithinPartitions("lang", "prefix", "split")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (lang, prefix, _, splits), group in groupby(rows_of(batches), lambda r: r[:4]):
            code: dict[bytes, int] = {}
            flat, ends, n = [], [], []
            for r in group:
                flat += [code.setdefault(w, len(code)) for w in r[4].split(b" ")]
                ends.append(len(flat))
                n.append(r[5])
            ends = np.array(ends)
            found = list(extended(prefix, np.array(flat), list(code), np.append(0, ends[:-1]), ends, np.array(n), least if splits == 1 else 1))
            if found:
                out.append((lang, *zip(*found)))
            if len(out) > 1 << 12:
                yield framed(out, COUNTED)
                out = []
        yield framed(out, COUNTED)

    return summed(in_arrow(dealt, extend, COUNTED, 1 << 14), least)


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of two words and more in counts, by the cut that scores lowest; all in exact decimals."""
    # a row per lang, written, so that its size is known when the join is planned
    totals = materialize(counts.where("phrase = ''").select("lang", F.col("n").alias("total")), "totals")
    parts = counts.where("phrase <> ''")
    words = F.split("phrase", " ")
    cuts = parts.withColumn("w", words).where("size(w) > 1").select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('1000 * a')} * {wide('total')}) div ({wide('l')} * {wide('r')})")
    each = cuts.join(totals, "lang").groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("total").alias("n"))).alias("m"))
    return each.select("lang", "phrase", "a", "m.l", "m.r", "m.n", "m.score")


def maximal(phrases: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a) without those inside a longer one that stands as often. Counts don't rise with length, so if any
    longer phrase stands as often, one that is a word longer does."""
    w = F.split("phrase", " ")
    longer = phrases.select("lang", "a", w.alias("w")).where("size(w) > 2")
    inner = F.array(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))
    covered = longer.select("lang", "a", F.explode(inner).alias("w")).select("lang", "a", F.array_join("w", " ").alias("phrase"))
    return phrases.join(covered.distinct(), ["lang", "phrase", "a"], "left_anti")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, phrase, n: every phrase of one to five words with `least` occurrences, and each lang's words under ''; written.

    Occurrences are contiguous, within pieces, overlaps included. A null text has no words, a null lang is `und`; rows that repeat
    each other count each time; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].cast("binary").alias("t")).where("t is not null"))
    words = materialize(summed(word_counts(rows), least), "words")
    pairs = materialize(summed(pair_counts(rows, spark.sparkContext.broadcast(filter_of(words.where("phrase <> ''")))), least), "pairs")
    projected = projections(rows, spark.sparkContext.broadcast(filter_of(pairs)))
    return materialize(words.unionByName(pairs).unionByName(grown(projected, pairs, least)), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each lang by score, then a, then the phrase's bytes. Odd input: see phrase_counts()."""
    kept = maximal(scored(phrase_counts(docs, text, lang, least)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
     listed AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
     word AS (SELECT lang, id, unnest(w) AS a1, unnest(range(1, len(w) + 1)) AS i FROM listed),
     ahead AS (SELECT lang, a1, lead(a1, 1) OVER p AS a2, lead(a1, 2) OVER p AS a3, lead(a1, 3) OVER p AS a4, lead(a1, 4) OVER p AS a5 FROM word WINDOW p AS (PARTITION BY id ORDER BY i)),
     gram AS (SELECT lang, 1 AS len, a1 AS phrase FROM ahead UNION ALL SELECT lang, 2, a1 || ' ' || a2 FROM ahead WHERE a2 IS NOT NULL UNION ALL SELECT lang, 3, a1 || ' ' || a2 || ' ' || a3 FROM ahead WHERE a3 IS NOT NULL
              UNION ALL SELECT lang, 4, a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 FROM ahead WHERE a4 IS NOT NULL UNION ALL SELECT lang, 5, a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 || ' ' || a5 FROM ahead WHERE a5 IS NOT NULL),
     f AS (SELECT lang, len, phrase, count(*) AS a FROM gram GROUP BY ALL),
     total AS (SELECT lang, sum(a) AS n FROM f WHERE len = 1 GROUP BY lang),
     cand AS (SELECT * FROM f WHERE len > 1 AND a >= 100),
     cut AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, len)) AS k FROM cand),
     rated AS (SELECT c.lang, c.len, c.phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(t.n AS BIGINT) AS n, CAST((CAST(1000 * c.a AS HUGEINT) * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
               FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') AND x.len = c.k JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') AND y.len = c.len - c.k JOIN total t ON t.lang = c.lang),
     lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM cand q WHERE q.lang = s.lang AND q.len > s.len AND 100 * q.a >= 100 * s.a AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""

"""Line dedup: a rolling hash over line hashes cuts texts into chunks of a few lines; chunks that occur again anywhere lose
all but their first occurrence, together with the equal lines beside them, after their bytes have been compared.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import free_name, materialize

#: The rolling hash spans WINDOW lines: a polynomial in BASE, modulo MODULUS. Lines beside a repeated chunk that are compared, on each side.
WINDOW, BASE, MODULUS, BESIDE = 2, 31, 1 << 32, 4
#: Salts of the chunks' hashes, and occurrences of one chunk that are compared with its first one in one place.
SALTS, HOT_ROWS = 16, 256


def line_hash(line: Column) -> Column:
    """32 bits of a line's MD5, as a long."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def rolling(hashes: Column) -> Column:
    """Polynomial hash of each line hash and the WINDOW - 1 before it, so a boundary depends on neighbouring lines alone."""
    return F.transform(hashes, lambda x, i: sum((F.coalesce(F.get(hashes, i - j), F.lit(0)) * F.lit(BASE**j) for j in range(1, WINDOW)), x) % MODULUS)


def boundaries(step: DataFrame) -> DataFrame:
    """ends: the last line of each chunk, from hashes and last.

    A chunk ends where the rolling hash is less than at both neighbours, so neighbours never both end one; what is longer
    than three lines between such minima is cut into pairs from its first line on. No chunk is a single line unless
    the text is.
    """
    at = lambda i: F.get("roll", i)
    least = lambda i: (i > 0) & (i < F.col("last") - 1) & (at(i) < at(i - 1)) & (at(i) < at(i + 1))
    step = step.withColumn("roll", rolling(F.col("hashes")))
    step = step.withColumn("minima", F.filter(F.sequence(F.lit(0), F.col("last")), lambda i: (i == F.col("last")) | least(i)))

    def pairs(end, j):
        first = F.coalesce(F.get("minima", j - 1) + 1, F.lit(0))
        return F.filter(F.sequence(first, end), lambda i: (i == end) | (((i - first) % 2 == 1) & (end - i >= 2)))

    return step.withColumn("ends", F.flatten(F.transform("minima", pairs)))


def packed(first: Column, count: Column) -> Column:
    """first line << 32 | number of lines"""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(count.cast("long"))


def first_line(chunk: Column) -> Column:
    return F.shiftright(chunk, 32).cast("int")


def line_count(chunk: Column) -> Column:
    return chunk.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines_at(first: Column, count: Column) -> Column:
    return F.slice("lines", first + 1, count)


def chunked(rows: DataFrame) -> DataFrame:
    """id, h, chunk, bh (hash of the chunk's bytes): the chunks of several lines, one of them not blank, of rows (id, h, lines)."""
    step = rows
    step = boundaries(step.withColumn("hashes", F.transform("lines", line_hash)).withColumn("last", F.size("lines") - 1))
    chunks = F.transform("ends", lambda end, j: packed(F.coalesce(F.get("ends", j - 1) + 1, F.lit(0)), end - F.coalesce(F.get("ends", j - 1), F.lit(-1))))
    found = step.select("id", "h", "lines", F.explode(F.filter(chunks, lambda c: line_count(c) > 1)).alias("chunk"))
    body = F.array_join(lines_at(first_line(F.col("chunk")), line_count(F.col("chunk"))), "\n")
    return found.select("id", "h", "chunk", body.alias("body")).where(F.col("body").rlike(r"\S")).select("id", "h", "chunk", F.xxhash64("body").alias("bh"))


def salted(df: DataFrame, salts: Column) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))


def salt_of(salts: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64("id", "h"), salts).cast("int"), F.lit(0))


def equal_run(a: Column, b: Column) -> Column:
    """How many elements from the first on are equal."""
    unequal = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(unequal > 0, unequal - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def removals(rows: DataFrame, key: str, text: str, h: str) -> DataFrame:
    """id, h, removed (array of line ranges, like chunks): the repetitions in the texts of rows; h is their texts' hash.

    Hashes of chunks tell which may repeat and where the first of each is, by (id, h, line). Their bytes are fetched from
    the texts, compared, and the equal lines on both sides (BESIDE at most) are added to what goes.
    """
    place = F.struct("id", "h", "chunk")
    own = [rows[key].alias("id"), rows[h].alias("h"), lines_of(rows[text]).alias("lines")]
    found = materialize(chunked(rows.select(*own)), "chunks")
    # a chunk may be in a third of all documents: occurrences are dealt over salts, the other side is repeated for each; where that
    # side holds texts, there are as many salts as the occurrences of its chunk ask for
    groups = found.groupBy("bh").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.ceil(F.count(F.lit(1)) / F.lit(HOT_ROWS)).cast("int").alias("salts"))
    groups = groups.where(~F.col("first").eqNullSafe(F.col("final"))).drop("final")
    later = found.withColumn("salt", salt_of(F.lit(SALTS))).join(salted(groups, F.lit(SALTS)), ["bh", "salt"]).where(~place.eqNullSafe(F.col("first"))).select("id", "h", "chunk", "bh", F.lit(False).alias("head"), "salts")
    heads = groups.select("first.*", "bh", F.lit(True).alias("head"), "salts")
    wanted = later.union(heads).groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(F.collect_set(F.struct("chunk", "bh", "head", "salts")).alias("wanted"))
    wanted = materialize(wanted, "chunks")
    # the texts move by (h, key) here as in the last join: nothing is renamed or filtered below, so that Spark moves them once
    texts = rows.join(wanted, (rows[h] == wanted["wh"]) & rows[key].eqNullSafe(wanted["wid"])).select(*own, F.explode(wanted["wanted"]).alias("w")).select("id", "h", "lines", "w.*")
    first, count = first_line(F.col("chunk")), line_count(F.col("chunk"))
    start = F.greatest(first - BESIDE, F.lit(0))
    texts = texts.select("id", "h", "chunk", "bh", "head", "salts", lines_at(first, count).alias("body"), F.reverse(lines_at(start, first - start)).alias("before"), lines_at(first + count, F.lit(BESIDE)).alias("after"))
    kept = texts.where("head").groupBy("bh").agg(F.min(F.struct("body", "before", "after")).alias("kept"), F.max("salts").alias("salts"))
    again = texts.where("not head").withColumn("salt", salt_of(F.col("salts"))).drop("salts").join(salted(kept, F.col("salts")), ["bh", "salt"]).where(F.col("body") == F.col("kept.body"))
    up, down = equal_run(F.col("before"), F.col("kept.before")), equal_run(F.col("after"), F.col("kept.after"))
    return again.select("id", "h", packed(first - up, count + up + down).alias("range")).groupBy("id", "h").agg(F.collect_set("range").alias("removed"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (without repeated chunks), n_lines, n_removed: one row per input row.

    Chunks end where the content says so, so a passage of several lines is cut alike wherever it stands. Of equal chunks
    of two lines and more the one with the smallest (key, hash of text, line) stays; null keys are the smallest. The others
    go, with the lines beside them that equal those beside the first. Single lines and blank lines alone never go
    for themselves. Rows that repeat key and text are one document: they lose the same lines. A null text stays null
    with no lines, an empty one is one empty line; a text that loses everything becomes empty. Other columns are
    ignored; an empty table gives an empty one.
    """
    rows = dedup_rows(docs.select(docs[key], docs[text]), key, text)
    return rows.select(key, text, "n_lines", "n_removed")


def dedup_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with column text without repeated chunks, and n_lines and n_removed (in place of columns of these names, in
    letters of any case). Nulls, empty texts, repeated rows and empty tables as in dedup_lines(); other columns stay."""
    own_h, gone_h, gone_id, removed, lines = (free_name(docs, n) for n in ("own_h", "gone_h", "gone_id", "removed", "lines"))
    rows = docs.withColumn(own_h, F.xxhash64(docs[text]))
    gone = removals(rows, key, text, own_h)
    gone = gone.select(F.col("id").alias(gone_id), F.col("h").alias(gone_h), F.col("removed").alias(removed))
    step = rows.join(gone, (F.col(own_h) == F.col(gone_h)) & rows[key].eqNullSafe(F.col(gone_id)), "left")
    step = step.withColumn(lines, lines_of(docs[text]))
    # positions of removed lines, as a set; what stays keeps its order
    dropped = F.array_distinct(F.flatten(F.transform(removed, lambda c: F.sequence(first_line(c), first_line(c) + line_count(c) - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    rebuilt = F.when(F.col(removed).isNull(), docs[text]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    own = [rebuilt.alias(c) if c == text else docs[c] for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return step.select(*own, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size(dropped), F.lit(0)).alias("n_removed"))


ORACLE_SQL = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM docs),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines),
rolled AS (SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4294967296 AS r FROM hashed),
least AS (SELECT *, coalesce(i > 1 AND i < n - 1 AND r < lag(r) OVER (PARTITION BY doc_id ORDER BY i) AND r < lead(r) OVER (PARTITION BY doc_id ORDER BY i), false) AS low FROM rolled),
spans AS (SELECT *, coalesce(sum(CAST(low AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM least),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) - 1 AS o, count(*) OVER (PARTITION BY doc_id, s) - 1 AS e FROM spans),
cut AS (SELECT *, coalesce(sum(CAST(o = e OR (o % 2 = 1 AND e - o >= 2) AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM placed),
chunks AS (SELECT doc_id, c, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM cut GROUP BY doc_id, c),
ranked AS (SELECT *, row_number() OVER own AS k, first_value(doc_id) OVER own AS doc_id0, first_value(first) OVER own AS first0
           FROM chunks WHERE n > 1 AND regexp_matches(body, '\\S') WINDOW own AS (PARTITION BY body ORDER BY doc_id, first)),
pairs AS (SELECT r.doc_id, r.first, r.n, a.lines[greatest(r.first - 4, 1):r.first - 1] AS b1, z.lines[greatest(r.first0 - 4, 1):r.first0 - 1] AS b0,
                 a.lines[r.first + r.n:r.first + r.n + 3] AS a1, z.lines[r.first0 + r.n:r.first0 + r.n + 3] AS a0
          FROM ranked r JOIN docs a ON a.doc_id = r.doc_id JOIN docs z ON z.doc_id = r.doc_id0 WHERE k > 1),
ranges AS (SELECT doc_id, first, n, len(list_filter([1, 2, 3, 4], lambda k: k <= least(len(b1), len(b0)) AND b1[len(b1) - k + 1:] = b0[len(b0) - k + 1:])) AS up,
                  len(list_filter([1, 2, 3, 4], lambda k: k <= least(len(a1), len(a0)) AND a1[:k] = a0[:k])) AS down FROM pairs),
gone AS (SELECT DISTINCT doc_id, unnest(range(first - up, first + n + down)) AS i FROM ranges),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS t
         FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""

"""Quality, sharding, near-dedup, archives and vectors against brute force, and on odd input; the pipeline as a whole."""

import hashlib
import random
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import components, near_dedup, quality, sharding, simhash, vector_dedup, warc, work
from newsloom.llm.queries import queries
from tests.llm.conftest import docs_of

SF = "/root/testdata/sf0.001"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def least_reachable(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_documents(docs, quality.fitted(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc > 0.97 and ((got.score >= 0.7) == (got.quality == 1)).mean() > 0.9 and (got.predicted == (got.score >= 0.7)).all()


def test_quality_learns():
    """The network learns to tell texts apart, and the tables of byte pairs give what the filters give."""
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, rng.integers(1, 700), dtype=np.uint8)) for _ in range(60)]
    y = np.array([i % 2 for i in range(60)])
    texts = [t if label else t[: len(t) // 2] + b"!!##!!##" + t[len(t) // 2 :] for t, label in zip(texts, y)]
    net = quality.train(texts, y)
    s = quality.scores(net, texts)
    assert ((s > 0.5) == (y == 1)).mean() > 0.95
    one = texts[0].ljust(quality.CHUNK, b"\0")[: quality.CHUNK]
    slow = max(sum(net.w[k, one[p + k], 3] for k in range(quality.KERNEL)) for p in quality.OFFSETS) + net.c[3]
    data, starts, _ = quality.chunked([texts[0][: quality.CHUNK]])
    assert quality.pooled_only(net, net.pairs(), data, starts)[0, 3] == pytest.approx(max(slow, 0), abs=1e-4)


def test_quality_looks_everywhere():
    data, starts, firsts = quality.chunked([b"x" * 5000, b"", b"y"])
    assert list(firsts) == [0, len(starts) - 2, len(starts) - 1]
    covered = set()
    for s in starts[: firsts[1]]:
        covered |= set(range(s, s + quality.CHUNK))
    assert set(range(5000)) <= covered


def test_quality_shifted_texts():
    """Filters look at every byte: a pattern counts the same wherever it stands in a chunk."""
    net = quality.Network.fresh()
    net.w[:] = 0
    net.w[np.arange(quality.KERNEL), np.frombuffer(b"needle", np.uint8)] = 1
    texts = [b"-" * i + b"needle" + b"-" * (60 - i) for i in range(60)]
    assert np.ptp(quality.scores(net, texts)) < 1e-6 < abs(quality.scores(net, texts)[0] - quality.scores(net, [b"-" * 66])[0])


def test_quality_batches_do_not_matter():
    net = quality.Network.fresh()
    texts = [b"abc" * i for i in range(200)]
    assert np.allclose(quality.scores(net, texts), np.concatenate([quality.scores(net, [t]) for t in texts]))


def test_quality_repeated_keys(spark):
    """Many rows of one key give one text, whatever the order of the rows."""
    rows = [(i % 40, f"text {'good words here' if i % 2 else '%%## junk'} {i}") for i in range(9000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    nets = [quality.fitted(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 3), (rows[::-1], 7))]
    assert all(np.array_equal(getattr(nets[0], x), getattr(nets[1], x)) for x in "wcvb")


def test_keys_must_be_integers(spark):
    df = spark.createDataFrame([("a", "one two three four five six", [1.0])], "doc_id string, text string, embedding array<double>")
    for f in (near_dedup.near_duplicates, simhash.fingerprint_documents, lambda d: vector_dedup.near_vectors(d, "doc_id")):
        with pytest.raises(TypeError, match="integer keys"):
            f(df)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (5, 1)], "doc_id long, quality int")
    net = quality.fitted(odd, labels)
    assert quality.score_documents(odd, net).count() == odd.count() and quality.score_documents(none, net).count() == 0
    assert quality.score_rows(odd, net).count() == odd.count()
    quality.fitted(none, labels.limit(0))
    assert [c for c in quality.score_rows(odd.withColumnRenamed("score", "SCORE"), net).columns if c.lower() == "score"] == ["score"]


# --- sharding --------------------------------------------------------------------------------------------------------


def check_shards(rows, sizes, shards=8, tolerance=0.001):
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    share = sum(sizes) / shards
    assert all(abs(total[s] - share) <= 2 * max(sizes) + tolerance * share for s in range(shards))


def test_shards_query(spark):
    rows, docs = queries()["op6_histogram_shards"](spark, SF).collect(), docs_of()
    got = {r["doc_id"]: r for r in rows}
    for d, t, *_ in docs:
        raw = (t or "").encode()
        assert (got[d]["size"], got[d]["text_crc32"], got[d]["law"], got[d]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    check_shards(rows, [r["size"] for r in rows])


def test_shards_hot_group(spark):
    """A third of all rows with one text, and another third with few keys."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = sharding.shard_rows(df).collect()
    check_shards(rows, [r["size"] for r in rows])


def test_shards_odd(odd, none):
    rows = sharding.shard_rows(odd).collect()
    assert len(rows) == odd.count() and sharding.shard_rows(none).count() == 0
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(8))


def test_buckets():
    rng = np.random.default_rng(3)
    h, k = rng.integers(-3, 3, 500), rng.integers(-3, 3, 500)
    probes = sorted({(int(a), int(b)) for a, b in rng.integers(-3, 3, (12, 2))})
    assert list(sharding.bucket_of(h, k, *sharding.as_arrays(probes))) == [sum(p <= (x, y) for p in probes) for x, y in zip(h, k)]


def test_many_splitters_in_seconds():
    """60,000 ranges: the driver's work follows their number. Counts come from sorted keys in memory here."""
    import time

    rng = np.random.default_rng(9)
    h = np.sort(rng.integers(-(1 << 62), 1 << 62, 600_000))
    size = rng.integers(1, 2000, len(h))
    total = np.append(0, np.cumsum(size))

    def count(probes):
        cut = [0, *np.searchsorted(h, sharding.as_arrays(probes)[0], "left").tolist(), len(h)]
        return {b: (int(total[j] - total[i]), j - i, int(h[i]), int(h[j - 1]), 0, 0) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i}

    began = time.time()
    cuts, below = sharding.refined(count, 60_000, 1, 0.1, 0.5)
    assert time.time() - began < 60 and len(cuts) == len(below) == 59_999 and cuts == sorted(cuts)
    at = np.searchsorted(h, sharding.as_arrays(cuts)[0], "left")
    assert below == at.tolist() and (np.abs(total[at] - total[-1] * np.arange(1, 60_000) / 60_000) <= 2000).all()


def test_shards_other_keys(spark):
    df = spark.range(500).select(F.concat(F.lit("key "), F.col("id")).alias("k"), F.concat(F.lit("text "), F.col("id") % 50).alias("t")).union(spark.createDataFrame([(None, "x")], "k string, t string"))
    rows = sharding.shard_rows(df, "k", "t").collect()
    check_shards(rows, [r["size"] for r in rows])
    assert len(rows) == 501


# --- near-dedup ------------------------------------------------------------------------------------------------------


def brute_near(docs):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    where = defaultdict(list)
    for i, d in enumerate(ids):
        for g in sets[d]:
            where[g].append(i)
    seen, links = set(), []
    for own in where.values():
        for x in range(len(own)):
            for y in range(x):
                p = (own[y], own[x])
                if p not in seen:
                    seen.add(p)
                    a, b = sets[ids[p[0]]], sets[ids[p[1]]]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        links.append(p)
    label = least_reachable(len(ids), links)
    return {d: (len(sets[d]), ids[label[i]]) for i, d in enumerate(ids)}


def test_near_query(spark):
    got = by_id(queries()["op7_minhash_near_dedup"](spark, SF))
    for d, (n, c) in brute_near([(d, t) for d, t, *_ in docs_of()]).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, c, c == d)


def test_near_families(spark):
    """Families of edited copies around the threshold, one of them large."""
    rng = random.Random(11)
    docs = []
    for family in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(150 if family == 0 else rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute_near(docs)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want


def test_near_large_nodes(spark, monkeypatch):
    """Nodes above their limit branch again, and blocks split what stays large."""
    monkeypatch.setattr(near_dedup, "NODE_MOST", 20)
    monkeypatch.setattr(near_dedup, "SETS_AT_ONCE", 16)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(200):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {d: r["component_id"] for d, r in got.items()} == {d: c for d, (_, c) in brute_near(docs).items()}


def test_near_odd(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_dedup.near_duplicates(none).count() == 0
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[2] == [(6, 1, False)] and got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[6] == [(got[6][0][0], 5, False)] and got[8] == [(1, 7, False)]
    assert got[9] == [(0, 9, True)] * 2 and all(c is None and kept for _, c, kept in got[None])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(1000, i) for i in range(500, 600)]
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = least_reachable(1001, edges)
    assert {v: c for v, c in enumerate(label) if v != c} == got


def test_large_sides_of_joins_are_not_broadcast(spark, monkeypatch):
    """A few rows may be broadcast, more may not, however small their file is; salted and plain rounds give the same components."""
    least = work.materialize(spark.range(1000).select(F.col("id").alias("a"), F.col("id").alias("m")), "least")
    both = work.materialize(spark.range(5000).select((F.col("id") % 1000).alias("a"), F.col("id").alias("b")), "both")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = components.with_least(both, "a", least, 1000)
    assert "Broadcast" in plan(few) and few.count() == 5000
    for module in (work, components, near_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 100)
    many = components.with_least(both, "a", least, 1000)
    assert "Broadcast" not in plan(many) and many.count() == 5000
    assert "Broadcast" not in plan(both.join(work.merged_if_large(least), "a", "left_semi"))
    test_components(spark)
    test_near_families(spark)


# --- archives --------------------------------------------------------------------------------------------------------


def test_archive_query(spark):
    import duckdb

    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    raw = {p: (h or "").encode() for p, h in pages}
    best = {}
    for p, b in raw.items():
        best[b] = max(best.get(b, p), p)
    for p, r in by_id(queries()["op8_arc_to_warc"](spark, SF), "page_id").items():
        keep = best[raw[p]] if len(raw[p]) >= 1000 else p
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw[p]), hashlib.sha1(raw[p]).hexdigest(), "response" if keep == p else "revisit", None if keep == p else keep)


def test_archive_odd(spark):
    big = "x\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (-5, "u", "short"), (7, "u", "short"), (8, "http://a/é", "日本" * 600), (2, None, big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit(0))
    out = warc.archive_pages(df)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out.collect())
    assert got == sorted([("1", "revisit", 2, 1500), ("2", "response", None, 1500), ("2", "response", None, 1500), ("3", "response", None, 0), ("4", "response", None, 0), ("None", "response", None, 1500), ("-5", "response", None, 5), ("7", "response", None, 5), ("8", "response", None, 3600)])
    assert warc.archive_pages(df.limit(0)).count() == 0
    two, one = warc.arc_to_records(warc.pages_to_arc(df)), warc.pages_to_records(df)
    assert sorted(map(str, two.collect())) == sorted(map(str, one.collect())) and one.count() == len(rows)
    assert {r["uri"] for r in out.collect()} == {"http://a/b%20c", "urn:page:none", "u", "http://a/é"}


def test_arc_versions():
    for version in (1, 2):
        data = warc.arc_head(version, "n.arc", warc.ARC_DATE) + warc.arc_record(version, "http://a", 5, b"\n\nbody\n", 0, "n.arc", warc.ARC_DATE) + warc.arc_record(version, "http://b", None, b"", 0, "n.arc", warc.ARC_DATE)
        a, b = warc.parse_arc(data)
        assert a["URL"] == "http://a" and warc.split_http(a["body"])[1] == b"\n\nbody\n" and warc.split_http(b["body"])[1] == b""
        assert set(a) == {*warc.ARC_FIELDS[version].split(), "body"}
        with pytest.raises(ValueError, match="ends earlier"):
            list(warc.parse_arc(data[:-3]))


def test_arc_malformed(spark):
    """A URL with blanks is kept, a line that is no header is passed over with what belongs to it, a cut end is noted."""
    for version in (1, 2):
        record = lambda url, body: warc.arc_record(version, "http://x", 5, body, 0, "n.arc", warc.ARC_DATE).replace(b"http://x", url)  # noqa: B023, E731
        data = warc.arc_head(version, "n.arc", warc.ARC_DATE) + record(b"http://a b  c", b"one") + b"\nnot a header\nlines\n" + record(b"http://d", b"two") + record(b"http://e", b"three")[:-2]
        problems = []
        got = list(warc.parse_arc(data, problems))
        assert [r["URL"] for r in got] == ["http://a b  c", "http://d"] and [warc.split_http(r["body"])[1] for r in got] == [b"one", b"two"]
        assert [reason.split()[0] for _, reason in problems] == ["header", "record"]
        arcs = spark.createDataFrame([(bytearray(data),), (bytearray(b"junk"),), (None,)], "content binary")
        assert warc.arc_to_records(arcs).count() == 2 and warc.arc_problems(arcs).count() == 4


def test_archive_files_are_bounded(spark, tmp_path, monkeypatch):
    """Files close by their bytes; each begins with a warcinfo record, and each record is a gzip member of its own."""
    import glob
    import zlib

    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame([(i, f"http://a/{i}", "".join(chr(97 + (i * j * j) % 26) for j in range(700))) for i in range(40)], "page_id long, url string, html string")
    warc.write_warc(warc.arc_to_records(warc.pages_to_arc(pages)).withColumn("refers_to", F.lit(None).cast("long")), f"file://{tmp_path}/w")
    files = glob.glob(f"{tmp_path}/w/part-*")
    assert len(files) >= 6
    records = 0
    for path in files:
        rest, members = open(path, "rb").read(), []
        while rest:
            unpack = zlib.decompressobj(31)
            members.append(unpack.decompress(rest))
            assert unpack.eof
            rest = unpack.unused_data
        assert members[-1] == b"" and b"WARC-Type: warcinfo" in members[0] and all(m.startswith(b"WARC/1.1") and m.count(b"WARC-Type: ") == 1 for m in members[:-1])
        records += len(members) - 2
    assert records == 40


def test_record_ids():
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 12345678901234):
        assert warc.page_of(warc.record_id(n)) == n and uuid.UUID(warc.record_id(n)[9:]).version == 8
    assert warc.page_of(warc.record_id(None, "u")) is None


def test_archives_are_warc(spark, tmp_path):
    """The files on disk hold well-formed records: version line, declared lengths, digests."""
    import glob
    import gzip
    import io

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i % 3}</p>" * 200) for i in range(50)], "page_id long, url string, html string")
    records = warc.arc_to_records(warc.pages_to_arc(pages))
    warc.write_warc(records.join(warc.revisits(records), "page_id", "left"), f"file://{tmp_path}/w")
    kinds = defaultdict(int)
    for path in glob.glob(f"{tmp_path}/w/part-*"):
        for fields, block in warc.parse_warc(io.BytesIO(gzip.open(path).read())):
            kinds[fields["warc-type"]] += 1
            assert int(fields["content-length"]) == len(block)
    assert kinds["response"] == 3 and kinds["revisit"] == 47 and kinds["warcinfo"] >= 1


# --- vectors ---------------------------------------------------------------------------------------------------------


def brute_vectors(vectors, threshold=0.95):
    x = np.array(vectors, np.float64)
    norm = np.sqrt((x * x).sum(1))
    hit = (x @ x.T) / np.outer(norm, norm) >= threshold
    return hit.sum(1) - 1, least_reachable(len(x), np.argwhere(hit).tolist())


@pytest.mark.parametrize(("cell", "block"), [(8192, 16384), (60, 25), (20, 7)])
def test_vectors_by_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", cell)
    monkeypatch.setattr(vector_dedup, "BLOCK_LEAST", min(block, 1024))
    monkeypatch.setattr(vector_dedup, "BLOCK_MOST", block)
    rng = np.random.default_rng(6)
    parts = [rng.normal(size=(250, 8))]
    for size, noise in ((60, 0.05), (30, 0.12), (10, 0.2)):
        parts.append(rng.normal(size=8) + noise * rng.normal(size=(size, 8)))
    x = np.concatenate([*parts, parts[1][:5], 2 * parts[1][:3]]).astype(np.float32)
    got = by_id(vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")), "vec_id")
    links, label = brute_vectors(x)
    assert [got[i]["n_links"] for i in range(len(x))] == list(links)
    assert [got[i]["component_id"] for i in range(len(x))] == label and all(got[i]["kept"] == (label[i] == i) for i in range(len(x)))


def test_vectors_odd(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit("clash"))
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(df).collect())
    assert got == [(-1, 0, None, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 3, 1, False), (9, 3, 1, False), (10, 0, 10, True)]
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    """Each stage on the rows the one before kept; each decision recomputed on the side."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], "/root/testdata/sf0.01").cache())
    columns = docs.columns
    rows = [f.toPandas().set_index("doc_id") for f in frames]
    assert all(list(f.columns) == columns for f in frames[:5])
    good, lines, near, clean, packed = rows[1:]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")
    known = labels.join(good[["text"]], how="left")
    assert known[known.quality == 1].text.notna().mean() > 0.95 and known[known.quality == 0].text.isna().mean() > 0.8
    assert list(lines.index.sort_values()) == list(good.index.sort_values())
    want = brute_near(list(lines.text.items()))
    assert sorted(near.index) == sorted(d for d, (_, c) in want.items() if c == d)
    from newsloom.llm import secrets

    for d, t in near.text.items():
        spans = secrets.scan(t)
        assert clean.text[d] == secrets.redacted(t, spans) and (not spans or clean.n_chars[d] == len(clean.text[d]))
    assert set(packed.index) == set(clean.index)


def test_pipeline_stages_odd(spark, odd, none, tmp_path):
    """Null keys and texts, empty and long texts, repeated rows, other columns of clashing names and empty tables, through every stage."""
    spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    more = {"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text")}
    for rows in (odd, none):
        docs = rows.withColumns(more)
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.select(out.columns[0], out.columns[1]).collect()
            assert len(got) <= n if name != "best_fit_packing" else len({(r[0]) for r in got}) == len({r[0] for r in docs.select("doc_id").collect()})
            assert name == "best_fit_packing" or out.columns == list(corpus_pipeline.COLUMNS)
            if name in ("line_dedup", "secret_scans"):
                assert len(got) == n and sum(r["text"] is None for r in got) == docs.where("text is null").count()


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "secret_scans", "best_fit_packing"]


def test_quality_score_by_brute_force():
    """The whole score of texts of one chunk and of many, filter by filter and byte by byte."""
    rng = np.random.default_rng(9)
    net = quality.Network.fresh(3)
    net.c[:] = rng.normal(0, 0.1, quality.FILTERS)
    texts = [b"", b"abc", bytes(rng.integers(32, 127, 256, dtype=np.uint8)), bytes(rng.integers(0, 256, 257, dtype=np.uint8)), bytes(rng.integers(32, 127, 1000, dtype=np.uint8))]

    def slow(text):
        pooled = []
        for first in range(0, max(1, len(text) - quality.CHUNK + quality.STEP), quality.STEP):
            chunk = text[first : first + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            each = [sum(net.w[k, chunk[p + k]].astype(float) for k in range(quality.KERNEL)) + net.c for p in range(quality.CHUNK - quality.KERNEL + 1)]
            pooled.append(np.maximum(np.max(each, 0), 0))
        x = np.append(np.mean(pooled, 0), np.max(pooled, 0))
        return 1 / (1 + np.exp(-(x @ net.v + net.b[0])))

    assert np.allclose(quality.scores(net, texts), [slow(t) for t in texts], atol=1e-5)

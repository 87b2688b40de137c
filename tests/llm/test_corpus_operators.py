"""Ranked search, phrases and context-tree weighting against brute force, and on odd input."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.llm import context_tree, phrases, search
from tests.llm.conftest import docs_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_search(docs, items, most=20):
    """(item, rank, doc_id, score), by the formulas, in Python's integers."""
    terms = [TERM.findall(t.translate(LOWER)) if t else [] for _, t in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for own in terms for w in set(own))
    counts = [Counter(own) for own in terms]
    out = []
    for item, text in items:
        scores = []
        for (k, _), own, tf in zip(docs, terms, counts):
            s = 0
            for w in TERM.findall((text or "").translate(LOWER)):
                if tf[w]:
                    m = 75 + 25 * len(own) * n_docs // n_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m))
            if s > 0:
                scores.append((-s, k is None, k))
        out += [(item, i + 1, k, -s) for i, (s, _, k) in enumerate(sorted(scores)[:most])]
    return out


def test_search_by_brute_force(spark, monkeypatch):
    """Small shards and query blocks give what large ones give; ties, copies and repeated terms of an item count."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["é", "ÉÀ", "日本", "x1y", "İ"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 60]))).replace("w3", "W3,")) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w1") for i in range(60)]  # more ties than places
    docs += [(400, None), (401, ""), (402, "\x00-\x7f"), (None, "w1 w2 w1")]
    rng.shuffle(docs)
    items = [(1, "w1 w2 W2"), (2, "nowhere"), (3, None), (4, "日本-İ é"), (5, " ".join(words)), (None, "w7"), (6, "")]
    want = sorted(brute_search(docs, items), key=repr)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = lambda: sorted(map(tuple, search.ranked_documents(*frames).collect()), key=repr)
    assert got() == want
    monkeypatch.setattr(search, "SHARD_ROWS", 7)
    monkeypatch.setattr(search, "TERMS_AT_ONCE", 20)
    assert got() == want


def test_search_on_odd_input(spark, odd, none):
    items = spark.createDataFrame([(1, "a b word5x5"), (1, "short"), (None, "END")], "item_id long, text string").withColumn("q", F.lit(1)).withColumn("rank", F.lit("r"))
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted(map(tuple, search.ranked_documents(odd, items).collect()), key=repr)
    assert got == sorted(brute_search(docs, [(1, "a b word5x5"), (1, "short"), (None, "END")]), key=repr)
    assert search.ranked_documents(none, items).count() == 0 and search.ranked_documents(odd, items.limit(0)).count() == 0
    with pytest.raises(TypeError):
        search.ranked_documents(odd.withColumn("doc_id", F.lit("x")), items)


def test_search_impacts_stay_exact():
    import numpy as np

    big = 1 << 45
    got = search.impact(np.array([3]), np.array([big]), 1 << 20, 1 << 50)
    assert got.tolist() == [3_000_000_000 // (3000 + 12 * (75 + 25 * big * (1 << 20) // (1 << 50)))]


# --- phrases -----------------------------------------------------------------------------------------------------------


def brute_phrases(docs, least=100, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) straight from the definitions; the longer candidates are all looked at."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + size])) for size in range(1, 6) for i in range(len(w) - size + 1))
    out = []
    for lang in n:
        own = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        inner = {q[i:j]: (q, b) for q, b in own.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and 100 * b >= 100 * own[q[i:j]]}
        rows = []
        for p, a in own.items():
            if p in inner:
                continue
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_docs():
    rng = random.Random(11)
    docs = []
    for _ in range(400):
        words = [f"w{min(int(rng.expovariate(0.4)), 30)}" for _ in range(rng.choice([0, 3, 40]))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x1f"]) for w in words)
        docs.append((text.replace("w2 ", "one Two three four five SIX "), rng.choice(["en", "fr", None, "und"])))
    docs += [("ab ab ab ab ab ab " * 40, "en"), ("é É 日 本 é É 日 本 " * 60, "fr"), (None, "en"), ("", None), ("x " * 20_000, "")]
    return docs


def test_phrases_by_brute_force(spark, monkeypatch):
    """Prefixes split over tasks, and filters so small that they let everything through, give what whole ones give."""
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    want = brute_phrases(docs, 20)
    assert len(want) > 30 and {len(r[2].split()) for r in want} == {2, 3, 4, 5}
    got = lambda **x: sorted(map(tuple, phrases.collocations(df, **x).collect()))
    assert got(least=20) == want
    assert got(least=20, top=7) == brute_phrases(docs, 20, 7)
    monkeypatch.setattr(phrases, "GROUP_ROWS", 8)
    monkeypatch.setattr(phrases, "PAIRS_SPLIT", 2)
    monkeypatch.setattr(phrases, "FILTER_BITS", 7)
    monkeypatch.setattr(phrases, "TEXT_BYTES", 500)
    assert got(least=20) == want


def test_phrase_scores_stay_exact(spark):
    """Products of counts beyond 64 bits, and a cut chosen after flooring."""
    a, big = 9_000_000_000_000_000, 9_100_000_000_000_000
    counts = spark.createDataFrame([("en", "", 9_223_372_036_854_775_807), ("en", "p", big), ("en", "q", big + 1), ("en", "s", big + 2), ("en", "p q", a), ("en", "q s", a + 1), ("en", "p q s", a - 7)], "lang string, phrase string, n long")
    f = {r["phrase"]: r["n"] for r in counts.collect()}
    cut = lambda p, k: (1000 * f[p] * f[""] // (f[" ".join(p.split()[:k])] * f[" ".join(p.split()[k:])]), k)
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in phrases.scored(counts).collect()}
    want = {}
    for p in ("p q", "q s", "p q s"):
        score, k = min(cut(p, k) for k in range(1, len(p.split())))
        want[p] = (score, f[" ".join(p.split()[:k])], f[" ".join(p.split()[k:])])
    assert got == want


def test_phrases_on_odd_input(spark, odd, none):
    lang = lambda df: df.withColumn("lang", F.lit(None).cast("string"))
    docs = [(r["text"], None) for r in odd.collect()]
    got = sorted(map(tuple, phrases.collocations(lang(odd).withColumn("phrase", F.lit("x")), least=2).collect()))
    assert got == brute_phrases(docs, 2) and got[0][0] == "und"
    assert phrases.collocations(lang(none)).count() == 0


# --- context trees -------------------------------------------------------------------------------------------------------


class SlowTree:
    """The weighted tree in dictionaries: counts of every (depth, context, decision), recursion for the probabilities."""

    def __init__(self, texts, depth=5):
        self.n, self.depth, self.children, self.kept = Counter(), depth, {}, {}
        for t in texts:
            data = b"\xff" * depth + t + b"\xff"
            for i in range(depth, len(data)):
                for d in range(depth + 1):
                    context = data[i - d : i]
                    if d:
                        self.children.setdefault(context[1:], set()).add(context)
                    for k in range(8):
                        self.n[context, k, data[i] >> (8 - k), data[i] >> (7 - k) & 1] += 1

    def counts(self, context, k, prefix):
        return self.n[context, k, prefix, 0], self.n[context, k, prefix, 1]

    def own(self, context, k, prefix):
        a, b = self.counts(context, k, prefix)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, context, k, prefix):
        return sum(self.weighted(c, k, prefix) for c in self.children.get(context, ()))

    def weighted(self, context, k, prefix):
        at = context, k, prefix
        if at not in self.kept:
            own = self.own(*at)
            if len(context) < self.depth:
                other = self.below(*at)
                top = max(own, other)
                own = top + math.log(math.exp(own - top) + math.exp(other - top)) - math.log(2)
            self.kept[at] = own
        return self.kept[at]

    def log10(self, context, byte):
        total = 0.0
        for k in range(8):
            prefix, bit = byte >> (8 - k), byte >> (7 - k) & 1
            p = None
            for d in range(self.depth, -1, -1):
                at = context[len(context) - d :], k, prefix
                n = self.counts(*at)
                if sum(n):
                    kt = (n[bit] + 0.5) / (sum(n) + 1)
                    w = 1 if p is None else 1 / (1 + math.exp(min(700, self.below(*at) - self.own(*at))))
                    p = w * kt + (1 - w) * (p or 0)
            total += math.log10(0.5 if p is None else p)
        return total


def brute_scores(docs):
    """key -> held out, tokens, known, training tokens, base score, score."""
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in docs]
    texts = [(t or "").translate(LOWER) for _, t in docs]
    tokens = [[*re.findall("[^ \t-\r]+", t), None] for t in texts]
    c = Counter(w for own, h in zip(tokens, held) if not h for w in own)
    n, v = sum(c.values()), len(c)
    tree = SlowTree([t.encode() for t, h in zip(texts, held) if not h])
    out = []
    for (k, _), h, t, own in zip(docs, held, texts, tokens):
        data = b"\xff" * 5 + t.encode() + b"\xff"
        score = sum(tree.log10(data[i - 5 : i], data[i]) for i in range(5, len(data)))
        out.append((k, h, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), score))
    return out


def close(got, want):
    rank = lambda r: (repr(r[:5]), r[5])
    got, want = sorted((tuple(r)[:7] for r in got), key=rank), sorted(want, key=rank)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_tree_by_brute_force(spark, monkeypatch):
    """One block or many, small slices and merges: the same scores, and those of the definition."""
    rng = random.Random(12)
    words = ["the", "The", "house", "of", "é", "日本", "and\x0b", "on", "", "x\x00y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30])))) for i in range(60)] + [(None, "the house"), (70, None), (next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2), "zzz unseen ZZZ"), (3, "the house of")]
    want = brute_scores(docs)
    assert sum(r[1] for r in want) > 4 and any(r[1] and r[3] < r[2] for r in want)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    close(context_tree.score_documents(df).collect(), want)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 300)
    close(context_tree.score_documents(df).collect(), want)


def test_tree_slices_and_sums_to_one(monkeypatch):
    import numpy as np

    texts = [b"abracadabra", b"", b"abba" * 9]
    whole = [(k, o) for keys, owner in context_tree.grams_of(texts) for k, o in zip(keys.tolist(), owner.tolist())]
    monkeypatch.setattr(context_tree, "SLICE", 4)
    assert sorted(whole) == sorted((k, o) for keys, owner in context_tree.grams_of(texts) for k, o in zip(keys.tolist(), owner.tolist()))
    assert len(whole) == sum(map(len, texts)) + 3
    grams, n = context_tree.added(np.array([k for k, _ in whole], np.uint64), np.ones(len(whole), np.int64))
    context = int(grams[5]) >> 8 << 8
    every = np.array([context | b for b in range(256)], np.uint64)
    tree = context_tree.Subtree(*context_tree.added(np.append(grams, every), np.append(n, np.zeros(256, np.int64))))
    p = 10 ** tree.log10s(context_tree.tops_of(*tree.roots()))
    assert p[np.isin(tree.keys, every)].sum() == pytest.approx(1)
    keys, numbers = context_tree.unpacked(context_tree.packed(grams, n))
    assert (keys == grams).all() and (numbers == n).all()


def test_tree_on_odd_input(spark, odd, none):
    got = context_tree.score_documents(odd)
    rows = got.collect()
    assert got.columns[0] == "doc_id" and len(rows) == odd.count() and all(r["score"] < 0 for r in rows)
    by = {}
    for r, t in zip(sorted(rows, key=lambda r: repr(r["doc_id"])), sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: repr(r[0]))):
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[1] == by[2] and by[3] == by[4] and by[7] == by[8]
    assert context_tree.score_documents(none).count() == 0


def test_tree_beats_words(spark):
    """Held-out texts of the corpus are likelier under the tree than by word frequencies."""
    got = context_tree.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out and n_tokens > 20").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte"), F.count("*")).first()
    assert got[0] > got[1] and got[2] < 3 and got[3] > 500

"""Best-fit packing: the configuration linear program over the histogram of lengths, solved by multiplicative weights
with knapsack pricing, then rounded; what rounding leaves over is a smaller program, until nothing is left."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import key_type, materialize, released, text_or_empty, within_bounds
from newsloom.session import ship, spread

CAPACITY = 2048
END_ID = 0
#: How fast a length's price falls once patterns cover it, and the power of its length that it is worth at first: a little over 1, so that
#: short pieces, which fit anywhere, are kept for the end.
RATE, FIRST_WORTH = 0.3, 1.05
#: A round prices the PRICED lengths that are covered least. With TAIL sequences left, several values of the first worth are tried.
PRICED, TAIL, TAIL_WORTHS = 192, 64, (1.05, 1.2, 1.5, 2.0, 1.0)
#: Steps of the weights, in all and more for each length; the share of a step, how fast a covered length loses worth, steps between two
#: knapsacks; the share of a program that rounding down must settle, else the rest is rounded up.
STEPS, STEPS_A_LENGTH, STEP, GROWTH, PRICE_EVERY, ENOUGH = 6000, 2, 1e-3, 150.0, 25, 0.005
#: A plan this near its bound is not worth another program, whose steps take minutes for a full histogram.
GAP = 5e-4
#: So many lengths are few; programs that are solved over all of more.
FEW, PROGRAMS = 32, 3
#: Rows of one length are ranked in buckets of about this many rows, or as many more as keep the buckets of all lengths below BUCKETS_MOST.
RANK_ROWS, BUCKETS_MOST = 128, 65536
#: Kept stretches, and how many new ones the tokenizer gets in one call.
WORDS_KEPT, WORDS_AT_ONCE = 120_000, 500
#: Longer ones aren't kept.
WORD_CHARS = 64
BLANKS = re.compile(r"[ \t-\r]+")
LETTERS = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+")
#: Latin-1 bytes in lower case.
LOWER = bytes(ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 256 else i for i in range(256))
#: Kinds of Latin-1 bytes: c for comma and full stop, m for other marks, a blank for blanks, w for letters and digits.
KINDS = bytes(ord("c") if i in b",." else ord(" ") if i in b" \t\n\x0b\f\r" else ord("w") if chr(i).isalnum() and (i < 128 or chr(i).isalpha()) and i not in b"\xaa\xb5\xba" else ord("m") for i in range(256))
#: A character that the tokenizer gives one id of its own; words that hold it are encoded alone.
MARK = "\x01"
#: Fixed values of a tokenizer that lower-cases and drops white space; only such a one is asked word by word.
WORD_SHAPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


# --- tokens -------------------------------------------------------------------------------------------------------


class WordTokens:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit bytes.

    A tokenizer of WORD_SHAPE drops white space and never joins across it, so each stretch between ASCII blanks is
    encoded once and kept; the kept ones are bounded, in two generations. With any other one, texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        shape = {k: json.loads(x.__getstate__()) if (x := getattr(self.tokenizer, k)) else None for k in WORD_SHAPE}
        self.by_words = shape == WORD_SHAPE and getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
        if not self.by_words:
            return
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        # words of lower-case letters alone are one pre-token each: they need no normalising or splitting, and the
        # suffix of their last token tells where each ends
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = None
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.lean.get_vocab_size(), bool)
        self.closes[[i for token, i in self.lean.get_vocab().items() if token.endswith("</w>")]] = True
        self.new: dict = {}
        self.old: dict = {}

    def encoded(self, words: list[str], lean: bool) -> dict[str, bytes]:
        """Ids of each word: few calls over many of them, with a mark between whose one id tells them apart, unless lean."""
        done = {}
        tokenizer, between = (self.lean, " ") if lean else (self.tokenizer, f" {MARK} ")
        for first in range(0, len(words), WORDS_AT_ONCE):
            some = words[first : first + WORDS_AT_ONCE]
            (found,) = tokenizer.encode_batch_fast([between.join([*some, ""])], add_special_tokens=False)
            found = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.closes[found] if lean else found == self.mark).tolist()
            if len(ends) != len(some):
                raise ValueError("the tokenizer joins or splits words otherwise than expected")
            raw, at = found.tobytes(), 0
            for w, end in zip(some, ends):
                done[w] = raw[4 * at : 4 * (end + lean)]
                at = end + 1
        return done

    def plain(self, text: str) -> bytes | None:
        """A text of Latin-1 characters alone, as bytes in lower case, which the tokenizer makes of it anyway, with commas
        and full stops apart where no other mark stands beside them, as in the tokenizer. None for other texts."""
        try:
            raw = text.encode("latin-1").translate(LOWER)
        except UnicodeEncodeError:
            return None
        kinds = raw.translate(KINDS)
        joined = b"cm" in kinds or b"mc" in kinds or b"cc" in kinds
        return raw if joined else raw.replace(b",", b" , ").replace(b".", b" . ")

    def fresh(self, words: list) -> dict:
        """Ids of words that aren't kept; those with the mark go one by one."""
        letters = [w for w in words if isinstance(w, bytes) and LETTERS.fullmatch(w)]
        done = {x.encode("latin-1"): ids for x, ids in self.encoded([w.decode("latin-1") for w in letters], True).items()}
        rest = {w: w.decode("latin-1") if isinstance(w, bytes) else w for w in words if w not in done}
        marked = self.encoded([x for x in set(rest.values()) if MARK not in x], False)
        for w, x in rest.items():
            done[w] = marked[x] if x in marked else np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        return done

    def known(self, words: list) -> list[bytes]:
        """Ids of distinct words; new ones are encoded and kept."""
        if len(self.new) > WORDS_KEPT // 2:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        values = list(map(new.get, words))
        missing = [w for w, v in zip(words, values) if v is None]
        if missing:
            found = {w: v for w in missing if (v := old.get(w)) is not None}
            found |= self.fresh([w for w in missing if w not in found])
            values = [found[w] if v is None else v for w, v in zip(words, values)]
            new.update({w: v for w, v in found.items() if len(w) <= WORD_CHARS})
        return values

    def ids(self, texts: list[str]) -> list[bytes]:
        """Words are told apart by Arrow, so that Python sees each distinct one of a batch once; numpy puts the ids in line."""
        if not self.by_words:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        raws = list(map(self.plain, texts))
        lists = pc.ascii_split_whitespace(pa.array([r or b"" for r in raws], pa.large_binary()).view(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        values = self.known(coded.dictionary.view(pa.large_binary()).to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each)
        blob = np.frombuffer(b"".join(values), "<u4")
        line = blob[np.repeat(starts[at] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = 4 * np.append(0, ends)[lists.offsets.to_numpy()]
        line, out = line.tobytes(), []
        for i, raw in enumerate(raws):
            if raw is None:
                words = [w for w in BLANKS.split(texts[i]) if w]
                own = dict(zip(some := list(dict.fromkeys(words)), self.known(some)))
                out.append(b"".join([own[w] for w in words]))
            else:
                out.append(line[bounds[i] : bounds[i + 1]])
        return out


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 and doc_tokens: a document's ids and END_ID, cut only where longer than capacity."""
    ship(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(path)
        for frame in frames:
            rows = []
            for k, raw in zip(frame["k"], tokens.ids(list(frame["t"]))):
                raw += end
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append((k, piece, start, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"])

    rows = spread(docs.select(docs[key].alias("k"), text_or_empty(text).alias("t")))
    return rows.mapInPandas(released(batches, 4096, 5 << 20), f"k {key_type(docs, key)}, piece int, start long, length long, ids_crc32 long")


# --- the linear program -------------------------------------------------------------------------------------------


def priced(lengths: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: how many of each length fill a sequence at the greatest total value, at most `most` of each."""
    sizes: list[tuple[int, int, int]] = []
    for i, (n, bound) in enumerate(zip(lengths.tolist(), most.tolist())):
        count, left = 1, min(bound, capacity // n)
        while left > 0:  # a bounded count as powers of two
            take = min(count, left)
            sizes.append((i, take, n * take))
            left, count = left - take, count * 2
    best, gain, pick = np.zeros(capacity + 1), np.empty(capacity + 1), np.zeros((len(sizes), capacity + 1), bool)
    for j, (i, take, weight) in enumerate(sizes):
        own, rest = gain[: capacity + 1 - weight], best[weight:]
        np.add(best[: capacity + 1 - weight], value[i] * take, out=own)
        np.greater(own, rest, out=pick[j, weight:])
        np.maximum(rest, own, out=rest)
    pattern, room, j = np.zeros(len(lengths), np.int64), capacity, len(sizes)
    while len(on := np.flatnonzero(pick[:j, room])):
        j = int(on[-1])
        i, take, weight = sizes[j]
        pattern[i] += take
        room -= weight
    return pattern


def lp_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """The better of two feasible solutions of the dual program, which no plan can undercut: a piece is worth its share of
    a sequence; or a sequence if it is longer than half of one, half a sequence if it is exactly that."""
    return max(float(lengths @ counts) / capacity, float(counts @ ((2 * lengths > capacity) + 0.5 * (2 * lengths == capacity))))


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, worth: float = FIRST_WORTH, seed: int = 0) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each: a solution of the covering program by multiplicative weights.

    A length is worth a power of itself at first, and less by a factor with each use of patterns that cover it. Each round
    adds the pattern that a knapsack prices highest over the least covered lengths, as often as its scarcest pieces
    last, until every length is covered; the solution is scaled so that the least covered one is covered once.
    """
    rng, patterns = np.random.default_rng(seed), {}
    base, covered = (lengths / capacity) ** worth, np.zeros(len(lengths))
    while (low := (share := covered / counts).min()) < 1:
        need = np.exp(-np.minimum((share - low) * RATE, 60))
        some = np.arange(len(lengths))
        if len(some) > PRICED:
            some = np.sort(np.argpartition(rng.random(len(lengths)) * -1e-3 - need, PRICED)[:PRICED])
        pattern = np.zeros(len(lengths), np.int64)
        pattern[some] = priced(lengths[some], (base * need)[some], counts[some], capacity)
        on = pattern > 0
        times = float(np.min(counts[on] / pattern[on]))
        patterns.setdefault(pattern.tobytes(), [pattern, 0.0])[1] += times
        covered += times * pattern
    return [(p, x / low) for p, x in patterns.values()]


def rounded(lengths: np.ndarray, left: np.ndarray, solution: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """Whole uses of the solution's fullest patterns, long pieces first: each as often as the solution says, once at least,
    as far as pieces last. `left` loses what they use; the other patterns' pieces are left to the next program."""
    plan, fullest = [], max(int(p @ lengths) for p, _ in solution)
    for pattern, x in sorted(solution, key=lambda s: (-int(np.flatnonzero(s[0])[-1]), -s[1])):
        if pattern @ lengths < fullest:
            continue
        on = pattern > 0
        times = min(max(1, int(x + 1e-9)), int(np.min(left[on] // pattern[on])))
        if times:
            plan.append((pattern, times))
            left -= times * pattern
    return plan


def rounds_of(lengths: np.ndarray, counts: np.ndarray, capacity: int, worth: float, until: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Programs, each over what rounding the one before left, until a volume of `until` sequences is left; the plan and what is left."""
    left, plan, number = counts.copy(), [], 0
    while left @ lengths > until * capacity:
        at = np.flatnonzero(left)
        own = left[at]
        for pattern, times in rounded(lengths[at], own, fractional(lengths[at], left[at], capacity, worth, number)):
            whole = np.zeros(len(lengths), np.int64)
            whole[at] = pattern
            plan.append((whole, times))
        left[at] = own
        number += 1
    return plan, left


def filled_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The fullest patterns of program after program. Together they are a solution of the first one too, whose value can be held
    against lp_bound(). The last TAIL sequences are solved under several first worths; the shortest plan stays.
    """
    plan, left = rounds_of(lengths, counts, capacity, FIRST_WORTH, TAIL)
    at = np.flatnonzero(left)
    if not len(at):
        return plan
    own, least, best = left[at], int(np.ceil(lp_bound(lengths[at], left[at], capacity) - 1e-9)), None
    for worth in TAIL_WORTHS:
        tail, _ = rounds_of(lengths[at], own, capacity, worth, 0)
        if best is None or sum(t for _, t in tail) < sum(t for _, t in best):
            best = tail
        if sum(t for _, t in best) <= least:
            break
    for pattern, times in best:
        whole = np.zeros(len(lengths), np.int64)
        whole[at] = pattern
        plan.append((whole, times))
    return plan


def weighed(lengths: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 0, growth: float = GROWTH) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows), how often to use each, and a bound that no solution of the program undercuts.

    Multiplicative weights over all lengths at once: a length is worth exp(-growth * what of it is covered) a piece. A step uses the
    pattern that is worth most, a share STEP of what its scarcest pieces allow. A knapsack prices a new pattern every PRICE_EVERY steps,
    and each step until every length has one; in between the best of the known ones counts. What the second half of the steps
    adds is the solution, scaled so that no length is used more often than there are pieces. The mean worths, priced over all
    lengths, are a dual solution.
    """
    rng, n = np.random.default_rng(seed), counts.astype(float)
    share, worths = np.zeros(len(n)), np.zeros(len(n))
    patterns, uses, most = np.zeros((0, len(n))), np.zeros(0), np.zeros(0)
    known: set[bytes] = set()
    half: tuple[np.ndarray, np.ndarray] | None = None
    steps, t = STEPS + STEPS_A_LENGTH * len(n), 0
    while t < steps:
        worth = np.exp(-np.minimum((share - share.min()) * growth, 600)) / n
        if t % PRICE_EVERY == 0 or len(known) < 2 * len(n) and not patterns.any(0).all():
            some = np.arange(len(n))
            if len(some) > PRICED:
                some = np.sort(np.argpartition(rng.random(len(n)) * -1e-3 - worth * n * (1 + ~patterns.any(0)), PRICED)[:PRICED])
            pattern = np.zeros(len(n))
            pattern[some] = priced(lengths[some], worth[some], counts[some], capacity)
            if pattern.tobytes() not in known:
                known.add(pattern.tobytes())
                on = pattern > 0
                patterns, uses, most = np.vstack([patterns, pattern]), np.append(uses, 0.0), np.append(most, (n[on] / pattern[on]).min())
        values = patterns @ worth
        k = int(values.argmax())
        uses[k] += STEP * most[k]
        share += STEP * most[k] * patterns[k] / n
        t += 1
        if t > steps // 2:
            worths += worth / values[k]
        elif t == steps // 2:
            half = uses.copy(), share.copy()
    first = np.append(half[0], np.zeros(len(uses) - len(half[0])))
    worths /= worths.max()
    best = float(priced(lengths, worths, counts, capacity) @ worths)
    return patterns.astype(np.int64), (uses - first) / (share - half[1]).max(), float(n @ worths) / best


def program_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, growth: float = GROWTH) -> tuple[list[tuple[np.ndarray, int]], float]:
    """The plan of program after program: all patterns of a solution as often as it says, rounded down, and the rest is the next
    program; once rounding leaves little, each pattern once more as far as pieces last. With more than FEW lengths what PROGRAMS
    programs leave over goes to filled_plan(). Also the first program's bound."""
    left, plan, bound, number = counts.copy(), [], None, 0
    while left.any():
        if number == PROGRAMS and len(lengths) > FEW:
            return plan + filled_plan(lengths, left, capacity), bound
        at = np.flatnonzero(left)
        own = left[at]
        patterns, uses, least = weighed(lengths[at], own, capacity, number, growth)
        bound, number = least if bound is None else bound, number + 1
        whole = np.floor(uses + 1e-9).astype(np.int64)
        last = whole.sum() < max(1, ENOUGH * least)
        if last:
            whole, order = np.ceil(uses - 1e-9).astype(np.int64), np.argsort(-uses, kind="stable")
        else:
            order = np.arange(len(uses))
        found = []
        for k in order.tolist():
            on = patterns[k] > 0
            times = min(int(whole[k]), int((own[on] // patterns[k][on]).min()))
            if times:
                found.append((patterns[k], times))
                own = own - times * patterns[k]
        if not found:
            pattern = priced(lengths[at], lengths[at].astype(float), own, capacity)
            on = pattern > 0
            found = [(pattern, int((own[on] // pattern[on]).min()))]
            own = own - found[0][1] * pattern
        for pattern, times in found:
            wide = np.zeros(len(lengths), np.int64)
            wide[at] = pattern
            plan.append((wide, times))
        left[at] = own
    return plan, bound or 0.0


def best_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers that use every piece exactly once, each from a program's solution.

    Where short pieces fill what long ones leave, the fullest patterns meet the bound at once, but for a share of GAP and one sequence (filled_plan). Otherwise the
    program is solved over all lengths and all its patterns are rounded (program_plan); the shorter plan stays.
    """
    plan = filled_plan(lengths, counts, capacity)
    size = lambda x: sum(t for _, t in x)
    if size(plan) <= int(np.ceil(lp_bound(lengths, counts, capacity) * (1 + GAP) - 1e-9)) + 1:
        return plan
    growths = (GROWTH, 2 * GROWTH, GROWTH / 2) if len(lengths) <= FEW else (GROWTH,)
    return min([plan, *(program_plan(lengths, counts, capacity, g)[0] for g in growths)], key=size)


def placements(lengths: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
    """length, first (rank of its first piece), times, base (first sequence), place (offset of the first copy), ordered by length and rank.

    Piece number r of a length belongs to the last row with first <= r; its sequence is base + (r - first) % times, its
    place that of copy (r - first) // times.
    """
    rows, base, used = [], 0, np.zeros(len(lengths), np.int64)
    for pattern, times in plan:
        place = 0
        for i in np.flatnonzero(pattern):
            rows.append((int(lengths[i]), int(used[i]), times, base, place))
            used[i] += pattern[i] * times
            place += int(pattern[i] * lengths[i])
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "times", "base", "place"]).sort_values(["length", "first"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (columns k, piece, length and others, lengths 1 to capacity) with sequence_id and offset.

    Only the histogram of lengths (at most `capacity` numbers) and counts per length and rank bucket (BUCKETS_MOST and a
    bucket per length at most) reach the driver; the plan sent back has a row per pattern and length. Pieces of one
    length are ranked in as many buckets as their number asks for. Equal rows are ranked in any order: each gets a place.
    """
    histogram = pieces.groupBy("length").count().toPandas().sort_values("length")
    if histogram.empty:
        return pieces.selectExpr("*", "0L as sequence_id", "0L as offset")
    lengths, n = histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    places = placements(lengths, best_plan(lengths, n, capacity))
    buckets = np.ones(capacity + 1, np.int64)
    buckets[lengths] = -(-n // max(RANK_ROWS, int(n.sum()) // BUCKETS_MOST))
    base_of = np.cumsum(buckets) - buckets
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("k", "piece"), F.get(F.lit(buckets.tolist()), F.col("length").cast("int"))))
    counts = bucketed.groupBy("length", "bucket").count().toPandas().sort_values(["length", "bucket"], ignore_index=True)
    before = np.zeros(int(buckets.sum()), np.int64)
    before[base_of[counts["length"].to_numpy()] + counts["bucket"].to_numpy()] = (counts.groupby("length")["count"].cumsum() - counts["count"]).to_numpy()
    wide = np.int64(1) << 40
    keys = places["length"].to_numpy(np.int64) * wide + places["first"].to_numpy(np.int64)
    first, times, base, place = (places[c].to_numpy(np.int64) for c in ("first", "times", "base", "place"))
    shared = pieces.sparkSession.sparkContext.broadcast((before, base_of, keys, first, times, base, place))
    ranked = bucketed.selectExpr("*", "row_number() over (partition by length, bucket order by struct(k, piece)) - 1 as r")

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, base_of, keys, first, times, base, place = shared.value
        for f in frames:
            length = f["length"].to_numpy(np.int64)
            rank = f["r"].to_numpy(np.int64) + before[base_of[length] + f["bucket"].to_numpy()]
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            rank = rank - first[at]
            yield f.drop(columns=["bucket", "r"]).assign(sequence_id=base[at] + rank % times[at], offset=place[at] + rank // times[at] * length)

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.mapInPandas(released(placed), f"{schema}, sequence_id long, offset long")


@within_bounds(4096, 5 << 20)  # the more texts, the rarer a word is met again in another batch
def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document.

    A null text counts as empty: one piece of END_ID alone. Null keys stay null; repeated rows are packed one by one;
    other columns are ignored; an empty table gives an empty one.
    """
    pieces = materialize(pieces_of(docs, path, capacity, key, text), "pieces")
    return pack(pieces, capacity).withColumnRenamed("k", key)

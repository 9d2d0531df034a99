"""Toxicity by noisy-channel deobfuscation.

Tokens that can be read in more than one way (leetspeak, inner separators, stretched letters,
letters spaced apart) become character lattices whose arcs carry the channel's costs; Viterbi decoding
under a character trigram model restores the likeliest word. In letters spaced apart each gap may be
the end of a word. Restored texts are scored by a lexicon of words and word beginnings
learned from labelled rows: precise features, each supported by several different contexts, so that
copies of one text count once, and by more toxic rows than luck would give. A text's score is the noisy-or
of the precisions of the distinct features it holds.

The character model counts the words of all texts, labelled or not, without their labels. The
lexicon is fitted on a bounded sample of labelled rows (about ``sample`` of each mark, at most twice
that and ``sampling.MOST_BYTES`` of text). Defined results: null and empty texts have score 0; without
learnable rows all scores are 0; an empty table gives no rows; repeated rows score alike, of labels
that repeat an id the greater mark counts; among paths of one cost the first in the lattice's order is
taken; long texts are read whole, piece by piece of rows; labels, language, source and id are never
inputs of a score, and columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, has_letter, pieces
from .sampling import joined_sample

SAMPLE, PREDICT, SUPPORT = 1500, 0.7, 3
#: Features without meaning that luck may let into the lexicon, as an upper bound of their expected number.
CHANCE = 20
#: Counters of the character model; distinct trigrams, and four times as many tokens, that a task holds before it passes them on.
COUNTERS, HELD = 1 << 20, 1 << 16
#: Least precision of a word, and of a word's beginning, which many clean words may share.
PRECISION, BEGINNING = 0.74, 0.97
#: What letters a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
    "€": "e", "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
_EDGE = ".,;:?\"'`~()[]{}<>…“”„«»¿¡"
_SEPARATORS = frozenset(".-_*~'`,·/\\")
_ODD = re.compile(r"[0-9@$!|+€(*#%]|[^\W\d_][._\-~'`,·/\\]+[^\W\d_]|([^\W\d_])\1\1")
#: Costs of the channel, as negative logarithms: a sign for a letter; a sign that means nothing, inside a
#: word or at its edge; a letter written twice for once.
SUBSTITUTE, DROP, DROP_AT_EDGE, TWICE = 1.0, 3.0, 1.5, 1.0
#: Punctuation at a token's edges that stands for no letter.
_PURE = "".join(c for c in _EDGE if c not in LEET)
_SPACED = re.compile(r"(?<![^\s])(?:[^\s][ \t]+){2,}[^\s](?![^\s])")
_CLEAN = re.compile(r"[\W\d_]+")
_TRIPLE = re.compile(r"(.)\1\1")
#: Tokens whose reading a worker remembers.
MEMO = 1 << 18


class CharModel:
    """Character trigrams with backoff, over letters and word edges.

    ``counts`` holds a counter for each hashed key: a trigram, its last two letters, its last, and
    with a ``<`` the contexts of the first two. So its size does not follow the alphabet or the corpus.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def seen(self, key: str) -> float:
        return float(self.counts[zlib.crc32(key.encode()) & len(self.counts) - 1])

    @lru_cache(1 << 16)  # noqa: B019
    def cost(self, a: str, b: str, c: str) -> float:
        p1 = (self.seen(c) + 0.5) / (self.seen("") + 200)
        p2 = (self.seen(b + c) + 4 * p1) / (self.seen("<" + b) + 4)
        return -math.log((self.seen(a + b + c) + 4 * p2) / (self.seen("<" + a + b) + 4))

    def decode(self, token: str) -> str:
        """The likeliest word behind a token, or words where it has gaps, by Viterbi over its lattice."""
        best = {("^", "^"): (0.0, None)}  # state -> cost and a chain of letters
        for ways in lattice(token):
            new: dict = {}
            for (a, b), (cost, chain) in best.items():
                for way, extra in ways:
                    x, y, total, tail = a, b, cost + extra, chain
                    for z in way:
                        if z == " ":
                            total += self.cost(x, y, "$")
                            x, y, tail = "^", "^", (tail, z)
                        else:
                            total += self.cost(x, y, z)
                            x, y, tail = y, z, (tail, z)
                    if total < new.get((x, y), (math.inf,))[0]:
                        new[x, y] = (total, tail)
            best = new
        _, chain = min(((cost + self.cost(a, b, "$"), chain) for (a, b), (cost, chain) in best.items()), key=lambda v: v[0])
        out = []
        while chain:
            chain, c = chain
            out.append(c)
        return "".join(reversed(out))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character what it may stand for, and the channel's cost of that."""
    runs: list[tuple[str, int]] = []
    for c in token:
        runs[-1:] = [(c, runs[-1][1] + 1)] if runs and runs[-1][0] == c else [*runs[-1:], (c, 1)]
    out = []
    for k, (c, n) in enumerate(runs):
        if c == " ":
            out.append([("", 0.0), (" ", 0.0)])
        elif c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, TWICE if n == 2 else 0.0), (c + c, 0.0)])
        else:
            ways = [(x * m, SUBSTITUTE) for x in LEET.get(c, "") for m in ((1,) if n == 1 else (1, 2))]
            if c not in LEET:
                ways.append(("", 0.0))
            elif k in (0, len(runs) - 1):
                ways.append(("", DROP_AT_EDGE))
            elif c in _SEPARATORS:
                ways.append(("", DROP))
            out.append(ways)
    return out


def trigrams(tokens: Counter[str]) -> Counter[str]:
    """Trigrams of the tokens that are words, as often as their tokens are."""
    out: Counter[str] = Counter()
    for token, n in tokens.items():
        w = token.strip(_EDGE + "!")
        if w.isalpha():
            s = "^^" + w + "$"
            for i in range(len(s) - 2):
                out[s[i : i + 3]] += n
    return out


def char_model(docs: DataFrame, counters: int = COUNTERS) -> CharModel:
    """Counts over the words of all texts of ``docs``; ``counters``: a power of two.

    A task folds its texts into trigrams first, so what is shuffled is small; the driver gets at
    most ``counters`` numbers.
    """

    def run(batches):
        tokens, grams = Counter(), Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array([*grams], pa.string()), pa.array([*grams.values()], pa.int64())], ["gram", "n"])
            grams.clear()
            return out

        for batch in batches:
            for piece in pieces(batch):
                for text in piece["text"].to_pylist():
                    tokens.update(text.lower().split())
                if len(tokens) > 4 * HELD:
                    grams.update(trigrams(tokens))
                    tokens.clear()
                if len(grams) > HELD:
                    yield emit()
        grams.update(trigrams(tokens))
        yield emit()

    grams = docs.select("text").filter("text is not null").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    g = F.col("gram")
    keys = F.explode(F.array(g, F.substring(g, 2, 2), F.substring(g, 3, 1), F.concat(F.lit("<"), F.substring(g, 1, 2)),
        F.concat(F.lit("<"), F.substring(g, 2, 1)), F.lit("")))
    at = F.crc32(F.col("key").cast("binary")).bitwiseAND(F.lit(counters - 1))
    rows = grams.select(keys.alias("key"), "n").groupBy(at.alias("at")).agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(counters, np.float32)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return CharModel(counts)


def _gapped(run: str) -> str:
    """A run of single characters with a blank at each gap; only wider gaps where widths differ."""
    parts = re.split(r"([ \t]+)", run)
    gaps = parts[1::2]
    least = min(map(len, gaps))
    if max(map(len, gaps)) == least:
        return " ".join(parts[::2])
    return "".join(c if k % 2 == 0 else " " if len(c) > least else "" for k, c in enumerate(parts))


def readings(token: str, model: CharModel) -> tuple[str, ...]:
    """What a lower-case token may say: itself or what its odd signs stand for, and a second reading
    where signs at its edges may be letters."""
    if token.isalpha() and not _TRIPLE.search(token):
        return (token,)
    core, outer = token.strip(_EDGE).rstrip("!"), token.strip(_PURE)
    if core.isalpha() and not _TRIPLE.search(core):
        found = core
    else:
        found = _CLEAN.sub("", core) if not _ODD.search(core) or not has_letter(core) else model.decode(core)
    other = model.decode(outer) if outer != core and has_letter(outer) else found
    return (found,) if other == found else (found, other)


def spelt(low: str, model: CharModel) -> list[str]:
    """Words that letters spaced apart spell; a one-letter word may stand at either end of a run."""
    out = []
    for m in _SPACED.finditer(low):
        run = "".join(m[0].split())
        if has_letter(run):
            out += [model.decode(part.strip(_EDGE)) for part in {run, run[1:], run[:-1], run[1:-1]}]
            out += model.decode(_gapped(m[0]).strip(_EDGE)).split()
    return out


def restored(text: str, model: CharModel, memo: dict[str, tuple[str, ...]]) -> tuple[list[str], list[str]]:
    """(tokens of the text, restored where odd; words that letters spaced apart spell, and second
    readings of tokens)."""
    low = text.lower()

    def word(token: str) -> tuple[str, ...]:
        found = memo.get(token)
        if found is None:
            if len(memo) > MEMO:
                memo.clear()
            found = memo[token] = readings(token, model)
        return found

    tokens = [word(t) for t in low.split()]
    more = [*spelt(low, model), *(w for t in tokens for w in t[1:])]
    return [t[0] for t in tokens], [w for w in more if w]


def features(w: str) -> tuple[str, ...]:
    return (w, w[:4] + "*", w[:5] + "*") if len(w) > 5 else (w, w[:4] + "*") if len(w) == 5 else (w,)


def learn(rows: list[tuple[bytes, int]], model: CharModel, weight: dict[int, float] | None = None) -> dict[str, float]:
    """The lexicon (feature -> precision). weight: rows that one of a mark stands for."""
    texts = [(t.decode(), int(y)) for t, y in rows]
    memo: dict[str, tuple[str, ...]] = {}
    ones: dict[str, set[int]] = defaultdict(set)
    contexts: dict[str, set[str]] = defaultdict(set)
    zeros: Counter[str] = Counter()
    positives = 0
    for t, y in texts:
        tokens, joined = restored(t, model, memo)
        if y:
            last = ""
            for w in [*tokens, *joined]:
                for f in features(w) if w else ():
                    ones[f].add(positives)
                    contexts[f].add(last)
                last = w
            positives += 1
        else:
            zeros.update({f for w in {*tokens, *joined} if w for f in features(w)})
    per = (weight or {}).get(0, 1.0) / (weight or {}).get(1, 1.0)
    p = {}
    for f, rows_of in ones.items():
        n = min(len(rows_of), len(contexts[f]))
        share = (n + 0.2) / (n + zeros[f] * per + 1.2)
        precise = share >= PRECISION if f[-1] != "*" else share >= BEGINNING or not zeros[f] and share >= PRECISION
        if n >= SUPPORT and precise and by_luck(n, zeros[f], positives / len(texts)) * len(ones) <= CHANCE:
            p[f] = share
    return p


def by_luck(ones: int, zeros: int, rate: float) -> float:
    """An upper bound (Chernoff) of the probability that a feature without meaning is in so many toxic
    rows of ``ones + zeros``, where a share ``rate`` of all rows is toxic."""
    n = ones + zeros
    x = ones / n
    if x <= rate or rate >= 1:
        return 1.0
    return math.exp(-n * (x * math.log(x / rate) + ((1 - x) * math.log((1 - x) / (1 - rate)) if x < 1 else 0.0)))


def hits_of(words, lexicon: dict[str, float]) -> tuple[str, ...]:
    return tuple(f for w in words if w for f in features(w) if f in lexicon)


def score(text: str | None, model: CharModel, lexicon: dict[str, float], memo: dict[str, tuple[str, ...]]) -> float:
    """Noisy-or of the distinct features of the lexicon that a text holds; ``memo``: those of tokens met before."""
    if not text:
        return 0.0
    low = text.lower()
    tokens, seen = set(low.split()), set()
    for token in tokens:
        found = memo.get(token)
        if found is None:
            if len(memo) > MEMO:
                memo.clear()
            found = memo[token] = hits_of(readings(token, model), lexicon)
        if found:
            seen.update(found)
    if any(len(t) == 1 for t in tokens):
        seen.update(hits_of(spelt(low, model), lexicon))
    return 1 - math.prod(1 - lexicon[f] for f in sorted(seen))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, predict: float = PREDICT) -> DataFrame:
    """doc_id, score, predicted. Learns from ``labels`` (doc_id, toxic) alone."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = joined_sample(docs, marks, "toxic", sample)
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    taken = Counter(y for _, y in rows)
    model = char_model(docs) if any(y for _, y in rows) else None
    lexicon = learn(rows, model, {y: counts[y] / taken[y] for y in taken}) if model else {}

    def make():
        memo: dict[str, tuple[str, ...]] = {}

        def work(batch):
            values = [score(t, model, lexicon, memo) if model else 0.0 for t in batch["text"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.float64()),
                pa.array([int(v >= predict) for v in values], pa.int32())], ["doc_id", "score", "predicted"])

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, predicted int")

"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

Words of a piece of rows become numbers; windows get polynomial hashes from prefix sums, so one
pass serves every length. Windows are sorted by (document, hash); neighbours with one hash are
compared word by word, so equal hashes of different windows do no harm.

Characters are code points, of n-grams and of lines alike, and the first copy counts as well as the
others. The base rule rejects texts under ``MIN_WORDS`` words, clean ones among them.

Defined results: null and empty texts have no words and fail the base rule; a share at its limit is
kept; repeated rows are judged each by itself; an empty table gives no rows; a very long text is a piece
of its own and measured whole; other columns are not read, or go through unchanged in ``row``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, byte_texts, judged, mix64

#: n-gram length -> largest share of a text's word characters inside n-grams found twice or more.
COVERAGE = {5: 0.40, 8: 0.30, 10: 0.30}
#: Largest share of the characters of a text's lines with a word in lines found twice or more, the first included.
LINE_SHARE = 0.30
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
_NOT_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, coverage array<double>"


def repeated(ids: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Which words are inside a window of ``size`` words found twice or more in their document."""
    n = len(ids) - size + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(ids), _BASE))))
    back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _INVERSE))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(ids + 1) * powers[:-1], dtype=np.uint64)))
    at = np.flatnonzero(doc[size - 1 :] == doc[:n])
    hashes = ((sums[size:] - sums[:n]) * back)[at] + mix64(doc[at])
    order = np.argsort(hashes)
    hashes, at = hashes[order], at[order]
    alike = np.flatnonzero(hashes[1:] == hashes[:-1])
    a, b = at[alike], at[alike + 1]
    same = doc[a] == doc[b]
    for j in range(size):
        same &= ids[a + j] == ids[b + j]
    if not same.all():  # different windows share a hash: compare them in full
        rows = np.unique(np.concatenate((alike, alike + 1)))
        windows = np.column_stack([doc[at[rows]], *(ids[at[rows] + j] for j in range(size))])
        _, group, many = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        found = at[rows[many[group.ravel()] > 1]]
    else:
        found = np.concatenate((a, b))
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(found)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = [t.split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
    chars = np.fromiter((len(w.decode()) for w in number), np.int64, len(number))[ids]
    doc = np.repeat(np.arange(len(texts)), n)
    total = lambda x: np.bincount(doc, x, len(texts))
    out = {"n_words": n, "word_chars": total(chars).astype(np.int64), "n_symbols": np.array([len(t.translate(None, _NOT_SYMBOLS)) for t in texts], np.int64)}
    again, share = [], []
    for t in texts:
        many = Counter(line for line in t.split(b"\n") if line.strip())
        again.append(many.total() - len(many))
        twice = sum(n * len(line.decode()) for line, n in many.items() if n > 1)
        share.append(twice / max(sum(n * len(line.decode()) for line, n in many.items()), 1) if twice else 0.0)
    out |= {"n_dup_lines": np.array(again, np.int64), "line_share": np.array(share)}
    for size in lengths:
        inside = repeated(ids, doc, size)
        if size == REPEAT_WINDOW:
            out["n_repeat_words"] = total(inside).astype(np.int64)
        out[f"coverage_{size}"] = total(chars * inside) / np.maximum(out["word_chars"], 1)
    return out


def quality_rules(docs: DataFrame, coverage: dict[int, float] | None = None, line_share: float = LINE_SHARE, rows: bool = False) -> DataFrame:
    """A row for each document with its counts, the base rule and the coverage verdict; ``rows``: and its columns as ``row``."""
    limits = coverage or COVERAGE
    lengths = tuple(sorted({*limits, REPEAT_WINDOW}))

    def work(batch):
        m = measure(byte_texts(batch["text"]), lengths)
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
        kept = ~failed & (m["line_share"] <= line_share)
        for size, most in limits.items():
            kept &= m[f"coverage_{size}"] <= most
        shares = np.column_stack([m[f"coverage_{s}"] for s in lengths])
        cols = [*(pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept),
            pa.array(m["line_share"]), pa.array(list(shares), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *cols], [x.split()[0] for x in _OUT.split(", ")])

    return arrow_map(judged(docs, rows), lambda: work, _OUT)

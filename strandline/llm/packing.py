"""Best-fit packing: length patterns with repeat counts fitted by non-negative least squares.

Documents become token pieces once, written with their length, checksum, task number and rank
among the task's pieces of that length. A histogram of at most ``seq_len`` lengths is all that
the driver sees. Patterns of one to three lengths that fill a sequence get repeat counts by
projected coordinate descent on ||Ax - h||, rounded down; what remains is packed by best fit on
the histogram: the longest length first, then the one or two lengths that fill the gap best.
The plan is a list of (pattern, repeats), whose size depends on ``seq_len`` and not on the data,
so each piece finds its place by arithmetic from its rank; no task needs more than its rows.

Defined results: null and empty texts are one end token; longer documents are cut from the end,
so that only the first piece may be shorter; repeated rows are packed each by itself; an empty
table gives no rows. Columns other than the id and the text are not read.

The byte-level BPE of the ``tokenizers`` file runs in tiktoken, built from that file's own
vocabulary and compared on a probe text with ``tokenizers`` at each start: same ids, a third of
the time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize

SEQ_LEN = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Fixed value: the pre-tokenizer pattern that byte-level BPE files of this kind stand for.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBE = "It's  a test, naïve 123\n\n\tübung <| 日本 !!%% x"
#: Characters of one run (of blanks, letters, ...) from which a text goes to ``tokenizers`` itself.
LONG_RUN = 1 << 14
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\w{{{LONG_RUN}}}|[^\w\s]{{{LONG_RUN}}}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from text to ids, the same ids as the ``tokenizers`` file gives with
    ``add_special_tokens=False``.

    tiktoken's pattern matcher keeps a stack as deep as a run of blanks, so a text with a very long
    run goes to ``tokenizers`` itself, as does one that spells an added token of the file.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def exact(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if fast.encode_ordinary(_PROBE) != exact(_PROBE):
        return exact

    def encode(text: str) -> list[int]:
        if any(t in text for t in added) or len(text) > LONG_RUN and _LONG_RUN.search(text):
            return exact(text)
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; only the first may be short."""
    first = n % most or min(n, most)
    return [(0, first), *((a, most) for a in range(first, n, most))]


def tokenized(docs: DataFrame, tokenizer: str | None, seq_len: int, end_id: int) -> DataFrame:
    path = tokenizer

    def make():
        from pyspark import TaskContext

        encode, part, seen = encoder(path or default_tokenizer()), TaskContext.get().partitionId(), defaultdict(int)

        def work(batch):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                for k, (a, n) in enumerate(cut(len(ids), seq_len)):
                    rows.append((doc, k, a, n, zlib.crc32(ids[a : a + n].tobytes()), part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _PIECES.split(", ")])

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, _PIECES)


def patterns(lengths: list[int], full: int) -> list[tuple[int, ...]]:
    """All multisets of at most three of the lengths that sum to ``full``, longest first."""
    have, out = set(lengths), [(full,)] if full in lengths else []
    down = sorted(have, reverse=True)
    for a in down:
        if a >= full:
            continue
        if full - a <= a and full - a in have:
            out.append((a, full - a))
        for b in range(min(a, full - a - 1), (full - a + 1) // 2 - 1, -1):
            if b in have and full - a - b in have:
                out.append((a, b, full - a - b))
    return out


def fit(hist: dict[int, int], full: int, sweeps: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Non-negative least squares by projected coordinate descent, rounded to what the histogram has."""
    pats = patterns(list(hist), full)
    cols = [tuple(Counter(p).items()) for p in pats]
    left, x = {k: float(v) for k, v in hist.items()}, [0.0] * len(cols)
    for _ in range(sweeps):
        for i, col in enumerate(cols):
            step = sum(left[n] * c for n, c in col) / sum(c * c for _, c in col)
            step = max(step, -x[i])
            if step:
                x[i] += step
                for n, c in col:
                    left[n] -= c * step
    out, have = [], dict(hist)
    for p, col, v in zip(pats, cols, x, strict=True):
        k = min(int(v + 1e-9), *(have[n] // c for n, c in col)) if v >= 1 else 0
        if k:
            out.append((p, k))
            for n, c in col:
                have[n] -= c * k
    return out


def pack_rest(have: np.ndarray, full: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on counts by length: each step uses a pattern as often as the counts allow."""
    have, out = have.copy(), []
    while have.any():
        used: Counter[int] = Counter()
        top = int(np.flatnonzero(have)[-1])
        used[top] += 1
        gap = full - top
        while gap > 0:
            free = have[: gap + 1].copy()
            for n, c in used.items():
                if n <= gap:
                    free[n] -= c
            at = np.flatnonzero(free > 0)
            if not len(at):
                break
            add = (int(at[-1]),)
            if add[0] < gap and len(at):
                # the best second length beside each first one
                second = np.searchsorted(at, gap - at, "right") - 1
                ok = second >= 0
                same = ok & (at[second] == at) & (free[at] < 2)
                second = np.where(same, second - 1, second)
                ok &= second >= 0
                sums = np.where(ok, at + at[second], 0)
                best = int(len(sums) - 1 - np.argmax(sums[::-1]))
                if sums[best] > add[0]:
                    add = (int(at[best]), int(at[second[best]]))
            used.update(add)
            gap -= sum(add)
        times = min(int(have[n]) // c for n, c in used.items())
        for n, c in used.items():
            have[n] -= c * times
        out.append((tuple(used.elements()), times))
    return out


def plan(hist: dict[int, int], full: int) -> list[tuple[tuple[int, ...], int]]:
    fitted = fit(hist, full)
    have = np.zeros(full + 1, np.int64)
    for n, c in hist.items():
        have[n] = c
    for p, k in fitted:
        for n in p:
            have[n] -= k
    return fitted + pack_rest(have, full)


def slots(packed: list[tuple[tuple[int, ...], int]], full: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies a sequence, first sequence, offset of the first copy)."""
    out, seen, seq = defaultdict(list), Counter(), 0
    for p, times in packed:
        at = 0
        for n, c in sorted(Counter(p).items(), reverse=True):
            out[n].append((seen[n], c, seq, at))
            seen[n] += c * times
            at += n * c
        seq += times
    return {n: np.array(v, np.int64) for n, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(tokenized(docs, tokenizer, seq_len, end_id), "pieces")
    counts = materialize(rows.groupBy("part", "length").count(), "counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = slots(plan(hist, seq_len), seq_len) if hist else {}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    base = materialize(base, "base")
    # merged, not broadcast: the base table grows with the number of tasks
    ranked = rows.join(base.hint("merge"), (rows.part == base.p) & (rows.length == base.l)).select("doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.col("nth")).alias("rank"))

    def make():
        def work(batch):
            size, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
                n = int(size[rows[0]])
                at = places[n]
                row = at[np.searchsorted(at[:, 0], rank[rows], "right") - 1]
                k = rank[rows] - row[:, 0]
                seq[rows] = row[:, 2] + k // row[:, 1]
                off[rows] = row[:, 3] + k % row[:, 1] * n
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            return pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], [c.split()[0] for c in _PLACED.split(", ")])

        return work

    return arrow_map(ranked, make, _PLACED)

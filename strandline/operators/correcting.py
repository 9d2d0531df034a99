"""Read correction within a task: each read goes through its rounds by itself, and the reads of a batch look k-mers up together."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .coded import Table, bases, pieces, windows


@dataclass(frozen=True)
class Rules:
    k: int
    least: int
    rounds: int | None
    window: int
    errors: int
    collision: float
    chance: float


def corrected(reads: DataFrame, table: Table, rules: Rules) -> DataFrame:
    """(id, seq, cut) -> (id, seq, changes, cut), as ``unitigs.correct_reads`` tells."""
    kind = reads.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, cuts = batch.column(0), batch.column(2).to_pylist()
            for at, some in pieces(batch.column(1).to_pylist()):
                out = _all(some, cuts[at : at + len(some)], table, rules)
                keep = [i for i, x in enumerate(out) if x is not None]
                seqs, changes, cut = zip(*(out[i] for i in keep), strict=True) if keep else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([at + i for i in keep], pa.int64())), pa.array(seqs, pa.string()), pa.array(changes, pa.int32()), pa.array(cut, pa.int32())],
                    ["id", "seq", "changes", "cut"],
                )

    return reads.select("id", "seq", "cut").mapInArrow(run, f"id {kind}, seq string, changes int, cut int")


def _all(seqs, cuts, table, rules):
    """What becomes of each read; steps of all reads that are open ask the table at once."""
    out = [None] * len(seqs)
    going = {}
    for i, s in enumerate(seqs):
        if s is not None and len(s) >= rules.k:
            going[i] = _steps(s, cuts[i], rules)
    asked = {i: next(g) for i, g in going.items()}
    while asked:
        sizes = [len(x) for x in asked.values()]
        answers = np.split(table(np.concatenate(list(asked.values()))), np.cumsum(sizes)[:-1])
        following = {}
        for i, answer in zip(asked, answers, strict=True):
            try:
                following[i] = going[i].send(answer)
            except StopIteration as end:
                out[i] = end.value
        asked = following
    return out


def _counted(a: np.ndarray, k: int):
    """Counts of the windows of bases; those with something else have none."""
    fore, back, sound = windows(a, k)
    got = yield np.minimum(fore, back)[sound]
    out = np.zeros(len(sound), np.int64)
    out[sound] = got
    return out


def _steps(text: str, cut: int, rules: Rules):
    """Yields the numbers of k-mers it asks for, gets their counts, returns (seq, changes, cut) or None. Places are
    counted from 1, those of windows by their first base."""
    k, a, letters = rules.k, bases(text).copy(), list(text)
    kept, fore_at, back_at, changes = set(), [], [], 0
    good = (yield from _counted(a, k)) >= rules.least
    step = 0
    while True:
        n = len(letters) - k + 1
        if not good.any():  # an anchor is a trusted k-mer, not one that merely stays
            return None
        held = good.copy()
        held[[i - 1 for i in kept]] = True
        edges = np.flatnonzero(np.diff(held, prepend=False, append=False))
        begins, ends = (edges[::2] + 1).tolist(), edges[1::2].tolist()
        # a run behind the anchor's counts on its own if it begins beyond the base of the break before it
        fore = [e + 1 for j, e in enumerate(ends) if e < n and (j == 0 or begins[j] > ends[j - 1] + k)]
        back = begins[0] - 1 if begins[0] > 1 else None
        open_ = ends[0] < n
        if not open_ and back is None:
            return "".join(letters), changes, cut
        if step == rules.rounds:
            begin, end = (back or 0) + 1, fore[0] + k - 2 if open_ else len(letters)
            return "".join(letters[begin - 1 : end]), changes, cut + len(letters) - (end - begin + 1)
        step += 1
        fore = fore if open_ else []
        asks = [("fore", i, i + k - 1) for i in fore] + ([("back", back, back)] if back else [])
        said = yield from _verdicts(a, asks, rules)
        fixes = {"fore": [], "back": []}
        stays = {"fore": [], "back": []}
        for (side, i, at), verdict in zip(asks, said, strict=True):
            if verdict == "stays":
                stays[side].append(i)
            elif verdict is not None:
                fixes[side].append((at, verdict))
        known = {at - k + 1 for at, _ in fixes["fore"]} | set(stays["fore"])
        # the first break behind a run that has no way on: the read ends before its base
        dead = next((i for i in fore if i not in known), None)
        begin, end = 1, len(letters) if dead is None else dead + k - 2
        if back is not None and not fixes["back"] and not stays["back"]:
            begin = back + 1
        fixed = fixes["fore"] + fixes["back"]
        for at, base in fixed:
            a[at - 1], letters[at - 1] = base, "ACGT"[base]
        fore_at = sorted(fore_at + [at for at, _ in fixes["fore"]])
        back_at = sorted(back_at + [at for at, _ in fixes["back"]], reverse=True)
        if (crowd := _crowded(fore_at, rules)) is not None:
            end = min(end, crowd - 1)
        if (crowd := _crowded(back_at, rules)) is not None:
            begin = max(begin, crowd + 1)
        kept |= {*stays["fore"], *stays["back"]}
        # windows over a fix are counted anew
        touched = np.zeros(n, bool)
        for at, _ in fixed:
            touched[max(at - k, 0) : at] = True
        cut += len(letters) - (end - begin + 1)
        a, letters = a[begin - 1 : max(end, 0)], letters[begin - 1 : max(end, 0)]
        if len(letters) < k:
            return None
        good, touched = good[begin - 1 : end - k + 1], touched[begin - 1 : end - k + 1]
        for x, y in np.flatnonzero(np.diff(touched, prepend=False, append=False)).reshape(-1, 2).tolist():
            good[x:y] = (yield from _counted(a[x : y + k - 1], k)) >= rules.least
        fore_at, back_at = ([p - begin + 1 for p in places if begin <= p <= end] for places in (fore_at, back_at))
        # a kept window counts by its first base, whose last must be there too
        kept = {i - begin + 1 for i in kept if i >= begin and i + k - 1 <= end}
        changes = len(fore_at) + len(back_at)


def _verdicts(a, asks, rules):
    """For each (side, window, place): ``stays``, the base to put there, or None."""
    first, at = np.array([i for _, i, _ in asks]) - 1, np.array([p for _, _, p in asks]) - 1
    m = np.repeat(a[first[:, None] + np.arange(rules.k)][:, None, :], 4, axis=1)  # an ask, a base, a place
    m[np.arange(len(asks))[:, None], np.arange(4), (at - first)[:, None]] = np.arange(4)
    sound = ~(m > 3).any(axis=2)
    wide = (m & 3).astype(np.int64)
    up = 1 << 2 * np.arange(rules.k, dtype=np.int64)
    codes = np.minimum((wide * up[::-1]).sum(axis=2), ((3 - wide) * up).sum(axis=2))
    counts = np.zeros(codes.shape, np.int64)
    counts[sound] = yield codes[sound]
    out = []
    for own, row in zip(a[at].tolist(), counts.tolist(), strict=True):
        mine = row[own] if own < 4 else 0
        others = sorted((n, b) for b, n in enumerate(row) if b != own and n >= rules.least and n > 0)
        if mine and _poisson(sum(row) * rules.collision, mine) < rules.chance:
            out.append("stays")
        elif others and (len(others) == 1 or others[-1][0] != others[-2][0]):
            out.append(others[-1][1])
        else:
            out.append(None)
    return out


def _poisson(mean: float, i: int) -> float:
    return math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) if mean > 0 else 1.0


def _crowded(fixes: list[int], rules: Rules) -> int | None:
    """The place of the first of more than ``errors`` fixes within ``window`` bases, in the order of the list."""
    return next((f for f, g in zip(fixes, fixes[rules.errors :]) if abs(g - f) < rules.window), None)  # noqa: B905

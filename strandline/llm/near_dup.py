"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of XXH64 over a text's word shingles. Documents with one
fingerprint are one class; only classes go on. Fingerprints at most ``distance`` bits apart differ
in three segments by little: with ball radii r0 + r1 + r2 = distance - 2, some segment differs by
at most its radius (else the sum would be over ``distance``). Each class enters, for each segment,
its own value and the values of the Hamming ball around it; a ball's row meets the rows whose own value
its key is, and complete distances are verified. A bucket gives a spanning set of links: small ones by
comparing rows at each lag of a sorted run, large ones by breadth-first search from pivots, in which a
reached row is never compared again with another reached one. So links grow with the rows and
not with a group's square, and no link between different texts is lost. Buckets with very many own
fingerprints are dealt by further bits, so that no task holds one whole.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
repeated rows share a class; a null id names no component, but its row has one if others share its
class; a bit set in exactly half of the shingles is 0; a long text is hashed whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_texts, materialize
from .components import connected_components

SHINGLE, DISTANCE, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
WIDE_SEGMENTS = ((0, 32), (32, 32))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LAGS = 16
CARRY = 1 << 16
#: Own fingerprints of a bucket from which it is dealt by further bits.
HOT_BUCKET = 1 << 14


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = hashes[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long."""

    def make():
        def work(batch):
            fps = np.array([simhash(shingle_hashes(t, size, seed)) for t in byte_texts(batch["text"])], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], ["doc_id", "fp"])

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def segments_for(classes: int) -> tuple[tuple[int, int], ...]:
    """(place, width) of each segment: three, and two wider ones with larger balls beyond 2^28 fingerprints,
    where buckets of 21 bits would fill with chance neighbours. Links are the same either way."""
    return SEGMENTS if classes <= 1 << 28 else WIDE_SEGMENTS


def _balls(distance: int, segments: tuple[tuple[int, int], ...]) -> list[tuple[int, int, int]]:
    """(segment, shift, mask) of each key: a segment's value xor each mask of its ball."""
    spare = max(0, distance - len(segments) + 1)
    radii = [spare // len(segments) + (k < spare % len(segments)) for k in range(len(segments))]
    return [(k, at, sum(1 << b for b in bits)) for k, ((at, width), r) in enumerate(zip(segments, radii,
        strict=True)) for n in range(r + 1) for bits in combinations(range(width), n)]


def _search(fps: np.ndarray, ids: np.ndarray, distance: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning links of distinct fingerprints by breadth-first search, and the group of each."""
    links, open_, group, groups = [], np.arange(len(fps)), np.zeros(len(fps), np.int64), 0
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        group[queue] = groups
        while queue and len(open_):
            p = queue.pop()
            near = np.bitwise_count(fps[open_] ^ fps[p]) <= distance
            got, open_ = open_[near], open_[~near]
            group[got] = groups
            links += [(int(ids[p]), int(ids[q])) for q in got]
            queue += got.tolist()
        groups += 1
    return links, group


def _bucket(ball: np.ndarray, fps: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of one large bucket: its own fingerprints span each other, and each that came by its ball is
    linked with one of every group of them that it reaches."""
    own = np.flatnonzero(~ball)
    if not len(own):
        return []
    links, group = _search(fps[own], ids[own], distance)
    by = np.argsort(group, kind="stable")
    own, group = own[by], group[by]
    step = max(1, (1 << 22) // len(own))
    guests = np.flatnonzero(ball)
    for a in range(0, len(guests), step):
        some = guests[a : a + step]
        row, col = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[own][None, :]) <= distance)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (group[col[1:]] != group[col[:-1]])
        links += zip(ids[some[row[new]]].tolist(), ids[own[col[new]]].tolist(), strict=True)
    return links


def _links(keys: np.ndarray, ball: np.ndarray, fps: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; the rows are sorted by key."""
    cut = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    size = np.diff(cut)
    a, b = [], []
    small = np.repeat(size <= LAGS, size)
    for lag in range(1, min(LAGS, int(size.max(initial=0)))):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:] & ~(ball[lag:] & ball[:-lag]))
        near = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= distance]
        a.append(ids[near])
        b.append(ids[near + lag])
    for k in np.flatnonzero(size > LAGS):
        rows = slice(cut[k], cut[k + 1])
        got = np.array(_bucket(ball[rows], fps[rows], ids[rows], distance), np.int64).reshape(-1, 2)
        a.append(got[:, 0])
        b.append(got[:, 1])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _split_hot(rows: DataFrame, distance: int, segments: tuple[tuple[int, int], ...], hot_bucket: int) -> DataFrame:
    """Buckets with more than ``hot_bucket`` own fingerprints are dealt by further bits: of distance + 1
    parts of the bits outside the segment one is equal in any two that are to be linked."""
    hot = materialize(rows.filter("not ball").groupBy("key").count().filter(F.col("count") > hot_bucket).select("key", F.lit(True).alias("hot")), "hot")
    if not hot.limit(1).count():
        return rows
    fp, bits = F.col("fp"), -(-64 // (distance + 1))
    rest = F.lit(None).cast("long")
    for k, (at, width) in enumerate(segments):
        low = fp.bitwiseAND((1 << at) - 1) if at else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, at + width), at) if at + width < 64 else F.lit(0).cast("long")
        rest = F.when(F.shiftright("key", 32) == k, high.bitwiseOR(low)).otherwise(rest)
    parts = F.array(*(F.xxhash64("key", F.lit(j), F.shiftrightunsigned("rest", j * bits).bitwiseAND((1 << bits) - 1)) for j in range(distance + 1)))
    marked = rows.withColumn("rest", rest).join(hot, "key", "left")
    return marked.withColumn("key", F.explode(F.when(F.col("hot"), parts).otherwise(F.array("key")))).select("node", "fp", "ball", "key")


def fingerprint_links(classes: DataFrame, distance: int = DISTANCE, segments: tuple[tuple[int, int], ...] = SEGMENTS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """classes: node, fp (distinct) -> a, b: links that span what ``distance`` bits connect."""
    value = F.col("fp")
    balls = defaultdict(list)
    for k, at, mask in _balls(distance, segments):
        balls[k, at].append(mask)

    def keys(k: int, at: int, masks: list[int]):
        own = F.shiftrightunsigned(value, at).bitwiseAND((1 << segments[k][1]) - 1).bitwiseOR(F.lit(k << 32))
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct((m != 0).alias("ball"), own.bitwiseXOR(m).alias("key")))

    rows = classes.select("node", "fp", F.explode(F.concat(*(keys(*at, masks) for at, masks in balls.items()))).alias("k")).select("node", "fp", "k.ball", "k.key")
    # no number of partitions: adaptive execution merges small ones
    rows = _split_hot(rows, distance, segments, hot_bucket).repartition("key").sortWithinPartitions("key")
    names = ("node", "fp", "ball", "key")

    def run(batches):
        held: list[dict[str, np.ndarray]] = []

        def flush(end: int | None):
            """Links of the held rows, but of those of the last batch from ``end`` on, which stay."""
            cols = {c: np.concatenate([x[c] if k < len(held) - 1 else x[c][:end] for k, x in enumerate(held)]) for c in names}
            held[:] = [] if end is None else [{c: held[-1][c][end:] for c in names}]
            a, b = _links(cols["key"], cols["ball"], cols["fp"].view(np.uint64), cols["node"], distance)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        many = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: batch[c].to_numpy(zero_copy_only=False) for c in names})
            many += batch.num_rows
            key = held[-1]["key"]
            # a bucket goes on until its key does not: rows are put together once, when it ends
            if many >= CARRY and (end := int(np.searchsorted(key, key[-1]))):
                yield flush(end)
                many = len(held[0]["key"])
        if held:
            yield flush(None)

    return rows.select(*names).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id that links reach."""
    prints = materialize(fingerprints(docs, size, seed), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    parts = connected_components(fingerprint_links(classes.filter("node is not null"), distance, segments_for(classes.count())))
    moved = materialize(classes.join(parts, "node", "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "node").alias("component_id")), "components")
    out = prints.join(moved, prints.fp == moved.fp_)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

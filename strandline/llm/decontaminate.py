"""Benchmark decontamination by one Aho-Corasick automaton over normalised test texts.

Normalisation keeps a text's bytes in place (A-Z lower-cased, separators become spaces),
so that offsets in the original follow from the positions of words. Runs of spaces then
shrink to one, and each pattern is a window of words between spaces.

Defined results: null and empty texts have no words and no hits; benchmark rows with a null
id or without words are no items; rows that repeat an item id count as one item, and each row of a
repeated document is judged by itself; an empty benchmark hits nothing, an empty table gives no rows;
a long text is scanned whole; columns of ``docs`` other than the id and the text are not read, so
names cannot clash.

The automaton holds at most ``block_bytes`` of benchmark text. A larger benchmark is cut into
blocks, scanned one after another in narrow passes: no shuffle, and no broadcast beyond the bound. A
text is read once for each block; a worker keeps its automaton for its next tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_texts, judged

WINDOW = 8
BLOCK_BYTES = 8 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STATE = "doc_id long, text string, runs array<struct<first:int,last:int>>, ids array<string>"
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<begin:long,end:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def automaton(items: list[tuple[str, bytes]], size: int = WINDOW):
    """(automaton, item ids of each pattern). Patterns are latin-1 views of UTF-8 bytes; the value of one:
    (its number of words, its number)."""
    import ahocorasick

    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for w in windows_of(words_of(text), size):
            found.setdefault(w, set()).add(item)
    if not found:
        return None, []
    out = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for k, w in enumerate(found):
        out.add_word((b" " + b" ".join(w) + b" ").decode("latin-1"), (len(w), k))
    out.make_automaton()
    return out, [sorted(ids) for ids in found.values()]


#: The automaton that a worker built last, kept for its next tasks.
_BUILT: dict[str, tuple] = {}


def _built(name: str, items: list[tuple[str, bytes]], size: int):
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton(items, size)
    return _BUILT[name]


def _hits(text: bytes, aut, owners: list[list[str]]) -> tuple[list[tuple[int, int]], set[str]]:
    """(runs of words inside windows as first and last, item ids) of one text."""
    norm = b" " + b" ".join(words_of(text)) + b" "
    got = list(aut.iter(norm.decode("latin-1")))
    if not got:
        return [], set()
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    last = np.searchsorted(gaps, [e for e, _ in got]) - 1
    first = last - np.array([n for _, (n, _) in got]) + 1
    return _joined(zip(first.tolist(), last.tolist(), strict=True)), {i for k in {k for _, (_, k) in got} for i in owners[k]}


def _joined(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], size: int, first: bool, last: bool) -> DataFrame:
    """One pass over the texts with the automaton of ``items``. What a pass finds (runs of words, item
    ids) goes to the next; the last gives the digest."""
    digest = hashlib.sha256(repr((size, sorted(items))).encode()).hexdigest()
    runs_kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    spans_kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), spans_kind)
    names = [c.split()[0] for c in _OUT.split(", ", 7)]

    def make():
        aut, owners = _built(digest, items, size)

        def work(batch):
            found = []
            for k, text in enumerate(byte_texts(batch["text"])):
                runs, ids = _hits(text, aut, owners) if aut is not None and text else ([], set())
                if not first:
                    had = batch["runs"][k].as_py()
                    runs = _joined([*((r["first"], r["last"]) for r in had), *runs]) if had else runs
                    ids = ids.union(batch["ids"][k].as_py())
                found.append((text, runs, sorted(ids)))
            if last:
                cols = zip(*(_digest(*f) for f in found), strict=True)
                return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)
            runs = pa.array([[{"first": a, "last": b} for a, b in r] for _, r, _ in found], runs_kind)
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], runs,
                pa.array([i for _, _, i in found], pa.list_(pa.string()))], ["doc_id", "text", "runs", "ids"])

        return work

    return arrow_map(docs, make, _OUT if last else _STATE)


def _digest(text: bytes, runs: list[tuple[int, int]], ids: list[str]) -> tuple:
    same = text.translate(_TABLE)
    spans = []
    if runs:
        at = np.diff(np.concatenate(([0], (np.frombuffer(same, np.uint8) != 32).view(np.int8), [0])))
        begin, end = np.flatnonzero(at == 1), np.flatnonzero(at == -1)
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        spans = [{"begin": int(chars[begin[a]]), "end": int(chars[end[b]])} for a, b in runs]
    return len(same.split()), sum(b - a + 1 for a, b in runs), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2, ids, spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, rows: bool = False) -> DataFrame:
    """A row for each document: words, words inside benchmark windows, items, spans in the original text; ``rows``: and its columns as ``row``."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) * 2 if total > block_bytes else 1
    scanned = judged(docs, rows)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        scanned = _scan(scanned, [(r["item"], r["text"].encode()) for r in part.collect()], window, k == 0, k == blocks - 1)
    return scanned

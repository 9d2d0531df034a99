"""Hashed byte n-gram features of whole texts, and their linear scores, in numpy.

A feature's value is its share of a text's n-grams, so a score is a mean of weights over the
text's positions and needs no vector for each text.
"""

from __future__ import annotations

import numpy as np

_GAP = 4  # zero bytes between texts, so that no n-gram spans two of them


def grams(texts: list[bytes], sizes: tuple[int, ...], bits: int, classes: np.ndarray | None = None):
    """(bucket of each position, text of each position) for all n-gram sizes."""
    joined = np.frombuffer(b"".join(t + bytes(_GAP) for t in texts), np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + _GAP for t in texts])
    codes = (joined if classes is None else classes[joined]).astype(np.uint32)
    buckets, owners = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        h = codes[: len(codes) - n + 1].copy()
        real = joined[: len(codes) - n + 1] != 0
        for j in range(1, n):
            h = h * np.uint32(0x01000193) ^ codes[j : len(codes) - n + 1 + j]
            real &= joined[j : len(codes) - n + 1 + j] != 0
        h = (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        buckets.append((h >> np.uint32(32 - bits))[real])
        owners.append(owner[: len(h)][real])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def matrix(texts: list[bytes], blocks, bits: int, rows: int = 50) -> np.ndarray:
    """Shares of each text's n-grams, one row a text; ``blocks`` gives (bucket, owner) pairs for some texts.

    Works through ``rows`` texts at a time, so that memory is the matrix and little more.
    """
    out = []
    for k in range(0, len(texts), rows):
        part = texts[k : k + rows]
        sides = [np.bincount((owner.astype(np.int64) << bits) + bucket, minlength=len(part) << bits).reshape(len(part),
            1 << bits).astype(np.float32) for bucket, owner in blocks(part)]
        out.append(np.column_stack([x / np.maximum(x.sum(1, keepdims=True), 1) for x in sides]))
    return np.concatenate(out)


def scores(bucket: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """One column of scores for each column of weights."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.column_stack([np.bincount(owner, w[bucket], n) / count for w in weights.T])

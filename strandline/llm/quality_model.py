"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector over hashed text features and
ordered thresholds. It gives the expected grade and, for selection, the tail probability
P(grade >= 1). Grades: 0 bad, 1 good text that is toxic, 2 good text. Features are hashed
n-grams of the text's bytes and of their character classes, over the whole text.

Fitting reads a bounded sample of labelled rows (about ``sample`` a grade); every row is scored.
Defined results: null and empty texts score at the thresholds with w.x = 0 and are rejected;
without labelled rows nothing is rejected but empty texts; an empty table gives no rows; repeated
rows are scored alike; of labels that repeat an id the least grade counts; a text at the limit is
kept; a long text is scored whole; columns other than id and text are not read.

The grades put two 0/1 marks in order, which is all that ``labels`` has: p_tail is P(quality = 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from .common import arrow_map, byte_texts, judged
from .sampling import joined_sample

SAMPLE, BITS, SELECT = 500, 11, 0.5
_CLASS = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b >= 128 else b + 8 for b in range(256)], np.uint32)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One (bucket, text) pair for each block of features: character classes, then raw bytes."""
    return [hashed.grams(texts, (1, 2, 3), BITS, _CLASS), hashed.grams(texts, (3,), BITS)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[bytes, int]], l2: float = 1e-3, rounds: int = 300) -> dict | None:
    """weights by feature and ordered thresholds, by Adam on the weighted log likelihood."""
    grades = sorted({g for _, g in rows})
    if len(grades) < 2:
        return None
    texts, y = [t for t, _ in rows], np.array([grades.index(g) for _, g in rows])
    x = hashed.matrix(texts, features, BITS)
    scale = (1 / (x.std(0) + 1e-3) / np.sqrt(x.shape[1])).astype(np.float32)
    x *= scale
    k = len(grades) - 1
    share = (1 / (len(grades) * np.bincount(y, minlength=k + 1)))[y]
    w, first, gaps = np.zeros(x.shape[1], np.float32), -1.0, np.zeros(k - 1)  # thresholds: first, then + exp(gap)
    state = [np.zeros(x.shape[1] + k), np.zeros(x.shape[1] + k)]
    for t in range(1, rounds + 1):
        cuts = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        s = x @ w
        at = np.concatenate((np.full((len(y), 1), -40.0), cuts[None, :] - s[:, None], np.full((len(y), 1), 40.0)), axis=1)
        p = _sigmoid(at)
        p[:, 0], p[:, -1] = 0, 1
        d = p * (1 - p)
        row = np.arange(len(y))
        mass = np.maximum(p[row, y + 1] - p[row, y], 1e-9)
        up, down = share * d[row, y + 1] / mass, share * d[row, y] / mass  # of log mass, by the upper and lower cut
        by_cut = np.array([-(up[y == j].sum()) + down[y == j + 1].sum() for j in range(k)])
        by_gap = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate((x.T @ (up - down).astype(np.float32) + l2 * w, [by_gap[0]], by_gap[1:] * np.exp(gaps)))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w = w - move[: len(w)].astype(np.float32)
        first -= move[len(w)]
        gaps = gaps - move[len(w) + 1 :]
    cuts = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
    return {"weights": w * scale, "cuts": cuts, "grades": grades}


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    """P(grade >= g) for each grade but the least, one column each."""
    size = 1 << BITS
    s = sum(hashed.scores(*f, len(texts), model["weights"][i * size : (i + 1) * size, None])[:, 0] for i, f in enumerate(features(texts)))
    return 1 - _sigmoid(model["cuts"][None, :] - s[:, None])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for bad quality, else 2 less the toxic mark; repeated ids take the least."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce("toxic", F.lit(0)))
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, select: float = SELECT, rows: bool = False) -> DataFrame:
    """doc_id, expected_grade, p_tail = P(grade >= 1), kept = p_tail >= select; ``rows``: and its columns as ``row``."""
    model = fit(joined_sample(docs, graded(labels), "grade", sample))

    def work(batch):
        texts = byte_texts(batch["text"])
        empty = np.array([not t.strip() for t in texts], bool)
        if model is None:
            expected, tail = np.zeros(len(texts)), np.ones(len(texts))
            kept = ~empty
        else:
            p = score(model, texts)
            steps = np.diff(np.array(model["grades"], float))
            expected, tail = model["grades"][0] + p @ steps, p[:, 0]
            kept = (tail >= select) & ~empty
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(expected), pa.array(tail), pa.array(kept)], ["doc_id", "expected_grade", "p_tail", "kept"])

    return arrow_map(judged(docs, rows), lambda: work, "doc_id long, expected_grade double, p_tail double, kept boolean")

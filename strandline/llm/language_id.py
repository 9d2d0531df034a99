"""Language ID in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams of the whole lower-cased text. Fitting reads a bounded sample
of labelled rows (``sample`` a language at most twice over, and ``sampling.MOST_BYTES`` of text);
prediction reads every row.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0;
without any learnable row all are ``und``; a language without a known family is a family of its own;
repeated rows are judged alike, and learned from each with its own language; an empty table gives no
rows; equal votes go to the larger margin, then to the language first in order; columns other than
id, text and language are not read; a long text is read whole, as one piece of its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from .common import arrow_map, has_letter
from .sampling import own_sample

SAMPLE, SIZES, BITS = 300, (2, 3), 12
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(8):  # the largest curvature, by power iteration
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (2 * float(np.sum(share * (x @ v) ** 2)) * 1.1 + l2)
    w = z = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (l2 * z - 2 * x.T @ (share * y * slack))
        z, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[bytes, str]]) -> dict | None:
    """families, members of each, and machines: (first, second, weights, bias), first where positive."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    texts = [t.decode().lower().encode() for t, _ in rows]
    x = hashed.matrix(texts, lambda part: [hashed.grams(part, SIZES, BITS)], BITS)
    scale = 1 / (x.std(0) + 1e-4)
    x = x * scale / np.sqrt(x.shape[1])
    lang = np.array([lang for _, lang in rows])
    family = np.array([_FAMILY.get(v, v) for v in lang])
    machines = []

    def versus(names: np.ndarray, values: list[str], kind: str) -> None:
        for a, b in combinations(values, 2):
            pick = (names == a) | (names == b)
            w, bias = svm(x[pick], np.where(names[pick] == a, 1, -1).astype(x.dtype))
            machines.append((kind, a, b, w * scale / np.sqrt(x.shape[1]), bias))

    families = sorted(set(family))
    members = {f: sorted(set(lang[family == f])) for f in families}
    versus(family, families, "family")
    for f in families:
        versus(lang, members[f], f)
    return {"families": families, "members": members, "machines": machines}


def _vote(values: list[str], machines: list[tuple[str, str, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner by votes, ties by margins; its weakest probability against any other."""
    at = {v: i for i, v in enumerate(values)}
    votes, margin, least = np.zeros((n, len(values))), np.zeros((n, len(values))), np.ones((n, len(values)))
    for a, b, score in machines:
        p = 1 / (1 + np.exp(-np.clip(2 * score, -30, 30)))
        for v, s, q in ((a, score, p), (b, -score, 1 - p)):
            votes[:, at[v]] += s > 0
            margin[:, at[v]] += np.tanh(s)
            least[:, at[v]] = np.minimum(least[:, at[v]], q)
    best = np.argmax(votes + margin / (2 * len(values) + 1), axis=1)
    return best, least[np.arange(n), best]


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    n = len(texts)
    letters = np.array([has_letter(t) for t in texts], bool)
    if model is None:
        return ["und"] * n, np.zeros(n)
    raw = [(t or "").lower().encode() for t in texts]
    machines = model["machines"]
    weights = np.column_stack([m[3] for m in machines]) if machines else np.zeros((1 << BITS, 0))
    value = hashed.scores(*hashed.grams(raw, SIZES, BITS), n, weights) + np.array([m[4] for m in machines]) if machines else np.zeros((n, 0))
    of = lambda kind: [(m[1], m[2], value[:, i]) for i, m in enumerate(machines) if m[0] == kind]
    top, sure = _vote(model["families"], of("family"), n)
    out = np.full(n, "und", object)
    for k, family in enumerate(model["families"]):
        langs = model["members"][family]
        best, p = _vote(langs, of(family), n)
        mine = top == k
        out[mine] = np.array(langs, object)[best[mine]]
        sure = np.where(mine, sure * p, sure)
    out[~letters] = "und"
    return out.tolist(), np.where(letters, sure, 0.0)


def identify(docs: DataFrame, learn_from: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang_pred, score. Learns from rows of ``learn_from`` (text, non-null lang)."""
    learn_from = docs if learn_from is None else learn_from
    model = fit(own_sample(learn_from, "lang", sample))

    def work(batch):
        langs, score = predict(model, batch["text"].to_pylist())
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda: work, "doc_id long, lang_pred string, score double")

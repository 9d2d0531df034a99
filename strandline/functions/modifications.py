"""Base modifications of reads: the tags MM and ML taken apart."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_PAIR = str.maketrans("ACGTUNacgtun", "TGCAANtgcaan")
_GROUP = re.compile(r"([ACGTUN])([-+])([a-z]+|\d+)([.?]?)((?:,\d+)*)")
_FIELDS = (("pos", IntegerType()), ("base", StringType()), ("strand", StringType()), ("code", StringType()), ("likelihood", IntegerType()))
KIND = ArrayType(StructType([StructField(name, kind) for name, kind in _FIELDS]))


def modified(seq: str | None, reverse: bool, mm: str | None, ml: list[int] | None) -> list[tuple] | None:
    """(place in seq from 0, base, strand, code, likelihood 0-255 or None) of each call, by place.

    Counts in MM pass over bases of their kind in the direction of sequencing, so ``seq`` of a reverse alignment is
    turned first. A group with several codes has a likelihood for each at every place. Null for what can't be
    read: another shape, or more bases than there are.
    """
    if seq is None or mm is None:
        return None
    read = seq.translate(_PAIR)[::-1].upper() if reverse else seq.upper()
    out, at = [], 0
    for group in filter(None, mm.split(";")):
        m = _GROUP.fullmatch(group)
        if not m:
            return None
        base, strand, codes, _, skips = m.groups()
        codes = [codes] if codes.isdigit() else list(codes)
        places = [i for i, c in enumerate(read) if base == "N" or c == ("T" if base == "U" else base)]
        k = -1
        for skip in map(int, skips.split(",")[1:]):
            k += skip + 1
            if k >= len(places):
                return None
            pos = len(read) - 1 - places[k] if reverse else places[k]
            for code in codes:
                out.append((pos, base, strand, code, ml[at] if ml is not None and at < len(ml) else None))
                at += 1
    return sorted(out, key=lambda x: (x[0], x[3]))


@F.pandas_udf(KIND)
def base_modifications(seq: pd.Series, reverse: pd.Series, mm: pd.Series, ml: pd.Series) -> pd.Series:
    """seq, whether it is turned, MM as text and ML as an array of numbers -> the calls of ``modified``."""
    names = [name for name, _ in _FIELDS]
    rows = (modified(s, bool(r), m, None if p is None else list(p)) for s, r, m, p in zip(seq, reverse, mm, ml, strict=True))
    return pd.Series([None if x is None else [dict(zip(names, c, strict=True)) for c in x] for x in rows])

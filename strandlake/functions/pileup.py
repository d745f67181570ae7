"""Pileup strings to bases."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INDEL = re.compile(r"[+-]([0-9]+)")


def bases_of(text: str, ref: str) -> list[str]:
    """The base of each read in a pileup string: matches as the reference base (upper case forward, lower
    case reverse), others as written; gaps (``*``, ``<``, ``>``) as they are.  Marks of read starts and ends
    and inserted or deleted stretches are skipped, so that a read's first base counts too."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "^":
            at += 2
        elif c == "$":
            at += 1
        elif c in "+-":
            size = _INDEL.match(text, at)
            at = size.end() + int(size.group(1)) if size else at + 1
        else:
            out.append(ref.upper() if c == "." else ref.lower() if c == "," else c)
            at += 1
    return out


def pileup_bases(text: Column | str, ref: Column | str, coverage: Column | str) -> Column:
    """Array of bases; null if their number isn't the stated coverage."""

    @F.pandas_udf("array<string>")
    def run(t: pd.Series, r: pd.Series, n: pd.Series) -> pd.Series:
        rows = [bases_of(x or "", y or "N") for x, y in zip(t, r)]
        return pd.Series([x if k == len(x) else None for x, k in zip(rows, n)], dtype=object)

    return run(text, ref, coverage)

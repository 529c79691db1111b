"""Token-sort similarity: 200 * LCS / (|a| + |b|) of the sorted tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != "")), " ")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big integer is a row of the table."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        x = row & where.get(ch, 0)
        row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """ratio() of many pairs at once: one step of 64-bit words a place of the longer list of names, for all pairs together.

    Each distinct name is sorted and coded once. Names of over 63 signs go pair by pair.
    """
    (ia, ua), (ib, ub) = pd.factorize(np.array(a, object)), pd.factorize(np.array(b, object))
    sa, sb = ([" ".join(sorted(x.split())) for x in u] for u in (ua, ub))
    la, lb = np.array([len(x) for x in sa], np.int64), np.array([len(x) for x in sb], np.int64)
    code = {c: i for i, c in enumerate(sorted(set("".join(sb))), 1)}
    # the row of a name's signs: bit i where sign i of the name is this one; code 0 pads and never fits
    where = np.zeros((len(sa), len(code) + 1), np.uint64)
    for row, x in zip(where, sa, strict=True):
        for i, c in enumerate(x[:63]):
            if c in code:
                row[code[c]] |= np.uint64(1 << i)
    signs = np.zeros((len(sb), int(lb.max(initial=0))), np.int32)
    for row, x in zip(signs, sb, strict=True):
        row[: len(x)] = [code[c] for c in x]
    out = np.empty(len(ia))
    for at in range(0, len(ia), 1 << 15):
        i, j = ia[at : at + (1 << 15)], ib[at : at + (1 << 15)]
        full = (np.uint64(1) << np.minimum(la[i], 63).astype(np.uint64)) - np.uint64(1)
        left = full.copy()
        for k in range(signs.shape[1]):
            x = left & where[i, signs[j, k]]
            left = ((left + x) | (left - x)) & full
        common = np.bitwise_count(full ^ left).astype(np.float64)
        total = la[i] + lb[j]
        out[at : at + (1 << 15)] = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)
    for k in np.flatnonzero(la[ia] > 63).tolist():
        out[k] = ratio(a[k], b[k])
    return out


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio() over Arrow batches; null where either name is."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        out[known] = ratios(a[known].tolist(), b[known].tolist())
    return pd.Series(out).where(known, None).astype("float64")


def token_sort_ratio_native(a: Column, b: Column) -> Column:
    """The same in Catalyst alone: a table row is an array, folded over the characters."""
    x, y = F.split(sorted_tokens(a), ""), F.split(sorted_tokens(b), "")

    def step(row: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(y)),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(F.when(F.element_at(y, j) == ch, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, j))))),
        )

    table = F.aggregate(x, F.array_repeat(F.lit(0), F.size(y) + 1), step)
    return (F.lit(200).cast("double") * F.element_at(table, -1)) / (F.size(x) + F.size(y)).cast("double")

"""Edit distance of whole texts by bit-parallel columns, and how many edits of each kind a shortest alignment has.

A column of the distance matrix is two sets of bits: where it rises by one from a row to the
next, and where it falls. Sequences are taken in blocks of rows; a block passes on what it adds
from column to column, so memory is linear. The alignment is found by halving the second
sequence: the columns of both halves, one from each end, meet in the row where the shortest
alignment crosses; small parts keep all columns and are walked back through.

Where one text is the other with only such characters dropped or replaced as the other lacks altogether, the counts are
certain, and are found in one pass instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a block, and cells of a part whose columns are all kept.
BLOCK, KEPT = 8192, 1 << 20
#: Characters compared for one piece of a text, at most, in the look for a way that is certain; beyond that it is searched.
MOST_REACHED = 1 << 20


def _masks(block: Sequence) -> dict:
    """For each element of a block the bits of the rows that have it."""
    at: dict = {}
    for i, x in enumerate(block):
        at.setdefault(x, []).append(i)
    masks = {}
    for x, rows in at.items():
        bits = np.zeros(-(-len(block) // 8) * 8, np.uint8)
        bits[rows] = 1
        masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return masks


def _columns(block: Sequence, b: Sequence, into: Sequence[int] | None, keep: list | None = None) -> tuple[int, int, list[int]]:
    """The last column's rises and falls of a block, and what its last row adds in each column; ``into`` is what the row above adds (1 each, if none)."""
    masks, size = _masks(block), len(block)
    full, top = (1 << size) - 1, 1 << (size - 1)
    rises, falls, out = full, 0, []
    for j, x in enumerate(b):
        carry = 1 if into is None else into[j]
        equal = masks.get(x, 0)
        vertical = equal | falls
        if carry < 0:
            equal |= 1
        across = ((((equal & rises) + rises) ^ rises) | equal) & full
        up, down = falls | (full & ~(across | rises)), rises & across
        out.append(1 if up & top else -1 if down & top else 0)
        up, down = ((up << 1) | (carry > 0)) & full, ((down << 1) | (carry < 0)) & full
        rises, falls = down | (full & ~(vertical | up)), up & vertical
        if keep is not None:
            keep.append((rises, falls))
    return rises, falls, out


def _bits(x: int, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little")[:size].astype(np.int64)


def last_column(a: Sequence, b: Sequence) -> np.ndarray:
    """Distances of all beginnings of ``a`` to ``b``."""
    steps, into = [np.array([len(b)])], None
    for at in range(0, len(a), BLOCK):
        block = a[at : at + BLOCK]
        rises, falls, into = _columns(block, b, into)
        steps.append(_bits(rises, len(block)) - _bits(falls, len(block)))
    return np.cumsum(np.concatenate(steps))


def _walked_back(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions of a part that is small enough to keep its columns."""
    kept: list[tuple[int, int]] = []
    _columns(a, b, None, kept)
    i, j, substituted, inserted, deleted = len(a), len(b), 0, 0, 0
    while i and j:
        if kept[j - 1][0] >> (i - 1) & 1:
            deleted, i = deleted + 1, i - 1
        elif j > 1 and kept[j - 2][1] >> (i - 1) & 1:
            inserted, j = inserted + 1, j - 1
        else:
            substituted += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
    return substituted, inserted + j, deleted + i


def _all_native_kept(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` with each character that ``b`` lacks dropped or replaced by one, and nothing else."""
    foreign = set(a) - set(b)
    if not foreign or len(a) < len(b):
        return a == b
    parts = re.split("([" + "".join(map(re.escape, sorted(foreign))) + "]+)", a)
    reached = {0}  # how much of b may be used up
    for i in range(0, len(parts), 2):
        native = parts[i]
        if i:
            most = len(parts[i - 1])
            if len(reached) * most > MOST_REACHED:
                return False
            starts = {j + k for j in reached for k in range(most + 1)}
        else:
            starts = reached
        reached = {j + len(native) for j in starts if b.startswith(native, j)}
        if not reached or len(reached) * len(native) > MOST_REACHED:
            return False
    return len(b) in reached


def _certain_counts(a: str, b: str) -> tuple[int, int, int] | None:
    """The counts of all shortest ways where those are certain without a search; None where not.

    Each character of ``a`` that ``b`` lacks is replaced or dropped in any way. Where a way does just that and inserts nothing,
    it is a shortest one, and so no other shortest one inserts anything: the lengths then give the counts. The same holds backwards.
    """
    for one, other, back in ((a, b, False), (b, a, True)):
        if _all_native_kept(one, other):
            there = set(other)
            lost = sum(n for x, n in Counter(one).items() if x not in there)
            fewer = len(one) - len(other)
            return (lost - fewer, fewer, 0) if back else (lost - fewer, 0, fewer)
    return None


def edit_counts(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions of a shortest way from ``a`` to ``b``; of several ways always the same one."""
    if isinstance(a, str) and isinstance(b, str) and (certain := _certain_counts(a, b)) is not None:
        return certain
    out, open_ = np.zeros(3, np.int64), [(0, len(a), 0, len(b))]
    while open_:
        i, k, j, m = open_.pop()
        while i < k and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
        if i == k or j == m:
            out += (0, m - j, k - i)
        elif m - j == 1:
            there = b[j] in a[i:k]
            out += (0 if there else 1, 0, k - i - 1)
        elif (k - i) * (m - j) <= KEPT:
            out += _walked_back(a[i:k], b[j:m])
        else:
            half = (j + m) // 2
            ahead, back = last_column(a[i:k], b[j:half]), last_column(a[i:k][::-1], b[half:m][::-1])[::-1]
            cross = i + int((ahead + back).argmin())
            open_ += [(i, cross, j, half), (cross, k, half, m)]
    return tuple(int(x) for x in out)


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions between two sequences."""
    same = 0
    while same < min(len(a), len(b)) and a[-1 - same] == b[-1 - same]:
        same += 1
    a, b, into = a[: len(a) - same], b[: len(b) - same], None
    for at in range(0, len(a), BLOCK):
        into = _columns(a[at : at + BLOCK], b, into)[2]
    return len(a) + sum(into) if a else len(b)


def counted_edits(a: Column, b: Column, by_words: bool = False) -> Column:
    """substitutions, insertions and deletions from text a to text b, by characters or by white-space words; null if either text is."""

    @F.pandas_udf("struct<substitutions:long,insertions:long,deletions:long>")
    def edits(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        cut = str.split if by_words else str
        memo = {p: (None,) * 3 if p[0] is None or p[1] is None else edit_counts(cut(p[0]), cut(p[1])) for p in set(zip(x, y))}
        return pd.DataFrame([memo[p] for p in zip(x, y)], columns=["substitutions", "insertions", "deletions"], dtype="Int64")

    none = F.lit(None).cast("struct<substitutions:long,insertions:long,deletions:long>")
    return F.when(a.isNull() | b.isNull(), none).otherwise(edits(a, b))

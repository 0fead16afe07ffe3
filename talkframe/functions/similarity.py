"""String similarities that Spark lacks, in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .edits import edit_distance


def jaro(a: str, b: str) -> float:
    """Share of matching characters, matched within half the longer length, less transpositions."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, hits = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits.append(c)
                break
    if not hits:
        return 0.0
    m = len(hits)
    swapped = sum(x != y for x, y in zip(hits, (c for c, f in zip(b, free) if not f))) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str, scale: float = 0.1, threshold: float = 0.7) -> float:
    """Jaro raised for a common prefix of up to four characters, where it is above the threshold."""
    j = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * scale * (1 - j) if j > threshold else j


def least_jaro(least: float, prefix: int, scale: float = 0.1, threshold: float = 0.7) -> float:
    """The Jaro similarity that two words with so many first characters in common need for a Jaro-Winkler similarity of ``least``."""
    raised = (least - prefix * scale) / (1 - prefix * scale)
    return min(least, max(threshold, raised)) if prefix else least


def least_common(a: int, b: int, jaro_: float) -> int:
    """How many characters words of these lengths have in common at least if their Jaro similarity is ``jaro_``.

    It is (m/a + m/b + (m - t)/m) / 3 for m matching characters, and these are common ones.
    """
    return max(1, math.ceil((3 * jaro_ - 1) * a * b / (a + b) - 1e-9))


#: Letters from common to rare; all other characters count as rarer still.
COMMON_FIRST = "etaoinsrhldcumfpgwybvkxjqz"
_RANKS = {c: -i for i, c in enumerate(COMMON_FIRST)}
#: How many rare characters two words must share besides a prefix of 0, 1 or 2 characters; a longer prefix is enough. More make
#: fewer pairs of more keys. It is for so many words on the other side, or less.
SHARED_BESIDES = {1000: (1, 1, 1), 100_000: (2, 2, 1), math.inf: (3, 3, 2)}


@lru_cache(100_000)
def _partners(a: int, prefix: int, least: float, lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """The lengths of words that may be similar to one of length a with such a prefix in common, and how many characters they share."""
    needed = ((b, least_common(a, b, least_jaro(least, prefix))) for b in lengths if b >= max(1, prefix))
    return [(b, common) for b, common in needed if common <= min(a, b)]


def similarity_keys(word: str, lengths: tuple[int, ...], least: float, first: bool, besides: Sequence[int] = SHARED_BESIDES[math.inf]) -> set[str]:
    """Keys of which two words share one if their Jaro-Winkler similarity is ``least`` or more.

    ``lengths`` are those of the words on the other side, and ``first`` tells the sides apart. Words with a common prefix of p characters
    have a known number of characters in common (``least_common``). Of two words with c common characters, rare ones first, the
    first a - c + k and b - c + k have k in common; so each set of k of these is a key, with the lengths and the prefix.
    """
    out, a = set(), len(word)
    if not a:
        return out
    out.update(f"{p}:{word[:p]}" for p in (len(besides), len(besides) + 1) if p <= a)
    for p, most in enumerate(besides):
        needed = _partners(a, p, least, lengths) if p <= a else ()
        if not needed:
            continue
        seen: dict[str, int] = {}
        marks = []
        for c in word[p:]:
            seen[c] = n = seen.get(c, 0) + 1
            marks.append((_RANKS.get(c, 1), c, n))
        marks.sort(reverse=True)
        said = [f"{c}{n}" for _, c, n in marks]
        for b, common in needed:
            k = min(most, max(0, common - p))
            at = f"{p}:{a}:{b}:{word[:p]}:" if first else f"{p}:{b}:{a}:{word[:p]}:"
            out.update(at + ",".join(some) for some in combinations(said[: a - common + k], k))
    return out


def metaphone_of(word: str) -> str:
    """Lawrence Philips' phonetic code of an English word's letters."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out: list[str] = []
    n, i = len(w), 0

    def at(k: int) -> str:
        return w[k] if 0 <= k < n else ""

    while i < n:
        c, after, before = w[i], at(i + 1), at(i - 1)
        if c == before and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (before == "M" and i == n - 1):
                out.append("B")
        elif c == "C":
            if after == "I" and at(i + 2) == "A":
                out.append("X")
            elif after and after in "IEY":
                if before != "S":
                    out.append("S")
            elif after == "H":
                out.append("K" if before == "S" or (i == 0 and at(i + 2) not in tuple("AEIOU")) else "X")
                i += 1
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if after == "G" and at(i + 2) and at(i + 2) in "EIY" else "T")
        elif c == "G":
            if after == "H":
                if i + 2 < n and at(i + 2) not in "AEIOU":
                    pass
                elif i + 2 >= n:
                    pass
                else:
                    out.append("K")
            elif after == "N":
                if not (i + 2 == n or w[i + 1 :] == "NED"):
                    out.append("K")
            elif before == "D" and after and after in "EIY":
                pass
            else:
                out.append("J" if after and after in "EIY" and before != "G" else "K")
        elif c == "H":
            if (before not in tuple("CSPTG")) and (after and after in "AEIOU") and not (before and before in "AEIOU" and after not in "AEIOU"):
                out.append("H")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            if after == "H":
                out.append("F")
                i += 1
            else:
                out.append("P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if after == "H":
                out.append("X")
                i += 1
            elif after == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif w[i : i + 3] == "SCH":
                out.append("SK")
                i += 2
            else:
                out.append("S")
        elif c == "T":
            if after == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif after == "H":
                out.append("0")
                i += 1
            elif w[i + 1 : i + 3] != "CH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if after and after in "AEIOU":
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _each(a: pd.Series, b: pd.Series, f) -> list:
    """``f`` of each pair, once for equal pairs of a batch; null if either side is."""
    memo = {p: None if p[0] is None or p[1] is None else f(*p) for p in set(zip(a, b))}
    return [memo[p] for p in zip(a, b)]


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity by code points; null if either is null."""

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_each(x, y, jaro_winkler_of), dtype=float)

    return similar(a, b)


def metaphone(a: Column) -> Column:
    @F.pandas_udf("string")
    def code(x: pd.Series) -> pd.Series:
        return x.map(lambda w: None if w is None else metaphone_of(w))

    return code(a)


def word_edits(a: Column, b: Column) -> Column:
    """Levenshtein distance of white-space words."""

    @F.pandas_udf("int")
    def edits(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_each(x, y, lambda p, q: edit_distance(p.split(), q.split())), dtype="Int32")

    return edits(a, b)

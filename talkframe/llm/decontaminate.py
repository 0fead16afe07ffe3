"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

A window of a document, with as many words as a benchmark item, is compared with the item.
Fingerprints of windows and items fall into blocks; two within the radius agree in some block
up to its share of the errors, so a window's candidates are all items of its size with a block
that is near the window's. Candidates are verified by the exact weighted similarity of their
five-word shingles.

A window similar enough to an item shares a shingle with it. So windows are only laid where a
document has a shingle of the benchmark: hashes of all shingles are looked up first, for many
documents at once, and the rest of the text needs no fingerprints. Nothing is lost by this.

Words and shingles are 64-bit hashes throughout; equal hashes count as equal.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, table, text_or_empty, tidy
from .tokens import U, mix, sized, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS = 4, 16
#: Differing bits of 64 within which every item is a candidate of a window, and a block's share of them.
RADIUS = 14
SHARE = RADIUS // BLOCKS
#: Windows, and words of a text, that are looked at once.
AT_ONCE, WORDS_AT_ONCE = 4096, 32768
#: Bytes of benchmark text that executors hold at once, about ten times that in Python; a larger benchmark is taken in parts.
MOST_BYTES = 8 << 20
#: Characters outside ASCII that part words: signs, marks, symbols, blanks.
PARTING = re.compile(r"[^\w\x00-\x7f]+")


def _plain(text: str) -> bytes:
    """The text in lower case, with ASCII alone to part words: runs of letters and digits."""
    low = text.lower()
    return (low if low.isascii() else PARTING.sub(" ", low)).encode("utf-8", "surrogatepass")


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts in the form of ``_plain``, and where each text's words start (and the last one's end)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    # Bytes of words: letters and digits, and all outside ASCII, where only those of words are left.
    starts, _, hashes = word_hashes(raw, ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128))
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def _shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def _bits(words: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each word."""
    return np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), 8), axis=1)


def _fingerprints(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words; starts are ascending. Few words are held as bits at once."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + WORDS_AT_ONCE)))
        low = starts[at]
        bits = _bits(words[low : starts[to - 1] + size])
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
        own = starts[at:to] - low
        out[at:to] = np.packbits(2 * (sums[own + size] - sums[own]) > size, axis=1).view(">u8").ravel()
        at = to
    return out


def _in(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), int), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


@lru_cache(1)
def _near_words() -> np.ndarray:
    """All 16-bit words with up to a block's share of the errors."""
    return np.array([sum(1 << p for p in c) for k in range(SHARE + 1) for c in combinations(range(BLOCK_BITS), k)], np.int64)


class Blocks:
    """Fingerprints of items, found by blocks near those of a window."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps
        self.tables = []
        for b in range(BLOCKS):
            own = self._block(fps, b)
            order = np.argsort(own, kind="stable")
            values, first = np.unique(own[order], return_index=True)
            self.tables.append((values, np.append(first, len(own)), order))

    @staticmethod
    def _block(fps: np.ndarray, b: int) -> np.ndarray:
        return ((fps >> U(BLOCK_BITS * b)) & U((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def within(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item) within the radius, sorted."""
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(fps), AT_ONCE):
            for b, (values, first, order) in enumerate(self.tables):
                block = self._block(fps[at : at + AT_ONCE], b)
                # A window's near words are looked up in the table, or the table's words compared with it, whichever are fewer.
                if len(values) <= len(_near_words()):
                    window, value = np.nonzero(np.bitwise_count(block[:, None] ^ values[None, :]) <= SHARE)
                else:
                    near = block[:, None] ^ _near_words()[None, :]
                    place, there = _in(values, near.ravel())
                    window, value = np.flatnonzero(there) // near.shape[1], place[there]
                n = first[value + 1] - first[value]
                item = order[np.repeat(first[value] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                window = np.repeat(window + at, n)
                close = np.bitwise_count(fps[window] ^ self.fps[item]) <= RADIUS
                found.append(window[close] * len(self.fps) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.fps)), pairs % max(1, len(self.fps))


class Benchmark:
    """Items with their shingles and weights, and an index of their fingerprints' blocks for each number of words.

    Where the items are a part of a benchmark, ``whole`` is the number of all, and shingles that
    several of all have, sorted, with how many have them.
    """

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, np.ndarray, np.ndarray] | None = None) -> None:
        words, bounds = _words([_plain(t or "") for _, t in items])
        self.ids, self.sizes, own, counts = [], [], [], []
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for (i, _), a, b in zip(items, bounds.tolist(), bounds[1:].tolist()):
            if b > a:
                s, n = np.unique(_shingles(words[a:b], min(SHINGLE, b - a)), return_counts=True)
                by_size[b - a].append((len(self.ids), words[a:b]))
                self.ids.append(i)
                self.sizes.append(b - a)
                own.append(s)
                counts.append(n)
        every = np.concatenate([np.zeros(0, np.uint64), *own])
        self.known, holders = np.unique(every, return_counts=True)
        total = len(self.ids)
        if whole:
            total = whole[0]
            at, there = _in(whole[1], self.known)
            holders = np.where(there, whole[2][at] if len(whole[2]) else 1, 1)
        #: Shingles that many items share tell less.
        self.weights = 1.0 + np.log((1 + total) / (1 + holders))
        self.unknown = 1.0 + np.log(1 + total)
        self.items = list(zip(own, counts))
        self.of_size = {n: (np.array([k for k, _ in x]), Blocks(np.concatenate([_fingerprints(w, np.zeros(1, int), n) for _, w in x]))) for n, x in by_size.items()}
        #: Which sizes of items have each shingle, and how long shingles are: shorter ones in items with fewer words.
        place = np.searchsorted(self.known, every)
        both = np.unique(np.stack((place, np.repeat(self.sizes, [len(s) for s in own]).astype(np.int64))), axis=1) if len(every) else np.zeros((2, 0), np.int64)
        self.holds, self.held_by = both
        self.first = np.searchsorted(self.holds, np.arange(len(self.known) + 1))
        self.lengths = sorted({min(SHINGLE, n) for n in self.sizes})
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known >> U(42)).astype(np.int64)] = True

    def met(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in a run of words where shingles of the benchmark start, and which ones."""
        for length in self.lengths:
            run = _shingles(words, length)
            maybe = np.flatnonzero(self.filter[(run >> U(42)).astype(np.int64)])
            at, there = _in(self.known, run[maybe])
            yield maybe[there], at[there]

    def _similarity(self, window: np.ndarray, item: int) -> float:
        a, n = np.unique(_shingles(window, min(SHINGLE, len(window))), return_counts=True)
        b, m = self.items[item]
        at, there = _in(b, a)
        place, known = _in(self.known, a)
        weight = np.where(known, self.weights[place] if len(self.known) else 0.0, self.unknown)
        shared = np.minimum(n, np.where(there, m[at], 0))
        least = float((weight * shared).sum())
        most = float((weight * n).sum() + (self.weights[np.searchsorted(self.known, b)] * m).sum()) - least
        return least / most

    def find(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Items in a text: id, best similarity, and the window's first word and number of words."""
        laid: dict[int, np.ndarray] = {}
        for at, which in self.met(words):
            n = self.first[which + 1] - self.first[which]
            size = self.held_by[np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            at = np.repeat(at, n)
            for own in np.unique(size).tolist():
                places = at[size == own]
                if own > len(words):  # the whole text may still be most of the item
                    laid[own] = np.zeros(1, np.int64)
                    continue
                edges = np.zeros(len(words) - own + 2, np.int64)
                np.add.at(edges, np.maximum(0, places - own + min(SHINGLE, own)), 1)
                np.add.at(edges, np.minimum(places, len(words) - own) + 1, -1)
                laid[own] = np.flatnonzero(np.cumsum(edges)[:-1])
        best: dict[int, tuple[float, int, int]] = {}
        for size, starts in laid.items():
            items, blocks = self.of_size[size]
            long = min(size, len(words))
            for w, k in zip(*(x.tolist() for x in blocks.within(_fingerprints(words, starts, long)))):
                start, item = int(starts[w]), int(items[k])
                s = self._similarity(words[start : start + long], item)
                if s >= SIMILARITY - 1e-12 and s > best.get(item, (0.0,))[0]:
                    best[item] = (s, start, long)
        return sorted((self.ids[k], *v) for k, v in best.items())


#: The benchmark that this worker has built, and the items that it was built from.
_built: list = []


def _benchmark(shared: tuple) -> Benchmark:
    """Built once a worker, not once a task."""
    if not _built or _built[0] is not shared:
        _built[:] = [shared, Benchmark(*shared)]
    return _built[1]


def _item_shingles(items: DataFrame) -> DataFrame:
    """Column s: each item's distinct shingles; an item without a word gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, bounds = _words([_plain(t.as_py()) for t in b.column(0)])
            own = [np.unique(_shingles(words[x:y], min(SHINGLE, y - x))) for x, y in zip(bounds.tolist(), bounds[1:].tolist()) if y > x]
            lead = np.concatenate([np.zeros(0, bool), *(np.arange(len(s)) == 0 for s in own)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)), pa.array(lead)], ["s", "lead"])

    return lean(items).select("text").mapInArrow(tidy(run), "s long, lead boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The key, item_id, similarity, start and words of every item that a document holds.

    A row for each pair, with the window most similar to the item, the first if several. Null
    and empty texts and items match nothing; a text shorter than an item is compared as a whole;
    an item or text of fewer than five words is one shingle; repeated rows give a row each, as
    does an item id with several texts; a null key stays null; an empty table gives an empty
    result; other columns are ignored. Words are runs of letters and digits in lower case, of any script; marks and signs
    part them.
    """
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-size // MOST_BYTES))
    out, whole = None, None
    if n_parts > 1:
        # Weights are those of the whole benchmark, so that parts change nothing.
        counted = checkpointed(_item_shingles(items).groupBy("s").agg(F.count("*").alias("n"), F.count_if("lead").alias("items")))
        total = counted.agg(F.sum("items")).first()[0] or 0
    for part in range(n_parts):
        some = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_parts)) == part)
        own = [(r["id"], r["text"]) for r in some.collect()]
        if n_parts > 1:
            shared = counted.where("n > 1").join(_item_shingles(some).select("s").distinct(), "s", "left_semi").toArrow()
            s, n = shared.column("s").to_numpy().view(np.uint64), shared.column("n").to_numpy()
            order = np.argsort(s)
            whole = (total, s[order], n[order])
        found = _find(docs, own, whole, text, key)
        out = found if out is None else out.unionAll(found)
    return out


def _find(docs: DataFrame, items: list[tuple[int, str]], whole: tuple | None, text: str, key: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _benchmark(shared.value)
        for b in batches:
            raw = [_plain(t.as_py()) for t in b.column(1)]
            rows: list[tuple] = []
            for at, to in sized(raw):
                words, bounds = _words(raw[at:to])
                suspects = np.unique(np.concatenate([np.searchsorted(bounds, places, "right") - 1 for places, _ in bench.met(words)] or [np.zeros(0, int)]))
                for i in suspects.tolist():
                    rows += [(at + i, *m) for m in bench.find(words[bounds[i] : bounds[i + 1]])]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64())))],
                [key, "item_id", "similarity", "start", "words"],
            )

    kind = dict(docs.dtypes)[key]
    return lean(docs).select(key, text_or_empty(text).alias("_text")).mapInArrow(tidy(run), f"`{key}` {kind}, item_id long, similarity double, start long, words long")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Near-duplicates: SimHash links found by Golay-code fuzzy hashing, and exact links of shingles.

Fingerprints fall into three segments, of 23, 23 and 18 bits. A segment's keys are the Golay
codewords near it (see ``golay``): segments that differ in up to two bits share one. Documents
that meet under a key composed of two segments' keys are compared and verified.

``fingerprint_components`` links fingerprints at two or fewer differing bits, exactly: of three
segments one is then free of errors, and another has two at most, so the pair meets under one
segment as it is with a codeword of another.

``near_duplicates`` links documents by the exact similarity of their word shingles. Documents
whose fingerprints link in the same way are candidates, and a prefix filter adds those that are
further apart in bits, so that candidates are complete: shingles have one order for all texts, common ones last, and two texts
that are similar enough share one among the first few of each (a prefix filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hinted, lean, table, text_or_empty, tidy, without
from .golay import keys as golay_keys
from .graph import components
from .tokens import U, mix, sized, word_hashes

SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
SEED = 42


def _majority(hashes: list[int]) -> int:
    """Bit i is one if more than half of the hashes have it."""
    if not hashes:
        return 0
    rows = np.array(hashes, ">u8").view(np.uint8).reshape(len(hashes), 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def shingle_fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the shingles of white-space words, A-Z lower-cased, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return _majority([xxhash.xxh64_intdigest(joined, SEED)])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return _majority([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())])


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and fp, the 64-bit SimHash as a signed long. A null text is empty; that gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [shingle_fingerprint(t.as_py(), size) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], [key, "fp"])

    kind = dict(docs.dtypes)[key]
    return lean(docs).select(key, text_or_empty(text).cast("binary").alias("_text")).mapInArrow(tidy(run), f"`{key}` {kind}, fp long")


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    fps = fps.view(np.uint64)
    return [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _exact_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of a segment as it is with each codeword of another."""
    parts = _segments(fps)
    rows, out = [], []
    for tag, (exact, fuzzy) in enumerate(((0, 1), (1, 0), (2, 0))):
        near = golay_keys(parts[fuzzy]).astype(np.int64)
        key = (tag << 60) | (parts[exact] << 12)[:, None] | near
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        out.append(key[row, column])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(fps: DataFrame, make, columns: list[str]) -> DataFrame:
    """A row for each key of each row's ``fp``, with these other long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                rows, keys = make(part.column("fp").to_numpy(zero_copy_only=False))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(part.column(c).take(take) for c in ["fp", *columns])], ["key", "fp", *columns])

    schema = ", ".join(f"{c} long" for c in ["key", "fp", *columns])
    return fps.select("fp", *columns).mapInArrow(tidy(run), schema)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Rows of each key, which come sorted by it, in parts of ``most`` at most; and whether it is a part.

    Keys with one row are passed over.
    """
    held: dict[str, np.ndarray] | None = None
    partial = False
    for b in batches:
        rows = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        if held is not None:
            rows = {n: np.concatenate([held[n], v]) for n, v in rows.items()}
        key = rows["key"]
        cuts = np.flatnonzero(np.diff(key)) + 1
        bounds = [0, *cuts.tolist()]
        for a, c in zip(bounds, bounds[1:]):
            if c - a > 1 or partial:
                for x in range(a, c, most):
                    yield {n: v[x : min(c, x + most)] for n, v in rows.items()}, partial or c - a > most
            partial = False
        last = bounds[-1]
        while len(key) - last > most:
            yield {n: v[last : last + most] for n, v in rows.items()}, True
            last, partial = last + most, True
        held = {n: v[last:] for n, v in rows.items()}
    if held is not None and (len(held["key"]) > 1 or partial):
        yield held, partial


def _within(fps: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius


def _spanning(link: np.ndarray) -> np.ndarray:
    """For each row the first row of its component under a symmetric matrix of links."""
    root = np.arange(len(link))
    while True:
        best = np.where(link, root[None, :], len(link)).min(axis=1)
        best = best[best]
        if (best == root).all():
            return root
        root = best


def fingerprint_links(fps: DataFrame, radius: int = 2, most: int = 1024) -> DataFrame:
    """Edges (a, b) whose components are those of all distinct ``fp`` within ``radius`` bits.

    A key's members are compared at once and give one edge each at most. Where more than
    ``most`` members share a key they are not compared: each gives itself and the 64 words one
    bit from it, and those that share one of these are linked. That is exact too for a radius
    of two, in 65 rows a member, and a shared word has no more than 65 members.
    """
    if radius != 2:
        raise ValueError("the segments' keys are made for a radius of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, partial in _groups(batches, most):
            fps_ = rows["fp"].view(np.uint64)
            if partial:
                a = b = fps_
            else:
                root = _spanning(_within(fps_, radius))
                own = root != np.arange(len(root))
                a, b = fps_[own], fps_[root[own]]
            if len(a):
                columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), partial))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "crowded"])

    keyed = _keyed(fps.select("fp"), _exact_keys, [])
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long, crowded boolean").distinct()
    met = checkpointed(met)
    balls = met.where("crowded").select(F.col("a").alias("fp"), F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))).alias("bit"))
    shared = balls.groupBy(F.col("fp").bitwiseXOR(F.col("bit")).alias("word")).agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    return met.where("not crowded").select("a", "b").unionAll(stars)


def fingerprint_components(docs: DataFrame, size: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, fp (signed long) and component_id: the smallest key reachable over links.

    Null and empty texts have no shingle and the fingerprint zero, which links like any other;
    documents of equal fingerprint are one node, so that copies never meet in pairs. Null keys
    count as larger than all others; repeated rows share a component; an empty table gives an
    empty result; other columns are ignored.
    """
    fps = checkpointed(fingerprints(docs, size, text, key))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min(key).alias("_least")))
    roots = components(fingerprint_links(nodes, radius)).withColumnRenamed("node", "fp")
    linked = checkpointed(nodes.join(roots, "fp"))
    least = linked.groupBy("root").agg(F.min("_least").alias("_component"))
    named = linked.join(least, "root").select("fp", "_component")
    # A table of its own, so that both sides of the join are exchanged and a crowded fingerprint's rows can be split.
    own = checkpointed(nodes.join(named, "fp", "left").select("fp", F.coalesce("_component", "_least").alias("component_id")))
    return fps.join(own, "fp").select(key, "fp", "component_id")


#: Of one text in SAMPLED the shingles are counted; those of SEEN texts or more are common, MOST_COMMON of them at most.
SAMPLED, SEEN, MOST_COMMON = 32, 4, 1_000_000
#: Bits of a text's marks, at most.
MOST_MARKS = 1 << 16
#: Texts of a part of a crowd, about; a task compares two parts. And texts that all of a large crowd are compared with first.
PART, HUBS = 512, 3
#: A text of a large crowd is as long as so many marks, about (8 kB and 530 bytes on average in the largest crowd of check_l).
TEXT_IN_MARKS = 8
#: Texts of a part of a crowd that is compared by marks, about; and pairs a text that are left, at most, if they are to be listed.
MARKS_PART, PAIRS_LEFT = 4096, 8


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's words start (and the last ones end).

    Words are runs of letters, digits and characters outside ASCII, in lower case.
    """
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    inside = ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    starts, _, hashes = word_hashes(raw, inside)
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in encoded)]))


def _classify(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text two hashes of its words in order, 128 bits together: texts are never equal by chance."""
    words, bounds = _words(texts)
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(texts)), n)
    place = (np.arange(len(words)) - bounds[:-1][of]).astype(np.uint64)
    out = []
    for turn in (U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix((words ^ turn) + place * turn))))
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; fewer words are one shingle."""
    words, bounds = _words(texts)
    n = max(0, len(words) - size + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole = mix(whole * U(0x9E3779B97F4A7C15) + words[k : k + n])
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
            continue
        short = np.zeros(min(1, b - a), np.uint64)
        for w in words[a:b]:
            short = mix(short * U(0x9E3779B97F4A7C15) + w)
        out.append(short)
    return out


def _common(source: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts have, sorted, and each one's rank, the commonest last.

    They are counted in a sample. It only decides the order in which shingles are taken, and so
    how many texts meet; every order finds all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for at, to in sized(texts):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_shingle_sets(texts[at:to], size)).view(np.int64))], ["s"])

    sample = source.where(F.pmod(F.xxhash64("_text"), F.lit(SAMPLED)) == 0).select("_text").distinct()
    counts = sample.mapInArrow(tidy(run), "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    found = counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int64)


def _set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash, as a signed number, of a set of hashes: a bit is one if more than half of them have it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 16):
        bits = shingles[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")[0])


def _marks(shingles: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes, one if an odd number of them has it; two bits a hash or more, up to ``MOST_MARKS``."""
    bits = min(MOST_MARKS, max(64, 1 << (2 * len(shingles)).bit_length()))
    odd = np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _least_apart(x: bytes, y: bytes) -> int:
    """How many shingles only one of two texts has, at least, by their marks: each such shingle turns one bit. Longer marks are folded."""
    a, b = sorted((x, y), key=len)
    low, high, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        high = (high & ((1 << bits) - 1)) ^ (high >> bits)
    return (low ^ high).bit_count()


def _may_be_similar(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) but for those that the marks (node, n, marks) rule out: no similar pair is lost.

    Two sets of n and m shingles that are similar enough differ in (1 - s) / (1 + s) of n + m at most.
    """
    share = (1 - similarity + 1e-9) / (1 + similarity - 1e-9)

    @F.pandas_udf("boolean")
    def near(n: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_least_apart(a, b) <= share * k + 1e-6 for k, a, b in zip(n, x, y)], dtype=bool)

    a, b = (marks.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"m_{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").where(near(F.col("n_a") + F.col("n_b"), F.col("m_a"), F.col("m_b"))).select("a", "b")


def _fingerprint_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs a < b of nodes that join all those whose fingerprints (fp) are reached over links of two bits or fewer."""
    firsts = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    links = checkpointed(fingerprint_links(firsts))
    ends = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    for c, end in zip("ab", ends):
        links = links.join(end, c)
    near = links.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = nodes.join(hinted(firsts), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return near.unionAll(same).where("a <> b").distinct()


def _prefixes(sets: list[np.ndarray], similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """For each set the number of its distinct shingles, and the first of them in the common order.

    Texts of n shingles that are similar enough share ceil(similarity * n) at least, so one of
    them is among the n - ceil(similarity * n) + 1 first ones.
    """
    n = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate(sets)
    rank = np.zeros(len(every), np.int64)
    known, ranks = common
    if len(known):
        at = np.minimum(np.searchsorted(known, every), len(known) - 1)
        rank = np.where(known[at] == every, ranks[at], 0)
    every = every[np.argsort((np.repeat(np.arange(len(sets)), n) << 32) | rank, kind="stable")]
    first = np.where(n > 0, n - np.ceil((similarity - 1e-9) * n - 1e-6).astype(np.int64) + 1, 0)
    return n, [every[a : a + k].tobytes() for a, k in zip((np.cumsum(n) - n).tolist(), first.tolist())]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def shingle_similarity(a: str, b: str, size: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; 1 if both texts have no word."""
    return _jaccard(*_shingle_sets([a, b], size))


def _runs(batches: Iterator[pa.RecordBatch], longest: int = 1_000_000) -> Iterator[tuple[dict[str, np.ndarray], int | None]]:
    """Columns of rows sorted by key, in pieces that end with a key's last row; and a key that was cut.

    A key of more than ``longest`` rows is given in pieces.
    """
    held: list[dict[str, np.ndarray]] = []
    broken = None
    for b in batches:
        if sum(len(h["key"]) for h in held) > longest:
            broken = int(held[0]["key"][-1])
            yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}, broken
            held = []
        rows = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
        if held and (cut or rows["key"][0] != held[0]["key"][-1]):
            head = [*held, {n: v[:cut] for n, v in rows.items()}]
            yield {n: np.concatenate([h[n] for h in head]) for n in rows}, broken
            held = []
        elif cut:
            yield {n: v[:cut] for n, v in rows.items()}, broken
        held.append({n: v[cut:] for n, v in rows.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}, broken


def _close(rows: dict[str, np.ndarray], at: np.ndarray, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of rows under one key, both among ``at``'s keys, that may be similar enough.

    Where two texts first meet, they share no more shingles than either has from there on.
    """
    key, n, left = rows["key"], rows["spot"] & 0xFFFFFFFF, rows["spot"] >> 32
    share = (similarity - 1e-9) / (1 + similarity - 1e-9)
    found = [np.zeros((2, 0), np.int64)]
    for distance in range(1, most):
        at = at[at + distance < len(key)]
        at = at[key[at] == key[at + distance]]
        if not len(at):
            break
        near = at[np.minimum(left[at], left[at + distance]) >= share * (n[at] + n[at + distance]) - 1e-6]
        found.append(np.stack((near, near + distance)))
    i, j = np.concatenate(found, axis=1)
    return i, j


def _shingle_keys(nodes: DataFrame) -> DataFrame:
    """A row (key, spot, node) for each of the first shingles of each node.

    The spot has the number of the node's shingles from this one on, and below it that of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, first = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for at, to in sized(first, 1_000_000):
                key = np.frombuffer(b"".join(first[at:to]), np.int64)
                k = np.array([len(x) // 8 for x in first[at:to]])
                place, all_ = np.arange(len(key)) - np.repeat(np.cumsum(k) - k, k), np.repeat(n[at:to].astype(np.int64), k)
                columns = [pa.array(key), pa.array((all_ - place) << 32 | all_), pa.array(np.repeat(node[at:to], k))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "spot", "node"])

    return nodes.select("node", "n", "first").mapInArrow(tidy(run), "key long, spot long, node long")


def _candidates(nodes: DataFrame, most: int, similarity: float, all_pairs: bool = False) -> DataFrame:
    """What hangs together: rows (a, b, pairs, crowded), each node b with one earlier node a, once by crowded keys and once by others.

    Members of a key are compared at all distances in the order of their nodes, for all keys
    of a batch at once. A node is given with the first node of its component among the key's
    close pairs, and the number of close pairs that it adds. A key with over ``most`` members
    counts all its pairs as close: each member comes with the first one. So a key gives no
    more rows than it has members. ``all_pairs`` gives every close pair of small keys instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of: dict[int, int] = {}
        for rows, broken in _runs(batches):
            key, node = rows["key"], rows["node"]
            n = len(key)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.concatenate((starts, [n])))
            crowded = np.repeat(sizes > most, sizes)
            if broken is not None:
                crowded |= key == broken
            i, j = _close(rows, np.flatnonzero(np.repeat(sizes > 1, sizes) & ~crowded), most, similarity)
            if all_pairs:
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(np.ones(len(i), np.int64)), pa.array(np.zeros(len(i), bool))], names)
                continue
            root = np.arange(n)
            while len(i):
                least, new = np.minimum(root[i], root[j]), root.copy()
                np.minimum.at(new, i, least)
                np.minimum.at(new, j, least)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            start = np.repeat(starts, sizes)
            root = np.where(crowded, start, root)
            pairs = np.where(crowded, np.arange(n) - start, np.bincount(j, minlength=n))
            head = node[root]
            if broken is not None:  # a key in pieces: all pieces hang on its very first node
                head[key == broken] = first_of.setdefault(broken, int(head[key == broken][0]) if (key == broken).any() else 0)
            own = np.flatnonzero(head != node)
            _, once = np.unique(np.stack((head[own], node[own])), axis=1, return_index=True)
            own = own[once]
            yield pa.RecordBatch.from_arrays([pa.array(head[own]), pa.array(node[own]), pa.array(pairs[own].astype(np.int64)), pa.array(crowded[own])], names)

    names = ["a", "b", "pairs", "crowded"]
    keyed = _shingle_keys(nodes).repartition("key").sortWithinPartitions("key", "node")
    met = keyed.mapInArrow(tidy(run), "a long, b long, pairs long, crowded boolean")
    return met.groupBy("a", "b", "crowded").agg(F.max("pairs").alias("pairs")).select("a", "b", "pairs", "crowded")


def _block_links(texts: list[str], fps: np.ndarray | None, size: int, similarity: float) -> np.ndarray:
    """For each text the first one of its component. Similar enough shingles alone decide; ``fps`` has no part in it."""
    sets: list[np.ndarray] = []
    for a, b in sized([t.encode("utf-8", "surrogatepass") for t in texts]):
        sets += _shingle_sets(texts[a:b], size)
    counts = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), counts)
    place = np.cumsum(times > 1) - 1  # shingles that only one text has are in no intersection
    row, column = row[times[column] > 1], place[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        shared += part @ part.T
    union = counts[:, None] + counts[None, :] - shared
    link = shared >= (similarity - 1e-9) * union
    np.fill_diagonal(link, True)
    return _spanning(link)


def _similarities(a: Column, b: Column, size: int) -> Column:
    """Jaccard similarity of the word shingles of two texts."""

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list[float] = []
        for at in range(0, len(a), 256):
            left, right = a[at : at + 256].tolist(), b[at : at + 256].tolist()
            texts = list(dict.fromkeys(left + right))
            sets = {}
            for x, y in sized([t.encode("utf-8", "surrogatepass") for t in texts]):
                sets |= zip(texts[x:y], _shingle_sets(texts[x:y], size))
            out += [_jaccard(sets[x], sets[y]) for x, y in zip(left, right)]
        return pd.Series(out, dtype=float)

    return similar(a, b)


def _around_hubs(texts: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of texts (crowd, node, text) with a few hubs of their crowd; and (crowd, node, linked) of all.

    Hubs are any texts of the crowd. ``linked`` are those that the links join to the first hub:
    so the near copies of one text cost a few comparisons each, however many they are.
    """

    @F.pandas_udf("int")
    def near(texts: pd.Series, hubs: pd.Series) -> pd.Series:
        """A bit for each hub that a text is similar enough to."""
        out: list[int] = []
        for at in range(0, len(texts), 256):
            own, around = texts[at : at + 256].tolist(), [[h["text"] for h in x] for x in hubs[at : at + 256]]
            every = list(dict.fromkeys([*own, *(h for x in around for h in x)]))
            sets = {}
            for x, y in sized([t.encode("utf-8", "surrogatepass") for t in every]):
                sets |= zip(every[x:y], _shingle_sets(every[x:y], size))
            out += [sum((_jaccard(sets[t], sets[h]) >= similarity - 1e-9) << i for i, h in enumerate(x)) for t, x in zip(own, around)]
        return pd.Series(out, dtype="int32")

    hubs = texts.groupBy("crowd").agg(F.array(*(F.min_by(F.struct("node", "text"), F.xxhash64(F.lit(i), "node")) for i in range(HUBS))).alias("hubs"))
    hubs = checkpointed(hubs)
    met = checkpointed(texts.join(hubs, "crowd").select("crowd", "node", near("text", "hubs").alias("bits")))
    which = hubs.select("crowd", F.posexplode("hubs").alias("i", "hub")).select("crowd", "i", F.col("hub.node").alias("a"))
    links = met.select("crowd", F.col("node").alias("b"), F.explode(F.array(*(F.when(F.col("bits").bitwiseAND(1 << i) != 0, i) for i in range(HUBS)))).alias("i"))
    links = links.join(which, ["crowd", "i"]).where("a <> b").select("a", "b")
    # Hubs that hang together through any text are one component, that of the first hub counts.
    joined = lambda bits, all_: F.aggregate(all_, bits, lambda acc, x: F.when(acc.bitwiseAND(x) != 0, acc.bitwiseOR(x)).otherwise(acc))
    main = met.groupBy("crowd").agg(F.collect_set("bits").alias("all"))
    main = main.select("crowd", F.aggregate(F.sequence(F.lit(1), F.lit(HUBS)), F.lit(1), lambda acc, _: joined(acc, F.col("all"))).alias("main"))
    state = met.join(main, "crowd").select("crowd", "node", (F.col("bits").bitwiseAND(F.col("main")) != 0).alias("linked"))
    return links, checkpointed(state)


def _blocks(crowds: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float, text: str, key: str) -> DataFrame:
    """Links (a, b) within crowds (crowd, node): all are compared that could still matter, and each block gives a link a text at most.

    A crowd of up to ``PART`` texts is one block. In a larger one texts are first compared with
    hubs. Those linked to one are in one component, and need not be compared with each other;
    those that are not are dealt into parts, which meet each other and the parts of the linked
    ones, two parts a task. No pair is ever a row.
    """
    sizes = crowds.groupBy("crowd").count()
    small = crowds.join(sizes.where(F.col("count") <= PART).select("crowd"), "crowd").select("crowd", F.lit(0).alias("i"), F.lit(0).alias("j"), "node")
    large = checkpointed(crowds.join(sizes.where(F.col("count") > PART).select("crowd"), "crowd"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        root = _block_links(rows["text"].tolist(), None, size, similarity)
        own = np.flatnonzero(root != np.arange(len(root)))
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": node[own], "b": node[root[own]]})

    def met(dealt: DataFrame, texts: DataFrame) -> DataFrame:
        return dealt.join(texts, "node").groupBy("crowd", "i", "j").applyInPandas(meet, "a long, b long")

    links = met(small, _texts(small.select("node").distinct(), nodes, docs, text, key))
    if large.isEmpty():
        return links
    texts = checkpointed(large.join(_texts(large.select("node"), nodes, docs, text, key), "node"))
    starred, state = _around_hubs(texts, size, similarity)
    parts = state.groupBy("crowd").agg(F.ceil(F.count_if(~F.col("linked")) / PART).cast("int").alias("n"), F.ceil(F.count_if("linked") / PART).cast("int").alias("m"))
    dealt = state.join(parts.where("n > 0"), "crowd")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("m")).otherwise(F.col("n"))).cast("int")
    # Parts of linked texts have the numbers from n on; they only meet those before n.
    dealt = dealt.select("crowd", "node", "n", "m", "linked", F.when(F.col("linked"), F.col("n") + own).otherwise(own).alias("p"))
    others = F.when(F.col("linked"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.sequence(F.lit(0), F.col("n") + F.col("m") - 1))
    dealt = dealt.select("crowd", "node", "p", F.explode(others).alias("q"))
    dealt = dealt.select("crowd", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "node")
    return links.unionAll(starred).unionAll(met(dealt, texts.select("node", "text")))


def _crowds(met: DataFrame, weight: int) -> tuple[DataFrame, DataFrame]:
    """(crowd, node) of what hangs together by ``met``, and (crowd, dense) of each crowd: whether it is compared in blocks.

    Keys with too many members for pairs have crowds of their own, numbered below zero: all who meet in one are compared. The
    other keys' pairs are counted, and chain most texts of a large corpus to one crowd, hardly any two of them similar. That
    crowd stays one of pairs, whatever keys with many members some of its texts have: those are in a crowd of each kind.
    Where a crowd is large, a text in a block costs ``weight`` times what a text in a pair does.
    """
    few = met.where(~F.col("crowded"))
    crowds = checkpointed(components(few.select("a", "b"))).withColumnRenamed("root", "crowd")
    pairs = few.join(crowds, F.col("b") == F.col("node")).groupBy("crowd").agg(F.sum("pairs").alias("m"))
    sizes = crowds.groupBy("crowd").agg(F.count("*").alias("k")).join(pairs, "crowd")
    # Blocks send a text once for each part of its crowd, pairs send two texts each.
    cost = F.col("k") * F.ceil(F.col("k") / PART) * F.when(F.col("k") > PART, weight).otherwise(1)
    sizes = checkpointed(sizes.select("crowd", (cost <= 2 * F.col("m")).alias("dense")))
    many = met.where("crowded").select("a", "b")
    if many.isEmpty():
        return crowds, sizes
    full = checkpointed(components(many)).select("node", (-1 - F.col("root")).alias("crowd"))
    return crowds.unionByName(full), sizes.unionByName(full.select("crowd", F.lit(True).alias("dense")).distinct())


def _thinned(crowds: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b, pairs, crowded), as candidates have them, of all pairs within crowds (crowd, node) that marks do not rule out.

    Marks (node, n, marks) are sent once for each part of the crowd; they are much shorter than texts, and a part has more of
    them. Two parts with too many pairs left give stars that join them instead, as crowded.
    """
    share = (1 - similarity + 1e-9) / (1 + similarity - 1e-9)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable")
        node, n, part = (rows[c].to_numpy() for c in ("node", "n", "p"))
        width, marks, one = rows["marks"].str.len().to_numpy(), rows["marks"].tolist(), rows["i"].iloc[0] == rows["j"].iloc[0]
        ends = np.searchsorted(n, np.floor(n / (similarity - 1e-9) + 1e-6), side="right")
        root, pairs, left = np.arange(len(n)), [np.zeros((2, 0), np.int64)], PAIRS_LEFT * len(n)
        for w in np.unique(width).tolist():  # sorted as n is; texts of a width may be like those of the next, which are folded
            at, to, end = np.searchsorted(width, (w, w + 1, 2 * w + 1)).tolist()
            words = np.frombuffer(b"".join(marks[at:to]), np.uint64).reshape(-1, w // 8)
            if to < end:
                longer = np.frombuffer(b"".join(marks[to:end]), np.uint64).reshape(-1, w // 4)
                words = np.concatenate((words, longer[:, : w // 8] ^ longer[:, w // 8 :]))
            for i in range(at, to):
                j = np.arange(i + 1, min(end, ends[i]))
                j = j if one else j[part[j] != part[i]]
                apart = np.bitwise_count(words[j - at] ^ words[i - at]).sum(axis=1, dtype=np.int64)
                j = j[apart <= share * (n[i] + n[j]) + 1e-6]
                if not len(j):
                    continue
                joined = np.unique(root[[i, *j]])
                root[np.isin(root, joined)] = joined[0]
                left -= len(j)
                if left >= 0:
                    pairs.append(np.stack((np.full(len(j), i), j)))
        own = np.flatnonzero(root != np.arange(len(n)))
        i, j = np.concatenate(pairs, axis=1) if left >= 0 else np.stack((root[own], own))
        return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "pairs": np.int64(1), "crowded": left < 0})

    parts = crowds.groupBy("crowd").agg(F.ceil(F.count("*") / MARKS_PART).cast("int").alias("m"))
    dealt = crowds.join(parts, "crowd").join(marks, "node").withColumn("p", F.pmod(F.xxhash64("node"), "m").cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("crowd", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "n", "marks")
    met = dealt.groupBy("crowd", "i", "j").applyInPandas(meet, "a long, b long, pairs long, crowded boolean")
    return met.distinct()


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """node and text of the nodes wanted; nodes has the key of a document with the text."""
    keys = checkpointed(wanted.join(nodes, "node").select("node", F.col("rep").alias(key)))
    found = docs.select(key, text_or_empty(text).alias("text")).join(hinted(keys), key)
    return found.select("node", "text").dropDuplicates(["node"])


def _pair_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float, text: str, key: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, each pair by itself."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(wanted, nodes, docs, text, key)

    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    return both.select("a", "b", _similarities(F.col("text_a"), F.col("text_b"), size).alias("s")).where(F.col("s") >= similarity - 1e-9).select("a", "b")


def near_duplicates(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id", most: int = 512
) -> DataFrame:
    """The key and group_id, the smallest key of its group, of every row with a non-null key.

    Texts with the same words are one node, so exact copies never meet. Candidates that hang
    together are a crowd, and so are the members of keys with over ``most`` of them. A crowd
    with many pairs for its texts is compared in blocks, each a task with a bounded number of
    texts that gives a link a text at most; one with few pairs is compared pair by pair.
    Either way every candidate pair is verified, and a large group of near copies makes no
    more rows than it has texts and parts.

    Candidates are first those whose 64-bit fingerprints link at two or fewer bits, found by Golay
    keys, then those of a prefix filter, which are further apart. Pairs that are compared one by
    one are first told apart by short marks, so that few texts are sent.

    Candidates are complete and verification is exact, so all pairs of ``similarity`` or more
    are joined, in crowds of either kind, and no others. Null and empty
    texts have no words and are one group. Rows repeated under one key share a group through
    either's text. Null keys give no row. Other columns are ignored.
    """

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for at, to in sized(texts):
                sets = _shingle_sets(texts[at:to], size)
                n, first = _prefixes(sets, similarity, known)
                columns = [*map(pa.array, _classify(texts[at:to])), pa.array(n.astype(np.int32)), pa.array(first, pa.binary())]
                columns += [pa.array([_set_fingerprint(x) for x in sets], pa.int64()), pa.array([_marks(x) for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *columns], [key, "h", "g", "n", "first", "fp", "marks"])

    kind = dict(docs.dtypes)[key]
    source = lean(docs).where(F.col(key).isNotNull()).select(key, text_or_empty(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(source, size))
    classes = checkpointed(source.mapInArrow(tidy(classify), f"`{key}` {kind}, h long, g long, n int, first binary, fp long, marks binary"))
    nodes = checkpointed(classes.groupBy("h", "g").agg(F.min(key).alias("rep"), F.min("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()))
    own = hinted(nodes.select(F.col("rep").alias(key), "h", "g", "node"))
    shingles = classes.join(own, [key, "h", "g"]).select("node", "n", "first", "marks")

    linked_bits = checkpointed(_fingerprint_candidates(nodes.select("node", "fp")))
    met = checkpointed(_candidates(shingles, most, similarity).unionAll(linked_bits.select("a", "b", F.lit(1).cast("long"), F.lit(False))))
    crowds, sizes = _crowds(met, TEXT_IN_MARKS)
    dense, sparse = (crowds.join(sizes.where(F.col("dense") == x).select("crowd"), "crowd") for x in (True, False))
    dense = checkpointed(dense.select("crowd", "node"))
    large = checkpointed(dense.join(dense.groupBy("crowd").count().where(F.col("count") > PART).select("crowd"), "crowd"))
    listed = None
    if not large.isEmpty():  # all of them would meet all others: first by their marks, and then those that are left
        left = checkpointed(_thinned(large, shingles.select("node", "n", "marks").dropDuplicates(["node"]), similarity))
        again, how = _crowds(left, 1)
        meeting, apart = (again.join(how.where(F.col("dense") == x).select("crowd"), "crowd") for x in (True, False))
        others = F.when(F.col("crowd") < 0, F.col("crowd") - (1 << 61)).otherwise(F.col("crowd") + (1 << 61))  # numbers of their own
        small = dense.join(large.select("crowd").distinct(), "crowd", "left_anti")
        dense = checkpointed(small.unionByName(meeting.select(others.alias("crowd"), "node")))
        listed = left.where(~F.col("crowded")).join(apart.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    links = checkpointed(_blocks(dense, nodes, docs, size, similarity, text, key))
    if listed is not None:
        links = links.unionAll(checkpointed(_pair_links(listed, nodes, docs, size, similarity, text, key)))
    if not sizes.where("not dense").isEmpty():
        apart = hinted(checkpointed(sparse.select("node")))
        alone = shingles.join(apart, "node", "left_semi")
        pairs = _candidates(alone, most, similarity, all_pairs=True).select("a", "b")
        pairs = checkpointed(pairs.unionAll(linked_bits.join(apart.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")).distinct())
        marks = checkpointed(alone.select("node", "n", "marks").dropDuplicates(["node"]))
        pairs = checkpointed(_may_be_similar(pairs, marks, similarity))
        links = links.unionAll(checkpointed(_pair_links(pairs, nodes, docs, size, similarity, text, key)))
    roots = components(links)
    linked = checkpointed(nodes.join(roots, "node"))
    least = linked.groupBy("root").agg(F.min("rep").alias("group_id"))
    named = linked.join(least, "root").select("node", "group_id")
    # A table of its own, so that both sides of the join are exchanged and a crowded text's rows can be split.
    own = checkpointed(nodes.join(named, "node", "left").select("h", "g", F.coalesce("group_id", "rep").alias("group_id")))
    return classes.join(own, ["h", "g"]).select(key, "group_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without all but the document of the smallest key of each group of near-duplicates.

    Null texts, empty ones and those without a word are one group. Rows with a null key stay; of
    rows repeated under the key that stays, one is kept; an empty table gives an empty result; all
    columns are kept, whatever their names.
    """
    groups = checkpointed(near_duplicates(docs, text=text, key=key, **options))
    gone = groups.groupBy(key).agg(F.min("group_id").alias("g"), F.count("*").alias("n"))
    gone = checkpointed(gone.where((F.col("g") < F.col(key)) | (F.col("n") > 1)))
    again = gone.where(F.col("g") == F.col(key)).select(key)
    kept = without(docs, gone, key)
    if again.isEmpty():
        return kept.select(docs.columns)
    return kept.unionByName(docs.join(hinted(again), key, "left_semi").dropDuplicates([key])).select(docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = fingerprint_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

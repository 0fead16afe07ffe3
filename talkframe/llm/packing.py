"""Packing of tokenized documents into fixed windows by best-fit decreasing.

Documents are tokenized and cut where they are read; only a short row a piece is exchanged. A
document longer than a window gives full windows first, each a sequence of its own, and one
shorter rest. The rests are dealt by a hash into groups of about ``pieces_per_group`` and each
group is packed alone: longest piece first, into the open window with the least room that still
holds it, which a segment tree over the remaining capacities finds in log2(window) steps.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table, tidy

#: Texts are tokenized in slices of about so many bytes; so many words are remembered, about, in 40 bytes each.
SLICE_BYTES = 4_000_000
CACHED_WORDS = 800_000
#: Words that the tokenizer gets at once: it keeps a hundred bytes for each of their tokens.
WORDS_AT_ONCE = 20_000
#: What a tokenizer says of itself whose texts may be taken word by word.
NORMALIZER = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: A letter before a sign of ASCII: the two are never in one token, nor is the sign in one with what comes before.
LETTER_SIGN = f"([{LATIN}])([!-/:-@\\[-`{{-~])"
PLAIN = re.compile(f"[{LATIN}]+")


class WordCache:
    """Token ids of words: the words as one Arrow array, their ids one after another.

    Words are looked up many at once. Beyond ``CACHED_WORDS`` those that were not met for
    longest go, about half of them.
    """

    def __init__(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.lengths, self.met, self.now = np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def places(self, words: pa.Array, encode) -> np.ndarray:
        """Where each of these distinct words is; ``encode`` gives ids and lengths of unknown ones."""
        self.now += 1
        if len(self.words) > CACHED_WORDS:
            self._keep(self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2])
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            missing = at.is_null()
            new = words.filter(missing)
            ids, lengths = encode(new.to_pylist())
            place = at.fill_null(0).to_numpy().copy()
            place[missing.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids, self.lengths = np.concatenate((self.ids, ids)), np.concatenate((self.lengths, lengths.astype(np.int32)))
            self.met = np.concatenate((self.met, np.zeros(len(new), np.int32)))
        else:
            place = at.to_numpy()
        self.met[place] = self.now
        return place

    def _keep(self, own: np.ndarray) -> None:
        self.ids = self.ids[np.repeat(own, self.lengths)]
        self.words = self.words.filter(pa.array(own))
        self.lengths, self.met = self.lengths[own], self.met[own]


class WordTokenizer:
    """Token ids of whole texts through a cache of words.

    That is for tokenizers whose normalizer and pattern of words are NORMALIZER and
    WORD_PATTERN: they lower-case, drop white space and part letters from signs, and never join
    characters across these, so a text's ids are its words' ids one after another, and most
    words have been seen before. Only ASCII capitals are folded and only Latin letters parted
    from signs here; all else is left to the tokenizer. Texts that spell a special token go to
    the tokenizer whole, and so do all texts where the tokenizer is of another kind.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Each run of letters ends in one token of this kind, if the vocabulary marks word ends.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.by_word = self._takes_words()
        self.cache = WordCache()

    def _takes_words(self) -> bool:
        about = json.loads(self.tokenizer.to_str())
        steps = (about["normalizer"] or {}).get("normalizers", [])
        splits = (about["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            [(x["type"], x.get("pattern")) for x in steps] == NORMALIZER
            and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": WORD_PATTERN}
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
        )

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), WORDS_AT_ONCE):
            own = words[a : a + WORDS_AT_ONCE]
            plain = np.array([bool(PLAIN.fullmatch(w)) for w in own])
            # Plain words go to the tokenizer as one text, which is parted at the word ends again.
            found = np.array(self.tokenizer.encode(" ".join([w for w, p in zip(own, plain) if p]), add_special_tokens=False).ids, np.uint32)
            n = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
            if len(n) != plain.sum():
                plain[:] = False
                found = found[:0]
            other = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, p in zip(own, plain) if not p], add_special_tokens=False)]
            count = np.zeros(len(own), np.int64)
            count[plain], count[~plain] = n[: plain.sum()], [len(x) for x in other]
            out, in_plain = np.zeros(count.sum(), np.uint32), np.repeat(plain, count)
            out[in_plain], out[~in_plain] = found, np.array([i for x in other for i in x], np.uint32)
            ids.append(out)
            lengths.append(count)
        return np.concatenate(ids), np.concatenate(lengths)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (and the last one's end)."""
        if not self.by_word:
            parts = self._whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
        lower = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, LETTER_SIGN, r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        place = self.cache.places(coded.dictionary, self._ids)
        lengths = self.cache.lengths[place].astype(np.int64)
        starts = (np.cumsum(self.cache.lengths, dtype=np.int64) - self.cache.lengths)[place]
        word = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[word]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[word] - ends + n, n)
        at += np.arange(total)
        out = self.cache.ids[at]
        bounds = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        marked = {i for s in self.specials if s.encode() in _data(lower) for i in np.flatnonzero(pc.match_substring(lower, s).to_numpy(zero_copy_only=False))}
        if marked:
            parts = [out[a:b] for a, b in zip(bounds, bounds[1:])]
            for i in marked:
                parts[i] = self._whole([texts[int(i)].as_py()])[0]
            out, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return out, bounds


def _data(texts: pa.Array) -> bytes:
    return (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about ``most`` in all; a longer row is alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have about ``most`` bytes: in longer ones more words repeat."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, with_ids: bool, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's pieces: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        for whole in gathered(batches, SLICE_BYTES):
            texts = whole.column(1)
            for a, b in slices(pc.binary_length(texts).to_numpy(), SLICE_BYTES):
                ids, bounds = encoder.encode(texts.slice(a, b - a).cast(pa.string()))
                all_ = np.insert(ids, bounds[1:], end_id).astype("<u4")
                n = np.diff(bounds) + 1
                k = -(-n // window)  # pieces of each document
                doc = np.repeat(np.arange(len(n)), k)
                start = (np.arange(len(doc)) - (np.cumsum(k) - k)[doc]) * window
                length = np.minimum(window, n[doc] - start)
                at = (np.cumsum(n) - n)[doc] + start
                raw = memoryview(all_).cast("B")
                crc = [zlib.crc32(raw[x:y]) for x, y in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
                columns = [whole.column(0).slice(a, b - a).take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, length, crc, n[doc]))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(all_)), pa.int32()), pa.array(all_.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return lean(docs).select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(tidy(cut), schema)


class Windows:
    """Open windows by remaining capacity, under a segment tree of their counts."""

    def __init__(self, window: int) -> None:
        self.half = 1 << window.bit_length()
        self.tree = [0] * (2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made, self.window = 0, window

    def _count(self, capacity: int, by: int) -> None:
        i = capacity + self.half
        while i:
            self.tree[i] += by
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity, ``length`` or more, of any open window."""
        i = length + self.half
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.half:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.half
            i >>= 1
        return None

    def put(self, length: int) -> tuple[int, int]:
        """The window that takes the piece, and the piece's place in it."""
        room = self.tightest(length)
        if room is None:
            room, which = self.window, self.made
            self.made += 1
        else:
            which = self.open[room].pop()
            self._count(room, -1)
        if left := room - length:
            self.open[left].append(which)
            self._count(left, 1)
        return which, self.window - room


def best_fit_decreasing(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    pieces_per_group: int = 8192,
    with_ids: bool = False,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: a place in a window for each token.

    Result: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on
    request). A null text is empty; an empty text is its end token alone; a null key stays
    null; repeated rows are packed each; an empty table gives no sequence; other columns are
    ignored. ``tokenizer`` is a file that every executor has.
    """
    cut = pieces(docs, tokenizer, window, end_id, with_ids, text, key)
    groups = max(1, -(-docs.count() // pieces_per_group))
    rows_at_once = 8 * pieces_per_group

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group, then longest first; a group too large to hold is packed in turns."""
        made: dict[int, int] = {}

        def packed(rows: pd.DataFrame, group: int) -> pd.DataFrame:
            windows = Windows(window)
            places = [windows.put(int(n)) for n in rows["length"]]
            first = made.get(group, 0)
            made.clear()
            made[group] = first + windows.made
            ids = [(group << 36) + first + w for w, _ in places]
            return rows.drop(columns="_group").assign(sequence_id=ids, offset=[o for _, o in places])

        held: list[pd.DataFrame] = []
        for batch in batches:
            for group, rows in batch.groupby("_group", sort=True):
                if held and (held[0]["_group"].iloc[0] != group or sum(map(len, held)) >= rows_at_once):
                    yield packed(pd.concat(held), int(held[0]["_group"].iloc[0]))
                    held = []
                held.append(rows)
        if held:
            yield packed(pd.concat(held), int(held[0]["_group"].iloc[0]))

    grouped = cut.withColumn("_group", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(groups)))
    ordered = grouped.repartition("_group").sortWithinPartitions("_group", F.desc("length"), key, "start", "ids_crc32")
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return ordered.mapInPandas(tidy(pack), schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    import public_tokenizers

    return best_fit_decreasing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

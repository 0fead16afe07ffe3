"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, kept as bits (a set bit is -1). An n-gram's vector
binds its letters: the first letter's vector is permuted (rotated by a byte) n-1 times, the next
n-2 times, and so on, and all are multiplied, which is XOR of the bits. A text's vector bundles
(adds up) the vectors of its n-grams; a language's prototype bundles its training texts, each
scaled to length one. A text is given the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, lean, table, tidy, unboxed

DIMENSIONS, NGRAM, SEED = 1024, 3, 7
#: Training texts a language, about: the bound of the sample that the prototypes are fitted on.
TRAIN_PER_LANGUAGE = 4000
#: Characters that are bundled at once; a longer text is alone.
SLICE_CHARS = 300_000
#: N-grams whose vectors are made at once, and counts of n-grams in texts that are held at once.
NGRAMS_AT_ONCE, COUNTS_AT_ONCE = 2048, 1 << 21


class Encoder:
    """Text vectors; letters get their random vectors when first met, the same everywhere."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = NGRAM, seed: int = SEED) -> None:
        if dimensions % 8:
            raise ValueError("dimensions come in whole bytes")
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.id_of = np.full(0x110000, -1, np.int32)  # -1: not met; 0: not a letter
        self.letters, self.met = np.zeros((64, dimensions // 8), np.uint8), 1  # row 0 is the gap's
        self.letters[0] = self._bits(32)
        self.id_of[[0, 32]] = 0

    def _bits(self, point: int) -> np.ndarray:
        return np.frombuffer(np.random.default_rng([self.seed, point]).bytes(self.dimensions // 8), np.uint8)

    def _meet(self, points: np.ndarray) -> None:
        for p in points.tolist():
            if not chr(p).isalpha():
                self.id_of[p] = 0
                continue
            if self.met == len(self.letters):
                self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
            self.letters[self.met], self.id_of[p] = self._bits(p), self.met
            self.met += 1

    def _bound(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Bits of the vectors of n-grams, a row each; ``codes`` are their letters' ids in base ``width``."""
        out = np.zeros((len(codes), self.dimensions // 8), np.uint8)
        for place in reversed(range(self.n)):
            out ^= np.roll(self.letters[codes % width], self.n - 1 - place, axis=1)
            codes = codes // width
        return np.unpackbits(out, axis=1)

    def _bundle(self, codes: np.ndarray, own: np.ndarray, n_texts: int, width: int) -> np.ndarray:
        """Sums of the vectors of n-grams in each text; ``own`` are the texts' numbers."""
        if width**self.n <= 1 << 21:
            found = np.flatnonzero(np.bincount(codes, minlength=1))
            column = np.zeros(int(found[-1]) + 1 if len(found) else 1, np.int64)
            column[found] = np.arange(len(found))
            column = column[codes]
        else:
            found, column = np.unique(codes, return_inverse=True)
        counts, step = None, NGRAMS_AT_ONCE
        if n_texts * len(found) <= COUNTS_AT_ONCE:
            counts = np.bincount(own * len(found) + column, minlength=n_texts * len(found)).reshape(n_texts, len(found)).astype(np.float32)
        else:
            step = max(1, min(step, COUNTS_AT_ONCE // n_texts))
            order = np.argsort(column, kind="stable")
            column, own = column[order], own[order]
        set_bits = np.zeros((n_texts, self.dimensions), np.float32)
        for at in range(0, len(found), step):
            some = found[at : at + step]
            if counts is not None:
                part = counts[:, at : at + step]
            else:
                a, b = np.searchsorted(column, (at, at + len(some)))
                part = np.bincount(own[a:b] * len(some) + column[a:b] - at, minlength=n_texts * len(some)).reshape(n_texts, len(some)).astype(np.float32)
            set_bits += part @ self._bound(some, width).astype(np.float32)
        return np.bincount(own, minlength=n_texts)[:, None].astype(np.float32) - 2 * set_bits

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of length one, a row a text, and which texts have a letter (others get zeros)."""
        lower = [t.lower() for t in texts]  # this can lengthen a text
        points = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in lower])
        ids = self.id_of[points]
        if (new := ids < 0).any():
            self._meet(np.unique(points[new]))
            ids = self.id_of[points]
        doc = np.repeat(np.arange(len(texts) + 1), np.diff(ends, prepend=-1, append=len(ids) - 1))  # text i: after ends[i-1], to ends[i]
        keep = np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))  # one gap between words
        ids, doc = ids[keep], doc[keep]
        has = np.bincount(doc[ids > 0], minlength=len(texts))[: len(texts)] > 0
        width, m = max(2, self.met), len(ids) - self.n + 1
        if m <= 0:
            return np.zeros((len(texts), self.dimensions), np.float32), has
        codes = np.zeros(m, np.int64)
        for place in range(self.n):
            codes = codes * width + ids[place : place + m]
        # An n-gram belongs to the text of its middle letter; those across a border touch only the gap.
        own = doc[self.n // 2 : self.n // 2 + m]
        inside = (own < len(texts)) & (ids[self.n // 2 : self.n // 2 + m] > 0)
        out = self._bundle(codes[inside], own[inside], len(texts), width)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm), has

    def batches(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of texts with their vectors, few enough at once to hold."""
        start, total = 0, 0
        for i, t in enumerate([*texts, None]):
            if t is None or total + len(t) > SLICE_CHARS and i > start or i - start >= 256:
                if i > start:
                    yield start, i, *self.encode(texts[start:i])
                start, total = i, 0
            total += len(t or "")


@lru_cache(2)
def _encoder(dimensions: int, n: int, seed: int) -> Encoder:
    return Encoder(dimensions, n, seed)


def fit_prototypes(
    train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE,
    dimensions: int = DIMENSIONS, n: int = NGRAM, seed: int = SEED,
) -> dict[str, np.ndarray]:
    """A unit vector for each language of the training rows with a non-null language.

    About ``per_language`` texts of each language, chosen by a hash of the key, are bundled;
    partial sums are formed where the texts are, so the driver gets one vector a language.

    Rows with a null text or language teach nothing; nor does a text without a letter, and a
    language that has no other gets no prototype. A null key hashes like any other; repeated
    rows count each; texts count as a whole; an empty table gives no prototype; other columns,
    whatever their names, are ignored. The result does not depend on the rows' order but for
    the rounding of sums.
    """
    train = train.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    train = train.where("lang is not null and text is not null")
    share = {r[0]: min(1.0, per_language / r[1]) for r in train.groupBy("lang").count().collect()}
    if not share:
        return {}
    rate = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
    chosen = train.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 20)) < rate * (1 << 20))

    def bundle(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = _encoder(dimensions, n, seed), {}
        for batch in rows:
            names = batch["lang"].to_numpy()
            for a, b, vectors, _ in encoder.batches(batch["text"].tolist()):
                for name in set(names[a:b]):
                    sums[name] = sums.get(name, 0) + vectors[names[a:b] == name].sum(axis=0, dtype=np.float64)
        for name, v in sums.items():
            yield pd.DataFrame({"lang": name, "at": np.arange(dimensions), "value": v})

    parts = lean(chosen).select("lang", "text").mapInPandas(tidy(bundle), "lang string, at int, value double")
    out = {name: np.zeros(dimensions) for name in share}
    for r in parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).collect():
        out[r["lang"]][r["at"]] = r["value"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text",
    dimensions: int = DIMENSIONS, n: int = NGRAM, seed: int = SEED,
) -> DataFrame:
    """``docs`` with lang_pred and score, the cosine with its prototype (0 to 1).

    A null text, and one without a letter, is ``und`` with score 0, as is every text if there
    are no prototypes. Equal cosines go to the language first in the alphabet. Repeated rows
    are judged each; an empty table gives an empty result; long texts count as a whole; input
    columns with the result's names are replaced.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), dimensions)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return tidy(judged_texts)(batches)

    def judged_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(dimensions, n, seed)
        for texts in batches:
            langs, scores = [], []
            for _, _, vectors, has in encoder.batches(texts.fillna("").tolist()):
                cosines = vectors @ matrix.T if names else np.zeros((len(vectors), 1), np.float32)
                best = cosines.argmax(axis=1)
                ok = has & bool(names)
                langs += [names[i] if y else "und" for i, y in zip(best, ok)]
                scores += np.where(ok, cosines[np.arange(len(best)), best].clip(0, 1), 0.0).tolist()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    judged = boxed(lean(docs), judged=judge(F.col(text)))
    return unboxed(judged, docs, lang_pred=F.col("judged.lang_pred"), score=F.col("judged.score"))


def remainder(key: str, of: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    prototypes = fit_prototypes(docs.where(~held_out).select("doc_id", "text", "lang"))
    judged = identify(docs.select("doc_id", "text"), prototypes)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

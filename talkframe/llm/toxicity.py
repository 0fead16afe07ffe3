"""Toxicity: a lexicon matched with up to one or two errors, weighed by its context.

The lexicon is learned from labelled texts: words, and word beginnings, that toxic texts hold
far more often than others. Its trie is intersected with Levenshtein automata; the product is
made deterministic while it is used, so that a word is rejected after the few letters that no
term within the allowed distance has. A match counts for less inside quotation marks or after
a word of reporting, and more beside a word of address. A logistic regression over the sums
turns them into a score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, table, tidy, with_columns
from .lang_id import remainder

#: Labelled texts of each class, about, that the lexicon and the regression are fitted on.
TRAIN_PER_CLASS = 2500
PREFIXES = (4, 5, 6, 7)
#: A term must be in so many contexts of toxic texts, and in this share of all its contexts, were
#: those of clean texts as many as they may be by chance. Copies of a text add no context.
MIN_TOXIC, MIN_PRECISION = 5, 0.85
MIN_DEVIATIONS = 8  # standard deviations over what the clean texts' share would give
WINDOW = 6  # words on each side
REPORTING = frozenset("said says quote quoted quotes wrote called calling word words term reported dijo dice palabra sagte sagt wort dit disait mot".split())
ADDRESS = frozenset("you your yourself tu te vous toi du dich ihr usted ustedes".split())
QUOTES = "\"“”„«»‘’`"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¡¿"
FEATURES = 6


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """Terms within their allowed edit distance of a word.

    A state is the set of (trie node, errors so far, row of the Levenshtein automaton) that the
    letters read so far can be in, kept as a dictionary node -> row of the edit-distance matrix
    against the node's letters. It is expanded letter by letter and remembered.
    """

    def __init__(self, terms: dict[str, float], prefixes: dict[str, float], most_states: int = 50_000) -> None:
        self.weight = {**{t: w for t, w in terms.items()}, **{f"{p}*": w for p, w in prefixes.items()}}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int, bool] | None] = [None]
        self.bound: list[int] = [0]  # the most errors that any term below may have
        self.open_end: dict[int, str] = {}
        for term in terms:
            self._insert(term, allowed_errors(term), False)
        for p in prefixes:
            self._insert(p, 0, True)
        self.most_states = most_states
        self._reset()

    def _insert(self, term: str, errors: int, prefix: bool) -> None:
        node = 0
        self.bound[0] = max(self.bound[0], errors)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.ends.append(None)
                self.bound.append(0)
            node = self.children[node][c]
            self.bound[node] = max(self.bound[node], errors)
        if prefix:
            self.open_end[node] = f"{term}*"
        else:
            self.ends[node] = (term, errors, False)

    def _close(self, errors: dict[int, int], begun: str | None) -> tuple:
        """Letters of terms that the word leaves out: each costs an error."""
        queue = sorted(errors)
        while queue:
            node = queue.pop()
            for child in self.children[node].values():
                cost = errors[node] + 1
                if cost <= self.bound[child] and cost < errors.get(child, 9):
                    errors[child] = cost
                    queue.append(child)
        return tuple(sorted(errors.items())), begun

    def _reset(self) -> None:
        start = self._close({0: 0}, None)
        self.number, self.states, self.next, self.found = {start: 0}, [start], [{}], [self._accept(start)]

    def _accept(self, state: tuple) -> tuple[str, int] | None:
        hits = [(e, *self.ends[n][:2]) for n, e in state[0] if self.ends[n]]
        hits = [(e, t) for e, t, most in hits if e <= most]
        if hits and (min(hits)[0] == 0 or not state[1]):
            e, t = min(hits)
            return t, e
        return (state[1], 0) if state[1] else None

    def _step(self, s: int, c: str) -> int:
        """The state after one more letter: it matches, replaces a term's letter, or is surplus."""
        errors: dict[int, int] = {}
        old, begun = self.states[s]
        for node, e in old:
            if e + 1 <= self.bound[node]:
                errors[node] = min(e + 1, errors.get(node, 9))
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.bound[child] and cost < errors.get(child, 9):
                    errors[child] = cost
                if cost == 0 and child in self.open_end:
                    begun = self.open_end[child] if begun is None or len(self.open_end[child]) > len(begun) else begun
        if not errors and begun is None:
            return -1
        state = self._close(errors, begun)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
            self.found.append(self._accept(state))
        return self.number[state]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, or None; exact terms come before beginnings."""
        if len(self.states) > self.most_states:
            self._reset()
        s = 0
        for c in word:
            after = self.next[s].get(c)
            if after is None:
                after = self.next[s][c] = self._step(s, c)
            if after < 0:
                return None
            s = after
        return self.found[s]


@dataclass
class Model:
    terms: dict[str, float]
    prefixes: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [-3.0] + [0.0] * (FEATURES - 1))

    def trie(self) -> FuzzyTrie:
        return FuzzyTrie(self.terms, self.prefixes)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _matches(words: list[str], trie: FuzzyTrie, memo: dict) -> list[tuple[int, str, int]]:
    out = []
    for w in set(words):
        if w not in memo:
            if len(memo) > 500_000:
                memo.clear()
            memo[w] = trie.match(w.strip(EDGES)) if len(w) > 2 else None
        if m := memo[w]:
            out.append((w, m))
    if not out:
        return []
    found = dict(out)
    return [(i, *found[w]) for i, w in enumerate(words) if w in found]


def features(text: str, trie: FuzzyTrie, memo: dict) -> list[float]:
    """1, evidence of abuse, evidence in quotation, most in a window, its density, a misspelling's share."""
    words = words_of(text)
    hits = _matches(words, trie, memo)
    if not hits:
        return [1.0] + [0.0] * (FEATURES - 1)
    abuse = quoted = fuzzy = 0.0
    quotes = np.cumsum([sum(w.count(q) for q in QUOTES) for w in words])
    near: list[tuple[int, float]] = []
    for i, term, errors in hits:
        weight = trie.weight[term] * 0.7**errors
        around = [w.strip(EDGES) for w in words[max(0, i - WINDOW) : i + WINDOW + 1]]
        before = quotes[i - 1] if i else 0
        own = quotes[i] - before
        inside = own >= 2 or (before % 2 == 1 and quotes[-1] > before)
        if inside or REPORTING.intersection(around):
            quoted += weight
            weight *= 0.3
        elif ADDRESS.intersection(around):
            weight *= 1.5
        abuse += weight
        fuzzy += weight * (errors > 0)
        near.append((i, weight))
    most, left, total = 0.0, 0, 0.0
    for i, w in near:
        total += w
        while near[left][0] < i - 2 * WINDOW:
            total -= near[left][1]
            left += 1
        most = max(most, total)
    return [1.0, math.log1p(abuse), math.log1p(quoted), math.log1p(most), math.log1p(1000 * abuse / len(words)), fuzzy / (abuse + 1e-9)]


def _terms_of(text: str) -> set[tuple[str, int]]:
    """Words and their beginnings, each with the word before it: copies of a passage repeat both."""
    out = set()
    words = [w.strip(EDGES) for w in words_of(text)]
    for before, w in zip(["", *words], words):
        if 3 <= len(w) <= 40:
            context = zlib.crc32(before.encode("utf-8", "surrogatepass"))
            out.add((w, context))
            out.update((f"{w[:n]}*", context) for n in PREFIXES if n < len(w))
    return out


def _sample(labels: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each class, by a hash of the key."""
    share = {r[0]: min(1.0, per_class / r[1]) for r in labels.groupBy(label).count().collect()}
    if not share:
        return labels
    rate = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col(label)]
    return labels.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 20)) < rate * (1 << 20))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Newton's method; classes weigh as they come."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = TRAIN_PER_CLASS
) -> Model:
    """Lexicon and regression from about ``per_class`` labelled texts of each class.

    The sample is drawn from the labels and, being bounded, broadcast to the documents. A key
    with several labels counts as toxic if one of them says so.

    One half of the sample, by a hash of the key, gives the lexicon and the other the
    regression, so that terms which are frequent by chance get no trust. Terms are counted
    where the texts are; the driver gets the terms that pass, no more than the bounded sample
    holds, and the sample's features.

    Null texts, and rows with a null or other label, teach nothing; an empty text has no term; a
    null key meets no label; rows repeated under one key are the same label's texts; texts count
    as a whole; equal terms and features need no order; without rows of both classes, as in an
    empty table, the model has no term and gives every text a low score; other columns, whatever
    their names, are ignored.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    labels = labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
    one = labels.where(F.col("label").isin(0, 1)).groupBy("key").agg(F.max("label").cast("int").alias("_label"))
    sample = F.broadcast(_sample(one, "_label", "key", per_class))
    half = F.pmod(F.xxhash64(F.lit(12), "key"), F.lit(2))
    rows = checkpointed(docs.where("text is not null").join(sample, "key").select(F.col("text").alias("_text"), "_label", half.alias("_half")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, int]] = set()
        for b in batches:
            for t, y in zip(b.column("_text").to_pylist(), b.column("_label").to_pylist()):
                seen.update((*x, y) for x in _terms_of(t))
        for part in iter(lambda: list(islice(rest, 100_000)), []) if (rest := iter(seen)) else ():
            columns = [pa.array(c, k) for c, k in zip(zip(*part), (pa.string(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "context", "label"])

    sizes = {r[0]: r[1] for r in rows.where("_half = 0").groupBy("_label").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_toxic or not n_clean:
        return Model({}, {})
    counted = rows.where("_half = 0").mapInArrow(tidy(count), "term string, context long, label int").distinct()
    counted = counted.groupBy("term").agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic"))
    # Shares of the classes, so that the sample's balance does not matter.
    a, b = F.col("toxic") / n_toxic, (F.col("clean") + 1 + 2 * F.sqrt(F.col("clean") + 1)) / n_clean
    expected = (F.col("clean") + 1) * (n_toxic / n_clean)
    kept = (
        counted.where(F.col("toxic") >= MIN_TOXIC)
        .withColumn("precision", a / (a + b))
        .where((F.col("precision") >= MIN_PRECISION) & (F.col("toxic") - expected >= MIN_DEVIATIONS * F.sqrt(expected)))
        .collect()
    )
    weight = {r["term"]: math.log(r["precision"] / (1 - r["precision"])) for r in kept}
    # A longer beginning, or a word, that a kept shorter beginning covers as well adds nothing.
    prefixes: dict[str, float] = {}
    for t in sorted((t for t in weight if t.endswith("*")), key=len):
        covered = [prefixes[t[:n]] for n in range(2, len(t) - 1) if t[:n] in prefixes]
        if not covered or weight[t] > max(covered) + 0.5:
            prefixes[t[:-1]] = weight[t]
    model = Model({t: w for t, w in weight.items() if not t.endswith("*")}, prefixes)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, memo = model.trie(), {}
        for b in batches:
            yield pd.DataFrame({"x": [features(t, trie, memo) for t in b["_text"]], "y": b["_label"]})

    got = rows.where("_half = 1").mapInPandas(tidy(extract), "x array<double>, y int").collect()
    if got:
        model.weights = _logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 up).

    Null and empty texts have no match and get the score of such. Repeated rows are scored
    each; an empty table gives an empty result; texts count as a whole; input columns with the
    result's names are replaced.
    """
    w = np.array(model.weights)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, memo = model.trie(), {}
        for texts in batches:
            x = np.array([features(t, trie, memo) for t in texts.fillna("")]).reshape(len(texts), FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    docs = lean(docs)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*kept, judge(F.col(text)).alias("score"))
    return with_columns(scored, predicted=(F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")

"""Dictionary substitution, and the making of dictionaries from identifiers and word lists."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_identifier
from .relational import first_of_each

#: Entries that a task holds as an automaton at most.
MOST_ENTRIES = 2_000_000


class Substitution:
    """Triggers replaced in a text: leftmost first, of those the longest, at word borders only.

    A border is any character that is no letter or digit. Case does not matter; replacements
    are taken as they are. Two passes let a replacement's own triggers expand once more.
    """

    def __init__(self, entries: Sequence[tuple[str, str]]) -> None:
        self.replacements: dict[str, str] = {}
        for trigger, replacement in entries:
            if trigger and replacement and trigger.strip() and replacement.strip():
                self.replacements.setdefault(self.fold(trigger), replacement)
        try:
            import ahocorasick
        except ImportError:
            ahocorasick = None
        self.automaton = None
        self.trie: dict = {}
        if ahocorasick and self.replacements:
            self.automaton = ahocorasick.Automaton()
            for t in self.replacements:
                self.automaton.add_word(t, len(t))
            self.automaton.make_automaton()
        elif self.replacements:
            for t in self.replacements:
                node = self.trie
                for c in t:
                    node = node.setdefault(c, {})
                node[""] = True

    @staticmethod
    def fold(text: str) -> str:
        """Lower case of the same length."""
        low = text.lower()
        return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c.lower()[0] for c in text)

    def _spans(self, low: str) -> Iterator[tuple[int, int]]:
        if self.automaton is not None:
            for last, length in self.automaton.iter(low):
                yield last + 1 - length, last + 1
            return
        for start in range(len(low)):
            node, at = self.trie, start
            while at < len(low) and low[at] in node:
                node, at = node[low[at]], at + 1
                if "" in node:
                    yield start, at

    def once(self, text: str) -> str:
        low = self.fold(text)
        at_border = [
            (s, -e)
            for s, e in self._spans(low)
            if (s == 0 or not low[s - 1].isalnum()) and (e == len(low) or not low[e].isalnum())
        ]
        if not at_border:
            return text
        out, done = [], 0
        for s, e in sorted(at_border):
            if s >= done:
                out += [text[done:s], self.replacements[low[s:-e]]]
                done = -e
        return "".join([*out, text[done:]])

    def apply(self, text: str) -> str:
        return self.once(self.once(text)) if self.replacements else text


def apply_dictionary(text: Column, entries: DataFrame | Sequence[tuple[str, str]]) -> Column:
    """Substitution by trigger and replacement; a table's rows are ordered by ord, where it has that.

    The entries go to every executor, so their number is checked.
    """
    if isinstance(entries, DataFrame):
        rows = entries.orderBy("ord") if "ord" in entries.columns else entries
        found = rows.select("trigger", "replacement").limit(MOST_ENTRIES + 1).collect()
        entries = [(r[0], r[1]) for r in found]
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"a dictionary of more than {MOST_ENTRIES} entries must be split by tenant first")
    if not entries:
        return text
    shared = SparkSession.active().sparkContext.broadcast(list(entries))

    @F.pandas_udf("string")
    def substitute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = _substitution(shared.value)
        for texts in batches:
            yield texts.map(made.apply, na_action="ignore")

    return substitute(text)


#: The automaton that this worker has built, and the entries that it was built from.
_built: list = []


def _substitution(entries: list[tuple[str, str]]) -> Substitution:
    """Built once a worker, not once a task."""
    if not _built or _built[0] is not entries:
        _built[:] = [entries, Substitution(entries)]
    return _built[1]


def apply_small_dictionary(text: Column, entries: Sequence[tuple[str, str]]) -> Column:
    """The same for a handful of triggers that do not hold one another, inside Catalyst."""
    out = text
    for trigger, replacement in sorted(entries, key=lambda e: (-len(e[0]), e[0])):
        if trigger.strip() and replacement.strip():
            quoted = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in trigger)
            literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
            out = F.regexp_replace(out, rf"(?iu)(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])", literal)
    return out


def triggers(name: Column, variants: Mapping[str, Sequence[str]], most: int = 60) -> Column:
    """Spoken forms of an identifier, shortest first.

    Every part is said as itself or as one of its variants; of all combinations the first
    ``most`` count, in the order of the parts' variants. Forms of under three letters are left out.
    """
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in variants.items() for x in (k, list(v)))) if variants else None

    def forms(part: Column) -> Column:
        own = F.array(F.lower(part))
        more = F.coalesce(table[part], F.array().cast("array<string>")) if table is not None else F.array().cast("array<string>")
        return F.array_distinct(F.concat(own, more))

    def extend(acc: Column, part: Column) -> Column:
        return F.slice(F.flatten(F.transform(acc, lambda a: F.transform(forms(part), lambda v: F.trim(F.concat_ws(" ", a, v))))), 1, most)

    parts = split_identifier(name)
    joined = F.aggregate(parts, F.array(F.lit("")), extend)
    ranked = F.array_sort(F.transform(joined, lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i"), t.alias("t"))))
    return F.when(F.size(parts) > 0, F.filter(F.array_distinct(F.transform(ranked, lambda x: x["t"])), lambda t: F.length(t) >= 3)).otherwise(F.array().cast("array<string>"))


def smart_entries(identifiers: DataFrame, variants: Mapping[str, Sequence[str]], name: str = "name") -> DataFrame:
    """trigger and replacement for identifiers of 6 to 60 letters; each trigger once, by the name's order."""
    kept = identifiers.select(name).distinct().where(F.length(name).between(6, 60))
    pairs = kept.select(F.col(name).alias("replacement"), F.posexplode(triggers(F.col(name), variants)).alias("pos", "trigger"))
    pairs = pairs.where(F.col("trigger") != F.lower("replacement"))
    return first_of_each(pairs, ["trigger"], ["replacement", "pos"]).select("trigger", "replacement")


def morphology_bundle(bases: DataFrame, suffixes: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Base entries and each with every suffix, without stop words, each (trigger, replacement) once.

    ``bases`` has trigger and replacement, ``suffixes`` suffix; the product is what is asked for.
    """
    both = bases.crossJoin(suffixes).select(F.concat("trigger", "suffix").alias("trigger"), F.concat("replacement", "suffix").alias("replacement"))
    all_ = bases.select("trigger", "replacement").unionByName(both).withColumn("_key", F.lower("trigger"))
    stops = stop_words.select(F.lower("word").alias("_key"))
    return all_.join(stops, "_key", "left_anti").dropDuplicates(["_key", "replacement"]).select("trigger", "replacement")


def corrections_to_entries(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """(trigger, replacement) of words that a user changed in place; texts of other lengths tell nothing."""
    from ..functions.text import words

    a, b = words(F.col(before)), words(F.col(after))
    zipped = F.filter(F.arrays_zip(a.alias("trigger"), b.alias("replacement")), lambda p: p["trigger"] != p["replacement"])
    return pairs.where(F.size(a) == F.size(b)).select(F.inline(zipped)).distinct()


def replaced_words(pairs: DataFrame, before: str = "raw_text", after: str = "text", least: int = 3) -> DataFrame:
    """(before, after, n): words that corrections put in another's place, in so many places or more.

    Texts are aligned word by word; where as many words stand against as many others, they pair up
    in order. Rows without both texts are passed over. Alignment needs both whole word lists at
    once, so it is done in Arrow batches.
    """

    @F.pandas_udf("array<struct<before:string,after:string>>")
    def changed(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = x.split(), y.split()
            blocks = SequenceMatcher(None, p, q, autojunk=False).get_opcodes()
            out.append([{"before": u, "after": v} for kind, i, j, k, m in blocks if kind == "replace" and j - i == m - k for u, v in zip(p[i:j], q[k:m])])
        return pd.Series(out)

    rows = pairs.where(F.col(before).isNotNull() & F.col(after).isNotNull() & (F.col(before) != F.col(after)))
    found = rows.select(F.inline(changed(F.col(before), F.col(after))))
    return found.groupBy("before", "after").agg(F.count("*").alias("n")).where(F.col("n") >= least)

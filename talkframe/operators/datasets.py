"""Training pairs: merged, made unique, spoilt on purpose, split and formatted, repeatably.

Chance is a hash of the row and a seed, so a result does not depend on how rows are dealt.
Exact sizes come from ``numbered``, which counts rows by ranges of their hash instead of
sorting them in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import below, choose, order, uniform
from ..functions.text import capitalize_first, chat_ml, drop_filler_words, drop_punctuation, end_sentence, fold_marks, let, strip, words
from .relational import first_of_each

PAIR = ("input", "output")


def valid_pairs(rows: DataFrame, differ: bool = False) -> DataFrame:
    """Pairs with both sides there and not blank; ``differ`` asks for two different sides."""
    out = rows.where((F.trim("input") != "") & (F.trim("output") != ""))
    return out.where(F.col("input") != F.col("output")) if differ else out


def changed(rows: DataFrame, how: str = "exact") -> DataFrame:
    """Pairs whose sides differ: ``exact``; ``folded``, by case and outer blanks; ``loose``, by a last stop too."""
    a, b = F.col("input"), F.col("output")
    if how != "exact":
        a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    if how == "loose":
        a, b = F.regexp_replace(a, r"\.+$", ""), F.regexp_replace(b, r"\.+$", "")
    return rows.where(a != b)


def short_enough(rows: DataFrame, most: float = 1.5) -> DataFrame:
    """Pairs whose output is no more than so many times as long as the input."""
    return rows.where(F.length("output") <= most * F.length("input"))


def merge(*sources: DataFrame) -> DataFrame:
    """All sources' rows with src and ord: the source's number and the row's in it."""
    out = None
    for i, s in enumerate(sources):
        own = s if "ord" in s.columns else s.withColumn("ord", F.monotonically_increasing_id())
        own = own.withColumn("src", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def unique(rows: DataFrame, keys: Sequence[str] = PAIR, trimmed: bool = False, arrival: Sequence[str] = ("src", "ord")) -> DataFrame:
    """The first row of each key in order of arrival; ``trimmed`` ignores outer blanks of the keys alone."""
    columns = [F.trim(k) if trimmed else F.col(k) for k in keys]
    return first_of_each(rows, columns, list(arrival))


def numbered(rows: DataFrame, seed: int, *keys: str, ranges: int | None = None) -> DataFrame:
    """Rows with n, their place from 0 in a shuffle by the seed, and no task for all of them.

    A row's hash falls into one of ``ranges`` ranges, a power of two that grows with the rows: a
    hundred thousand in each, about. Ranges are counted, which gives each the number of rows
    before it, and rows are only sorted inside their range. Rows of equal hash are ordered by
    the keys; rows with equal keys are interchangeable.
    """
    ranges = ranges or 1 << min(20, max(8, (rows.count() // 100_000).bit_length()))
    hashed = rows.withColumn("_h", order(seed, *map(F.col, keys)))
    hashed = hashed.withColumn("_r", F.shiftright("_h", 64 - (ranges.bit_length() - 1)))
    counts = hashed.groupBy("_r").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.sum("_c").over(Window.orderBy("_r")) - F.col("_c")).select("_r", "_b")
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_h", *keys))
    return hashed.join(F.broadcast(before), "_r").withColumn("n", (F.col("_b") + place - 1).cast("long")).drop("_r", "_h", "_b")


#: Bits of a hash by which rows are counted.
BIN_BITS = 16


def stratified(rows: DataFrame, k: int, seed: int, *keys: str, strata: Sequence[str] = ()) -> DataFrame:
    """``k`` rows without replacement of each stratum, or all it has; null is a stratum of its own.

    A stratum's rows of the least hashes are taken. Rows are counted by the first bits of their
    hashes, which is all that is exchanged of them; the counts say up to which bin all rows are
    taken, and only those of the next bin, one in 65,536, are put in order. Rows of equal hash
    are ordered by the keys; rows with equal keys are interchangeable.
    """
    hashed = rows.withColumn("_h", order(seed, *map(F.col, keys))).withColumn("_bin", F.shiftright("_h", 64 - BIN_BITS))
    places = [f"_s{i}" for i in range(len(strata))]
    counts = hashed.groupBy(*(F.col(s).alias(p) for s, p in zip(strata, places)), "_bin").agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*places).orderBy("_bin"))).where(F.col("_upto") > k)
    edges = upto.groupBy(*places).agg(F.min("_bin").alias("_edge"), F.min_by(k - F.col("_upto") + F.col("_c"), "_bin").alias("_rest"))
    same = [F.col(s).eqNullSafe(F.col(p)) for s, p in zip(strata, places)]
    near = hashed.join(edges if strata else F.broadcast(edges), reduce(Column.__and__, same, F.lit(True)), "left").where(F.col("_edge").isNull() | (F.col("_bin") <= F.col("_edge")))
    sure = near.where(F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")))
    edge = near.where(F.col("_bin") == F.col("_edge")).withColumn("_n", F.row_number().over(Window.partitionBy(*places).orderBy("_h", *keys))).where(F.col("_n") <= F.col("_rest"))
    return sure.select(rows.columns).unionAll(edge.select(rows.columns))


def sample(rows: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """``k`` rows without replacement, or all."""
    return stratified(rows, k, seed, *keys)


def split(rows: DataFrame, seed: int, *keys: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Rows with split: floor(n·train) train, floor(n·valid) valid, the rest test."""
    total = rows.agg(F.count("*").alias("_t"))
    both = numbered(rows, seed, *keys).crossJoin(F.broadcast(total))  # the total is one row
    a = F.floor(F.col("_t") * train + 1e-9)
    b = a + F.floor(F.col("_t") * valid + 1e-9)
    label = F.when(F.col("n") < a, "train").when(F.col("n") < b, "valid").otherwise("test")
    return both.withColumn("split", label).drop("n", "_t")


def split_with_floor(rows: DataFrame, seed: int, *keys: str, valid: float = 0.1, test: float = 0.05, least: tuple[int, int] = (1, 1)) -> DataFrame:
    """Rows with split: valid and test get their share, rounded down but no less than ``least``; train the rest."""
    total = rows.agg(F.count("*").alias("_t"))
    both = numbered(rows, seed, *keys).crossJoin(F.broadcast(total))
    v = F.greatest(F.lit(least[0]), F.floor(F.col("_t") * valid + 1e-9))
    t = F.greatest(F.lit(least[1]), F.floor(F.col("_t") * test + 1e-9))
    label = F.when(F.col("n") < v, "valid").when(F.col("n") < v + t, "test").otherwise("train")
    return both.withColumn("split", label).drop("n", "_t")


#: Rows that one task sorts, about, and the most parts that an order is cut into.
ROWS_A_PART, MOST_PARTS = 1_000_000, 4096


def placed(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows with n, their place from 0 in the order of a key, and no task for all of them.

    There are as many ``parts`` as millions of rows, 64 at least and 4096 at most. Borders come
    from a sample of 16 keys a part, chosen by their hash; rows between two borders are counted,
    and sorted among themselves. A key that is a border has parts of its own, into which its rows
    are dealt by a hash of their values: so a key that is repeated often is not sorted in one
    task. Null keys come first.
    """
    parts = parts or min(MOST_PARTS, max(64, -(-rows.count() // ROWS_A_PART)))
    known = rows.select(key).where(F.col(key).isNotNull())
    sampled = sorted(r[0] for r in known.orderBy(order(0, F.col(key)), key).limit(16 * parts).collect())
    cuts = sorted(set(sampled[:: max(1, len(sampled) // parts)][1:]))
    kind = dict(rows.dtypes)[key]
    # The borders are one row, which is broadcast; each key is searched for by halves.
    borders = rows.sparkSession.createDataFrame([(cuts,)], f"_cuts array<{kind}>")
    at = F.aggregate(
        F.sequence(F.lit(0), F.lit(max(0, len(cuts).bit_length()))), F.struct(F.lit(0).alias("a"), F.size("_cuts").alias("b")),
        lambda s, _: F.when(s["a"] < s["b"], F.when(F.get("_cuts", F.floor((s["a"] + s["b"]) / 2).cast("int")) <= F.col(key), F.struct((F.floor((s["a"] + s["b"]) / 2) + 1).cast("int").alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b")))).otherwise(s),
        lambda s: s["a"],
    )
    cut = rows.crossJoin(F.broadcast(borders)).withColumn("_p", F.when(F.col(key).isNull(), -1).otherwise(at))
    border = F.coalesce(F.get("_cuts", F.col("_p") - 1) == F.col(key), F.lit(False)) | F.col(key).isNull()
    dealt = F.when(border, F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(parts))).otherwise(F.lit(parts).cast("long"))
    cut = cut.withColumn("_q", dealt).drop("_cuts")
    counts = cut.groupBy("_p", "_q").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.sum("_c").over(Window.orderBy("_p", "_q")) - F.col("_c")).select("_p", "_q", "_b")
    place = F.row_number().over(Window.partitionBy("_p", "_q").orderBy(key)) - 1
    return cut.join(F.broadcast(before), ["_p", "_q"]).withColumn("n", (F.col("_b") + place).cast("long")).drop("_p", "_q", "_b")


def split_sorted(rows: DataFrame, key: str, train: float = 0.95) -> DataFrame:
    """Rows with split by their place in the order of a key: floor(n·train) train, the rest is held out."""
    total = rows.agg(F.count("*").alias("_t"))
    both = placed(rows, key).crossJoin(F.broadcast(total))  # the total is one row
    return both.withColumn("split", F.when(F.col("n") < F.floor(F.col("_t") * train + 1e-9), "train").otherwise("eval")).drop("n", "_t")


def tagged(rows: DataFrame, **tags: str) -> DataFrame:
    """Pairs with constant tags, such as type, difficulty or category."""
    return rows.withColumns({k: F.lit(v) for k, v in tags.items()})


def recipe(sources: Sequence[DataFrame], seed: int, cap: int | None = None, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Sources merged, made unique by trimmed pairs, cut to ``cap``, shuffled and split."""
    rows = unique(merge(*(valid_pairs(s) for s in sources)), trimmed=True)
    if cap is not None:
        rows = sample(rows, cap, seed, *PAIR)
    return split(rows, seed + 1, *PAIR, train=train, valid=valid)


def refresh(new: DataFrame, old: DataFrame, seed: int, most_old: int = 600) -> DataFrame:
    """All new pairs with a sample of old ones; valid gets a tenth but 30 at least, test a twentieth but 20."""
    kept = sample(old, most_old, seed, *PAIR)
    return split_with_floor(new.unionByName(kept, allowMissingColumns=True), seed + 1, *PAIR, least=(30, 20))


def extend(new: DataFrame, prior: DataFrame, seed: int) -> DataFrame:
    """New pairs split 85/10/5 and added to a prior split, which keeps its own."""
    return prior.unionByName(split_with_floor(new, seed, *PAIR), allowMissingColumns=True)


def rounds(files: DataFrame, last: int, base: Sequence[DataFrame], seed: int) -> DataFrame:
    """Pairs of rounds 1 to ``last`` (column round) and of the base sets, unique by input, split."""
    rows = unique(merge(*base, files.where(F.col("round").between(1, last))), keys=("input",))
    return split(rows, seed, *PAIR)


def shard(rows: DataFrame, n: int, i: int, key: str) -> DataFrame:
    """Every nth row, from the ith, in the order of a key."""
    return placed(rows, key).where(F.col("n") % n == i).drop("n")


def quotas(groups: DataFrame, target: int, key: str) -> DataFrame:
    """Groups with quota: equal shares of the target; the first groups get what is over."""
    w = Window.orderBy(key)
    total = F.count("*").over(Window.partitionBy(F.lit(0)))
    extra = F.row_number().over(w) <= F.lit(target) % total
    return groups.select("*", (F.floor(F.lit(target) / total) + extra.cast("int")).cast("long").alias("quota"))


def scaled_plan(plan: Mapping[str, int], target: int, least: int = 10) -> dict[str, int]:
    """A plan's numbers scaled to a target, none under ``least``; the last takes the difference."""
    total, names = sum(plan.values()), list(plan)
    out = {k: max(least, int(v * target / total)) for k, v in plan.items()}
    out[names[-1]] += target - sum(out.values())
    return out


def composite_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of each ``a:b`` of the keys, sorted."""
    return rows.groupBy(F.concat_ws(":", *keys).alias("key")).agg(F.count("*").alias("n")).orderBy("key")


def quality(rows: DataFrame, source: str = "input", target: str = "output") -> DataFrame:
    """One row of counters: total, missing, empty, changed and (of pairs) duplicates."""
    a, b = F.col(source), F.col(target)
    return rows.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("a").isNull() | F.col("b").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when((F.trim("a") == "") | (F.trim("b") == ""), F.col("n"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("n"))), F.lit(0)).alias("changed"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def chat_rows(rows: DataFrame, system: str) -> DataFrame:
    """text: each pair as a chat."""
    return rows.select(chat_ml(F.col("input"), F.col("output"), system).alias("text"), *[c for c in rows.columns if c not in PAIR])


# Fillers by how often a speaker uses them, those of recognisers, and common mishearings.
FILLERS = {
    "low": ("yani", "iste", "hani"),
    "medium": ("yani", "sey", "iste", "hani", "ee", "aa", "tamam"),
    "high": ("yani", "sey", "iste", "hani", "ee", "aa", "falan", "nasil diyeyim", "bi dakika", "him", "simdi", "aslinda", "bir nevi", "dur bi saniye", "neyse", "tamam", "ya"),
}
SPOKEN_FILLERS = ("yani", "şey", "hani", "işte", "ee", "aa", "falan", "filen", "öyle yani")
TRUTH_FILLERS = ("ee", "aa", "hmm", "hm", "ıı", "mm", "ah", "eh", "uh", "um")
MISHEARD = (
    ("değil", "deil"), ("gideceğim", "gideceyim"), ("yapacağız", "yapacayiz"), ("başlamak", "baslamak"), ("çalışıyor", "calisiyor"),
    ("söylüyor", "soyluyor"), ("görüşürüz", "gorusuruz"), ("öğrenci", "ogrenci"), ("düşünüyorum", "dusunuyorum"),
)
# How many fillers a text gets at least and at most.
FILLER_COUNTS = {"low": (0, 1), "medium": (1, 3), "high": (3, 6)}


class Style(NamedTuple):
    """How a persona speaks: how often with fillers, and the chances that each kind of thing is spoilt."""

    fillers: str
    term: float
    mark: float
    suffix: float
    stop: float
    capital: float
    border: float


# The personas.
STYLES = {
    "senior": Style(fillers="low", term=0.5, mark=0.3, suffix=0.4, stop=0.3, capital=0.5, border=0.05),
    "mid": Style(fillers="medium", term=0.6, mark=0.4, suffix=0.5, stop=0.5, capital=0.6, border=0.08),
    "junior": Style(fillers="high", term=0.8, mark=0.5, suffix=0.6, stop=0.6, capital=0.7, border=0.12),
    "pm": Style(fillers="medium", term=0.4, mark=0.35, suffix=0.5, stop=0.4, capital=0.5, border=0.06),
}
# Suffixes that run together with their word, with what follows them.
SUFFIXES = (
    "ı ", "i ", "u ", "ü ", "a ", "e ", "da ", "de ", "dan ", "den ", "ta ", "te ", "tan ", "ten ", "la ", "le ", "ın ", "in ", "nın ", "nin ", "ya ", "ye ",
    "ı.", "i.", "a.", "e.", "da.", "de.", "dan.", "den.", "nın.", "nin.", "ya.", "ye.",
    "ı,", "i,", "a,", "e,",
)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _each_character(text: Column, seed: int, row: Column, change) -> Column:
    """Characters changed by ``change(character, place, chance)``; null drops one."""
    return F.array_join(F.filter(F.transform(_characters(text), lambda c, i: change(c, i, uniform(seed, row, i))), lambda c: c.isNotNull()), "")


def spoil_terms(text: Column, variants: Mapping[str, Sequence[str]], chance: float, seed: int, row: Column) -> Column:
    """Terms, longest first, said as one of their variants, a chance a term."""
    if not variants:
        return text
    quoted = lambda t: "(?iu)" + "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in t)
    terms = F.array(*(
        F.struct(F.lit(quoted(t)).alias("p"), F.array(*map(F.lit, variants[t])).alias("v"))
        for t in sorted(variants, key=lambda t: (-len(t), t))
    ))

    def step(acc: Column, x: Column) -> Column:
        said = F.element_at(x["v"], below(F.size(x["v"]), seed + 1, row, x["p"]).cast("int") + 1)
        return F.when(uniform(seed, row, x["p"]) < chance, F.regexp_replace(acc, x["p"], said)).otherwise(acc)

    return F.aggregate(terms, text, step)


def spoil_marks(text: Column, chance: float, seed: int, row: Column) -> Column:
    return _each_character(text, seed, row, lambda c, i, u: F.when(u < chance, fold_marks(c)).otherwise(c))


def spoil_suffixes(text: Column, chance: float, seed: int, row: Column) -> Column:
    """Suffixes after an apostrophe run together with their word, the first of each kind."""

    def step(acc: Column, s: Column) -> Column:
        at = F.position(F.concat(F.lit("'"), s), acc)
        joined = F.concat(F.substring(acc, F.lit(1), at - 1), F.substring(acc, at + 1, F.length(acc)))
        return F.when((at > 0) & (uniform(seed, row, s) < chance), joined).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, SUFFIXES)), text, step)


def spoil_punctuation(text: Column, chance: float, seed: int, row: Column) -> Column:
    marks = F.array(*map(F.lit, ".,;:!?"))
    return _each_character(text, seed, row, lambda c, i, u: F.when(~(F.array_contains(marks, c) & (u < chance)), c))


def spoil_capitals(text: Column, chance: float, seed: int, row: Column) -> Column:
    """The first capital goes with the chance, others with two fifths of it."""
    return _each_character(text, seed, row, lambda c, i, u: F.when(u < F.when(i == 0, chance).otherwise(0.4 * chance), F.lower(c)).otherwise(c))


def spoil_borders(text: Column, chance: float, seed: int, row: Column) -> Column:
    """A word joined to the next, or, if longer than seven letters, parted in the middle, at half the chance."""

    def step(acc: Column, w: Column) -> Column:
        i = acc["i"]
        joins = ~acc["glued"] & (uniform(seed, row, i) < chance)
        mid = F.floor(F.length(w) / 2).cast("int")
        parts = ~joins & ~acc["glued"] & (F.length(w) > 7) & (uniform(seed + 1, row, i) < chance / 2)
        said = F.when(parts, F.concat(F.substring(w, F.lit(1), mid), F.lit(" "), F.substring(w, mid + 1, F.length(w)))).otherwise(w)
        gap = F.when(acc["glued"] | (i == 0), F.lit("")).otherwise(F.lit(" "))
        return F.struct((i + 1).alias("i"), joins.alias("glued"), F.concat(acc["out"], gap, said).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("glued"), F.lit("").alias("out"))
    return F.aggregate(words(text), start, step, lambda acc: acc["out"])


def add_fillers(text: Column, frequency: Column | str, seed: int, row: Column) -> Column:
    """None or one filler (low), one to three (medium), or three to six (high); texts under three words keep none."""
    named = F.lit(frequency) if isinstance(frequency, str) else frequency
    of = lambda values, f: F.create_map(*(x for k, v in values.items() for x in (F.lit(k), f(v))))[named]
    fillers = of(FILLERS, lambda v: F.array(*map(F.lit, v)))
    least, most = (of(FILLER_COUNTS, lambda v, i=i: F.lit(v[i])) for i in range(2))
    return let(words(text), lambda said: _with_fillers(said, fillers, least, most, seed, row))


def _with_fillers(said: Column, fillers: Column, least: Column, most: Column, seed: int, row: Column) -> Column:
    room = F.greatest(F.lit(1), F.size(said) - 1)
    low, high = F.least(least, room), F.least(most, room)
    n = low + below(high - low + 1, seed, row).cast("int")

    def put(acc: Column, k: Column) -> Column:
        at = F.when((k == 0) & (uniform(seed + 1, row) < 0.5), 1).otherwise(2 + below(F.size(acc) - 1, seed + 2, row, k).cast("int"))
        return F.array_insert(acc, at, F.element_at(fillers, 1 + below(F.size(fillers), seed + 3, row, k).cast("int")))

    turns = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.when(F.size(said) < 3, said).otherwise(F.aggregate(turns, said, put)), " ")


def spoil(text: Column, style: Column | str, variants: Mapping[str, Sequence[str]], seed: int, row: Column) -> Column:
    """All layers in order: terms, marks, suffixes, punctuation, capitals, word borders, fillers.

    The style may differ from row to row; one that is not known is ``mid``.
    """
    named = F.lit(style) if isinstance(style, str) else style
    known = F.when(named.isin(*STYLES), named).otherwise("mid")
    chance = {f: F.create_map(*(F.lit(x) for k, v in STYLES.items() for x in (k, getattr(v, f))))[known] for f in Style._fields}
    out = spoil_terms(text, variants, chance["term"], seed, row)
    out = spoil_marks(out, chance["mark"], seed + 10, row)
    out = spoil_suffixes(out, chance["suffix"], seed + 20, row)
    out = spoil_punctuation(out, chance["stop"], seed + 30, row)
    out = spoil_capitals(out, chance["capital"], seed + 40, row)
    out = spoil_borders(out, chance["border"], seed + 50, row)
    out = add_fillers(out, chance["fillers"], seed + 60, row)
    return F.array_join(words(out), " ")


def spoil_by_difficulty(text: Column, difficulty: Column, seed: int, row: Column) -> Column:
    """easy: one letter's marks, and stops or the first capital; medium: two letters', stops, the capital and two
    of (filler, mishearing, parted word); hard: all marks, all of these, a dropped word and one more filler."""
    letters = F.array(*map(F.lit, "âüöışçğİÜÖŞÇĞ"))

    def marks(t: Column, k: int) -> Column:
        there = F.filter(letters, lambda c: F.contains(t, c))
        mixed = F.array_sort(F.transform(there, lambda c: F.struct(order(seed, row, c).alias("o"), c.alias("c"))))
        return F.aggregate(F.slice(mixed, 1, k), t, lambda acc, x: F.replace(acc, x["c"], F.translate(x["c"], "âüöışçğİÜÖŞÇĞ", "auoiscgIUOSCG")))

    lower_first = lambda text_: let(text_, lambda t: F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, 2, 2147483647)))

    def filler(t: Column, k: int) -> Column:
        w = choose(list(SPOKEN_FILLERS), None, seed + k, row)

        def put(said: Column) -> Column:
            at = F.when(F.size(said) < 2, 1).otherwise(2 + below(F.greatest(F.size(said) - 1, F.lit(1)), seed + k + 1, row).cast("int"))
            return F.array_join(F.array_insert(said, at, w), " ")

        return let(words(t), put)

    def misheard(text_: Column) -> Column:
        return let(text_, _misheard)

    def _misheard(t: Column) -> Column:
        hits = F.filter(F.array(*(F.struct(order(seed + 3, row, F.lit(a)).alias("o"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in MISHEARD)), lambda x: F.contains(t, x["a"]))
        first = F.try_element_at(F.array_sort(hits), F.lit(1))
        at = F.instr(t, first["a"])
        return F.when(F.size(hits) == 0, t).otherwise(F.concat(F.substring(t, F.lit(1), at - 1), first["b"], F.substring(t, at + F.length(first["a"]), F.length(t))))

    def parted(t: Column) -> Column:
        return let(words(t), _parted)

    def _parted(said: Column) -> Column:
        long = F.filter(F.transform(said, lambda w, i: F.when(F.length(w) > 5, i)), lambda i: i.isNotNull())
        which = F.element_at(long, below(F.greatest(F.size(long), F.lit(1)), seed + 4, row).cast("int") + 1)
        cut = lambda w: 2 + below(F.length(w) - 3, seed + 5, row).cast("int")
        out = F.transform(said, lambda w, i: F.when(i == which, F.concat(F.substring(w, F.lit(1), cut(w)), F.lit(" "), F.substring(w, cut(w) + 1, F.length(w)))).otherwise(w))
        return F.array_join(F.when(F.size(long) == 0, said).otherwise(out), " ")

    def dropped(t: Column) -> Column:
        return let(words(t), _dropped)

    def _dropped(said: Column) -> Column:
        short = F.filter(F.transform(said, lambda w, i: F.when(F.length(w) <= 4, i)), lambda i: i.isNotNull())
        which = F.element_at(short, below(F.greatest(F.size(short), F.lit(1)), seed + 6, row).cast("int") + 1)
        return F.array_join(F.when((F.size(said) < 4) | (F.size(short) == 0), said).otherwise(F.filter(said, lambda w, i: i != which)), " ")

    easy = let(marks(text, 1), lambda t: F.when(uniform(seed + 7, row) < 0.5, drop_punctuation(t)).otherwise(lower_first(t)))
    left_out = below(3, seed + 8, row)
    medium = let(
        lower_first(drop_punctuation(marks(text, 2))),
        lambda t: F.when(left_out == 0, parted(misheard(t))).when(left_out == 1, parted(filler(t, 20))).otherwise(misheard(filler(t, 20))),
    )
    hard = lower_first(drop_punctuation(marks(text, 13)))
    hard = filler(dropped(parted(misheard(filler(hard, 20)))), 30)
    return F.when(difficulty == "easy", easy).when(difficulty == "medium", medium).otherwise(hard)


def spoilt_pairs(rows: DataFrame, seed: int, text: str = "text", key: str = "id", shares: Mapping[str, float] | None = None) -> DataFrame:
    """input, output and difficulty from clean texts; texts that come out unchanged give no pair."""
    shares = shares or {"easy": 0.3, "medium": 0.4, "hard": 0.3}
    level = choose(list(shares), list(shares.values()), seed, F.col(key))
    own = rows.select(key, strip(F.col(text)).alias("output"), level.alias("difficulty"))
    out = own.withColumn("input", spoil_by_difficulty(F.col("output"), F.col("difficulty"), seed + 1, F.col(key)))
    return changed(out).select(key, "input", "output", "difficulty")


def persona_variants(rows: DataFrame, variants: Mapping[str, Sequence[str]], seed: int, n: int = 7, text: str = "text", key: str = "id", persona: str = "persona") -> DataFrame:
    """``n`` spoilt versions of each text in its persona's style, unique by input, none equal to its output.

    A version that comes out unchanged is said in lower case without punctuation instead, and
    left out if even that changes nothing.
    """
    own = rows.select(F.col(key), F.col(persona), F.col(text).alias("output"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant"))
    row = F.struct(key, "variant")
    out = own.withColumn("input", spoil(F.col("output"), F.col(persona), variants, seed, row))
    plain = drop_punctuation(F.lower("output"))
    out = out.withColumn("input", F.when(F.col("input") == F.col("output"), plain).otherwise(F.col("input")))
    return unique(changed(out), keys=("input",), arrival=(key, "variant"))


class Round(NamedTuple):
    """What a training round does: the chances for stops and capitals, whether fillers are more, and versions of a text."""

    name: str
    stop: float
    capital: float
    boost: bool
    versions: int


# The rounds, which then begin again.
ROUNDS = (
    Round("balanced", stop=0.5, capital=0.6, boost=False, versions=5),
    Round("filler_heavy", stop=0.3, capital=0.4, boost=True, versions=6),
    Round("punct_focus", stop=0.8, capital=0.9, boost=False, versions=5),
    Round("light", stop=0.3, capital=0.3, boost=False, versions=5),
    Round("extreme_filler", stop=0.6, capital=0.7, boost=True, versions=7),
    Round("no_punct", stop=0.9, capital=0.5, boost=False, versions=5),
    Round("mixed", stop=0.5, capital=0.6, boost=True, versions=7),
    Round("gentle", stop=0.2, capital=0.2, boost=False, versions=4),
    Round("real_world", stop=0.5, capital=0.5, boost=True, versions=8),
    Round("final_push", stop=0.5, capital=0.6, boost=True, versions=9),
)


def spoilt_round(rows: DataFrame, number: int, frequency: str, seed: int, text: str = "text", key: str = "id") -> DataFrame:
    """Pairs of round ``number`` (from 1): each text in as many versions as the round asks for, unique by input."""
    _, stop, capital, boost, n = ROUNDS[(number - 1) % len(ROUNDS)]  # rounds are numbered from 1
    if boost:
        frequency = "medium" if frequency == "low" else "high"
    own = rows.select(key, F.col(text).alias("output"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant"))
    row = F.struct(key, "variant", F.lit(number))
    said = spoil_capitals(spoil_punctuation(F.col("output"), stop, seed, row), capital, seed + 1, row)
    out = own.withColumn("input", F.array_join(words(add_fillers(said, frequency, seed + 2, row)), " "))
    return unique(changed(out), keys=("input",), arrival=(key, "variant"))


def more_fillers(frequency: Column) -> Column:
    """low becomes medium, all else high."""
    return F.when(frequency == "low", "medium").otherwise("high")


def from_templates(templates: DataFrame, vocabulary: DataFrame, slot: str, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Pairs of every template (text with ``{slot}``) and word: the sentence, and it in lower case without its stop."""
    both = templates.crossJoin(vocabulary)  # the product is what is asked for
    said = capitalize_first(end_sentence(F.replace(F.col("template"), F.lit(f"{{{slot}}}"), F.col("word"))))
    pairs = both.select(F.regexp_replace(F.lower(said), r"[.!?…]+$", "").alias("input"), said.alias("output"))
    pairs = pairs.dropDuplicates(["input", "output"])
    return sample(pairs, cap, seed, *PAIR) if cap is not None else pairs


def clean_truth(text: Column) -> Column:
    """A transcript as it should have been written: no fillers, a capital first, a stop last."""
    trimmed = strip(text)
    left = drop_filler_words(trimmed, TRUTH_FILLERS)
    gone = F.size(F.filter(words(trimmed), lambda w: ~F.regexp_replace(F.lower(w), "[.,!?]+$", "").isin(*TRUTH_FILLERS))) == 0
    return F.when(gone, trimmed).otherwise(end_sentence(capitalize_first(left)))


def recognition_pairs(rows: DataFrame, heard: str = "heard", truth: str = "truth") -> DataFrame:
    """input (as heard) and output (as it should be), where the two differ by more than case and blanks."""
    return changed(rows.select(F.col(heard).alias("input"), clean_truth(F.col(truth)).alias("output")), "folded")


def pair_by_stem(audio: DataFrame, transcripts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Audio files (path, stem) with a text: a transcript of the same stem, else a line of metadata that holds it.

    ``transcripts`` has stem and text; ``metadata`` file, line_no and line: what it names up to
    the first tab, comma or ``|``, and the words after that. A line counts for every stem that
    stands anywhere in its name; the last file that has one decides, in it the first line. If
    both have a column folder, only lines of the file's own folder count. Blank texts are null.

    The join is on equal keys: the stems, and all runs of a name that are as long as some stem.
    Stems of equal beginnings, as numbered files have them, so never meet one another's lines.
    """
    own = ["folder"] if "folder" in audio.columns and "folder" in metadata.columns else []
    stems = audio.select("stem", *own).where("stem <> ''").distinct()
    lengths = stems.agg(F.collect_set(F.length("stem")).alias("_lengths"))  # one row
    named = metadata.where(F.col("line").rlike(r"[\t,|]")).select("file", "line_no", *own, F.regexp_extract("line", r"^([^\t,|]*)[\t,|]", 1).alias("_name"), F.regexp_extract("line", r"(?s)^[^\t,|]*[\t,|](.*)$", 1).alias("_said"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length("_name") - n + 1), lambda i: F.substring(F.col("_name"), i, n))
    every = F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.length("_name")), runs))
    pieces = named.join(F.broadcast(lengths)).select("file", "line_no", *own, "_said", F.explode(F.array_distinct(every)).alias("stem"))
    best = stems.join(pieces, ["stem", *own]).groupBy("stem", *own).agg(F.max_by("_said", F.struct("file", -F.col("line_no"))).alias("_line"))
    direct = transcripts.select("stem", *(c for c in own if c in transcripts.columns), F.col("text").alias("_text"))
    joined = audio.join(direct, [c for c in ("stem", *own) if c in direct.columns], "left").join(best, ["stem", *own], "left")
    return joined.withColumn("text", F.nullif(F.trim(F.coalesce("_text", "_line")), F.lit(""))).drop("_text", "_line")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier, broken-off run has not written."""
    return rows.join(done.select(key), key, "left_anti")

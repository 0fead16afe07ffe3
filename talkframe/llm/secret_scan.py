"""Secret scan: fixed patterns, and values whose guess cost shows that they are secrets.

The fixed patterns always count. The method adds values in a credential context (a keyword such
as ``pwd`` or ``Bearer`` before them): each is segmented into words, dates, repeats, sequences,
keyboard walks and brute-force spans so that the guesses needed are fewest, by dynamic
programming over its positions; a value that still takes more than ``min_log10`` decimal orders
of guesses is reported. Placeholders and plain words are cheap to guess and are left alone: the
words are COMMON and those of the scanned texts themselves, counted outside of values.

1. Words of all texts are counted, and ranked by the number of texts that have them.
2. Spans of the fixed patterns and values in context are found where the texts are.
3. Each different value's heads, four letters in a row, are joined with those of the ranked
   words; its parts that begin with a word's head are joined with the ranks; then its cost is
   worked out. No list of words is sent to any worker, and a value has hardly more parts than letters.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, checkpointed, hinted, lean, table, tidy, unboxed

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same runs as HEX and ACCESS find, once those too short to count are left out.
LONG_HEX, LONG_ACCESS = re.compile(r"[0-9a-f]{24,}"), re.compile(r"AKIA[A-Z0-9]{16,}")
#: Contexts that the fixed patterns do not know, each followed by one value.
CONTEXT = re.compile(
    r"""(?i:\b(?:pwd|pass(?:word|phrase|code)?|passwd|pin|cred(?:ential)?s?|secret(?:[_-]?key)?|auth(?:orization)?|bearer|access[_-]?key|private[_-]?key|client[_-]?secret|api[_ -]?key|token)\b)"""
    r"""["']?\x20*(?:[:=]|\bis\b|\x20)\x20*["'`]?([^\s"'`<>,;|]{8,})""",
    re.A,
)
KINDS = ("assign", "access", "hex", "guess")

#: Words that people put into passwords and placeholders, commonest first: the rank is the cost.
COMMON = (
    "password pass secret token admin user login test example sample dummy changeme default root guest "
    "welcome letmein dragon master monkey shadow qwerty hello love sun flower star summer winter spring "
    "autumn monday friday january march april june july august october access key api auth server client "
    "your my the and for none null true false value string placeholder redacted hidden removed"
).split()
RANKS = {w: i + 1 for i, w in enumerate(COMMON)}
#: What a word is, in the texts and in a value; those in SEEN texts or more count as known. A worker holds HELD counts.
SHORTEST, LONGEST = 3, 24
WORDS = re.compile(rf"[^\W\d_]{{{SHORTEST},{LONGEST}}}")
LETTERS = re.compile(r"[^\W\d_]+")
SEEN, HELD = 3, 300_000
#: Letters by which words are found in values first; rows of a batch of parts.
HEAD, ROWS = 4, 50_000
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEIGHBOURS = {a + b for row in KEY_ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@4301!5$7", "aaeolisst")
#: A repeat is of a block of so many characters at most.
WIDEST = 16


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33


def _runs(n: int, goes_on) -> list[int]:
    """For each of n places the end of the run that starts there: ``goes_on(i)`` says whether i + 1 belongs to it."""
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        ends[i] = ends[i + 1] if goes_on(i) else i + 1
    return ends


def guess_cost(value: str, ranks: dict[str, int] = RANKS) -> float:
    """Decimal logarithm of the fewest guesses that some segmentation of the value needs.

    best[j] is the least cost of the first j characters. Each span adds the logarithm of its
    own guesses, and a small charge for the choice of one more span. Where runs of each kind
    end is worked out beforehand, so that time is linear in the value's length.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # letters that lower-case to several stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    single = [math.log10(_alphabet(c)) for c in value]
    step = [ord(b) - ord(a) for a, b in zip(value, value[1:])]
    same = _runs(n, lambda i: step[i] == 0)
    up, down = (_runs(n, lambda i, s=s: step[i] == s) for s in (1, -1))
    walk = _runs(n, lambda i: low[i : i + 2] in NEIGHBOURS)
    again = {w: _runs(max(0, n - w) + 1, lambda i, w=w: i + w < n and value[i] == value[i + w]) for w in range(2, min(WIDEST, n // 2) + 1)}
    brute = [0.0, *accumulate(single)]
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i] + (0.3 if i else 0.0)

        def offer(end: int, cost: float, here: float = here) -> None:
            best[end] = min(best[end], here + cost)

        # A brute-force character carries on the span before it free of the charge.
        best[i + 1] = min(best[i + 1], best[i] + single[i])
        for end in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            if rank := ranks.get(low[i:end]) or ranks.get(plain[i:end]):
                capital = 0.3 if value[i:end] not in (low[i:end], low[i:end].upper()) else 0.0
                offer(end, math.log10(rank + 1) + capital + (0.6 if low[i:end] not in ranks else 0.0))
        if value[i].isdigit() and (m := DATE.match(value, i)):
            offer(m.end(), math.log10(365 * 120 if m.end() - i > 4 else 120))
        if same[i] - i >= 3:
            offer(same[i], single[i] + math.log10(same[i] - i))
        for run in (up[i], down[i]):
            if run - i >= 3:
                offer(run, single[i] + math.log10(2 * (run - i)))
        if walk[i] - i >= 3:
            offer(walk[i], math.log10(36) + math.log10(2.3) * (walk[i] - i - 1))
        for width, ends in again.items():  # a block that is said again
            if i + 2 * width <= n and (times := (ends[i] - 1 - i if ends[i] - 1 > i else 0) // width + 1) > 1:
                offer(i + width * times, brute[i + width] - brute[i] + math.log10(times))
    return best[n]


def spans_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Spans (kind, start, end) of the fixed patterns, and (start, end) of values in a context, outside of these; in code points."""
    if not text:
        return [], []
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [("access", m.start(), m.end()) for m in LONG_ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    ends = list(accumulate((s[2] for s in sorted(spans, key=lambda s: s[1])), max))
    starts = sorted(s[1] for s in spans)
    values = []
    for m in CONTEXT.finditer(text):
        start = m.start(1)
        end = start + len(m[1].rstrip(".!?)]}:"))
        before = bisect_left(starts, end)  # fixed spans that start before the value's end
        if end - start >= 8 and not (before and ends[before - 1] > start):
            values.append((start, end))
    return spans, values


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By start and then in the order of KINDS."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(text: str | None, min_log10: float = 12.0, ranks: dict[str, int] = RANKS) -> list[tuple[str, int, int]]:
    """One text's spans (kind, start, end) in code points, with these words."""
    spans, values = spans_of(text)
    return in_order(spans + [("guess", a, b) for a, b in values if guess_cost(text[a:b], ranks) >= min_log10])


def heads_of(value: str, heads: set[str] | None = None) -> Iterator[str]:
    """The HEAD letters in a row from every place of a value; or, with these ``heads``, the parts that may be words: the shorter ones, and those with a known head."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    for said in {low, low.translate(LEET)}:
        for m in LETTERS.finditer(said):
            run = m[0]
            for i in range(len(run) - SHORTEST + 1):
                head = run[i : i + HEAD]
                if heads is None:
                    yield head
                    continue
                yield from (run[i:j] for j in range(i + SHORTEST, min(len(run) + 1, i + HEAD)))
                if head in heads:
                    yield from (run[i:j] for j in range(i + HEAD, min(len(run), i + LONGEST) + 1))


def _in_rows(words: Iterator[tuple[str, Iterator[str]]]) -> Iterator[pa.RecordBatch]:
    """(digest, word) of each digest's words, in batches of bounded size in which a word comes once a digest."""
    digests: list[str] = []
    parts: list[str] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(parts, pa.string())], ["digest", "word"])
        digests.clear()
        parts.clear()
        return out

    for digest, some in words:
        seen: set[str] = set()
        for w in some:
            if w not in seen:
                seen.add(w)
                digests.append(digest)
                parts.append(w)
                if len(parts) >= ROWS:
                    yield batch()
                    seen.clear()
    yield batch()


def _words_outside(text: str) -> set[str]:
    """A text's words in lower case, without those of values that may be secrets."""
    parts, at = [], 0
    for a, b in sorted(m.span(1) for m in chain(CONTEXT.finditer(text), ASSIGN.finditer(text))):
        parts.append(text[at : max(at, a)])
        at = max(at, b)
    return set(WORDS.findall(" ".join([*parts, text[at:]]).lower()))


def known_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and rank: COMMON first, then the words of all the texts by the number of texts that have them.

    Words in equally many texts share a rank. A value after a credential keyword is not counted,
    so that a secret does not become a word however many copies of it there are; a plain word
    stands elsewhere too. How many words have each number of texts is gathered on the driver:
    k different numbers take k * k / 2 words in texts at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for rows in batches:
            for t in rows.column(0).to_pylist():
                counts.update(_words_outside(t or ""))
                if len(counts) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counted = lean(docs).select(F.col(text).alias("_text")).mapInArrow(tidy(run), "word string, n long")
    common = docs.sparkSession.createDataFrame(list(RANKS.items()), "word string, rank long")
    totals = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN).join(F.broadcast(common), "word", "left_anti")
    totals = checkpointed(totals)
    sizes = totals.groupBy("n").count().toArrow().to_pandas().sort_values("n", ascending=False)
    ahead = sizes["count"].cumsum() - sizes["count"]
    places = [(int(n), len(COMMON) + int(k) + 1) for n, k in zip(sizes["n"], ahead)]
    ranks = docs.sparkSession.createDataFrame(places, "n long, rank long")
    return totals.join(F.broadcast(ranks), "n").select("word", "rank").unionAll(common)


def _secret_values(values: DataFrame, words: DataFrame, min_log10: float) -> DataFrame:
    """digest of those of the different values (digest, value) that take ``min_log10`` orders of guesses or more.

    What a value is joined with is gathered in its row: its known heads and words, no more than
    a few for each of its letters.
    """

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _in_rows((d, heads_of(v)) for d, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _in_rows((d, heads_of(v, set(h or ()))) for d, v, h in zip(*(c.to_pylist() for c in b.columns)))

    @F.pandas_udf("double")
    def cost(value: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([guess_cost(v, {x["word"]: int(x["rank"]) for x in (k if k is not None else ())}) for v, k in zip(value, known)], dtype=float)

    rows = "digest string, word string"
    heads = words.where(F.length("word") >= HEAD).select(F.substring("word", 1, HEAD).alias("word")).distinct()
    begun = values.mapInArrow(tidy(starts), rows).join(heads, "word").groupBy("digest").agg(F.collect_set("word").alias("heads"))
    begun = values.join(begun, "digest", "left").select("digest", "value", "heads")
    met = begun.mapInArrow(tidy(parts), rows).join(words, "word")
    known = met.groupBy("digest").agg(F.collect_set(F.struct("word", "rank")).alias("known"))
    return values.join(known, "digest", "left").where(cost("value", "known") >= min_log10).select("digest")


def scan(docs: DataFrame, min_log10: float = 12.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's secrets: the key and ``secrets``, an array of (kind, start, end).

    Null and empty texts have none; a null key stays null; repeated rows are scanned each; an
    empty table gives an empty result; texts of any length are scanned whole. Other columns are
    ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    value = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            spans, values = [], []
            for t in rows.column(1).to_pylist():
                fixed, open_ = spans_of(t)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in in_order(fixed)])
                values.append([{"start": a, "end": b, "value": t[a:b]} for a, b in open_])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, pa.list_(span)), pa.array(values, pa.list_(value))], ["key", "spans", "values"])

    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, spans array<struct<kind:string,start:long,end:long>>, values array<struct<start:long,end:long,value:string>>"
    found = lean(docs).select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInArrow(tidy(run), schema)
    found = checkpointed(found.withColumn("id", F.monotonically_increasing_id()))
    values = found.select("id", F.explode("values").alias("v")).select("id", "v.start", "v.end", F.col("v.value").alias("value"), F.sha2("v.value", 256).alias("digest"))
    different = checkpointed(values.select("digest", "value").dropDuplicates(["digest"]))
    secret = _secret_values(different, checkpointed(known_words(docs, text)), min_log10)
    values = values.drop("value")
    more = F.collect_list(F.struct(F.lit("guess").alias("kind"), "start", "end"))
    guessed = values.join(checkpointed(secret), "digest").groupBy("id").agg(more.alias("more"))
    # No two spans of different kinds start alike but fixed ones, which stand in their order.
    place = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(place(a) - place(b))
    every = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))), order))
    return found.select("key", "spans", "id").join(guessed, "id", "left").select(F.col("key").alias(key), every.alias("secrets"))


def redact(docs: DataFrame, mask: str = "[secret]", min_log10: float = 12.0, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; overlapping spans give one mask.

    Null texts stay null and empty ones empty; all columns are kept, whatever their names; equal
    texts, repeated rows among them, are scanned once; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def masked(texts: pd.Series, secrets: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, secrets):
            parts, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], mask]
                at = max(at, s["end"])
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    digest = F.sha2(F.col(text), 256)
    found = scan(docs.select(digest.alias("digest"), F.col(text).alias("text")), min_log10, "text", "digest")
    found = checkpointed(found.where(F.size("secrets") > 0).dropDuplicates(["digest"]))
    joined = boxed(lean(docs), digest=digest).join(hinted(found), "digest", "left")
    changed = F.when(F.col("secrets").isNull(), F.col("row").getField(text)).otherwise(masked(F.coalesce(F.col("row").getField(text), F.lit("")), F.coalesce("secrets", F.array().cast(dict(found.dtypes)["secrets"]))))
    return unboxed(joined, docs, **{text: changed}).select(docs.columns)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans in every document."""
    found = scan(table(spark, sf_dir, "documents"))

    def of_kind(kind: str):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )

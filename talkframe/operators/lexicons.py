"""Each user's own dictionary, for texts of many users at once.

A lexicon is a table keyed by its owner; entries without an owner are everyone's. Texts meet it
by equal keys only: the first piece of a trigger (a run of letters and digits, or one other
character) says where in a text a trigger may begin and of how many pieces it is; the slices of
so many pieces are then joined with the triggers themselves. No lexicon is collected, broadcast
or held by one task, so that its size has no limit; texts and triggers of an owner with much
text are dealt into as many slices as that takes.

Equal texts of a user are worked out once, under a digest of both, which is the same however
often Spark works it out again.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionary import Substitution

#: What a text is made of: runs of letters and digits, and single other characters.
PIECES = re.compile(r"[^\W_]+|[\W_]", re.S)
#: Characters of an owner's texts in one slice, at least; no owner has more than MOST_SLICES. Rows of a batch.
SLICE, MOST_SLICES, ROWS = 1 << 26, 1000, 50_000
#: Bytes of a batch, but for one row that is larger: as Arrow holds it, and of it what is turned into Python's much larger values at once.
BATCH_BYTES, BYTES_AT_ONCE = 2 << 20, 1 << 18
#: The owner of entries that are everyone's.
SHARED = ""


def pieces(low: str) -> list[tuple[int, int, bool]]:
    """Start, end and whether it is a run of letters and digits, of each piece of a folded text."""
    return [(m.start(), m.end(), m[0][0].isalnum()) for m in PIECES.finditer(low)]


def _begins(found: list[tuple[int, int, bool]], i: int) -> bool:
    """Whether no letter or digit stands before a piece; before a run none ever does."""
    return i == 0 or not found[i - 1][2]


def _ends(found: list[tuple[int, int, bool]], i: int) -> bool:
    """Whether none stands behind it."""
    return i + 1 == len(found) or not found[i + 1][2]


def heads(text: str) -> set[str]:
    """The pieces of a text at which a trigger may begin."""
    low = Substitution.fold(text)
    found = pieces(low)
    return {low[s:e] for i, (s, e, _) in enumerate(found) if _begins(found, i)}


def slices(text: str, known: dict[str, dict[str, list[int]]]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, owner, folded slice) of what may be a trigger; ``known`` has the numbers of pieces by head and owner."""
    low = Substitution.fold(text)
    found = pieces(low)
    for i, (s, e, _) in enumerate(found):
        for owner, sizes in known.get(low[s:e], {}).items() if _begins(found, i) else ():
            for n in sizes:
                if i + n <= len(found) and _ends(found, i + n - 1):
                    yield s, found[i + n - 1][1], owner, low[s : found[i + n - 1][1]]


def spliced(text: str, spans: Iterable[dict]) -> str:
    """The text with spans replaced: leftmost first, of those the longest, none over another."""
    out, done = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= done:
            out += [text[done : x["start"]], x["replacement"]]
            done = x["end"]
    return "".join([*out, text[done:]])


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded number and size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, str) else 4 for x in row)
        if len(held) >= ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``BYTES_AT_ONCE``."""
    step = max(1, batch.num_rows * BYTES_AT_ONCE // max(1, batch.nbytes))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def _give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the system: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def flat_mapped(df: DataFrame, rows: Callable[..., Iterable[tuple]], **schema: str) -> DataFrame:
    """The rows that ``rows`` makes of each row's values, as columns of these types (string or int)."""
    arrow = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in schema.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                yield from in_batches((out for part in in_slices(b) for row in zip(*(c.to_pylist() for c in part.columns)) for out in rows(*row)), arrow)
        finally:
            _give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # the value that all operators set
    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in schema.items()))


def owned(entries: DataFrame, user: str) -> DataFrame:
    """owner, trigger (folded), replacement, head and the number of pieces; of an owner's equal triggers the first by ord."""
    order = F.col("ord") if "ord" in entries.columns else F.lit(0)
    rows = entries.where((F.trim("trigger") != "") & (F.trim("replacement") != ""))
    rows = rows.select(F.coalesce(F.col(user).cast("string"), F.lit(SHARED)).alias("owner"), "trigger", "replacement", order.cast("int").alias("ord"))

    def entry(owner: str, trigger: str, replacement: str, ord_: int | None) -> Iterator[tuple]:
        low = Substitution.fold(trigger)
        if trigger.strip() and replacement.strip():
            found = pieces(low)
            yield owner, low, replacement, low[found[0][0] : found[0][1]], len(found), ord_

    parsed = flat_mapped(rows, entry, owner="string", trigger="string", replacement="string", head="string", n="int", ord="int")
    # An empty ord comes first, as in an ordered table; equal ones are told apart by the replacement.
    first = F.min_by(F.struct("replacement", "head", "n", "ord"), F.struct("ord", "replacement"))
    return parsed.groupBy("owner", "trigger").agg(first.alias("x")).select("owner", "trigger", "x.*")


def busy_owners(texts: DataFrame) -> DataFrame | None:
    """owner and the number of its slices, of those with more than one. So few that they may be sent to every task: ``MOST_SLICES`` at most."""
    sizes = texts.groupBy(F.col("user").alias("owner")).agg(F.sum(F.length("text")).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    least = max(SLICE, -(-total // MOST_SLICES))
    if total <= least:
        return None
    busy = [(r["owner"], -(-r["size"] // least)) for r in sizes.where(F.col("size") > least).collect()]
    return texts.sparkSession.createDataFrame([*busy, (SHARED, -(-total // least))], "owner string, slices long")


def met(rows: DataFrame, lexicon: DataFrame, on: list[str], busy: DataFrame | None) -> DataFrame:
    """``rows`` (with id and owner) joined with ``lexicon`` (with owner) on these columns; a busy owner's sides are dealt into its slices."""
    if busy is None:
        return rows.join(lexicon, on)
    few = F.coalesce(F.col("slices"), F.lit(1))
    dealt = rows.join(F.broadcast(busy), "owner", "left").withColumn("slice", F.pmod(F.xxhash64("id"), few)).drop("slices")
    copied = lexicon.join(F.broadcast(busy), "owner", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), few - 1))).drop("slices")
    return dealt.join(copied, [*on, "slice"]).drop("slice")


def _once(texts: DataFrame, lexicon: DataFrame, busy: DataFrame | None) -> DataFrame:
    """``texts`` (id, user, text) in which something is replaced, with it replaced."""
    begun = flat_mapped(texts.select("id", "user", "text"), lambda i, u, t: ((i, o, h) for h in heads(t) for o in (u, SHARED)), id="string", owner="string", head="string")
    sizes = lexicon.groupBy("owner", "head").agg(F.collect_set("n").alias("sizes"))
    known = met(begun, sizes, ["owner", "head"], busy).groupBy("id").agg(F.collect_list(F.struct("owner", "head", "sizes")).alias("known"))

    def cut(i: str, text: str, known: list[dict]) -> Iterator[tuple]:
        by_head: dict[str, dict[str, list[int]]] = {}
        for k in known:
            by_head.setdefault(k["head"], {})[k["owner"]] = k["sizes"]
        return ((i, *x) for x in slices(text, by_head))

    parts = flat_mapped(texts.join(known, "id").select("id", "text", "known"), cut, id="string", start="int", end="int", owner="string", trigger="string")
    own_first = F.struct("ord", F.when(F.col("owner") == SHARED, 1).otherwise(0))
    found = met(parts, lexicon.select("owner", "trigger", "replacement", "ord"), ["owner", "trigger"], busy)
    one = found.groupBy("id", "start", "end").agg(F.min_by("replacement", own_first).alias("replacement"))
    spans = one.groupBy("id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("spans"))

    @F.pandas_udf("string")
    def splice(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([spliced(t, s) for t, s in zip(text, spans)], dtype=object)

    return texts.join(spans, "id").select("id", "user", splice("text", "spans").alias("text"))


def digest(user: Column, text: Column) -> Column:
    """What tells a user's text from all others."""
    return F.md5(F.concat_ws("\x00", user.cast("string"), text))


def different_texts(df: DataFrame, user: Column, text: str) -> DataFrame:
    """id (the digest), user and text of the different texts of each user.

    The rows pass through a worker, so that a text's own functions in Python are no part of the aggregation's keys, which Spark
    could not evaluate; equal ones meet before they are exchanged.
    """
    rows = df.where(user.isNotNull() & F.col(text).isNotNull()).select(user.cast("string").alias("user"), F.col(text).alias("text"))
    return flat_mapped(rows, lambda u, t: [(md5(f"{u}\x00{t}".encode()).hexdigest(), u, t)], id="string", user="string", text="string").distinct()


def apply_by_user(df: DataFrame, entries: DataFrame, text: str = "text", user: str = "user_id", passes: int = 2) -> DataFrame:
    """``df`` with each text's triggers replaced by its user's entries and everyone's.

    ``entries`` has trigger, replacement, the owner under the name of ``user`` (null: everyone's)
    and, if it likes, ord: of equal triggers the least ord counts, of equal ones the user's own.
    What is replaced is what ``Substitution`` replaces with the same entries, in so many passes.
    Texts that are null, or of no user, stay as they are. For batches: on a stream, call it in
    ``foreachBatch``.
    """
    id_ = digest(F.col(user), F.col(text))
    named = F.col(user).isNotNull() & F.col(text).isNotNull()
    texts, lexicon = different_texts(df, F.col(user), text), owned(entries, user)
    busy, done = busy_owners(texts), []
    for _ in range(passes):  # a text in which nothing was replaced has nothing to replace
        texts = _once(texts, lexicon, busy)
        done.append(texts)
    changed = done[0]
    for later in done[1:]:
        again = later.select("id", F.col("text").alias("again"))
        changed = changed.join(again, "id", "left").select("id", F.coalesce("again", "text").alias("text"))
    changed = changed.select(F.col("id").alias("_id"), F.col("text").alias("_new"))
    out = df.withColumn("_id", F.when(named, id_)).join(changed, "_id", "left")
    return out.withColumn(text, F.coalesce("_new", F.col(text))).select(df.columns)

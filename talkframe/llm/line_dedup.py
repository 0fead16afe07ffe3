"""Line dedup with a log-template tree of fixed depth.

A line is a sequence of words; a word with a digit is a variable field. The tree parses by the
number of words and then by the leading words; in a leaf, lines that agree in most places are
one template, whose other places are variable fields too. A template that lines of
``min_docs`` documents have is recurring, or of two if it is a passage of 50 words or more, and its lines are dropped from every document but
the first that has them, so that a passage is never lost to its own copies.

1. Leaves are counted, a row a document and leaf; those in too few documents cannot matter.
2. Lines of the other leaves are counted, equal ones together before the exchange. Those near
   to a leaf's most frequent line are its first template; each leaf's other different lines
   are gathered into templates, most frequent first.
3. A template's documents are counted, each once however many of its lines are variants of the
   template. Where one line alone is in enough documents, or all lines together in too few, the
   sums say so; otherwise the documents of the template's lines are listed.
4. The lines of recurring templates, as hashes, are looked up while texts are rewritten.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hinted, lean, table, tidy
from .tokens import NUMBER, U, lower_ascii, mix, sized, word_hashes

DEPTH = 3  # leading words
#: Words from which a line is a passage, which recurs as soon as two documents have it.
PASSAGE = 50
#: First templates of each leaf that are found before its other lines are gathered.
LEADERS = 2
#: Hashes that are broadcast at most, 16 bytes each. More are joined by an exchange.
MOST_HASHES = 4_000_000
NO_KEY = -(2**63)  # stands for a null key


@dataclass
class Lines:
    """All lines of some texts: where they are, and the hashes of those long enough."""

    data: bytes
    text: np.ndarray  # number of the text, a line
    starts: np.ndarray
    ends: np.ndarray
    long: np.ndarray  # numbers of the lines that count
    leaf: np.ndarray  # these two are of the lines that count
    line: np.ndarray
    first: np.ndarray  # their first words and numbers of words
    count: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], min_words: int) -> Lines:
        data = b"\n".join([*texts, b""])
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        at, to, words = word_hashes(lower_ascii(raw), ~space)
        digits = np.flatnonzero((raw >= 48) & (raw <= 57))
        number = np.searchsorted(digits, to) > np.searchsorted(digits, at)
        words = np.where(number, NUMBER, words)
        of = np.searchsorted(ends, at, "left")
        count = np.bincount(of, minlength=len(ends))
        first = np.cumsum(count) - count
        # At least half of the words must be fixed, else the line is data, not a template.
        fixed = np.bincount(of, ~number, minlength=len(ends)) * 2 >= count
        long = np.flatnonzero((count >= min_words) & fixed)
        leaf = U(0) + count[long].astype(np.uint64)
        for k in range(DEPTH):
            leaf = mix(leaf * U(0x9E3779B97F4A7C15) + words[first[long] + k] + U(k))
        place = (np.arange(len(words)) - first[of]).astype(np.uint64)
        each = mix(words + place * U(0xD1B54A32D192ED03))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
        line = mix(sums[first[long] + count[long]] - sums[first[long]] + count[long].astype(np.uint64))
        return cls(data, text, starts, ends, long, leaf, line, first[long], count[long], words)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column]


def _within(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), int), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def templates(lines: pd.DataFrame, similarity: float) -> np.ndarray:
    """The number of each line's template; ``lines``, all of one leaf, come most frequent first.

    A line joins the template whose first line it equals in ``similarity`` of all places, the
    earliest if several. With so few places that differ, one of their number plus one runs of
    places has none: templates are looked up by these runs, and never all compared.
    """
    words = np.stack([np.frombuffer(w, np.uint32) for w in lines["words"]])
    n = words.shape[1]
    errors = int((1 - similarity) * n + 1e-9)
    runs = [(i * n // (errors + 1), (i + 1) * n // (errors + 1)) for i in range(errors + 1)]
    known: dict[tuple[int, bytes], list[int]] = defaultdict(list)
    out = np.zeros(len(words), np.int64)
    leaders: list[int] = []
    for i, w in enumerate(words):
        parts = [(r, w[a:b].tobytes()) for r, (a, b) in enumerate(runs)]
        near = sorted({t for p in parts for t in known.get(p, ())})
        found = -1
        if near:
            same = (words[[leaders[t] for t in near]] != w).sum(axis=1) <= errors
            found = near[int(same.argmax())] if same.any() else -1
        if found < 0:
            found = len(leaders)
            leaders.append(i)
            for p in parts:
                known[p].append(found)
        out[i] = found
    return out


def _enough(n: Column, words: Column, min_docs: int) -> Column:
    """Whether so many documents make a template of so many words a recurring one."""
    return n >= F.when(words >= PASSAGE, min(2, min_docs)).otherwise(min_docs)


def recurring(docs: DataFrame, min_docs: int, min_words: int, similarity: float, text: str, key: str) -> DataFrame:
    """line (hash) and first_doc of every line of a recurring template. Every row of ``docs`` is a document."""
    source = lean(docs).select(F.col(key).cast("long").alias("_key"), F.col(text).cast("binary").alias("_text"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _bytes(b.column(1))
            for at, to in sized(texts):
                x = Lines.of(texts[at:to], min_words)
                _, own = np.unique(np.stack((x.text[x.long].astype(np.uint64), x.leaf)), axis=1, return_index=True) if len(x.long) else (None, x.long)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(x.leaf[own])), pa.array(x.count[own].astype(np.int32))], ["leaf", "size"])

    counted = source.mapInArrow(tidy(leaves), "leaf long, size int").groupBy("leaf").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    counted = counted.where(_enough(F.col("n"), F.col("size"), min_docs))
    frequent = checkpointed(counted.select("leaf"))
    if frequent.count() <= MOST_HASHES:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(_column(frequent, "leaf")[0].view(np.uint64)))
    else:
        known = None  # every leaf's lines go on: more rows, the same result

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys = _bytes(b.column(1)), b.column(0)
            for at, to in sized(texts):
                x = Lines.of(texts[at:to], min_words)
                own = np.flatnonzero(_within(known.value, x.leaf)[1]) if known else np.arange(len(x.long))
                if len(own):
                    # A document's equal lines count once.
                    own = own[np.unique(np.stack((x.text[x.long[own]].astype(np.uint64), x.line[own])), axis=1, return_index=True)[1]]
                short = (x.words >> U(32)).astype(np.uint32)
                parts = [short[a : a + n].tobytes() for a, n in zip(x.first[own].tolist(), x.count[own].tolist())]
                row = pa.array(x.text[x.long[own]] + at)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(x.leaf[own])), pa.array(_signed(x.line[own])), keys.take(row), b.column(2).take(row), pa.array(parts, pa.binary())], ["leaf", "line", "doc", "row", "words"])

    numbered = source.withColumn("_row", F.monotonically_increasing_id())
    said = numbered.mapInArrow(tidy(lines), "leaf long, line long, doc long, row long, words binary")
    if min_docs > 3:  # a line in too few documents may be in more than its first and last one: they are read again
        said = checkpointed(said)
    different = said.groupBy("leaf", "line").agg(
        F.count("*").alias("n"), F.min("doc").alias("doc"), F.min("row").alias("low"), F.max("row").alias("high"), F.first("words").alias("words")
    )

    def least(words: pd.Series) -> np.ndarray:
        return np.where(words.map(len).to_numpy() >= 4 * PASSAGE, min(2, min_docs), min_docs)

    def gathered(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The number of each line's template in its leaf. Leaves come one after another; one whose lines are all too few goes."""
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            part = pd.concat(held)
            part = part[part.groupby("leaf")["n"].transform("sum").to_numpy() >= least(part["words"])]
            if part.empty:
                return part.assign(template=0, size=0)[["leaf", "template", "line", "n", "doc", "low", "high", "size"]]
            part = part.sort_values(["leaf", "n", "line"], ascending=[True, False, True]).assign(template=0)
            several = part.groupby("leaf")["n"].transform("size") > 1
            numbers = [templates(leaf, similarity) for _, leaf in part[several].groupby("leaf")]
            part.loc[several, "template"] = np.concatenate(numbers) if numbers else []
            return part.assign(size=part["words"].map(len) // 4)[["leaf", "template", "line", "n", "doc", "low", "high", "size"]]

        for b in rows:
            if held and b["leaf"].iloc[0] != held[-1]["leaf"].iloc[-1] and sum(map(len, held)) > 50_000:
                yield done()
                held = []
            last = b["leaf"].iloc[-1]
            inside = b["leaf"] != last
            if inside.any():
                held.append(b[inside])
                yield done()
                held = [b[~inside]]
            else:
                held.append(b)
        if held:
            yield done()

    # A leaf's most frequent line is the leader of its first template, whatever comes after it; so
    # the lines that join it are found without gathering the leaf, which may be mostly these.
    found, rest = None, checkpointed(different)
    for i in range(LEADERS):
        leaders = checkpointed(rest.groupBy("leaf").agg(F.max_by("words", F.struct("n", F.bitwise_not("line"))).alias("leader")))
        near = _near(F.col("words"), F.col("leader"), similarity).alias("near")
        rest = checkpointed(rest.join(leaders, "leaf").select("leaf", "line", "n", "doc", "low", "high", "words", near))
        size = (F.octet_length("words") / 4).cast("int").alias("size")
        own = rest.where("near").select("leaf", F.lit(-1 - i).cast("long").alias("template"), "line", "n", "doc", "low", "high", size)
        rest = rest.where("not near").drop("near")
        found = own if found is None else found.unionAll(own)
    met = rest.repartition("leaf").sortWithinPartitions("leaf")
    found = found.unionAll(met.mapInPandas(tidy(gathered), "leaf long, template long, line long, n long, doc long, low long, high long, size int"))
    return _of_enough_documents(checkpointed(found), said, min_docs)


def _of_enough_documents(lines: DataFrame, said: DataFrame, min_docs: int) -> DataFrame:
    """line and first_doc of the templates that ``min_docs`` documents have lines of."""
    of = ["leaf", "template"]
    totals = lines.groupBy(of).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("doc").alias("first_doc"), F.first("size").alias("size"))
    totals = checkpointed(totals.where(_enough(F.col("total"), F.col("size"), min_docs)))
    sure = _enough(F.col("most"), F.col("size"), min_docs)
    unsure = totals.where(~sure)
    open_ = lines.join(hinted(unsure.select(of)), of)
    if min_docs > 3:
        rows = open_.select(*of, "line").join(said.select("leaf", "line", "row"), ["leaf", "line"]).select(*of, "row")
    else:  # none of these lines is in more than two documents
        rows = open_.select(*of, F.explode(F.array("low", "high")).alias("row"))
    documents = rows.distinct().groupBy(of).count()
    proven = documents.join(unsure, of).where(_enough(F.col("count"), F.col("size"), min_docs))
    enough = checkpointed(totals.where(sure).select(*of, "first_doc").unionAll(proven.select(*of, "first_doc")))
    return lines.select(*of, "line").join(hinted(enough), of).select("line", "first_doc")


def _near(words: Column, leader: Column, similarity: float) -> Column:
    """Whether a line equals its leader in enough of all places."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            out.append(int((p != q).sum()) <= int((1 - similarity) * len(p) + 1e-9))
        return pd.Series(out, dtype=bool)

    return near(words, leader)


def _column(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of longs on the driver; the caller has counted the rows."""
    rows = df.select(*names).toArrow()
    return [rows.column(n).to_numpy() for n in names]


def _rewrite(docs: DataFrame, known, drops: DataFrame | None, min_words: int, text: str, key: str, into: str) -> DataFrame:
    """``docs`` with ``into``: the text left, the numbers of lines and of those dropped, and their bytes.

    Lines to drop are looked up in ``known``, a broadcast of sorted hashes and first documents,
    or come with each document's key in ``drops``.
    """
    kind = pa.struct([("text", pa.string()), ("lines", pa.int64()), ("dropped", pa.int64()), ("bytes", pa.int64())])

    def gone_of(x: Lines, b: pa.RecordBatch, at: int, to: int) -> np.ndarray:
        gone, text_of = np.zeros(len(x.starts), bool), x.text[x.long]
        if known is None:
            lists = b.column("drop")[at:to]
            n = pc.list_value_length(lists).fill_null(0).to_numpy()
            mine = np.stack((np.repeat(np.arange(to - at), n), lists.flatten().to_numpy(zero_copy_only=False)))
            both = pd.MultiIndex.from_arrays(mine)
            gone[x.long] = pd.MultiIndex.from_arrays((text_of, _signed(x.line))).isin(both) if len(both) and len(x.long) else False
            return gone
        hashes, first = known.value
        place, there = _within(hashes, x.line)
        hit = np.flatnonzero(there)
        keys = b.column("key").fill_null(NO_KEY).to_numpy()[at:to]
        gone[x.long[hit[first[place[hit]] != keys[text_of[hit]]]]] = True
        return gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _bytes(b.column("raw"))
            null = b.column("raw").is_null().to_numpy(zero_copy_only=False)
            out: list[dict] = []
            for at, to in sized(texts):
                x = Lines.of(texts[at:to], min_words)
                gone = gone_of(x, b, at, to)
                n = np.bincount(x.text, minlength=to - at)
                lost = np.bincount(x.text, gone, minlength=to - at).astype(int)
                begin = np.cumsum(n) - n
                for i in range(to - at):
                    kept, size = texts[at + i], 0
                    if lost[i]:
                        own = range(begin[i], begin[i] + n[i])
                        kept = b"\n".join(x.data[x.starts[k] : x.ends[k]] for k in own if not gone[k])
                        size = sum(int(x.ends[k] - x.starts[k]) for k in own if gone[k])
                    out.append({"text": None if null[at + i] else kept.decode("utf-8", "replace"), "lines": int(n[i]), "dropped": int(lost[i]), "bytes": size})
            columns = [c for name, c in zip(b.schema.names, b.columns) if name not in ("raw", "key", "drop")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names)

    # Places for names inside: no column of the input can clash with these.
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    names = [*(f"c{i}" for i in range(len(own))), "kept"]
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", kept struct<text:string,lines:long,dropped:long,bytes:long>"
    rows = lean(docs).select(*own, F.col(text).cast("binary").alias("raw"), F.col(key).cast("long").alias("key"))
    if drops is not None:
        rows = rows.join(drops, F.coalesce(rows["key"], F.lit(NO_KEY)) == drops["of"], "left").drop("of")
    return rows.mapInArrow(tidy(run), schema).toDF(*docs.columns, into)


def _drops(docs: DataFrame, found: DataFrame, min_words: int, text: str, key: str) -> DataFrame:
    """of (a key) and drop, the hashes of the lines that its documents lose: by an exchange on the line's hash."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys = _bytes(b.column(1)), b.column(0).to_numpy()
            for at, to in sized(texts):
                x = Lines.of(texts[at:to], min_words)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:to][x.text[x.long]]), pa.array(_signed(x.line))], ["of", "line"])

    source = lean(docs).select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("of"), F.col(text).cast("binary").alias("text"))
    met = source.mapInArrow(tidy(lines), "of long, line long").join(found, "line").where(F.col("first_doc") != F.col("of"))
    return checkpointed(met.groupBy("of").agg(F.collect_set("line").alias("drop")))


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = 3, min_words: int = 6, similarity: float = 0.75, text: str = "text", key: str = "doc_id", into: str = "_kept"
) -> DataFrame:
    """``docs`` with the column ``into``, a struct: text without recurring lines, lines, dropped and (their) bytes.

    Lines of fewer than ``min_words`` words, or mostly of numbers, stay: they recur by nature.
    Lines of 50 words or more recur from two documents on, others from ``min_docs``; every row is
    a document, and counts once for a template however many variants of it it has. A null text stays null and counts as empty; an empty text has one empty line; a text that
    loses all lines is empty; rows repeated under one key all keep what their first row keeps;
    under a null key every recurring line with a known first document goes; an empty table gives
    an empty result; other columns are passed on, whatever their names, but for one called
    ``into``. Keys are integers.

    Up to ``MOST_HASHES`` recurring lines are broadcast, in 16 bytes each; more are joined to the
    documents' lines by an exchange on their hash. The result is the same.
    """
    docs = docs.drop(into)
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"the key {key} is not an integer")
    found = recurring(docs.select(key, text), min_docs, min_words, similarity, text, key)
    found = checkpointed(found.groupBy("line").agg(F.min("first_doc").alias("first_doc")).na.fill(NO_KEY, ["first_doc"]))
    if found.count() > MOST_HASHES:
        return _rewrite(docs, None, _drops(docs, found, min_words, text, key), min_words, text, key, into)
    lines, first = _column(found, "line", "first_doc")
    order = np.argsort(lines.view(np.uint64))
    known = docs.sparkSession.sparkContext.broadcast((lines.view(np.uint64)[order], first[order]))
    return _rewrite(docs, known, None, min_words, text, key, into)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents with recurring lines: how many lines and bytes go, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("_kept")
    return drop_recurring_lines(docs).where(k["dropped"] > 0).select(
        "doc_id", k["lines"].alias("n_lines"), k["dropped"].alias("n_dropped"), k["bytes"].alias("dropped_bytes"),
        F.sha2(k["text"], 256).alias("kept_sha256"),
    )

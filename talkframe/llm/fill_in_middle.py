"""Fill-in-middle transformation: texts cut in three by lines and put in another order, by DuckDB inside of tasks.

Every Arrow batch is registered as a table of an in-memory DuckDB, which has one thread, no
files and no extensions. One SQL statement takes the lines (``regexp_extract_all``), draws by
``sha256`` of the key, slices the lines (``list_slice``) and joins them again
(``array_to_string``); its result goes on as Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, lean, table, tidy, unboxed


@dataclass(frozen=True)
class Recipe:
    """The three marks, the seed, and the percentages: of texts that are transformed, and of these with the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    transformed: int = 100
    suffix_first: int = 50

    def sql(self, source: str) -> str:
        """One row a row of ``source`` (place, doc_id, text): its lines, form, lengths and output."""
        p, s, m = (f"'{x.replace(chr(39), chr(39) * 2)}'" for x in (self.prefix, self.suffix, self.middle))
        draw = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT AS h{i + 1}" for i in range(4))
        return f"""
WITH given AS (
  SELECT *, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('{self.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {source}),
drawn AS (SELECT *, len(lines)::BIGINT AS n, {draw} FROM given),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN whole = '' OR contains(whole, {p}) OR contains(whole, {s}) OR contains(whole, {m}) OR h3 % 100 >= {self.transformed} THEN 'plain' WHEN h4 % 100 < {self.suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(list_slice(lines, 1, a), '') AS head, array_to_string(list_slice(lines, a + 1, b), '') AS mid, array_to_string(list_slice(lines, b + 1, n), '') AS tail FROM cut)
SELECT place, n, form, CASE WHEN form <> 'plain' THEN length(head)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  CASE form WHEN 'plain' THEN whole WHEN 'psm' THEN {p} || head || {s} || tail || {m} || mid ELSE {s} || tail || {p} || head || {m} || mid END AS output
FROM parts ORDER BY place"""


def _connected() -> duckdb.DuckDBPyConnection:
    """A DuckDB of this task alone: one thread, as the task has one core, and no way to files."""
    settings = {"threads": 1, "temp_directory": "", "autoinstall_known_extensions": "false", "autoload_known_extensions": "false"}
    return duckdb.connect(":memory:", config=settings)


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """``docs`` with ``n``, the number of lines, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    A null or empty text has no line, and its form is plain with an empty output; so is one that
    holds a mark, or that the draw leaves as it is: its output is the text. Texts are cut whole,
    however long, at line ends alone, so a single line goes into one part. The draw is of the
    key; rows repeated under a key are cut alike if their texts have equally many lines, and a
    null key draws as an empty one. An empty table gives an empty result. All other columns are
    kept; those of the result's names are replaced.
    """
    fields = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    given = lean(boxed(docs, doc_id=F.col("doc_id"), text=F.col("text")))
    schema = given.select("row").schema
    for name, kind in fields.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _connected() as duck:
            for batch in batches:
                part = pa.table({"place": pa.array(range(len(batch)), pa.int32()), "doc_id": batch.column(1), "text": batch.column(2)})
                duck.register("batch", part)
                done = duck.sql(recipe.sql("batch")).to_arrow_table().drop(["place"]).combine_chunks()
                duck.unregister("batch")
                columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in done.columns]
                if len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *fields])

    return unboxed(given.mapInArrow(tidy(run), schema), docs, **{f: F.col(f) for f in fields})


def restored(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """The text that ``output`` was made of. A transformed text holds none of the marks, so each mark is the first one there."""
    after = lambda mark: F.substring(output, F.instr(output, mark) + F.lit(len(mark)), F.length(output))
    before = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(recipe.middle)
    psm = F.concat(before(after(recipe.prefix), recipe.suffix), middle, before(after(recipe.suffix), recipe.middle))
    spm = F.concat(before(after(recipe.prefix), recipe.middle), middle, before(after(recipe.suffix), recipe.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document transformed, and rebuilt from what came out."""
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    output, form = F.col("output"), F.col("form")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(output).alias("output_sha256"), sha(restored(output, form)).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, CASE WHEN t = '' THEN 0 ELSE len(t) - len(replace(t, chr(10), '')) + CASE WHEN t[-1] = chr(10) THEN 0 ELSE 1 END END AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, string_split(t, chr(10)) AS l,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
k AS (
  SELECT *, CASE WHEN a = n THEN t ELSE array_to_string(list_transform(l[1:a], lambda x: x || chr(10)), '') END AS p,
    CASE WHEN b = n THEN t ELSE array_to_string(list_transform(l[1:b], lambda x: x || chr(10)), '') END AS pm FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || t[len(pm) + 1:] || '<M>' || pm[len(p) + 1:] ELSE '<S>' || t[len(pm) + 1:] || '<P>' || p || '<M>' || pm[len(p) + 1:] END AS x FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(pm) - len(p) END AS middle_chars,
  sha256(x) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

"""Code symbols: from source texts to an index, its lookup, and a report on a project."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import like_pattern, module_root, suffix, words
from ..session import checkpointed

# Languages by file suffix, folders that are passed over, and the most bytes of a file.
LANGUAGES = {".swift": "swift", ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".go": "go"}
SKIPPED_FOLDERS = ("__pycache__", "node_modules", "dist", "build")
MOST_BYTES = 512 * 1024


@dataclass(frozen=True)
class Declared:
    """A kind of declaration: its keyword, the words that may stand before it, how many of them, and how far it is indented.

    ``then`` is a word that has to follow the name; a ``receiver`` in brackets may stand before the name.
    """

    kind: str
    keyword: str
    before: tuple[str, ...] = ()
    most: int = 99
    indents: tuple[int, ...] | None = None
    then: str = ""
    receiver: bool = False
    annotated: bool = False


_SWIFT = ("public", "private", "internal")
#: Fixed values, as the same declarations must be found: keywords by language, the words that may stand before them, how many, and indents.
KEYWORDS = {
    "swift": (
        Declared("class", "class", (*_SWIFT, "open", "final"), annotated=True),
        Declared("struct", "struct", _SWIFT, annotated=True),
        Declared("enum", "enum", _SWIFT, annotated=True),
        Declared("protocol", "protocol", _SWIFT, annotated=True),
        Declared("func", "func", (*_SWIFT, "override", "static", "class"), annotated=True),
    ),
    "python": (Declared("class", "class", indents=(0,)), Declared("func", "def", ("async",), 1, indents=(0, 4))),
    "typescript": (
        Declared("class", "class", ("export", "abstract"), 2),
        Declared("interface", "interface", ("export",), 1),
        Declared("func", "function", ("export", "async"), 2),
    ),
    "kotlin": (Declared("class", "class", ("data", "sealed", "abstract", "open"), 1), Declared("func", "fun", ("suspend",), 1)),
    "go": (
        Declared("struct", "type", indents=(0,), then="struct"),
        Declared("interface", "type", indents=(0,), then="interface"),
        Declared("func", "func", indents=(0,), receiver=True),
    ),
}

#: Words after which any language names something; "export" may stand before the last, and "type" needs its kind after the name.
NAMING = ("class", "def", "func", "interface", "struct", "const")


def _declared(d: Declared, said: Column, indent: Column) -> Column:
    """The name that a line declares, from its words and the blanks before them; empty if it declares none of this kind."""
    at = F.array_position(said, d.keyword).cast("int")
    before = F.slice(said, F.lit(1), at - 1)
    marks = F.filter(before, lambda w: w.startswith("@")) if d.annotated else F.array().cast("array<string>")
    plain = F.filter(before, lambda w: ~w.startswith("@")) if d.annotated else before
    fits = (at > 0) & (F.size(plain) <= d.most) & F.forall(plain, lambda w: w.isin(*d.before) if d.before else F.lit(False)) & (F.concat(marks, plain) == before)
    if d.indents is not None:
        fits &= F.length(indent).isin(*d.indents) & (F.trim(indent) == "")
    word = lambda k: F.coalesce(F.get(said, at - 1 + k), F.lit(""))
    name = word(1)
    if d.receiver:
        name = F.when(word(1).rlike(r"(?U)^\(\w+$") & word(2).rlike(r"(?U)^\*?\w+\)$"), word(3)).otherwise(name)
    if d.then:
        fits &= F.startswith(word(2), F.lit(d.then)) & name.rlike(r"(?U)^\w+$")
    return F.when(fits, F.regexp_extract(name, r"(?U)^\w+", 0)).otherwise("")


def source_files(files: DataFrame, suffixes: Sequence[str] = tuple(LANGUAGES), path: str = "path", length: str | None = "length") -> DataFrame:
    """Files of these suffixes that are not too large and in no hidden, generated or vendored folder."""
    parts = F.split(F.col(path), "/")
    skipped = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED_FOLDERS))
    rows = files.where(suffix(F.col(path)).isin(*suffixes) & ~skipped)
    return rows.where(F.col(length) <= MOST_BYTES) if length else rows


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """A row a line with line_number, from 1."""
    return files.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("_at", "line")).withColumn("line_number", F.col("_at") + 1).drop("_at", text)


def declarations(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, symbol_type, symbol_name and line_number of declarations, by the words that lines begin with.

    A line gives a row for each kind that it declares. Names of one letter are left out. Lines
    are split and matched inside Catalyst; only lines with a keyword go further.
    """
    language = F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p))[suffix(F.col(path))]
    rows = lines_of(files.select(path, language.alias("_language"), text), text)
    keywords = sorted({d.keyword for own in KEYWORDS.values() for d in own})
    rows = rows.where(F.col("line").rlike(rf"\b({'|'.join(keywords)})\b"))
    rows = rows.withColumns({"_said": words(F.col("line")), "_indent": F.regexp_extract("line", r"(?U)^\s*", 0)})

    def found(lang: str) -> Column:
        every = F.array(*(F.struct(F.lit(d.kind).alias("symbol_type"), _declared(d, F.col("_said"), F.col("_indent")).alias("symbol_name")) for d in KEYWORDS[lang]))
        return F.filter(every, lambda x: F.length(x["symbol_name"]) >= 2)

    chosen = found("typescript")
    for lang in ("swift", "python", "kotlin", "go"):
        chosen = F.when(F.col("_language") == lang, found(lang)).otherwise(chosen)
    return rows.select(path, F.explode(chosen).alias("_s"), "line_number").select(path, "_s.symbol_type", "_s.symbol_name", "line_number")


def inheritance(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, symbol_name, parent_class and conformances of Swift types that name what they inherit, as their outline has them."""
    from .outline import outline

    types = outline(files.where(suffix(F.col(path)) == ".swift"), path, text).where(F.col("parent_class").isNotNull())
    return types.select(F.col("path").alias(path), "symbol_name", "parent_class", "conformances")


def python_symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Symbols of Python files from their syntax trees, with ends, signatures, parents and imports.

    A file that does not parse gives none here; ``declarations`` reads it all the same.
    """
    schema = "path string, symbol_type string, symbol_name string, line_number int, end_line int, signature string, parent_symbol string, parent_class string, return_type string, imports array<string>, decorators array<string>"

    def walk(tree: ast.AST, parent: str | None, imports: list[str]) -> Iterator[tuple]:
        for node in ast.iter_child_nodes(tree):
            if isinstance(node, ast.ClassDef):
                bases = [ast.unparse(b) for b in node.bases]
                yield "class", node.name, node.lineno, node.end_lineno, f"class {node.name}"[:200], parent, bases[0] if bases else None, None, imports, [ast.unparse(d) for d in node.decorator_list]
                yield from walk(node, node.name, imports)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                returned = ast.unparse(node.returns) if node.returns else None
                yield "func", node.name, node.lineno, node.end_lineno, f"def {node.name}({ast.unparse(node.args)})"[:200], parent, None, returned, imports, [ast.unparse(d) for d in node.decorator_list]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["text"]):
                try:
                    tree = ast.parse(t or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                imports = []
                for node in ast.walk(tree):
                    if isinstance(node, ast.Import):
                        imports += [a.name for a in node.names]
                    elif isinstance(node, ast.ImportFrom) and node.module:
                        imports.append(node.module)
                rows += [(p, *r) for r in walk(tree, None, imports) if len(r[1]) >= 2]
            yield pd.DataFrame(rows, columns=names)

    own = files.where(suffix(F.col(path)) == ".py").select(F.col(path).alias("path"), F.col(text).alias("text"))
    return own.mapInPandas(run, schema)


def symbol_names(files: DataFrame, text: str = "text") -> DataFrame:
    """Distinct names declared in any language, by the first words of each line."""
    said = files.select(F.explode(F.transform(F.split(F.col(text), "\n"), lambda x: F.slice(words(x), 1, 3))).alias("said"))
    word = lambda k: F.coalesce(F.get("said", F.lit(k)), F.lit(""))
    identifier = "^[A-Za-z_][A-Za-z0-9_]*"
    named = (
        F.when(word(0).isin(*NAMING), word(1))
        .when((word(0) == "export") & (word(1) == NAMING[-1]), word(2))
        .when((word(0) == "type") & word(2).rlike("^(struct|interface)") & word(1).rlike(f"{identifier}$"), word(1))
        .otherwise("")
    )
    return said.select(F.regexp_extract(named, identifier, 0).alias("name")).where(F.length("name") > 1).distinct()


def identifiers(files: DataFrame, text: str = "text") -> DataFrame:
    """Distinct PascalCase (6 letters or more) and camelCase identifiers of up to 60 letters."""
    # What counts as an identifier.
    pascal = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z0-9]{5,})\b"), F.lit(1))
    camel = F.regexp_extract_all(text, F.lit(r"\b([a-z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"), F.lit(1))
    rows = files.select(F.explode(F.array_distinct(F.concat(pascal, camel))).alias("name"))
    return rows.where(F.length("name").between(6, 60)).distinct()


def folder_names(paths: DataFrame, path: str = "path", most_depth: int = 4) -> DataFrame:
    """Lower-cased folder names and the paths that bear them, to a depth; hidden and noisy ones are left out."""
    parts = F.split(F.col(path), "/")
    rows = paths.select(parts.alias("_p"), F.posexplode(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(most_depth)))).alias("_i", "folder"))
    rows = rows.where(~F.exists(F.slice("_p", F.lit(1), F.col("_i") + 1), lambda x: x.startswith(".") | F.lower(x).isin(*SKIPPED_FOLDERS)))
    return rows.select(F.lower("folder").alias("name"), F.concat(F.array_join(F.slice("_p", F.lit(1), F.col("_i") + 1), "/"), F.lit("/")).alias("path")).distinct()


#: Kinds before others when names are equal.
KIND_RANK = {"class": 0, "struct": 1, "protocol": 2}


def lookup(symbols: DataFrame, query: str, limit: int = 5, name: str = "symbol_name", kind: str | None = "symbol_type") -> DataFrame:
    """Symbols equal to the query in any case, else those that begin with it, else those that hold it.

    One scan computes every row's tier; only the best tier that has rows is given.
    """
    low, q = F.lower(F.col(name)), query.lower()
    like = like_pattern(q)
    tier = F.when(low == q, 0).when(low.like(f"{like}%"), 1).when(low.like(f"%{like}%"), 2)
    hits = symbols.where(low.like(f"%{like}%")).withColumn("tier", tier)
    best = hits.agg(F.min("tier").alias("_best"))
    rank = F.lit(0)
    if kind:
        rank = F.coalesce(*(F.when(F.col(kind) == k, F.lit(r)) for k, r in KIND_RANK.items()), F.lit(len(KIND_RANK)))
    rank = F.when(F.col("tier") == 0, rank).otherwise(F.length(name))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("_best")).drop("_best").orderBy(rank, name).limit(limit)


def by_name(symbols: DataFrame) -> DataFrame:
    """One symbol a lower-cased name: a class before a struct before others, then the earliest."""
    rank = F.when(F.col("symbol_type") == "class", 0).when(F.col("symbol_type") == "struct", 1).otherwise(2)
    w = Window.partitionBy(F.lower("symbol_name")).orderBy(rank, "id")
    return symbols.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Modules that tell nothing about a project.
PLAIN_MODULES = (
    "re os sys io abc json time math copy typing types enum uuid datetime pathlib logging functools itertools collections "
    "dataclasses contextlib asyncio inspect hashlib struct base64 threading gc queue concurrent subprocess socket signal "
    "traceback warnings weakref shutil tempfile glob"
).split()


def libraries(symbols: DataFrame, most: int = 30, own: Sequence[str] = ()) -> DataFrame:
    """One row: the first ``most`` module roots in order, without plain and private ones and the project's ``own`` packages."""
    roots = symbols.select(F.explode("imports").alias("_i")).select(module_root(F.trim("_i")).alias("module"))
    kept = roots.where((F.length("module") > 1) & F.col("module").rlike("^[A-Za-z@]") & ~F.col("module").isin(*PLAIN_MODULES, *own)).distinct()
    return kept.orderBy("module").limit(most).agg(F.sort_array(F.collect_list("module")).alias("libraries"))


def patterns(symbols: DataFrame) -> DataFrame:
    """One row: which architectural patterns the names of classes and structs show."""
    n = F.col("symbol_name")
    tests = {
        "Repository Pattern": n.endswith("Repository"), "Service Layer": n.endswith("Service"), "MVVM": n.endswith("ViewModel"),
        "Dependency Injection (Protocol/Abstract)": n.startswith("Abstract") | n.endswith("Protocol"), "Factory Pattern": n.endswith("Factory"),
    }
    types = symbols.where(F.col("symbol_type").isin("class", "struct"))
    flags = types.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"p{i}") for i, c in enumerate(tests.values())))
    return flags.select(F.array_compact(F.array(*(F.when(F.col(f"p{i}"), F.lit(p)) for i, p in enumerate(tests)))).alias("patterns"))


def counts(symbols: DataFrame, by: Column) -> DataFrame:
    return symbols.groupBy(by.alias("name")).agg(F.count("*").alias("n"))


def report(symbols: DataFrame, project: str, at: str, most_key: int = 40, most_services: int = 20) -> DataFrame:
    """One row, content: a project's symbols as Markdown. No symbols, no row.

    Aggregates are formed in parallel; the two tables shown in full are cut to their limits.
    """
    language = F.coalesce(F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p))[suffix(F.col("file_path"))], suffix(F.col("file_path")))

    def joined(df: DataFrame, form: str, name: str) -> DataFrame:
        return df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "n"))), lambda x: F.format_string(form, x["name"], x["n"])), ", ").alias(name))

    kinds = joined(counts(symbols, F.col("symbol_type")), "%s: %d", "kinds")
    languages = joined(counts(symbols, language), "%s (%d)", "languages")
    place = F.concat_ws(":", "file_path", F.col("line_number").cast("string"))
    order = F.array_position(F.array(*map(F.lit, ("class", "struct", "protocol", "interface"))), F.col("symbol_type"))
    key = symbols.where((order > 0) & (F.col("parent_class").isNotNull() | F.col("conformances").isNotNull())).orderBy(order, "file_path", "line_number").limit(most_key)
    key_lines = key.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "file_path", "line_number", F.concat_ws(" ", F.lit("|"), "symbol_name", F.lit("|"), "symbol_type", F.lit("|"), place, F.lit("|"), F.coalesce("parent_class", F.lit("-")), F.lit("|"), F.coalesce("conformances", F.lit("-")), F.lit("|")).alias("t")))).alias("key_symbols"))
    service = symbols.where((F.col("symbol_type") == "class") & F.col("symbol_name").rlike("(Repository|Service|Manager|Controller)$")).orderBy("file_path", "line_number").limit(most_services)
    entry = F.concat_ws("\n", F.concat(F.lit("### "), "symbol_name"), F.concat(F.lit("- **File:** `"), place, F.lit("`")), F.concat(F.lit("- **Extends:** "), "parent_class"), F.concat(F.lit("- **Implements:** "), "conformances"))
    services = service.agg(F.sort_array(F.collect_list(F.struct("file_path", "line_number", entry.alias("t")))).alias("services"))
    total = symbols.agg(F.count("*").alias("n"))
    row = total.crossJoin(kinds).crossJoin(languages).crossJoin(patterns(symbols)).crossJoin(libraries(symbols)).crossJoin(key_lines).crossJoin(services)
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "\n")
    section = lambda title, body, there: F.when(there, F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n")))
    # The report's headings.
    content = F.concat_ws(
        "\n",
        F.lit(f"# Project Context -- {project}\n> Last updated: {at}\n\n## Architecture Overview"),
        F.format_string("- **Symbols:** %d total (%s)\n- **Languages:** %s\n", "n", "kinds", "languages"),
        section("Patterns Detected", F.array_join(F.transform("patterns", lambda p: F.concat(F.lit("- "), p)), "\n"), F.size("patterns") > 0),
        section("Key Libraries & Imports", F.array_join("libraries", ", "), F.size("libraries") > 0),
        section("Key Symbols", F.concat(F.lit("| Name | Type | File:Line | Inherits | Conforms To |\n|---|---|---|---|---|\n"), texts(F.col("key_symbols"))), F.size("key_symbols") > 0),
        section("Repositories & Services", texts(F.col("services")), F.size("services") > 0),
    )
    return row.where("n > 0").select(content.alias("content"))


def digests(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path and digest of every file; a null text is not an empty one."""
    return files.select(F.col(path).alias("path"), F.coalesce(F.sha2(text, 256), F.lit("-")).alias("digest"))


def folder_digests(files: DataFrame) -> DataFrame:
    """folder and digest of every folder, from path and digest of files: a folder's is that of what it holds directly, folders too.

    A round a level, from the deepest up; no folder gathers more than its own entries. Two trees are the same where their digests are.
    """
    entries = checkpointed(files.select("path", "digest", (F.size(F.split("path", "/")) - 1).alias("depth")))
    deepest, found, below = entries.agg(F.max("depth")).first()[0] or 0, None, None
    for depth in range(deepest, -1, -1):
        here = entries.where(F.col("depth") == depth).select("path", "digest")
        here = here if below is None else here.unionAll(below)
        folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
        own = F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("path", "digest")))), 256)
        level = checkpointed(here.groupBy(folder.alias("path")).agg(own.alias("digest")))
        found = level if found is None else found.unionAll(level)
        below = level.where("path <> ''")
    return found.withColumnRenamed("path", "folder")


def reindexed(files: DataFrame, known: DataFrame, symbols: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str = "path", text: str = "text") -> DataFrame:
    """Symbols of ``files``: those that ``symbols`` has of files as they were, and what ``parse`` finds in new and changed ones.

    ``known`` has path and digest of the files that ``symbols`` were found in. Symbols of files that are gone go.
    """
    same = digests(files, path, text).join(known.select("path", "digest"), ["path", "digest"], "left_semi").select(F.col("path").alias(path))
    return symbols.join(same, path, "left_semi").select(symbols.columns).unionByName(parse(files.join(same, path, "left_anti").select(files.columns)))


def stale(symbols: DataFrame, user: str, now: Column, seconds: int = 300) -> DataFrame:
    """Projects of the user whose index is older than so many seconds."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max("indexed_at"))
    return symbols.where(F.col("user_id") == user).groupBy("project_path").agg(age.alias("age")).where(F.col("age") > seconds)

"""Outlines of Swift, TypeScript, JavaScript, Kotlin and Go files: declarations with their ends, parents and headers.

There is no grammar at hand for these languages, so texts are read by their braces: comments and
strings are blanked out first; a keyword with a name begins a declaration, the next brace opens
its body, and the brace that closes it ends it. Declarations count at the top of a file and
directly in the body of a type, as those inside of functions are nobody's interface.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import suffix
from .symbols import LANGUAGES

SCHEMA = (
    "path string, symbol_type string, symbol_name string, line_number int, end_line int, signature string, parent_symbol string, parent_class string, "
    "conformances string, return_type string, properties array<string>, imports array<string>, is_static boolean"
)
#: Keyword and kind of declaration, by language.
KINDS = {
    "swift": {"class": "class", "struct": "struct", "enum": "enum", "actor": "class", "protocol": "protocol", "func": "func"},
    "typescript": {"class": "class", "interface": "interface", "type": "type", "enum": "enum", "function": "func"},
    "kotlin": {"class": "class", "object": "class", "interface": "interface", "fun": "func"},
    "go": {"type": "struct", "func": "func"},
}
#: Most imports of a file, letters of a signature and of a property.
MOST_IMPORTS, SIGNATURE, PROPERTY = 20, 200, 100
_NOISE = re.compile(r'"""(?:.|\n)*?"""|//[^\n]*|/\*(?:.|\n)*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`')
_NAMED = re.compile(r"\s+(?:\(\s*\w*\s*\*?\w+(?:\[[^\]]*\])?\s*\)\s*)?(?:<[^>]*>\s*)?([A-Za-z_$][\w$]*)")
_BEFORE = re.compile(r"[\s\w@()]*\Z")
_NO_NAMES = frozenset(("func", "var", "let", "init", "fun", "val"))
_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\(")
_CONTROL = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "with"))


def _blanked(text: str) -> str:
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def imports_of(text: str, language: str) -> list[str]:
    """A file's imports: modules for Swift, packages for TypeScript, and whole lines for the others."""
    if language == "swift":
        return re.findall(r"(?m)^\s*(?:@\w+\s+)?import\s+(.+?)\s*$", text)
    if language == "typescript":
        found = [a or b for a, b in re.findall(r"""(?m)^\s*import\b(?:[^'"\n]*\bfrom\s*['"]([^'"]+)['"]|\s*['"]([^'"]+)['"])""", text)]
        roots = ["/".join(x.split("/")[: 2 if x.startswith("@") else 1]) for x in found if not x.startswith(".")]
        return [x for x in dict.fromkeys(roots) if x][:MOST_IMPORTS]
    if language == "kotlin":
        return [x.strip() for x in re.findall(r"(?m)^import\s.*$", text)][:MOST_IMPORTS]
    return [x.strip() for x in re.findall(r"(?m)^import\s*\((?:[^)]*)\)|^import\s+[^\n(]+", text)]


class Outline:
    """The declarations of one text, as dictionaries in ``found``."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.plain, self.language = text, _blanked(text), language
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.found: list[dict] = []
        self._read()

    def _line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def _statement(self, at: int) -> int:
        """Where the statement begins in which ``at`` is: after a brace or semicolon, or with the line."""
        begin = max(self.plain.rfind(c, 0, at) for c in "{};\n") + 1
        return begin + len(self.plain[begin:at]) - len(self.plain[begin:at].lstrip())

    def _read(self) -> None:
        kinds = KINDS[self.language]
        tokens = re.compile(rf"[{{}}]|\b(?:{'|'.join(kinds)})\b")
        stack: list[dict | None] = []
        waiting: dict | None = None
        for m in tokens.finditer(self.plain):
            at = m.start()
            if m[0] == "{":
                if waiting is None and self.language == "typescript" and stack and stack[-1] and stack[-1]["symbol_type"] == "class":
                    waiting = self._method(at, stack[-1])
                if waiting:
                    self._header(waiting, at)
                stack.append(waiting)
                waiting = None
            elif m[0] == "}":
                if waiting:
                    self._header(waiting, at)
                    waiting = None
                if stack and (done := stack.pop()):
                    done["end_line"] = self._line(at)
            elif all(x and x["symbol_type"] != "func" for x in stack) and (new := self._declared(m, kinds[m[0]], stack)):
                if waiting:
                    self._header(waiting, at)
                waiting = new
        if waiting:
            self._header(waiting, len(self.plain))

    def _declared(self, m: re.Match, kind: str, stack: list) -> dict | None:
        named, begin = _NAMED.match(self.plain, m.end()), self._statement(m.start())
        if not named or named[1] in _NO_NAMES or not _BEFORE.match(self.plain, begin, m.start()) or self.plain[begin : m.start()].count("(") != self.plain[begin : m.start()].count(")"):
            return None
        if self.language == "go":
            if stack:
                return None
            if kind == "struct" and re.match(r"(?:\[[^\]]*\])?\s+interface\b", self.plain[named.end() :]):
                kind = "interface"
        return self._new(kind, named[1], begin, named.end(), stack[-1] if stack else None)

    def _method(self, brace: int, owner: dict) -> dict | None:
        """What has arguments before a brace in a class, on as many lines as it likes."""
        at, depth = self.plain.rfind(")", owner["body"], brace), 1
        while at > owner["body"] and depth:
            at -= 1
            depth += (self.plain[at] == ")") - (self.plain[at] == "(")
        begin = self._statement(at)
        m = _METHOD.match(self.plain, begin, brace)
        return self._new("func", m[1], begin, m.end(1), owner) if m and m[1] not in _CONTROL else None

    def _new(self, kind: str, name: str, begin: int, named: int, owner: dict | None) -> dict:
        line = self._line(begin)
        self.found.append({"symbol_type": kind, "symbol_name": name, "line_number": line, "end_line": line, "parent_symbol": owner and owner["symbol_name"], "begin": begin, "named": named, "is_static": False})
        return self.found[-1]

    def _header(self, d: dict, end: int) -> None:
        """What a declaration's words up to its body say. Without a body they end with their line."""
        if end == len(self.plain) or self.plain[end] != "{":
            stop = self.plain.find("\n", d["named"])
            end = min(end, stop if stop >= 0 else len(self.plain))
        head, rest = self.text[d["begin"] : end].strip(), " ".join(self.plain[d["named"] : end].split())
        if d["symbol_type"] == "func":
            d["is_static"] = self.language == "swift" and bool(re.match(r"(?:[\w@]+\s+)*(?:static|class)\s", head))
            if self.language == "swift":
                d["signature"] = head[:SIGNATURE] + "..." * (len(head) > SIGNATURE)
                d["return_type"] = (re.findall(r"->\s*(.+?)(?:\s+where\b.*)?$", rest) or [None])[-1]
            elif self.language == "typescript":
                d["signature"] = head[:SIGNATURE]
                d["return_type"] = (re.findall(r"\)\s*:\s*([^(){]+)$", rest) or [None])[-1]
        elif self.language == "swift":
            named = re.match(r"(?:<[^>]*>)?\s*:\s*(.+?)(?:\s+where\b.*)?$", rest)
            parts = [p.strip() for p in named[1].split(",") if re.match(r"\s*[A-Z]", p)] if named else []
            d["parent_class"], d["conformances"] = (parts or [None])[0], ", ".join(parts[1:]) or None
        elif self.language == "typescript":
            extends, implements = re.search(r"\bextends\s+([\w$.<>]+)", rest), re.search(r"\bimplements\s+(.+)$", rest)
            d["parent_class"] = extends and extends[1]
            d["conformances"] = ", ".join(p.strip() for p in implements[1].split(",")) if implements else None
        d["body"] = end

    def properties(self, d: dict) -> list[str]:
        """The constants and variables that a Swift type declares directly in its body."""
        if self.language != "swift" or d["symbol_type"] == "func" or "body" not in d:
            return []
        depth, out = 0, []
        for m in re.finditer(r"[{}]|(?m:^[ \t]*(?:[\w@]+(?:\([^)\n]*\))?[ \t]+)*(?:let|var)\s+\w[^\n{]*)", self.plain[d["body"] :]):
            depth += (m[0] == "{") - (m[0] == "}")
            if depth == 0:
                break
            if depth == 1 and m[0] not in "{}":
                at = d["body"] + m.start()
                out.append(self.text[at : at + len(m[0])].split("{")[0].strip()[:PROPERTY])
        return out


def outline(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Symbols of Swift, TypeScript, JavaScript, Kotlin and Go files with their ends, parents, headers and imports.

    Null texts give none; names of one letter are left out, as everywhere. Files come one by one,
    in Arrow batches.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, language, t in zip(b["path"], b["language"], b["text"]):
                read, imports = Outline(t, language), imports_of(t, language)
                rows += [{**d, "path": p, "imports": imports, "properties": read.properties(d)} for d in read.found if len(d["symbol_name"]) >= 2]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype(object).where(out.notna(), None) if len(out) else out

    known = {s: "typescript" if x in ("tsx", "javascript") else x for s, x in LANGUAGES.items() if x != "python"}
    language = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[suffix(F.col(path))]
    own = files.select(F.col(path).alias("path"), language.alias("language"), F.col(text).alias("text"))
    return own.where("language is not null and text is not null").mapInPandas(run, SCHEMA)

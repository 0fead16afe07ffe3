"""Text functions as Column expressions, so that Catalyst sees all of a cleaning chain.

Regular expressions carry ``(?iu)(?U)`` where words of any alphabet must match in any case.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY = "(?iu)(?U)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used.

    Without it each use would repeat the value's whole expression, and a chain of such
    functions would grow exponentially.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(text: Column) -> Column:
    """Lower case of the same length: the dotted capital I becomes one letter, not two."""
    return F.lower(F.translate(text, "İ", "i"))


def space_word_count(text: Column) -> Column:
    """Spaces plus one: an empty text has one, and double spaces count."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def words(text: Column) -> Column:
    """White-space words; a blank text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse_spaces(text: Column) -> Column:
    return F.array_join(words(text), " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column, characters: str) -> Column:
    """``characters`` is the inside of a regular expression's class."""
    return F.regexp_replace(text, rf"[{characters}]+\z", "")


def capitalize_first(text: Column, turkish: bool = False) -> Column:
    """The first character in upper case; ``turkish`` keeps dotted and dotless i apart."""
    first = F.substring(text, 1, 1)
    up = F.upper(first)
    if turkish:
        up = F.when(first == "i", "İ").when(first == "ı", "I").otherwise(up)
    return F.concat(up, F.substring(text, 2, 2147483647))


def end_sentence(text: Column, marks: str = ".!?…") -> Column:
    return F.when(text.rlike(f"[{marks}]$") | (text == ""), text).otherwise(F.concat(text, F.lit(".")))


def drop_filler_words(text: Column, fillers: Sequence[str], all_gone: Column | None = None) -> Column:
    """Words left after those in ``fillers``; if none is left, ``all_gone`` (by default the text)."""
    left = F.filter(words(text), lambda w: ~rstrip(F.lower(w), ".,!?").isin(*fillers))
    return F.when(F.size(left) == 0, text if all_gone is None else all_gone).otherwise(F.array_join(left, " "))


def split_identifier(name: Column) -> Column:
    """PascalCase and camelCase parts; runs of capitals stay together."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return words(spaced)


def matching_parts(name: Column) -> Column:
    """Parts as matching sees them: lower case, single letters left out."""
    return F.transform(F.filter(split_identifier(name), lambda p: F.length(p) > 1), F.lower)


def clean_edges(word: Column) -> Column:
    return F.regexp_replace(word, r"(?U)^[\W_]+|[\W_]+$", "")


def drop_suffix_after_apostrophe(word: Column) -> Column:
    return F.regexp_replace(word, "'[a-zA-ZığüşöçİĞÜŞÖÇ]+$", "")


def safe_file_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s-]", ""), r"(?U)\s+", "_"), 1, 40)


def numbered_file(number: Column, stamp: Column, suffix: str = ".wav") -> Column:
    return F.concat(F.lpad(number.cast("string"), 5, "0"), F.lit("_"), stamp.cast("string"), F.lit(suffix))


#: Letters and what they become without their marks.
MARKED, PLAIN = "çÇğĞıİöÖşŞüÜ", "cCgGiIoOsSuU"


def fold_marks(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def drop_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, "[.,!?;:]", "")


def replace_first(text: Column, old: str, new: str) -> Column:
    """The first occurrence of a literal."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))).otherwise(text)


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(text), m))


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` items, as arrays."""

    def runs(bound: Column) -> Column:
        count = F.size(bound) - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(bound, i, n))).otherwise(F.array().cast("array<array<string>>"))

    return let(items, runs)


def strip_json_fences(text: Column) -> Column:
    """A model's JSON answer without its code fence, language tag and control characters."""
    inner = F.regexp_replace(F.trim(text), r"(?is)^```(?:json)?\s*|\s*```$", "")
    return F.regexp_replace(inner, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def module_root(name: Column) -> Column:
    """Root of a dotted or slashed module name; ``@scope/package`` keeps its scope."""
    return F.when(name.startswith("@"), F.regexp_extract(name, "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(name, "^([^./]*)", 1))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def like_pattern(text: str) -> str:
    """``text`` for LIKE, with its wildcards taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def chat_ml(source: Column, target: Column, system: str) -> Column:
    """A pair as one chat-formatted training text."""
    turn = lambda role, body: F.concat(F.lit(f"<|im_start|>{role}\n"), body, F.lit("<|im_end|>"))
    return F.concat_ws("\n", turn("system", F.lit(system)), turn("user", source), turn("assistant", target))

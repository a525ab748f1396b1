"""Column functions over names, signatures and texts."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a symbol's source that are stored.
SOURCE_CHARS = 6000
#: The least similarity of a fuzzy hit; the scores of exact, file and content hits.
FUZZY_LEAST, EXACT_SCORE, FILE_SCORE, CONTENT_SCORE = 0.6, 1.0, 0.9, 0.8


def strip_wildcards(s: Column) -> Column:
    return F.translate(s, "*?", "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length in bytes; two empty strings are equal."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def truncate(text: Column, n: int = SOURCE_CHARS) -> Column:
    return F.substring(text, 1, n)


def truncate_middle(text: Column, n: int) -> Column:
    """The first and last half of a text of over n characters, and how long it was."""
    half = n // 2
    cut = F.concat(
        F.substring(text, 1, half), F.lit("\n... [truncated, "), F.length(text).cast("string"), F.lit(" total chars] ...\n"), F.right(text, F.lit(half))
    )
    return F.when(F.length(text) > n, cut).otherwise(text)


def ending_line(start: Column, count: Column) -> Column:
    return F.when(count > 1, start + count - 1).otherwise(start)


def is_camel(name: Column) -> Column:
    return name.rlike(r"\p{Ll}\p{Lu}|\p{Lu}\p{Ll}")


def go_visibility(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("package")


def python_visibility(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("_")), "private").otherwise("public")


def export_visibility(exported: Column, is_method: Column) -> Column:
    return F.when(is_method, "").when(exported, "public").otherwise("private")


def signature(text: Column) -> Column:
    """What stands before the first brace, if that isn't at the start."""
    return F.trim(F.when(F.instr(text, "{") > 1, F.substring_index(text, "{", 1)).otherwise(text))


def receiver_type(receiver: Column) -> Column:
    return F.replace(F.element_at(F.split(F.trim(F.translate(receiver, "()", "")), r"\s+"), -1), F.lit("*"), F.lit(""))


def module_kind(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("import ")) | F.contains(text, F.lit("export ")), "esm").otherwise("cjs")


def symbol_key(path: Column, name: Column) -> Column:
    return F.concat_ws(":", path, name)


def to_int(value: Column) -> Column:
    """A number as an integer, anything else as 0."""
    return F.coalesce(value.try_cast("double").cast("long"), F.lit(0).cast("long"))


def is_identifier(name: str) -> bool:
    return bool(re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name))


def classify_query(query: str) -> str:
    """fuzzy if there is a wildcard, file if there is a slash and an extension, else exact."""
    q = query.strip()
    if "*" in q or "?" in q:
        return "fuzzy"
    if "/" in q and re.search(r"\.[^./]+$", q):
        return "file"
    return "exact"


def classify_query_column(query: Column) -> Column:
    q = F.trim(query)
    return F.when(q.rlike(r"[*?]"), "fuzzy").when(q.rlike(r"/") & q.rlike(r"\.[^./]+$"), "file").otherwise("exact")


def code_blocks(text: str) -> list[str]:
    """The bodies of the fenced blocks marked repl."""
    return [m[1] for m in re.finditer(r"```repl[^\n]*\n(.*?)```", text, re.S)]


def final_answer(text: str) -> tuple[str, str] | None:
    """("text", answer) or ("var", name) of FINAL(...) or FINAL_VAR(...) outside code blocks."""
    outside = re.sub(r"```.*?```", "", text, flags=re.S)
    if m := re.search(r"FINAL_VAR\(\s*[\"']?(\w+)[\"']?\s*\)", outside):
        return "var", m[1]
    if m := re.search(r"FINAL\((.*)\)", outside, re.S):
        return "text", m[1].strip().strip("\"'")
    return None

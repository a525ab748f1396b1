"""Column functions over paths, globs, ignore patterns and import specifiers."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension (lower case) to language.
LANGUAGES = {
    ".go": "go", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python", ".rb": "ruby",
    ".java": "java", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp",
}
#: Suffixes taken off a module path, one after another.
MODULE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".go")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The parent directory; "." for a path without one."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def parent(path: Column) -> Column:
    """The parent relative to the root; "" at the root."""
    d = dirname(path)
    return F.when(d == ".", F.lit("")).otherwise(d)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def detect_language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(extension(path))), F.lit(""))


def is_binary(content: Column) -> Column:
    """A NUL in the first 512 bytes."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(?:..)*?00")


def line_count(text: Column) -> Column:
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    last = F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return (n + last).cast("int")


def is_test_file(path: Column) -> Column:
    name = basename(path)
    return (
        name.rlike(r"_test\.go$|\.(?:test|spec)\.[^.]+$|^test_.*\.py$|_(?:test)\.py$|_(?:test|spec)\.rb$")
        | path.rlike(r"(?:^|/)(?:test|tests|spec)/")
    )


def is_generated_file(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:generated|gen)(?:/|$)")


def glob_regex(pattern: str) -> str | None:
    """A whole-string regex of a glob: * and ? stay within a path segment. None if it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            m = re.match(r"(\^?)((?:\\.|[^\]\\])+)\]", pattern[i:])
            if not m:
                return None
            inner = re.sub(r"([&\[~|])", r"\\\1", m[2])
            out.append(f"[{m[1]}{inner}]")
            i += m.end()
        else:
            out.append(re.escape(c))
    return f"^(?:{''.join(out)})$"


def glob_match(path: Column, pattern: str) -> Column:
    regex = glob_regex(pattern)
    return F.lit(False) if regex is None else path.rlike(regex)


def ignore_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regex, negated, directories only) of one line of an ignore file by git's rules; None for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\") if line[:2] in (r"\#", r"\!") else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    parts = line.strip("/").split("/")
    regex = ""
    for k, part in enumerate(parts):
        if part == "**":
            regex += "(?:.*/)?" if k < len(parts) - 1 else ".*"
            continue
        inner = glob_regex(part.replace("**", "*")) or re.escape(part)
        regex += inner.removeprefix("^(?:").removesuffix(")$") + ("/" if k < len(parts) - 1 else "")
    return f"^{'' if anchored else '(?:.*/)?'}{regex}$", negated, only_dirs


def ignored(path: str, is_dir: bool, rules: list[tuple[str, str]]) -> bool:
    """Whether rules of (directory, line), outer directories first, ignore a path; the last match decides."""
    verdict = False
    for base, line in rules:
        if base and not path.startswith(base + "/"):
            continue
        rule = ignore_regex(line)
        if rule and (is_dir or not rule[2]) and re.match(rule[0], path[len(base) + 1 if base else 0 :]):
            verdict = not rule[1]
    return verdict


def normalize_module(path: Column) -> Column:
    for s in MODULE_SUFFIXES:
        path = F.regexp_replace(path, re.escape(s) + "$", "")
    return path


def is_relative_import(spec: Column) -> Column:
    return F.startswith(spec, F.lit("."))


def clean_path(path: Column) -> Column:
    """A path without empty, "." and inner ".." segments."""

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        back = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part.isin("", "."), acc).when(up, back).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    root = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    out = F.concat(root, F.array_join(parts, "/"))
    return F.when(out == "", F.lit(".")).otherwise(out)


def resolve_import(from_path: Column, spec: Column) -> Column:
    return clean_path(F.concat_ws("/", dirname(from_path), spec))


def dotted_module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))


def is_external_import(language: str, spec: Column) -> Column:
    if language in ("typescript", "tsx", "javascript"):
        return ~spec.rlike(r"^[./]")
    return ~F.startswith(spec, F.lit("."))


def is_go_stdlib(import_path: Column) -> Column:
    return ~F.contains(F.substring_index(import_path, "/", 1), F.lit("."))


def go_module_visibility(import_path: Column) -> Column:
    return F.when(import_path.rlike(r"/internal(?:/|$)"), "internal").otherwise("public")


def go_import_path(module: Column, mod_dir: Column, path: Column) -> Column:
    """The import path of a Go file's package: the module line of the go.mod in mod_dir, then the directories below it."""
    below = F.regexp_replace(path, r"/?[^/]*$", "").substr(F.when(mod_dir == "", F.lit(1)).otherwise(F.length(mod_dir) + 2), F.length(path))
    return F.when(below == "", module).otherwise(F.concat(module, F.lit("/"), below))

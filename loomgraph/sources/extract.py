"""Symbols, references and complexity of source files, by language.

Python goes through its own parser. The other languages are read from text whose
comments and strings are blanked, with braces (or Ruby's ends) matched, which
finds declarations, calls and decision points without a grammar. Extractors can
be registered by language; each takes (text, path) and returns (symbols, refs).
"""
from __future__ import annotations

import ast
import re
from collections.abc import Callable

Symbol = dict
Ref = dict
Extractor = Callable[[str, str], tuple[list[Symbol], list[Ref]]]

SYMBOL = (
    "name string, kind string, path string, language string, signature string, visibility string, source string, line_number int, "
    "line_count int, decorators array<string>, parent_name string, import_path string, module_kind string, complexity int"
)
REF = "file_path string, from_symbol string, to_name string, kind string, is_external boolean, external_import_path string"

#: Names of the language that are no calls to a symbol.
GO_BUILTINS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())
GO_TYPES = frozenset("bool byte error float32 float64 int int16 int32 int64 int8 rune string uint uint16 uint32 uint64 uint8 uintptr any".split())
KEYWORDS = frozenset(
    "if for while switch return func function go defer select case range catch do else new typeof await import super constructor require "
    "def class end unless until when rescue begin then and or not in yield puts raise".split()
)

_REGISTRY: dict[str, Extractor] = {}


def register(language: str, extractor: Extractor) -> None:
    _REGISTRY[language] = extractor


def extractor(language: str) -> Extractor | None:
    return _REGISTRY.get(language)


def _symbol(name: str, kind: str, path: str, language: str, text: str, line: int, **more) -> Symbol:
    n = text.count("\n") + 1
    base = {
        "signature": None, "visibility": None, "decorators": [], "parent_name": None, "import_path": None, "module_kind": None, "complexity": None,
    }
    return base | {"name": name, "kind": kind, "path": path, "language": language, "source": text, "line_number": line, "line_count": n} | more


def _ref(path: str, source: str | None, name: str, kind: str, external: bool = False, spec: str | None = None) -> Ref:
    return {"file_path": path, "from_symbol": source, "to_name": name, "kind": kind, "is_external": external, "external_import_path": spec}


def blanked(text: str, language: str) -> str:
    """The text with the contents of comments and strings as blanks, lines kept."""
    if language == "ruby":
        pattern = r"(?m)^=begin.*?^=end|#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
    else:
        pattern = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`" + r"|'(?:\\.|[^'\\\n])*'"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _close(code: str, at: int) -> int:
    """The place after the brace that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _signature(text: str) -> str:
    at = text.find("{")
    return (text[:at] if at > 0 else text).strip()


# --- Go --------------------------------------------------------------------------------------------------------------
def go_complexity(code: str) -> int:
    """1 and the decisions of blanked code; cases of type switches and defaults do not count."""
    n = 1 + len(re.findall(r"\b(?:if|for|case)\b|&&|\|\|", code))
    for m in re.finditer(r"\bswitch\b[^{]*\.\(type\)\s*{", code):
        body = code[m.end() - 1 : _close(code, m.end() - 1)]
        n -= len(re.findall(r"\bcase\b", body))
    return n


def go(text: str, path: str) -> tuple[list[Symbol], list[Ref]]:
    code = blanked(text, "go")
    symbols, refs, imports = [], [], {}
    if m := re.search(r"(?m)^package\s+(\w+)", code):
        symbols.append(_symbol(m[1], "module", path, "go", m[0], _line(text, m.start())))
    for m in re.finditer(r"(?m)^import\s*(?:\(([^)]*)\)|([^\n]+))", text):
        for alias, spec in re.findall(r"(?m)^\s*(?:([\w.]+)\s+)?\"([^\"]+)\"", m[1] or m[2] or ""):
            external = "." in spec.split("/")[0] or "/" not in spec
            imports[alias or spec.rsplit("/", 1)[-1]] = (spec, external)
            refs.append(_ref(path, None, alias or spec.rsplit("/", 1)[-1], "imports", external, spec))
    bodies = []
    for m in re.finditer(r"(?m)^func\s*(?:\(([^)]*)\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", code):
        brace = code.find("{", m.end())
        end = _close(code, brace) if brace >= 0 else len(code)
        source = text[m.start() : end]
        owner = m[1].split()[-1].lstrip("*") if m[1] and m[1].split() else None
        owner = re.sub(r"\[.*", "", owner) if owner else None
        symbols.append(_symbol(
            m[2], "method" if m[1] else "function", path, "go", source, _line(text, m.start()), signature=_signature(source),
            visibility="public" if m[2][0].isupper() else "package", parent_name=owner, complexity=go_complexity(code[m.start() : end]),
        ))
        bodies.append((m[2], code[brace:end]))
    for m in re.finditer(r"(?m)^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*{", code):
        end = _close(code, m.end() - 1)
        symbols.append(_symbol(m[1], m[2], path, "go", text[m.start() : end], _line(text, m.start()), visibility="public" if m[1][0].isupper() else "package"))
        if m[2] == "struct":
            refs += [_ref(path, m[1], x, "inherits") for x in re.findall(r"(?m)^\s*\*?([A-Z]\w*)\s*$", code[m.end() : end - 1])]
    for name, body in bodies:
        for pkg, called in re.findall(r"(?:\b(\w+)\s*\.\s*)?\b(\w+)\s*\(", body):
            if called in KEYWORDS or called in GO_BUILTINS or called in GO_TYPES:
                continue
            if not pkg:
                refs.append(_ref(path, name, called, "calls"))
            elif pkg in imports:
                spec, external = imports[pkg]
                refs.append(_ref(path, name, called, "calls", external, spec if external else None))
    return symbols, refs


# --- TypeScript and JavaScript -------------------------------------------------------------------------------------------
def script_complexity(code: str) -> int:
    """1 and the decisions of blanked code; a do loop counts by its while."""
    return 1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?\.|\?(?![.?:,)\]=;>])", code))


def _script(language: str) -> Extractor:
    def run(text: str, path: str) -> tuple[list[Symbol], list[Ref]]:
        code = blanked(text, language)
        stem = re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])
        symbols = [_symbol(stem, "module", path, language, "", 1, module_kind="esm" if "import " in text or "export " in text else "cjs", visibility="public")]
        refs, renamed = [], {}
        for m in re.finditer(r"(?m)^\s*import\s+(?:([^'\";]+?)\s+from\s+)?['\"]([^'\"]+)['\"]", text):
            external = m[2][0] not in "./"
            for old, new in re.findall(r"(\w+)\s+as\s+(\w+)", m[1] or ""):
                renamed[new] = old
            named = re.findall(r"[\w$]+", re.sub(r"\bas\s+\w+|\btype\b", "", m[1] or ""))
            to = m[2] if language != "javascript" else named[-1] if named else m[2]
            refs.append(_ref(path, None, to, "imports", external, m[2] if external else None))
        bodies = []

        def add(m: re.Match, name: str, kind: str, owner: str | None = None, exported: bool = False, decorators=()) -> int:
            brace = code.find("{", m.end() - 1)
            end = _close(code, brace) if brace >= 0 else len(code)
            source = text[m.start() : end]
            more = {"complexity": script_complexity(code[m.start() : end]), "signature": _signature(source)} if kind in ("function", "method") else {}
            symbols.append(_symbol(
                name, kind, path, language, source, _line(text, m.start()), parent_name=owner, decorators=list(decorators),
                visibility="" if kind == "method" else "public" if exported else "private", **more,
            ))
            if kind in ("function", "method"):
                bodies.append((name, code[brace:end]))
            return end

        for m in re.finditer(r"(?m)^[ \t]*(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^>]*>)?\(", code):
            add(m, m[2], "function", exported=bool(m[1]))
        for m in re.finditer(r"(?m)^[ \t]*((?:@\w+[^\n]*\n[ \t]*)*)(export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|enum)\s+([\w$]+)([^{]*){", code):
            kind = "class" if m[3] == "enum" else m[3]
            end = add(m, m[4], kind, exported=bool(m[2]), decorators=re.findall(r"@(\w+)", m[1]))
            heads = m[5].split("implements")
            refs += [_ref(path, m[4], x, "inherits") for x in re.findall(r"extends\s+([\w$]+)", heads[0])]
            refs += [_ref(path, m[4], x, "implements") for x in re.findall(r"[\w$]+", re.sub(r"<[^>]*>", "", heads[1]))] if len(heads) > 1 else []
            if m[3] != "class":
                continue
            at = m.end()
            member = re.compile(r"(?:(?:public|private|protected|static|async|override|get|set|readonly)\s+)*([\w$#]+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::\s*[^{};=]+)?{|{")
            while (f := member.search(code, at, end)) is not None:
                if f[1] and f[1] not in KEYWORDS - {"constructor"}:
                    add(f, f[1], "method", owner=m[4])
                at = _close(code, f.end() - 1)
        for name, body in bodies:
            for this, called in re.findall(r"(?:\b(this)\s*\.\s*)?(?<![\w$.])([\w$]+)\s*\(" if language == "javascript" else r"(?<![.\w$])()([\w$]+)\s*\(", body[1:]):
                if called not in KEYWORDS:
                    refs.append(_ref(path, name, renamed.get(called, called), "calls"))
            if language == "javascript":
                refs += [_ref(path, name, x, "calls") for x in re.findall(r"\bthis\.([\w$]+)\s*\(", body)]
        return symbols, refs

    return run


# --- Python ------------------------------------------------------------------------------------------------------------------
def python_complexity(node: ast.AST) -> int:
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def python(text: str, path: str) -> tuple[list[Symbol], list[Ref]]:
    tree = ast.parse(text)
    lines = text.splitlines()
    dotted = re.sub(r"\.[^./]*$", "", path).replace("/", ".")
    symbols = [_symbol(dotted.rsplit(".", 1)[-1], "module", path, "python", "", 1, import_path=dotted, visibility="public")]
    refs: list[Ref] = []

    def add(node, kind: str, owner: str | None) -> None:
        source = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        more = {}
        if kind != "class":
            more = {"signature": source.split("\n")[0].strip().removesuffix(":"), "complexity": python_complexity(node)}
        symbols.append(_symbol(
            node.name, kind, path, "python", source, node.lineno, parent_name=owner, decorators=[ast.unparse(d) for d in node.decorator_list],
            visibility="private" if node.name.startswith("_") else "public", **more,
        ))
        if kind == "class":
            refs.extend(_ref(path, node.name, b.attr if isinstance(b, ast.Attribute) else b.id, "inherits") for b in node.bases if isinstance(b, (ast.Name, ast.Attribute)))
            return
        for x in ast.walk(node):
            if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)):
                refs.append(_ref(path, node.name, x.func.id if isinstance(x.func, ast.Name) else x.func.attr, "calls"))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(node, "function", None)
        elif isinstance(node, ast.ClassDef):
            add(node, "class", None)
            for inner in node.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    add(inner, "method", node.name)
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            refs += [_ref(path, None, a.name, "imports", True, a.name) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            module = "." * x.level + (x.module or "")
            refs += [_ref(path, None, a.name, "imports", x.level == 0, module if x.level == 0 else None) for a in x.names]
    return symbols, refs


# --- Ruby ---------------------------------------------------------------------------------------------------------------------
def ruby_complexity(code: str) -> int:
    return 1 + len(re.findall(r"(?m)(?:^|[;=(]|\bthen\b)[ \t]*(?:if|unless|while|until|for)\b|\bwhen\b|\brescue\b|&&|\|\|", code))


def ruby(text: str, path: str) -> tuple[list[Symbol], list[Ref]]:
    code = blanked(text, "ruby")
    rows, all_lines = code.split("\n"), text.split("\n")
    symbols, refs, stack, visible = [], [], [], {}
    opens = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|for|case|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
    for i, row in enumerate(rows):
        m = re.match(r"\s*(def|class|module)\s+(?:self\.)?([\w:?!=]+)(?:\s*<\s*([\w:]+))?", row)
        owner = next((s[1] for s in reversed(stack) if s[0] in ("class", "module")), None)
        if v := re.match(r"\s*(private|protected|public)\s*$", row):
            visible[owner] = v[1]
        if m or opens.search(row):
            stack.append((m[1] if m else "block", m[2] if m else None, i, owner, visible.get(owner, "public"), m[3] if m else None))
        for _ in re.findall(r"(?:^|[;\s])end\b", row):
            if not stack:
                break
            kind, name, start, own, seen, base = stack.pop()
            if kind not in ("def", "class", "module"):
                continue
            source = "\n".join(all_lines[start : i + 1])
            body = "\n".join(rows[start : i + 1])
            what = {"def": "method" if own else "function"}.get(kind, kind)
            more = {"complexity": ruby_complexity(body), "signature": all_lines[start].strip()} if kind == "def" else {}
            symbols.append(_symbol(name, what, path, "ruby", source, start + 1, parent_name=own, visibility=seen if kind == "def" else "public", **more))
            if base:
                refs.append(_ref(path, name, base.rsplit("::", 1)[-1], "inherits"))
            if kind == "def":
                inner = "\n".join(rows[start + 1 : i])
                calls = re.findall(r"(?<![\w:@$])([a-z_]\w*[?!]?)\s*\(", inner) + re.findall(r"(?m)^\s*([a-z_]\w*[?!]?)\s*$", inner)
                refs += [_ref(path, name, c, "calls") for c in calls if c not in KEYWORDS]
    for m in re.finditer(r"(?m)^\s*(require|require_relative)\s*\(?\s*['\"]([^'\"]+)['\"]", text):
        refs.append(_ref(path, None, m[2], "imports", m[1] == "require", m[2] if m[1] == "require" else None))
    return sorted(symbols, key=lambda s: s["line_number"]), refs


for _name, _extract in (("go", go), ("typescript", _script("typescript")), ("tsx", _script("tsx")), ("javascript", _script("javascript")), ("python", python), ("ruby", ruby)):
    register(_name, _extract)

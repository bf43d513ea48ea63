"""Source files to symbols, edges and routes, by one contract for all languages.

Python files are parsed exactly; other languages are read by line patterns and say so in ``exact``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from chronoweave.runtime import ship

FIELDS = "path string, record string, name string, kind string, line int, end_line int, source string, target string, exact boolean"

# Of each language its file endings and the patterns of its definitions.
DEFINITIONS = {
    "rust": (("rs",), {"function": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "struct": r"^\s*(?:pub\s+)?struct\s+(\w+)", "trait": r"^\s*(?:pub\s+)?trait\s+(\w+)", "enum": r"^\s*(?:pub\s+)?enum\s+(\w+)"}),
    "javascript": (("js", "mjs", "cjs", "ts", "tsx"), {"function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "class": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "interface": r"^\s*(?:export\s+)?interface\s+(\w+)", "constant": r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("}),
    "go": (("go",), {"function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "struct": r"^type\s+(\w+)\s+struct", "interface": r"^type\s+(\w+)\s+interface"}),
    "java": (("java", "cs", "kt"), {"class": r"^\s*(?:public|private|protected)?\s*(?:static\s+|final\s+|abstract\s+|sealed\s+)*class\s+(\w+)", "interface": r"^\s*(?:public\s+)?interface\s+(\w+)", "method": r"^\s*(?:public|private|protected)\s+(?:static\s+|final\s+|async\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\("}),
    "ruby": (("rb",), {"method": r"^\s*def\s+(?:self\.)?(\w+[?!]?)", "class": r"^\s*class\s+(\w+)", "module": r"^\s*module\s+(\w+)"}),
    "php": (("php",), {"function": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)", "class": r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"}),
    "c": (("c", "h", "cpp", "hpp", "cc"), {"function": r"^[A-Za-z_][\w\s*&:<>]*?[\s*&](\w+)\s*\([^;]*\)\s*\{?\s*$", "struct": r"^\s*(?:typedef\s+)?struct\s+(\w+)", "class": r"^\s*class\s+(\w+)"}),
    "shell": (("sh", "bash"), {"function": r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"}),
    "document": (("md", "json", "yaml", "yml", "toml", "xml", "adoc"), {}),
}
# Patterns of route registrations of common web frameworks: method, path.
ROUTES = (
    r"\b(?:app|router|server)\.(get|post|put|patch|delete)\(\s*[\"'`]([^\"'`]+)",
    r"^\s*@\w+\.(get|post|put|patch|delete|route)\(\s*[\"']([^\"']+)",
    r"#\[(get|post|put|patch|delete)\(\"([^\"]+)\"",
    r"\.route\(\s*\"([^\"]+)\"\s*,\s*(get|post|put|patch|delete)\(",
    r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]+)\"",
    r"\[Http(Get|Post|Put|Patch|Delete)\(\"([^\"]+)\"",
    r"^\s*(get|post|put|patch|delete)\s+[\"']([^\"']+)[\"']",
    r"Route::(get|post|put|patch|delete)\(\s*[\"']([^\"']+)",
    r"\bHandleFunc\(\s*\"()([^\"]+)\"",
    r"\b\w+\.(GET|POST|PUT|PATCH|DELETE)\(\s*\"([^\"]+)\"",
)
IGNORED = (".git", "build", "node_modules", "target")


def ignored(path: str, extra: tuple[str, ...] = ()) -> bool:
    """Whether a path lies in a folder that isn't indexed."""
    return any(part in IGNORED or part in extra or part.startswith(".claude") for part in path.split("/")[:-1])


def _row(path, record, name, kind, line, end, source=None, target=None, exact=False):
    return (path, record, name, kind, line, end, source, target, exact)


def _python(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []

    def name_of(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        return node.attr if isinstance(node, ast.Attribute) else None

    def walk(node, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                out.append(_row(path, "symbol", child.name, kind, child.lineno, child.end_lineno, exact=True))
                if owner != "__module__":
                    out.append(_row(path, "edge", None, "contains", child.lineno, child.end_lineno, owner, child.name, True))
                for base in getattr(child, "bases", []):
                    if name_of(base):
                        out.append(_row(path, "edge", None, "inherits", child.lineno, child.lineno, child.name, name_of(base), True))
                walk(child, child.name)
            else:
                if isinstance(child, ast.Call) and name_of(child.func):
                    out.append(_row(path, "edge", None, "calls", child.lineno, child.lineno, owner, name_of(child.func), True))
                elif isinstance(child, ast.Import):
                    out.extend(_row(path, "import", a.asname or a.name, "imports", child.lineno, child.lineno, owner, a.name, True) for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    out.extend(_row(path, "import", a.asname or a.name, "imports", child.lineno, child.lineno, owner, f"{'.' * child.level}{child.module or ''}:{a.name}", True) for a in child.names)
                walk(child, owner)

    walk(tree, "__module__")
    return out


def extract(path: str, text: str | None) -> list[tuple]:
    """Rows of FIELDS for one file; unknown kinds of file and null texts give none."""
    text, ending = text or "", path.rsplit(".", 1)[-1].lower()
    lines, out = text.splitlines(), []
    if ending == "py":
        out = _python(path, text)
    else:
        for kinds, patterns in DEFINITIONS.values():
            if ending not in kinds:
                continue
            if not patterns:
                return [_row(path, "symbol", path.rsplit("/", 1)[-1], "document", 1, max(1, len(lines)))]
            symbols = [(n, m[1], kind) for n, line in enumerate(lines, 1) for kind, p in patterns.items() if (m := re.match(p, line))]
            for i, (n, name, kind) in enumerate(symbols):
                end = symbols[i + 1][0] - 1 if i + 1 < len(symbols) else len(lines)
                out.append(_row(path, "symbol", name, kind, n, end))
                names = {s[1] for s in symbols}
                for k in range(n, end):
                    out += [_row(path, "edge", None, "calls", k + 1, k + 1, name, t) for t in re.findall(r"\b(\w+)\s*\(", lines[k]) if t in names]
    for n, line in enumerate(lines, 1):
        for i, p in enumerate(ROUTES):
            m = re.search(p, line)
            if m:
                method, route = (m[2], m[1]) if i == 3 else (m[1], m[2])
                out.append(_row(path, "route", route, (method or "any").lower(), n, n))
                break
    return out


def extract_files(files: DataFrame) -> DataFrame:
    """Rows of FIELDS for files (path, text) outside ignored folders; whole files, in batches."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for p, t in zip(f["path"], f["text"]) if not ignored(p) for r in extract(p, t)], columns=[c.split()[0] for c in FIELDS.split(", ")])

    return files.select("path", "text").mapInPandas(run, FIELDS)

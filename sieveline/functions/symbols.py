"""Symbols of source files (E1): ``(name, kind, start_line, end_line)``, the first of each name.

Python is parsed by its own grammar. For the other languages declarations are
found by line patterns and their ends by matching braces (strings and comments
skipped); line ranges are therefore approximate in odd layouts.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Symbol = tuple[str, str, int, int]
SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int>"

_GO = [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]"), ("type", r"^type\s+(\w+)\s"), ("type", r"^\t(\w+)\s+(?:struct|interface)\s*\{")]
_JVM = [
    ("class", r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed|data|open|case|internal)\s+)*(?:class|record|object)\s+(\w+)"),
    ("interface", r"^\s*(?:(?:public|private|protected|static|sealed)\s+)*(?:interface|trait)\s+(\w+)"),
    ("enum", r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(?:class\s+)?(\w+)"),
    ("method", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|override|suspend)\s+)*(?:fun|def)\s+(\w+)"),
    ("method", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?.]+\s+(\w+)\s*\("),
]
_SCRIPT = [
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*="),
    ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)"),
]
_TERRAFORM = [("resource", r'^(?:resource|data)\s+"[^"]+"\s+"([^"]+)"'), ("block", r'^(?:variable|output|module|provider)\s+"([^"]+)"')]
_PATTERNS = {e: [(k, re.compile(p, re.M)) for k, p in rules] for exts, rules in (((".go",), _GO), ((".java", ".kt", ".scala"), _JVM), ((".js", ".jsx", ".ts", ".tsx"), _SCRIPT), ((".tf",), _TERRAFORM)) for e in exts}
_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|[{};\n]", re.S)


def _end(text: str, at: int) -> int:
    """Where a declaration that starts at ``at`` ends: behind its braces, or its line if it has none."""
    depth = 0
    for m in _TOKENS.finditer(text, at):
        t = m[0]
        if t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0 and t in ";\n":
            return m.start()
    return len(text)


def _python(text: str) -> list[Symbol]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((node.name, "function", node.lineno, node.end_lineno or node.lineno))
        elif isinstance(node, ast.ClassDef):
            out.append((node.name, "class", node.lineno, node.end_lineno or node.lineno))
    return sorted(out, key=lambda s: (s[2], s[3]))


def symbols_of(path: str, text: str) -> list[Symbol]:
    ext = path[path.rfind(".") :].lower() if "." in path else ""
    if ext == ".py":
        found = _python(text)
    else:
        found = []
        for kind, pattern in _PATTERNS.get(ext, []):
            for m in pattern.finditer(text):
                start = 1 + text.count("\n", 0, m.start(1))
                found.append((m[1], kind, start, 1 + text.count("\n", 0, max(m.start(1), _end(text, m.start(1)) - 1))))
        found.sort(key=lambda s: (s[2], s[3]))
    first: dict[str, Symbol] = {}
    for s in found:
        first.setdefault(s[0], s)
    return list(first.values())


def symbols(path: Column, content: Column) -> Column:
    """E1 as a column: ``array<struct<name,kind,start_line,end_line>>``."""

    @F.pandas_udf(f"array<{SYMBOL}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, texts in batches:
            yield pd.Series([[dict(zip(("name", "kind", "start_line", "end_line"), s)) for s in symbols_of(p or "", t or "")] for p, t in zip(paths, texts)])

    return run(path, content)

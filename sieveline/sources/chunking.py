"""Chunking (C1-C8): texts to bounded chunks with their lines.

The splitters walk a text once with running byte counts, which built-in
functions can't express, so they are Arrow functions over whole columns;
everything behind them (caps, overlaps with symbols, classes) is a plan.
Budgets are in bytes of UTF-8; a chunk never splits a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import symbols_of
from ..operators.joins import interval_overlap
from .extract import slices
from .files import CHUNK_BYTES, CODE_EXTENSIONS, CODE_NAMES, MAX_CHUNKS_PER_FILE

CHUNK = "struct<content:string,start_line:int,end_line:int>"
Chunk = tuple[str, int, int]
_SPACE = b" \t\n\v\f\r"


def _strip(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").strip()


def split_characters(raw: bytes, budget: int) -> list[bytes]:
    """C4: pieces of at most ``budget`` bytes; one character may be wider."""
    out = []
    while len(raw) > budget:
        cut = budget
        while cut > 0 and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        if cut == 0:
            cut = budget
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut += 1
        out.append(raw[:cut])
        raw = raw[cut:]
    return [*out, raw] if raw else out


def prose_chunks(raw: bytes, budget: int) -> list[Chunk]:
    """Windows that end at a line feed past their middle if there is one, with a tenth of overlap."""
    n = len(raw)
    if n <= budget:
        return [(_strip(raw), 1, 1 + raw.count(b"\n"))]
    out, start = [], 0
    while start < n:
        end = min(start + budget, n)
        if end < n:
            feed = raw.rfind(b"\n", start, end) - start
            if feed > budget // 2:
                end = start + feed + 1
            else:
                while end > start and raw[end] & 0xC0 == 0x80:
                    end -= 1
        out.append((_strip(raw[start:end]), 1 + raw.count(b"\n", 0, start), 1 + raw.count(b"\n", 0, max(0, end - 1))))
        if end >= n:
            break
        following = end - budget // 10
        while start < following < n and raw[following] & 0xC0 == 0x80:
            following -= 1
        start = following if following > start else end
    return out


def code_chunks(raw: bytes, budget: int, first_line: int = 1) -> list[Chunk]:
    """Runs of lines up to a blank line or the budget; longer lines are cut between characters."""
    out: list[Chunk] = []
    held, since, last = b"", 0, 0

    def flush():
        nonlocal held
        if held:
            out.append((_strip(held), since, last))
        held = b""

    for number, line in enumerate(raw.splitlines(keepends=True) if b"\r" not in raw else _lines(raw), first_line):
        if held and not line.decode("utf-8", "replace").strip():
            flush()
        elif len(line) > budget:
            flush()
            out += [(text, number, number) for text in map(_strip, split_characters(line, budget)) if text]
        else:
            if held and len(held) + len(line) + 1 > budget:
                flush()
            if not held:
                since = number
            last = number
            held += line + b"\n"
    flush()
    return out or (prose_chunks(raw, budget) if raw else [])


def _lines(raw: bytes) -> list[bytes]:
    parts = raw.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def symbol_chunks(path: str, raw: bytes, budget: int) -> list[Chunk]:
    """One chunk a symbol (``[kind] name`` on its first line), the text between symbols as code; empty without symbols."""
    found = sorted(symbols_of(path, raw.decode("utf-8", "replace")), key=lambda s: (s[2], s[3]))
    if not found:
        return []
    lines = _lines(raw)
    out: list[Chunk] = []
    at = 1
    for name, kind, start, end in found:
        end = min(end, len(lines))
        if start < at:
            continue
        if start > at:
            out += [c for c in code_chunks(b"".join(lines[at - 1 : start - 1]), budget, at) if c[0]]
        head = f"[{kind}] {name}\n".encode()
        body = b"".join(lines[start - 1 : end])
        if len(head) + len(body) <= budget:
            out.append((_strip(head + body), start, end))
        else:
            room = max(1, budget - len(head))
            for text, a, b in code_chunks(body, room, start):
                if text:
                    out.append(((head.decode() + text), a, b))
        at = end + 1
    if at <= len(lines):
        out += [c for c in code_chunks(b"".join(lines[at - 1 :]), budget, at) if c[0]]
    return out


def chunk_file(path: str, raw: bytes, budget: int = CHUNK_BYTES) -> list[Chunk]:
    """Code by symbols, then by blank lines; anything else as prose."""
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    code = name[dot:].lower() in CODE_EXTENSIONS if dot >= 0 else name in CODE_NAMES
    return (symbol_chunks(path, raw, budget) or code_chunks(raw, budget)) if code else prose_chunks(raw, budget)


def chunks_of(path: Column, content: Column, budget: int = CHUNK_BYTES, how: str = "file") -> Column:
    """C1-C3, C5 as a column: ``array<struct<content,start_line,end_line>>``; ``how``: file, code, prose or symbols."""
    kinds = {"file": chunk_file, "code": lambda p, b, n: code_chunks(b, n), "prose": lambda p, b, n: prose_chunks(b, n), "symbols": symbol_chunks}
    split = kinds[how]

    kind = pa.list_(pa.struct([("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))

    @F.arrow_udf(f"array<{CHUNK}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, texts in batches:
            for at, n in slices(texts):
                pairs = zip(paths.slice(at, n).to_pylist(), texts.slice(at, n).to_pylist())
                yield pa.array([[{"content": c, "start_line": a, "end_line": b} for c, a, b in split(p or "", (t or "").encode(), budget)] for p, t in pairs], kind)

    return run(path, content)


def pieces_of(text: Column, budget: int) -> Column:
    """C4 as a column: ``array<binary>``."""

    @F.pandas_udf("array<binary>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_characters((t or "").encode(), budget))

    return run(text)


def explode_chunks(files: DataFrame, budget: int = CHUNK_BYTES, how: str = "file") -> DataFrame:
    """One row a chunk: the file's columns but ``content``, ``chunk_index`` and the chunk."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode(chunks_of(F.col("path"), F.col("content"), budget, how)).alias("chunk_index", "c")).select(*keep, "chunk_index", "c.*")


def paragraphs(text: Column) -> Column:
    """C2's core in built-in functions, for texts within the budget: non-blank runs between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n[ \t\r]*\n"), F.trim), lambda p: p != "")


def cap_chunks(chunks: DataFrame, per_file: int = MAX_CHUNKS_PER_FILE, per_project: int | None = None) -> DataFrame:
    """The first chunks of each file, then of the project in the order of paths.

    The project budget counts files first (one row each), so no window holds a
    project's chunks.
    """
    kept = chunks.where(F.col("chunk_index") < per_file)
    if per_project is None:
        return kept
    sizes = kept.groupBy("project", "path").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("project").orderBy("path")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("project", "path").orderBy("chunk_index"))
    return kept.withColumn("_k", place).join(before, ["project", "path"]).where(F.col("_before") + F.col("_k") <= per_project).drop("_k", "_n", "_before")


def chunk_inputs(content: Column, start: Column, end: Column, symbols: Column, cap: int = 20) -> Column:
    """The text to embed, behind the names of the symbols on its lines; symbols: array of (name, kind, start_line, end_line)."""
    here = F.filter(symbols, lambda s: (s["start_line"] <= end) & (s["end_line"] >= start))
    names = F.transform(F.slice(here, 1, cap), lambda s: F.concat_ws(" ", s["kind"], s["name"]))
    listed = F.concat(F.array_join(names, ", "), F.when(F.size(here) > cap, "...").otherwise(""))
    return F.when(F.size(here) == 0, content).otherwise(F.concat(F.lit("Symbols: "), listed, F.lit("\n"), content))


#: The order of symbols in a list: ``at`` first, the rest where it is equal.
_LISTED = ["at", "name", "kind", "sym_start", "sym_end"]


def _first_of(symbols: DataFrame, n: int, *by: str) -> DataFrame:
    """The first ``n`` in list order of each group."""
    w = Window.partitionBy(*by).orderBy(*[c for c in _LISTED if c not in by])
    return symbols.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def listed_inputs(chunks: DataFrame, symbols: DataFrame, cap: int = 20) -> DataFrame:
    """C7 over tables: ``chunks`` (path, start_line, end_line, content and more) with ``input``; ``symbols``: path, at, name, kind, start_line, end_line.

    Of symbols on equal lines no chunk lists more than ``cap`` and one to tell that
    there are more; they meet each distinct run of lines once, so neither a list
    nor the rows between grow with a file's symbols.
    """
    s = symbols.withColumnsRenamed({"start_line": "sym_start", "end_line": "sym_end"})
    few = _first_of(s, cap + 1, "path", "sym_start", "sym_end")
    met = _first_of(interval_overlap(chunks.select("path", "start_line", "end_line").distinct(), few), cap + 1, "path", "start_line", "end_line")
    row = F.struct("at", "name", "kind", F.col("sym_start").alias("start_line"), F.col("sym_end").alias("end_line"))
    here = met.groupBy("path", "start_line", "end_line").agg(F.sort_array(F.collect_list(row)).alias("_here"))
    # chunks without symbols get an empty list of the same type
    none = F.filter(F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in here.schema["_here"].dataType.elementType])), lambda x: F.lit(False))
    joined = chunks.join(here, ["path", "start_line", "end_line"], "left")
    return joined.withColumn("input", chunk_inputs(F.col("content"), F.col("start_line"), F.col("end_line"), F.coalesce("_here", none), cap)).drop("_here")


def classify_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """C8 over tables as in C7: ``confidence, symbol``: declared here, overlapping, mentioned, or neither; the first symbol in list order.

    Lines are compared once for each distinct run of them, mentions once for each
    distinct text and name of a file, and only where lines decide nothing.
    """
    lines = ["path", "start_line", "end_line"]
    s = symbols.where("name <> ''").withColumnsRenamed({"start_line": "sym_start", "end_line": "sym_end"})
    few = _first_of(s, 1, "path", "sym_start", "sym_end").withColumns({"_end": F.col("sym_end"), "sym_end": F.greatest("sym_start", "sym_end")})
    met = interval_overlap(chunks.select(*lines).distinct(), few)
    row = F.struct("at", "name", "kind", "sym_start", F.col("_end").alias("sym_end"))
    first = lambda test: F.min(F.when(test, row))["name"]
    by_lines = met.groupBy(*lines).agg(
        first(F.col("sym_start").between(F.col("start_line"), F.col("end_line"))).alias("_declared"),
        first((F.col("sym_start") <= F.col("end_line")) & (F.col("_end") >= F.col("start_line"))).alias("_over"),
    )
    found = chunks.join(by_lines, lines, "left")
    texts = found.where("_declared is null and _over is null and content is not null").select("path", "content").distinct()
    names = s.groupBy("path", "name").agg(F.min(F.struct(*_LISTED)).alias("_row"))
    said = texts.join(names, "path").where(F.contains("content", F.col("name"))).groupBy("path", "content").agg(F.min("_row")["name"].alias("_said"))
    found = found.join(said, ["path", "content"], "left")
    confidence = F.when(F.col("_declared").isNotNull(), "EXTRACTED").when(F.coalesce("_over", "_said").isNotNull(), "INFERRED").otherwise("AMBIGUOUS")
    return found.withColumns({"confidence": confidence, "symbol": F.coalesce("_declared", "_over", "_said", F.lit(""))}).drop("_declared", "_over", "_said")

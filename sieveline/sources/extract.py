"""Text extraction (S5-S21): bytes of a file to rows ``path, text, error``.

Formats are found by name, then extension. Archives fan out to ``archive!entry``
rows. Nothing raises: what can't be read gives a row with ``error`` (``unsupported``,
``encrypted``, ``not_text`` or a reason). Only the standard library is used, so
PDF and legacy Office files are rows with ``unsupported``; others may register a
reader for their extension.
"""

from __future__ import annotations

import bz2
import email
import email.policy
import gzip
import io
import json
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits for archives.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES, MAX_DEPTH = 50, 10 << 20, 100 << 20, 2
#: Fixed value: text entries of Java archives up to this size.
MAX_JAR_TEXT = 1 << 20
Row = tuple[str, str, str]


class NotText(ValueError):
    pass


class Encrypted(ValueError):
    pass


class Unsupported(ValueError):
    pass


def decode_text(raw: bytes) -> str:
    """UTF-8; a NUL means that it isn't text; else Windows-1252, else Latin-1."""
    if b"\0" in raw:
        raise NotText("not_text")
    for encoding in ("utf-8", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def normalize_text(x: str) -> str:
    """No white space at line ends, one blank line at most, none around."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r]+(?=\n|\Z)", "", x)).strip()


def normalize_column(x: Column) -> Column:
    """S8 in built-in functions."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t\r]+(\n|\z)", "$1"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


class _Html(HTMLParser):
    hidden = frozenset("script style head noscript".split())
    block = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article header footer ul ol table pre blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden
        if tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.hidden))
        if tag in self.block:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.out.append(data.strip() + " ")


def html_text(raw: bytes) -> str:
    """Visible text, a line feed behind block elements."""
    parser = _Html()
    parser.feed(decode_text(raw))
    parser.close()
    return normalize_text("".join(parser.out))


def _zip(raw: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        if raw[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":  # an OLE container holds encrypted Office files
            raise Encrypted("encrypted") from None
        raise
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise Encrypted("encrypted")
    return z


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _flow(root, text_tags: set[str], line_tags: set[str], tab_tags: set[str] = frozenset({"tab"})) -> str:
    out: list[str] = []

    def walk(node):
        name = _local(node.tag)
        if name in tab_tags:
            out.append("\t")
        if name == "br" or name == "line-break":
            out.append("\n")
        if node.text and (not text_tags or name in text_tags):
            out.append(node.text)
        for child in node:
            walk(child)
            if child.tail and not text_tags:
                out.append(child.tail)
        if name in line_tags:
            out.append("\n")

    walk(root)
    return normalize_text("".join(out))


def docx_text(raw: bytes) -> str:
    """S10."""
    return _flow(ElementTree.fromstring(_zip(raw).read("word/document.xml")), {"t"}, {"p", "tr"})


def xlsx_text(raw: bytes) -> str:
    """A heading and tab-joined rows per sheet."""
    z = _zip(raw)
    names = z.namelist()
    shared = [" ".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    book = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for title, name in zip(book, sheets):
        out.append(f"# {title}")
        for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if _local(r.tag) == "row"):
            cells = []
            for c in row:
                value = "".join(v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            out.append("\t".join(cells))
    return normalize_text("\n".join(out))


def pptx_text(raw: bytes) -> str:
    """Slides in the order of their numbers."""
    z = _zip(raw)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    return normalize_text("\n\n".join(_flow(ElementTree.fromstring(z.read(n)), {"t"}, {"p"}) for n in slides))


def open_document_text(raw: bytes) -> str:
    """S12."""
    body = next(e for e in ElementTree.fromstring(_zip(raw).read("content.xml")).iter() if _local(e.tag) == "body")
    return _flow(body, set(), {"p", "h", "table-row"})


def epub_text(raw: bytes) -> str:
    """In the order of the spine."""
    z = _zip(raw)
    package = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile")
    root, base = ElementTree.fromstring(z.read(package)), package.rpartition("/")[0]
    files = {e.get("id"): e.get("href") for e in root.iter() if _local(e.tag) == "item"}
    order = [files[e.get("idref")] for e in root.iter() if _local(e.tag) == "itemref" and e.get("idref") in files]
    return normalize_text("\n\n".join(html_text(z.read(f"{base}/{f}" if base else f)) for f in order))


def notebook_text(raw: bytes) -> str:
    """The sources of all cells."""
    cells = json.loads(raw).get("cells", [])
    return normalize_text("\n\n".join("".join(s) if isinstance(s := c.get("source", ""), list) else str(s) for c in cells))


def rtf_text(raw: bytes) -> str:
    """Control words dropped, groups that hold no text skipped."""
    text, out, stack, skip = raw.decode("latin-1"), [], [], False
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", text):
        word, _, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            skip = True
        elif not skip:
            out.append("\n" if word in ("par", "line") else "\t" if word == "tab" else bytes.fromhex(code).decode("cp1252", "replace") if code else sign if sign in ("{", "}", "\\") else plain or "")
    return normalize_text("".join(out))


def eml_text(raw: bytes) -> str:
    """Four headers and the body, plain text before HTML."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    content = body.get_content() if body else ""
    if body is not None and body.get_content_type() == "text/html":
        content = html_text(content.encode())
    return normalize_text("\n".join(f"{h}: {m[h]}" for h in ("From", "To", "Subject", "Date") if m[h]) + "\n\n" + content)


def class_symbols(raw: bytes) -> str:
    """Readable names of a class file's constant pool."""
    if raw[:4] != b"\xca\xfe\xba\xbe":
        raise NotText("not_text")
    count, at, names, i = struct.unpack(">H", raw[8:10])[0], 10, [], 1
    sizes = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
    while i < count:
        tag = raw[at]
        if tag == 1:
            n = struct.unpack(">H", raw[at + 1 : at + 3])[0]
            names.append(raw[at + 3 : at + 3 + n].decode("utf-8", "replace"))
            at += 3 + n
        else:
            at += 1 + sizes[tag]
        i += 2 if tag in (5, 6) else 1
    return "\n".join(dict.fromkeys(n for n in names if re.fullmatch(r"[A-Za-z_$][\w$/.]{2,}", n)))


def java_archive(path: str, raw: bytes) -> list[Row]:
    """Names of classes, and small text entries."""
    out = []
    for info in _zip(raw).infolist():
        name = info.filename
        if name.endswith(".class") and info.file_size <= MAX_JAR_TEXT:
            out.append(_safe(f"{path}!{name}", lambda i=info: class_symbols(_zip(raw).read(i))))
        elif re.search(r"\.(?:xml|properties|MF|txt|md|json|ya?ml)$", name) and info.file_size <= MAX_JAR_TEXT:
            out.append(_safe(f"{path}!{name}", lambda i=info: normalize_text(decode_text(_zip(raw).read(i)))))
    return out


def archive(path: str, raw: bytes, depth: int = 0, spent: list[int] | None = None) -> list[Row]:
    """Zip and tar (plain, gzip, bzip2), with limits on entries, sizes and nesting."""
    spent = spent if spent is not None else [0, 0]
    low = path.lower()
    if low.endswith(".zip"):
        z = _zip(raw)
        entries = ((i.filename, i.file_size, lambda i=i: z.open(i).read(MAX_ENTRY_BYTES + 1)) for i in z.infolist() if not i.is_dir())
    elif re.search(r"\.(?:tar|tgz|tar\.gz|tbz2|tar\.bz2)$", low):
        t = tarfile.open(fileobj=io.BytesIO(raw))
        entries = ((m.name, m.size, lambda m=m: t.extractfile(m).read(MAX_ENTRY_BYTES + 1)) for m in t if m.isfile())
    else:
        plain = (gzip.GzipFile(fileobj=io.BytesIO(raw)) if low.endswith(".gz") else bz2.BZ2File(io.BytesIO(raw))).read(MAX_ENTRY_BYTES + 1)
        entries = iter([(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], len(plain), lambda: plain)])
    out: list[Row] = []
    for name, size, read in entries:
        spent[0] += 1
        if spent[0] > MAX_ENTRIES or spent[1] > MAX_TOTAL_BYTES:
            out.append((path, "", "archive_limit"))
            break
        clean = name.replace("\\", "/").lstrip("/")
        if size > MAX_ENTRY_BYTES or ".." in clean.split("/"):
            continue
        data = read()
        spent[1] += len(data)
        if is_archive(clean):
            out += archive(f"{path}!{clean}", data, depth + 1, spent) if depth + 1 < MAX_DEPTH else [(f"{path}!{clean}", "", "archive_limit")]
        else:
            out += extract_all(f"{path}!{clean}", data)
    return out


def is_archive(path: str) -> bool:
    return bool(re.search(r"\.(?:zip|tar|tgz|gz|tbz2|bz2)$", path.lower()))


def lockfile_text(raw: bytes) -> str:
    """``name@version`` lines of npm, yarn, go, cargo, poetry and gem lock files; another file as it is."""
    text = decode_text(raw)
    head = [x.strip() for x in text.split("\n") if x.strip()][:20]
    if not head:
        return ""
    if head[0].startswith("{"):
        found = [f"{n}@{v}" for n, v in re.findall(r'"name"\s*:\s*"([^"]+)"[^{}]*?"version"\s*:\s*"([^"]+)"', text)]
    elif "[[package]]" in text:
        found = [f"{n}@{v}" for n, v in re.findall(r'(?m)^name\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"', text)]
    elif any("yarn" in x.lower() for x in head) or re.search(r'(?m)^"?@?[\w./-]+@[^:\n]+:\s*$', text):
        found = re.findall(r'(?m)^"?(@?[\w./-]+@[^",:\n]+)', text)
    elif re.match(r"\S+ v\S+ h1:", head[0]):
        found = [f"{n}@{v}" for n, v in re.findall(r"(?m)^(\S+) (v[^\s/]+)(?:/go\.mod)? h1:", text)]
    elif any(x in ("GEM", "PATH", "PLATFORMS", "DEPENDENCIES") for x in head):
        found = [f"{n}@{v}" for n, v in re.findall(r"(?m)^    ([\w.-]+) \(([^)]+)\)", text)]
    else:
        found = []
    return "\n".join(dict.fromkeys(found)) or text.strip()


def openapi_text(raw: bytes) -> str | None:
    """Title, version and endpoints; None if the first 200 bytes don't tell of an API description."""
    text = decode_text(raw)
    if not re.search(r"openapi|swagger", text[:200]):
        return None
    methods = "get put post delete options head patch trace".split()
    if text.lstrip().startswith("{"):
        doc = json.loads(text)
        title, version = doc.get("info", {}).get("title", ""), doc.get("info", {}).get("version", "")
        ends = [f"{m.upper()} {p}" for p, ops in doc.get("paths", {}).items() for m in ops if m in methods]
    else:
        field = lambda f: (re.search(rf"(?m)^\s+{f}:\s*['\"]?(.*?)['\"]?\s*$", text) or ["", ""])[1]
        title, version, ends, path = field("title"), field("version"), [], ""
        for line in text.split("\n"):
            if m := re.match(r"\s{2}(/\S*):\s*$", line):
                path = m[1]
            elif path and (m := re.match(r"\s{4}(\w+):", line)) and m[1] in methods:
                ends.append(f"{m[1].upper()} {path}")
    return "\n".join([f"Title: {title}", f"Version: {version}", "Endpoints:", *ends])


#: What is listed before the text, by label and pattern.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "proto": [("Messages", r"(?m)^\s*message\s+(\w+)"), ("Services", r"(?m)^\s*service\s+(\w+)"), ("RPCs", r"(?m)^\s*rpc\s+(\w+)"), ("Enums", r"(?m)^\s*enum\s+(\w+)")],
    "graphql": [("Types", r"(?m)^\s*type\s+(\w+)"), ("Inputs", r"(?m)^\s*input\s+(\w+)"), ("Enums", r"(?m)^\s*enum\s+(\w+)"), ("Interfaces", r"(?m)^\s*interface\s+(\w+)")],
    "prisma": [("Models", r"(?m)^\s*model\s+(\w+)"), ("Enums", r"(?m)^\s*enum\s+(\w+)"), ("Datasources", r"(?m)^\s*datasource\s+(\w+)")],
    "makefile": [("Targets", r"(?m)^([A-Za-z][\w.-]*)\s*:(?!=)")],
    "dockerfile": [("Stages", r"(?mi)^FROM\s+(\S+(?:\s+AS\s+\S+)?)"), ("Ports", r"(?mi)^EXPOSE\s+(\S+)"), ("Entrypoints", r"(?mi)^(?:ENTRYPOINT|CMD)\s+(.+)$")],
    "agents": [("Sections", r"(?m)^#+\s+(.+?)\s*$")],
}


def declared_column(kind: str, content: Column) -> Column:
    """S18 in built-in functions: ``Label: a, b`` lines of what was declared, then the text."""
    lines = []
    for label, pattern in DECLARATIONS[kind]:
        names = F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)))
        lines.append(F.when(F.size(names) > 0, F.concat(F.lit(f"{label}: "), F.array_join(names, ", "), F.lit("\n"))).otherwise(""))
    return F.concat(*lines, content)


def declared_text(kind: str, raw: bytes) -> str:
    text = decode_text(raw)
    found = [(label, dict.fromkeys(re.findall(p, text))) for label, p in DECLARATIONS[kind]]
    return "".join(f"{label}: {', '.join(names)}\n" for label, names in found if names) + text


#: Markup taken away, by kind; patterns and what stays.
STRIPPED: dict[str, list[tuple[str, str]]] = {
    "vue": [(r"(?s)<style\b[^>]*>.*?</style>", ""), (r"</?(?:template|script)\b[^>]*>", "")],
    "jinja": [(r"(?s)\{#.*?#\}", ""), (r"\{%-?\s*(.*?)\s*-?%\}", r"\1"), (r"\{\{-?\s*(.*?)\s*-?\}\}", r"\1")],
    "handlebars": [(r"(?s)\{\{!--.*?--\}\}|\{\{![^}]*\}\}", ""), (r"\{\{\{?[#/^&>]?\s*(.*?)\s*\}?\}\}", r"\1")],
    "xml": [(r"(?s)<!--.*?-->|<\?.*?\?>", ""), (r"<[^>]+>", " ")],
    "legal": [(r"[ \t]+", " ")],
    "toml": [],
}


def stripped_text(kind: str, raw: bytes) -> str:
    text = decode_text(raw)
    for pattern, stays in STRIPPED[kind]:
        text = re.sub(pattern, stays, text)
    return normalize_text(text)


def stripped_column(kind: str, content: Column) -> Column:
    """S19 in built-in functions."""
    for pattern, stays in STRIPPED[kind]:
        content = F.regexp_replace(content, pattern, stays.replace("\\1", "$1"))
    return normalize_column(content)


def rst_text(raw: bytes) -> str:
    """Underlines, directives and their options dropped, titles and prose kept."""
    out, inside = [], False
    for line in decode_text(raw).split("\n"):
        if re.fullmatch(r"\s*([=\-~^\"'`#*+.:_])\1{2,}\s*", line):
            continue
        if re.match(r"\s*\.\.\s+[\w-]+::", line):
            inside = True
            continue
        if inside and (not line.strip() or re.match(r"\s+:[\w-]+:", line)):
            continue
        inside = False
        out.append(re.sub(r":\w+:`([^`<]+?)(?:\s*<[^>]*>)?`", r"\1", line))
    return normalize_text("\n".join(out))


def pdf_text(raw: bytes) -> str:
    """No reader at hand; encrypted files are told apart."""
    if b"/Encrypt" in raw[-4096:] or b"/Encrypt" in raw[:4096]:
        raise Encrypted("encrypted")
    raise Unsupported("unsupported")


def _plain(raw: bytes) -> str:
    return normalize_text(decode_text(raw))


def _api(raw: bytes) -> str:
    return openapi_text(raw) or _plain(raw)


def _unsupported(raw: bytes) -> str:
    raise Unsupported("unsupported")


BY_NAME: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys("package-lock.json yarn.lock go.sum Cargo.lock poetry.lock Gemfile.lock".split(), lockfile_text),
    **dict.fromkeys("Makefile makefile GNUmakefile".split(), lambda r: declared_text("makefile", r)), **dict.fromkeys("Dockerfile Containerfile".split(), lambda r: declared_text("dockerfile", r)),
    **dict.fromkeys("AGENTS.md CLAUDE.md".split(), lambda r: declared_text("agents", r)), **dict.fromkeys("LICENSE NOTICE COPYING LICENSE.txt LICENSE.md".split(), lambda r: stripped_text("legal", r)),
}
BY_EXTENSION: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys((".html", ".htm", ".xhtml"), html_text), ".pdf": pdf_text, ".docx": docx_text, ".xlsx": xlsx_text, ".pptx": pptx_text,
    **dict.fromkeys((".odt", ".ods", ".odp"), open_document_text), ".epub": epub_text, ".ipynb": notebook_text, ".rtf": rtf_text, ".eml": eml_text,
    ".proto": lambda r: declared_text("proto", r), **dict.fromkeys((".graphql", ".gql"), lambda r: declared_text("graphql", r)), ".prisma": lambda r: declared_text("prisma", r),
    ".vue": lambda r: stripped_text("vue", r), **dict.fromkeys((".jinja", ".jinja2"), lambda r: stripped_text("jinja", r)), **dict.fromkeys((".hbs", ".handlebars"), lambda r: stripped_text("handlebars", r)),
    ".rst": rst_text, ".xml": lambda r: stripped_text("xml", r), ".toml": lambda r: stripped_text("toml", r), **dict.fromkeys((".json", ".yaml", ".yml"), _api), **dict.fromkeys((".doc", ".xls", ".ppt"), _unsupported), ".class": class_symbols,
}


def register(key: str, reader: Callable[[bytes], str]) -> None:
    """A reader for an extension (with its dot) or a file name. Workers see what is registered in a module they import."""
    (BY_EXTENSION if key.startswith(".") else BY_NAME)[key] = reader


def _safe(path: str, read: Callable[[], str]) -> Row:
    try:
        return path, read(), ""
    except (NotText, Encrypted, Unsupported) as e:
        return path, "", str(e)
    except Exception as e:  # noqa: BLE001  a broken file is a row, not a failure
        return path, "", f"{type(e).__name__}: {e}"[:200]


def extract_all(path: str, raw: bytes) -> list[Row]:
    """Rows of a file; archives give one a text entry."""
    name = path.rsplit("/", 1)[-1].rsplit("!", 1)[-1].rsplit("/", 1)[-1]
    ext = name[name.rfind(".") :].lower() if "." in name else ""
    if ext in (".jar", ".war", ".aar") or is_archive(name):
        try:
            return java_archive(path, raw) if not is_archive(name) else archive(path, raw, path.count("!"))
        except Encrypted:
            return [(path, "", "encrypted")]
        except Exception as e:  # noqa: BLE001
            return [(path, "", f"{type(e).__name__}: {e}"[:200])]
    reader = BY_NAME.get(name) or BY_EXTENSION.get(ext) or _plain
    return [_safe(path, lambda: reader(raw))]


#: Bytes and rows that a Python worker turns into objects at a time.
SLICE_BYTES, SLICE_ROWS = 1 << 21, 1000


def slices(contents: pa.Array) -> Iterator[tuple[int, int]]:
    """``start, rows`` of runs of bounded size, so that a worker's memory doesn't follow the size of an Arrow batch."""
    start = held = 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(contents), 0).to_pylist()):
        if at > start and (held + size > SLICE_BYTES or at - start >= SLICE_ROWS):
            yield start, at - start
            start, held = at, 0
        held += size
    if start < len(contents):
        yield start, len(contents) - start


def extracted(files: DataFrame) -> DataFrame:
    """S5 over ``path, content`` (binary): ``path, text, error`` rows."""
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(1)):
                part = batch.slice(start, n)
                rows = [r for path, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in extract_all(path, raw or b"")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def can_be_encrypted(path: Column) -> Column:
    """Kinds of files that may need a password; unlocking them isn't offered, their outcome is ``encrypted``."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(".pdf", ".docx", ".xlsx", ".pptx", ".zip")

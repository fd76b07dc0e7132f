"""Extraction by format (S4, S6, S9-S17, S20, S21): files are made from whole tables, read back, and compared with what went in."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import extract
from .registry import query

#: White space at line ends, runs of blank lines and white space around taken away, as S8 does.
_NORM = "regexp_replace(regexp_replace(regexp_replace({x}, '[ \\t\\r]+(\\n|\\z)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+\\z', '', 'g')"
_TEXT = f"SELECT doc_id, sha256({_NORM.format(x='text')}) AS h FROM documents WHERE text IS NOT NULL"


def _zipped(entries: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _paragraphs(text: str, open_tag: str, close_tag: str) -> str:
    return "".join(f"{open_tag}{escape(line)}{close_tag}" for line in text.split("\n"))


def docx(text: str) -> bytes:
    return _zipped({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{_paragraphs(text, "<w:p><w:r><w:t>", "</w:t></w:r></w:p>")}</w:body></w:document>'})


def pptx(text: str) -> bytes:
    return _zipped({"ppt/slides/slide1.xml": f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a">{_paragraphs(text, "<a:p><a:r><a:t>", "</a:t></a:r></a:p>")}</p:sld>'})


def odt(text: str) -> bytes:
    return _zipped({"content.xml": f'<o:document-content xmlns:o="urn:o" xmlns:text="urn:t"><o:body>{_paragraphs(text, "<text:p>", "</text:p>")}</o:body></o:document-content>'})


def notebook(text: str) -> bytes:
    return json.dumps({"cells": [{"cell_type": "markdown", "source": text.splitlines(True)}, {"cell_type": "code", "source": "print(1)"}]}).encode()


def mail(text: str) -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@example.com", "b@example.com", "a subject"
    m.set_content(text, cte="base64")
    return m.as_bytes()


def epub(text: str) -> bytes:
    container = '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'
    package = '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    return _zipped({"META-INF/container.xml": container, "o/p.opf": package, "o/a.xhtml": f"<html><body><p>{escape(text)}</p></body></html>", "o/b.xhtml": "<p>second</p>"})


def sheet(text: str) -> bytes:
    words = text.split(" ")
    cells = "".join(f'<c t="s"><v>{i}</v></c>' for i in range(len(words)))
    return _zipped({
        "xl/workbook.xml": '<workbook><sheets><sheet name="Words"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(w)}</t></si>" for w in words) + "</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{cells}</row><row><c><v>{len(words)}</v></c></row></sheetData></worksheet>",
    })


def rich_text(text: str) -> bytes:
    return (r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\pard " + text.replace(" ", "\\par\n") + r"\tab end \'e9}").encode("latin-1")


def java_class(text: str) -> bytes:
    names = [w.encode() for w in text.split(" ")]
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, len(names) + 1) + b"".join(b"\x01" + struct.pack(">H", len(n)) + n for n in names)


def jar(text: str) -> bytes:
    return _zipped({"META-INF/MANIFEST.MF": "Name: " + text, "a/B.class": java_class(text), "icon.png": b"\x89PNG"})


def tar_of(text: str, mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=f"w:{mode}") as t:
        for name, data in (("d/a.txt", text.encode()), ("../out.txt", b"never"), ("n.zip", _zipped({"in.md": text}))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def locked_zip(text: str) -> bytes:
    raw = bytearray(_zipped({"a.txt": text}))
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the flag that says encrypted, in both headers
        raw[raw.index(mark) + at] |= 1
    return bytes(raw)


def made(texts: DataFrame, name: str, writer: Callable[[str], bytes]) -> DataFrame:
    """``id, text`` -> rows of the files that ``writer`` makes of the texts, read again: ``id, path, text, error``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in extract.slices(batch.column(1)):
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([writer(x) for x in part.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    named = texts.where("text is not null").select(F.concat(F.col("id").cast("string"), F.lit("/" + name)).alias("path"), "text")
    files = named.select("path", F.encode("text", "utf-8").alias("content")) if writer is None else named.mapInArrow(write, "path string, content binary")
    return extract.extracted(files).select(F.substring_index("path", "/", 1).cast("long").alias("id"), F.expr("substring(path, instr(path, '/') + 1)").alias("path"), "text", "error")


def _documents(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), "text")


def _parts(t, text: Column | str = "p_name") -> DataFrame:
    """Over all cores, where the scan of a small file brings its rows in a few tasks: making a file of a row costs much more than its way there."""
    rows = t("part").select(F.col("p_partkey").alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")


def _hashes(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), F.sha2("text", 256).alias("h"))


@query("S4_code_files", "SELECT p_partkey AS id, p_partkey % 3 = 0 AS code FROM part")
def _(spark, t):
    from ..sources.files import is_code_file

    name = F.concat(F.lit("a/f"), F.col("p_partkey").cast("string"), F.element_at(F.array(F.lit(".go"), F.lit(".md"), F.lit(".txt")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return t("part").select(F.col("p_partkey").alias("id"), is_code_file(name).alias("code"))


@query("S6_plain_text", f"SELECT doc_id, sha256({_NORM.format(x='text')}) AS h, '' AS error FROM documents WHERE text IS NOT NULL UNION ALL SELECT -p_partkey, sha256(''), 'not_text' FROM part")
def _(spark, t):
    plain = made(_documents(t), "a.txt", str.encode)
    binary = made(_parts(t).withColumn("id", -F.col("id")), "b.txt", lambda x: x.encode() + b"\0")
    return plain.unionByName(binary).select(F.col("id").alias("doc_id"), F.sha2("text", 256).alias("h"), "error")


@query("S9_pdf_outcomes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'encrypted' ELSE 'unsupported' END AS error FROM part")
def _(spark, t):
    text = F.concat(F.lit("%PDF-1.7 "), F.when(F.col("p_partkey") % 2 == 0, "trailer << /Encrypt 5 0 R >>").otherwise("trailer << >>"))
    return made(_parts(t, text), "a.pdf", str.encode).select("id", "error")


@query("S10_docx", _TEXT)
def _(spark, t):
    return _hashes(made(_documents(t), "a.docx", docx))


@query("S11_xlsx", "SELECT p_partkey AS id, '# Words' || chr(10) || replace(p_name, ' ', chr(9)) || chr(10) || len(string_split(p_name, ' ')) AS text FROM part")
def _(spark, t):
    return made(_parts(t), "a.xlsx", sheet).select("id", "text")


@query("S12_pptx", _TEXT)
def _(spark, t):
    return _hashes(made(_documents(t), "a.pptx", pptx))


@query("S12_odt", _TEXT)
def _(spark, t):
    return _hashes(made(_documents(t), "a.odt", odt))


@query("S12_notebook", f"SELECT doc_id, sha256({_NORM.format(x='text || chr(10) || chr(10) || ' + chr(39) + 'print(1)' + chr(39))}) AS h FROM documents WHERE text IS NOT NULL")
def _(spark, t):
    return _hashes(made(_documents(t), "a.ipynb", notebook))


@query("S12_epub", "SELECT p_partkey AS id, p_name || chr(10) || chr(10) || 'second' AS text FROM part")
def _(spark, t):
    return made(_parts(t), "a.epub", epub).select("id", "text")


@query("S12_rtf", "SELECT p_partkey AS id, replace(p_name, ' ', chr(10)) || chr(9) || 'end é' AS text FROM part")
def _(spark, t):
    return made(_parts(t), "a.rtf", rich_text).select("id", "text")


@query("S13_mail", f"SELECT doc_id, sha256({_NORM.format(x=chr(39) + 'From: a@example.com' + chr(39) + ' || chr(10) || ' + chr(39) + 'To: b@example.com' + chr(39) + ' || chr(10) || ' + chr(39) + 'Subject: a subject' + chr(39) + ' || chr(10) || chr(10) || text')}) AS h FROM documents WHERE text IS NOT NULL")
def _(spark, t):
    return _hashes(made(_documents(t), "a.eml", mail))


@query("S14_jar", """SELECT p_partkey AS id, 'a.jar!META-INF/MANIFEST.MF' AS path, 'Name: ' || p_name AS text FROM part
 UNION ALL SELECT p_partkey, 'a.jar!a/B.class', array_to_string(list_filter(string_split(p_name, ' '), lambda x, i: length(x) >= 3 AND list_position(string_split(p_name, ' '), x) = i), chr(10)) FROM part""")
def _(spark, t):
    return made(_parts(t), "a.jar", jar).select("id", "path", "text")


@query("S15_archives", f"""WITH f AS (SELECT unnest(['a.tar.gz', 'a.tar.bz2', 'a.tar']) AS f), e AS (SELECT f || '!' || e AS path FROM f, (SELECT unnest(['d/a.txt', 'n.zip!in.md']) AS e))
 SELECT doc_id AS id, path, sha256({_NORM.format(x='text')}) AS h FROM documents, e WHERE text IS NOT NULL""")
def _(spark, t):
    kinds = {"a.tar.gz": lambda x: tar_of(x, "gz"), "a.tar.bz2": lambda x: tar_of(x, "bz2"), "a.tar": lambda x: tar_of(x, "")}
    parts = [made(_documents(t), name, writer) for name, writer in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "path", F.sha2("text", 256).alias("h"))


@query("S15_single_files", f"SELECT doc_id AS id, path, sha256({_NORM.format(x='text')}) AS h FROM documents, (SELECT unnest(['b.txt.gz!b.txt', 'b.txt.bz2!b.txt', 'b.zip!c/d.txt']) AS path) WHERE text IS NOT NULL")
def _(spark, t):
    kinds = {"b.txt.gz": lambda x: gzip.compress(x.encode(), 1), "b.txt.bz2": lambda x: bz2.compress(x.encode(), 1), "b.zip": lambda x: _zipped({"c/d.txt": x})}
    parts = [made(_documents(t), name, writer) for name, writer in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "path", F.sha2("text", 256).alias("h"))


@query("S16_lockfiles", """SELECT id, path, text FROM (SELECT p_partkey AS id, 'part-' || p_partkey || '@1.' || p_size || chr(10) || 'other@2.0.0' AS n, 'example.com/m' || p_partkey || '@v1.' || p_size || '.0' AS g FROM part) x,
 LATERAL (SELECT 'package-lock.json' AS path, n AS text UNION ALL SELECT 'Cargo.lock', n UNION ALL SELECT 'poetry.lock', n UNION ALL SELECT 'Gemfile.lock', n UNION ALL SELECT 'go.sum', g) f""")
def _(spark, t):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    pairs = [(F.concat(F.lit("part-"), k), F.concat(F.lit("1."), size)), (F.lit("other"), F.lit("2.0.0"))]
    joined = lambda make: F.concat(*[make(n, v) for n, v in pairs])
    toml = joined(lambda n, v: F.concat(F.lit('[[package]]\nname = "'), n, F.lit('"\nversion = "'), v, F.lit('"\n\n')))
    npm = F.concat(F.lit('{"packages": ['), F.concat_ws(", ", *[F.concat(F.lit('{"name": "'), n, F.lit('", "version": "'), v, F.lit('"}')) for n, v in pairs]), F.lit("]}"))
    gem = F.concat(F.lit("GEM\n  specs:\n"), joined(lambda n, v: F.concat(F.lit("    "), n, F.lit(" ("), v, F.lit(")\n"))))
    go = F.concat(F.lit("example.com/m"), k, F.lit(" v1."), size, F.lit(".0 h1:abc=\nexample.com/m"), k, F.lit(" v1."), size, F.lit(".0/go.mod h1:def=\n"))
    parts = [made(_parts(t, text), name, str.encode) for name, text in (("package-lock.json", npm), ("Cargo.lock", toml), ("poetry.lock", toml), ("Gemfile.lock", gem), ("go.sum", go))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "path", "text")


@query("S17_openapi", """SELECT id, path, text FROM (SELECT p_partkey AS id, 'Title: ' || p_name || chr(10) || 'Version: 1.' || p_size || chr(10) || 'Endpoints:' || chr(10) || 'GET /parts/' || p_partkey || chr(10) || 'POST /parts/' || p_partkey AS text FROM part), (SELECT unnest(['api.json', 'api.yaml']) AS path)""")
def _(spark, t):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    js = F.concat(F.lit('{"openapi": "3.0.0", "info": {"title": "'), F.col("p_name"), F.lit('", "version": "1.'), size, F.lit('"}, "paths": {"/parts/'), k, F.lit('": {"get": {}, "post": {}, "parameters": []}}}'))
    yaml = F.concat(F.lit("openapi: 3.0.0\ninfo:\n  title: "), F.col("p_name"), F.lit("\n  version: '1."), size, F.lit("'\npaths:\n  /parts/"), k, F.lit(":\n    get:\n      summary: x\n    post:\n      summary: y\n"))
    return made(_parts(t, js), "api.json", str.encode).unionByName(made(_parts(t, yaml), "api.yaml", str.encode)).select("id", "path", "text")


@query("S18_build_files", """SELECT p_partkey AS id, 'Makefile' AS path, 'Targets: build, t' || p_partkey || chr(10) || 'build: t' || p_partkey || chr(10) || chr(9) || 'run' || chr(10) || 't' || p_partkey || ':' || chr(10) AS text FROM part
 UNION ALL SELECT p_partkey, 'Dockerfile', 'Stages: base' || p_partkey || ' AS b' || chr(10) || 'Ports: 80' || chr(10) || 'FROM base' || p_partkey || ' AS b' || chr(10) || 'EXPOSE 80' FROM part""")
def _(spark, t):
    k = F.col("p_partkey").cast("string")
    make = F.concat(F.lit("build: t"), k, F.lit("\n\trun\nt"), k, F.lit(":\n"))
    docker = F.concat(F.lit("FROM base"), k, F.lit(" AS b\nEXPOSE 80"))
    return made(_parts(t, make), "Makefile", str.encode).unionByName(made(_parts(t, docker), "Dockerfile", str.encode)).select("id", "path", "text")


@query("S19_rst", "SELECT p_partkey AS id, p_name || chr(10) || 'see ' || p_type AS text FROM part")
def _(spark, t):
    text = F.concat(F.col("p_name"), F.lit("\n=====\n.. image:: x.png\n   :width: 3\n\nsee :ref:`"), F.col("p_type"), F.lit("`\n"))
    return made(_parts(t, text), "a.rst", str.encode).select("id", "text")


@query("S20_legacy_office", "SELECT p_partkey AS id, '' AS text, 'unsupported' AS error FROM part")
def _(spark, t):
    return made(_parts(t), "a.doc", str.encode).select("id", "text", "error")


@query("S21_encrypted", "SELECT p_partkey AS id, path, 'encrypted' AS error FROM part, (SELECT unnest(['a.zip', 'a.docx', 'b.xlsx']) AS path)")
def _(spark, t):
    container = lambda x: b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + x.encode()  # noqa: E731  how encrypted Office files begin
    kinds = [made(_parts(t), "a.zip", locked_zip), made(_parts(t), "a.docx", locked_zip), made(_parts(t), "b.xlsx", container)]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where(extract.can_be_encrypted(F.col("path"))).select("id", "path", "error")

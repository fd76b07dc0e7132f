import io
import json
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import imports
from sieveline.functions.scalars import classify_query, clean_path, is_sensitive, search_words
from sieveline.functions.symbols import symbols_of
from sieveline.operators import codeintel
from sieveline.sources import chunking, extract, files

GO = b"package main\n\nfunc A() {\n\treturn\n}\n\nfunc B() {}\n"


def test_code_chunks_by_blank_lines():
    assert [(a, b) for _, a, b in chunking.code_chunks(GO, 4000)] == [(1, 1), (3, 5), (7, 7)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n日", max_size=400), st.integers(20, 200), st.sampled_from([".go", ".md", ".txt", ".py"]))
def test_chunks_are_bounded_and_ordered(text, budget, ext):
    raw = text.encode()
    found = chunking.chunk_file("x" + ext, raw, budget)
    lines = [a for _, a, _ in found]
    assert all(len(c.encode()) <= budget and 1 <= a <= b for c, a, b in found) and lines == sorted(lines)


def test_symbol_chunks_name_their_symbol():
    found = chunking.symbol_chunks("a.py", b"import os\n\n\ndef f():\n    return 1\n\n\nclass C:\n    x = 1\n", 4000)
    assert [c.split("\n")[0] for c, _, _ in found] == ["import os", "[function] f", "[class] C"]


def test_symbols_of_several_languages():
    assert [s[0] for s in symbols_of("a.go", GO.decode())] == ["A", "B"]
    assert ("f", "function", 1, 3) in symbols_of("a.ts", "export function f() {\n  return 1\n}\n")
    assert [s[0] for s in symbols_of("A.java", "public class A {\n  public int size() { return 1; }\n}\n")] == ["A", "size"]
    assert symbols_of("bad.py", "def (") == []


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_query_kinds(spark):
    q = lambda x: one(spark, classify_query(F.col("q")), q=x)
    assert [q(x) for x in ("", '"a b"', "a/b", "a b", "a.b_c", "1a")] == ["unknown", "exact", "path", "natural_language", "identifier", "natural_language"]


def test_search_words(spark):
    assert one(spark, search_words(F.col("q")), q="if Foo foo é éé bar " + "x" * 300) == ["Foo", "éé", "bar"]


def test_paths(spark):
    assert [one(spark, clean_path(F.col("p")), p=x) for x in ("a/./b/../c", "../x", "/../x", "a/..")] == ["a/c", "../x", "/x", "."]
    assert [one(spark, is_sensitive(F.col("p")), p=x) for x in ("src/api_key.go", "src/keyboard.go", "x.PEM")] == [True, False, True]
    assert [one(spark, files.should_index(F.col("p")), p=x) for x in ("a/b.go", "vendor/b.go", "Makefile", "x.png", "README")] == [True, False, True, False, False]


def test_imports(spark):
    def of(path, text, module=""):
        return one(spark, imports.imports_of(F.col("p"), F.col("t"), F.lit(module)), p=path, t=text)

    assert of("a/a.go", 'package a\nimport (\n\t"fmt"\n\tj "m/jwt"\n\t. "m/dot"\n\t"m/log"\n)\nvar s = "m/no"\n', "m") == ["jwt/", "log/"]
    assert of("A.java", "import com.foo.Bar;\nimport java.util.List;\nimport static com.baz.Qux.*;") == ["com/foo/", "com/baz/"]
    assert of("src/x.ts", "import a from './b';\nconst c = require('../d');\nimport('@/e/f');\nimport x from 'react'") == ["src/b/", "d/", "e/"]
    assert of("x.py", "import os\nfrom app.db import x\nfrom json import y\n") == ["app/db/"]
    assert of("x.c", '#include "lib/a.h"\n#include <sys/b.h>\n#include "c.h"') == ["lib/"]
    assert of("lib/x.rb", "require_relative 'y/z'\nrequire 'json'") == ["lib/y/"]
    assert of("X.cs", "using System.IO;\nusing App.Core;") == ["App/Core/"]
    assert of("README.md", "[a](docs/a.md) [b](https://x.y) [c](#d) [e](f.md)") == ["docs/"]


def test_licenses(spark):
    of = lambda p, t: one(spark, codeintel.detect_license(F.col("p"), F.col("t")), p=p, t=t)
    assert of("LICENSE", "Apache License, Version 2.0").spdx_id == "Apache-2.0"
    assert tuple(of("a.go", "// SPDX-License-Identifier: MIT\n")) == ("MIT", 0.95, "header")
    assert of("a.go", "package a\n# MIT License").source == "declared"
    assert of("a.go", "package a") is None


def test_manifests(spark):
    of = lambda p, t: [(d.name, d.constraint_text, d.resolved_version, d.scope) for d in one(spark, codeintel.manifest_dependencies(F.col("p"), F.col("t")), p=p, t=t)]
    assert of("go.mod", "module m\nrequire (\n\tx.y/z v1.2.0\n\ta.b/c v0.1.0 // indirect\n)\nrequire q.r/s v2.0.0\n") == [("x.y/z", "v1.2.0", "", "direct"), ("a.b/c", "v0.1.0", "", "direct"), ("q.r/s", "v2.0.0", "", "direct")]
    assert of("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>") == [("g:a", "1", "", "compile")]
    assert of("build.gradle", "implementation 'g:a:1.0'\nassert 'x'") == [("g:a", "1.0", "", "implementation")]
    assert of("Podfile", "pod 'A', '~> 1'\n") == [("A", "~> 1", "", "runtime")]
    assert of("Podfile.lock", "  - A (1.2)\n") == [("A", "", "1.2", "resolved")]
    assert of("Package.swift", '.package(url: "https://h/x/Lib.git", from: "1.0.0")') == [("Lib", "1.0.0", "", "runtime")]
    assert of("Package.resolved", json.dumps({"pins": [{"identity": "lib", "location": "u", "state": {"version": "3"}}]})) == [("lib", "", "3", "resolved")]


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_txt", ".txt"), text)
    return out.getvalue()


def test_extraction():
    text = lambda p, raw: extract.extract_all(p, raw)[0][1]
    assert text("a.html", b"<head><title>x</title></head><p>A &amp; B</p><script>y</script><p>C</p>") == "A & B\nC"
    assert text("a.docx", zipped(word__document_xml="<w><p><t>Hello</t></p><p><t>you</t></p></w>")) == "Hello\nyou"
    assert text("a.ipynb", json.dumps({"cells": [{"source": ["a\n", "b"]}]}).encode()) == "a\nb"
    assert text("a.rtf", rb"{\rtf1{\fonttbl x}Hi \b there\par you}") == "Hi there\nyou"
    assert text("a.eml", b"From: a@b.c\nSubject: S\n\nBody\n") == "From: a@b.c\nSubject: S\n\nBody"
    assert text("go.sum", b"x.y/z v1.0.0 h1:abc=\nx.y/z v1.0.0/go.mod h1:d=\n") == "x.y/z@v1.0.0"
    assert text("api.json", json.dumps({"openapi": "3", "info": {"title": "T", "version": "1"}, "paths": {"/a": {"get": {}}}}).encode()) == "Title: T\nVersion: 1\nEndpoints:\nGET /a"
    assert text("a.proto", b"message M {}\n").startswith("Messages: M\n")
    assert extract.extract_all("a.pdf", b"%PDF /Encrypt")[0][2] == "encrypted"
    assert extract.extract_all("a.bin", b"\0x")[0][2] == "not_text"
    assert extract.extract_all("a.docx", b"broken")[0][2]
    assert extract.extract_all("z.zip", zipped(a_txt="one", d__b_txt="two")) == [("z.zip!a.txt", "one", ""), ("z.zip!d/b.txt", "two", "")]
    assert extract.decode_text("é".encode("cp1252")) == "é"


def test_scan_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.go").write_text("package a")
    (tmp_path / "a" / "y.png").write_text("no")
    got = files.scan_files(spark, str(tmp_path)).select("path").collect()
    assert [r.path for r in got] == ["a/x.go"]

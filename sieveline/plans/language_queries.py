"""Import edges by language (G2-G10), symbols at places, resolvers, catalogs and bills of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import imports
from ..functions.scalars import branch_tracking
from ..operators import codeintel
from .registry import query
from .tables import EDGES_SQL, edges

_K = "p_partkey"


def _key() -> Column:
    return F.col(_K).cast("string")


def _text(*pieces: str) -> Column:
    """Pieces of text around the part's key."""
    out = [F.lit(pieces[0])]
    for p in pieces[1:]:
        out += [_key(), F.lit(p)]
    return F.concat(*out)


def _listed(t, found: Column) -> DataFrame:
    return t("part").select(F.col(_K).alias("id"), F.array_join(found, ",").alias("dirs"))


def _sql(*dirs: str) -> str:
    """What is expected of each part, ``{k}`` being its key."""
    return "SELECT p_partkey AS id, replace('" + ",".join(dirs) + "', '{k}', CAST(p_partkey AS VARCHAR)) AS dirs FROM part"


@query("G2_go_imports", _sql("pkg{k}/sub/", "util/"))
def _(spark, t):
    code = _text('package a\n\n// import "no/no"\nimport (\n\t"fmt"\n\talias "example.com/m/pkg', '/sub"\n\t. "example.com/m/dot"\n)\nimport "example.com/m/util"\nfunc F', '() {}\nvar s = `import "late/late"`\n')
    return _listed(t, imports.go_imports(code, F.lit("example.com/m")))


@query("G3_java_imports", _sql("org/acme/p{k}/", "org/acme/q{k}/"))
def _(spark, t):
    return _listed(t, imports.java_imports(_text("package x;\nimport java.util.List;\nimport org.acme.p", ".Thing;\nimport static org.acme.q", ".Other.*;\n")))


@query("G4_script_imports", _sql("src/lib/a{k}/", "src/web/b{k}/", "shared/", "src/c/"))
def _(spark, t):
    code = _text("import x from '../lib/a", "'\nimport {y} from \"./b", "\"\nimport 'react'\nconst z = require('../c')\nimport q from '@/shared/deep'\n")
    return _listed(t, imports.script_imports(F.lit("src/web/page.ts"), code))


@query("G5_python_imports", _sql("app/mod{k}/", "tools/"))
def _(spark, t):
    return _listed(t, imports.python_imports(_text("import tools\nfrom app.mod", " import x\nimport late\nfrom json import loads\n")))


@query("G6_rust_imports", _sql("net/h{k}/", "other/", "serde/"))
def _(spark, t):
    return _listed(t, imports.rust_imports(_text("use std::fmt;\nuse crate::net::h", ";\nuse other::{a, b};\nextern crate serde;\n")))


@query("G7_c_imports", _sql("lib{k}/inner/", "deep/"))
def _(spark, t):
    return _listed(t, imports.c_imports(_text('#include <stdio.h>\n#include "plain.h"\n#include "lib', '/inner/a.h"\n#include "x/../deep/b.h"\n')))


@query("G8_ruby_imports", _sql("app/models/m{k}/", "lib/"))
def _(spark, t):
    return _listed(t, imports.ruby_imports(F.lit("app/models/user.rb"), _text("require 'json'\nrequire_relative 'm", "/thing'\nrequire '../../lib/tool'\n")))


@query("G9_csharp_imports", _sql("Acme/P{k}/", "Other/"))
def _(spark, t):
    return _listed(t, imports.csharp_imports(_text("using System;\nusing Acme.P", ";\n  using Other;\nusing (var x = y) {}\n")))


@query("G10_markdown_links", _sql("docs/d{k}/", "img/"))
def _(spark, t):
    return _listed(t, imports.markdown_imports(_text("[a](docs/d", "/x.md) [b](https://example.com/p/q) [c](#here) [d](same.md) ![e]( img/f.png )")))


@query("E2_explain", f"""WITH {EDGES_SQL}, f AS (SELECT DISTINCT source_file AS path FROM edges), d AS (SELECT path, regexp_replace(path, '[^/]*$', '') AS dir FROM f),
 i AS (SELECT source_file AS path, string_agg(target_file, ',' ORDER BY target_file) AS imports FROM edges GROUP BY 1), c AS (SELECT target_file AS dir, count(*) AS importers FROM edges GROUP BY 1)
 SELECT path, 7 AS line, 'Run' AS name, rtrim(dir, '/') || '.Run' AS display, imports, coalesce(importers, 0) AS importers, path || '_test.go' AS tests FROM d JOIN i USING (path) LEFT JOIN c USING (dir)""")
def _(spark, t):
    e = edges(t)
    f = e.select(F.col("source_file").alias("path")).distinct()
    symbols = f.select("path", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for n, a, b in (("Init", 1, 4), ("Run", 5, 9), ("Stop", 10, 12))])).alias("s")).select("path", "s.*")
    tests = f.select(F.concat("path", F.lit("_test.go")).alias("path"), F.lit("").alias("content"))
    # a test of each file mentions a name of its own, so the join below is by name and file
    named = symbols.withColumn("name", F.when(F.col("name") == "Run", F.concat(F.lit("Run"), F.regexp_replace("path", r"\W", "_"))).otherwise(F.col("name")))
    tests = tests.withColumn("content", F.concat(F.lit("call Run"), F.regexp_replace(F.regexp_replace("path", "_test.go$", ""), r"\W", "_"), F.lit("()")))
    out = codeintel.explain(f.select("path", F.lit(7).alias("line")), named, e, tests)
    own = F.regexp_replace("name", "^Run.*", "Run")
    return out.select("path", "line", own.alias("name"), F.regexp_replace("display", r"\.Run.*", ".Run").alias("display"), F.array_join("imports", ",").alias("imports"), F.coalesce(F.size("importers"), F.lit(0)).cast("long").alias("importers"), F.array_join("tests", ",").alias("tests"))


@query("E8_resolver_output", """SELECT p_partkey AS id, kind, CASE kind WHEN 'go' THEN 'example.com/a' || p_partkey || '@v1.2.0,example.com/b@v0.1.0' WHEN 'maven' THEN 'org.a:a' || p_partkey || '@1.0,org.b:b@2.0'
 ELSE 'org.g:g' || p_partkey || '@2.1,org.h:h@3.0' END AS found FROM part, (SELECT unnest(['go', 'maven', 'gradle']) AS kind)""")
def _(spark, t):
    printed = {
        "go": _text("example.com/main\nexample.com/a", " v1.2.0\nexample.com/b v0.1.0\n"),
        "maven": _text("[INFO] x:main:jar:1\n[INFO] +- org.a:a", ":jar:1.0:compile\n[INFO] \\- org.b:b:jar:tests:2.0:test\n"),
        "gradle": _text("runtimeClasspath\n+--- org.g:g", ":2.0 -> 2.1\n\\--- org.h:h:3.0\n"),
    }
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("text")) for k, x in printed.items()]))
    rows = t("part").select(F.col(_K).alias("id"), kinds.alias("r")).select("id", "r.*")
    return rows.select("id", "kind", F.array_join(codeintel.resolver_output(F.col("kind"), F.col("text")), ",").alias("found"))


@query("E9_replace_dependencies", """SELECT 1 AS tenant_id, l_suppkey AS project_id, 'part-' || l_partkey AS name, 'old' AS version FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_suppkey % 3 <> 0
 UNION ALL SELECT 1, s_suppkey, 'only', 'new' FROM supplier WHERE s_suppkey % 3 = 0""")
def _(spark, t):
    old = t("lineitem").select(F.lit(1).alias("tenant_id"), F.col("l_suppkey").alias("project_id"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"), F.lit("old").alias("version")).distinct()
    new = t("supplier").where("s_suppkey % 3 = 0").select(F.lit(1).alias("tenant_id"), F.col("s_suppkey").alias("project_id"), F.lit("only").alias("name"), F.lit("new").alias("version"))
    return codeintel.replace_dependencies(old, new)


_COMPONENTS = f"WITH {EDGES_SQL}, c AS (SELECT DISTINCT rtrim(target_file, '/') AS name, '' AS version FROM edges UNION ALL SELECT 'main/module', '1.0')"


def _components(t):
    e = edges(t)
    none = e.select(F.col("target_file").alias("name"), F.lit("").alias("version")).limit(0)
    return codeintel.sbom_components(e, none, "main/module", "1.0")


@query("E11_cyclonedx", _COMPONENTS + """ SELECT '{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":[' || string_agg('{"type":"library","name":"' || name || '","version":"' || version || '"}', ',' ORDER BY name) || ']}' AS document FROM c""")
def _(spark, t):
    return codeintel.cyclonedx(_components(t))


@query("E11_spdx", _COMPONENTS + """ SELECT count(*) AS packages, string_agg('SPDXRef-' || replace(name, '/', '-') || '=' || name || '@' || version, ',' ORDER BY name) AS listed, 'SPDX-2.3' AS spdx FROM c""")
def _(spark, t):
    doc = codeintel.spdx(_components(t), "a project").select(F.from_json("document", "spdxVersion string, packages array<struct<SPDXID:string,name:string,versionInfo:string>>").alias("d"))
    listed = F.array_join(F.transform("d.packages", lambda p: F.concat(p["SPDXID"], F.lit("="), p["name"], F.lit("@"), p["versionInfo"])), ",")
    return doc.select(F.size("d.packages").cast("long").alias("packages"), listed.alias("listed"), F.col("d.spdxVersion").alias("spdx"))


@query("A12_dead_code_stats", f"""WITH {EDGES_SQL}, f AS (SELECT DISTINCT source_file AS path, length(source_file) % 2 = 0 AS shown FROM edges WHERE regexp_replace(source_file, '[^/]*$', '') NOT IN (SELECT target_file FROM edges WHERE target_file < 'pkg3/'))
 SELECT count(*) AS total, count(*) FILTER (WHERE NOT shown) AS confirmed, count(*) FILTER (WHERE shown) AS public_api FROM f""")
def _(spark, t):
    e = edges(t)
    s = e.select(F.col("source_file").alias("path")).distinct().select("path", F.when(F.length("path") % 2 == 0, "Run").otherwise("run").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"))
    return codeintel.dead_code_stats(codeintel.dead_code(s, e.where("target_file < 'pkg3/'")))


@query("F19_branch_tracking", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_custkey END AS ahead, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey + 2 END AS behind FROM orders")
def _(spark, t):
    a, b = F.concat(F.lit("ahead "), F.col("o_custkey").cast("string")), F.concat(F.lit("behind "), (F.col("o_custkey") + 2).cast("string"))
    kind = F.col("o_orderkey") % 3
    line = F.concat(F.lit("main origin/main ["), F.when(kind == 0, a).when(kind == 1, b).otherwise(F.concat(a, F.lit(", "), b)), F.lit("]"))
    return t("orders").select(F.col("o_orderkey").alias("id"), branch_tracking(line).alias("b")).select("id", F.col("b.ahead").cast("long").alias("ahead"), F.col("b.behind").cast("long").alias("behind"))

"""Code intelligence and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, dirname, normalize_dependency, trim_space
from .graph import importless_files

# Licence texts, the first found counts.
LICENSE_TEXTS = [
    ("Apache-2.0", "apache license, version 2.0"),
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("GPL-2.0-only", "gnu general public license, version 2"),
    ("GPL-3.0-only", "gnu general public license, version 3"),
    ("LGPL-2.1-only", "gnu lesser general public license, version 2.1"),
    ("LGPL-3.0-only", "gnu lesser general public license, version 3"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms, with or without modification"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms, with or without"),
    ("MPL-2.0", "mozilla public license, version 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Zlib", "this software is provided 'as-is', without any express or implied warranty"),
    ("ISC", "isc license"),
    ("PostgreSQL", "postgresql license"),
    ("AGPL-3.0-only", "gnu affero general public license, version 3"),
    ("EUPL-1.2", "european union public licence"),
    ("0BSD", "zero-clause bsd"),
]
# Declarations at a line's start, and how sure they are.
LICENSE_LINES = [
    (r"(?i)^\s*[#*/\-\s]*MIT\s+License", "MIT", 0.6),
    (r"(?i)^\s*[#*/\-\s]*Apache\s+License\b", "Apache-2.0", 0.6),
    (r"(?i)^\s*[#*/\-\s]*Licensed under the Apache License, Version 2.0", "Apache-2.0", 0.7),
    (r"(?i)^\s*[#*/\-\s]*GNU (Lesser )?General Public License", "GPL-3.0-only", 0.5),
    (r"(?i)^\s*[#*/\-\s]*BSD [23]-Clause", "BSD-3-Clause", 0.6),
]
PERMISSIVE = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "0BSD", "Zlib", "PostgreSQL", "CC0-1.0", "CC-BY-4.0"]


def detect_license(path: Column, content: Column) -> Column:
    """E5: struct(spdx_id, confidence, source), null if none: licence files by their text, then headers, then declared lines of the first 30."""

    def info(spdx, confidence, source: str) -> Column:
        spdx = spdx if isinstance(spdx, Column) else F.lit(spdx)
        return F.struct(spdx.alias("spdx_id"), F.lit(confidence).cast("double").alias("confidence"), F.lit(source).alias("source"))

    name, low = F.lower(basename(path)), F.lower(content)
    is_file = name.rlike(r"^(?:license|copying|copying\.lib|licen[cs]e[.-].*)$")
    by_text = F.coalesce(*[F.when(low.contains(text), info(spdx, 0.9 if len(text) > 80 else 0.7, "filename")) for spdx, text in LICENSE_TEXTS])
    head = F.slice(F.split(content, "\r?\n"), 1, 30)
    header = F.try_element_at(F.filter(F.transform(head, lambda x: F.regexp_extract(x, r"(?i)SPDX-License-Identifier:\s*([\w.-]+)", 1)), lambda x: x != ""), F.lit(1))
    declared = F.transform(head, lambda x: F.coalesce(*[F.when(x.rlike(p), info(spdx, score, "declared")) for p, spdx, score in LICENSE_LINES]))
    return F.coalesce(F.when(is_file, by_text), F.when(header.isNotNull(), info(header, 0.95, "header")), F.try_element_at(F.filter(declared, lambda x: x.isNotNull()), F.lit(1)))


def is_permissive(spdx: Column) -> Column:
    """E6."""
    return spdx.isin(PERMISSIVE)


def declarations(files: DataFrame) -> DataFrame:
    """Declarations by line, ``path, key, kind, name, line, signature``; the last of a key counts."""
    line = trim_space(F.col("raw"))
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "raw")).select("path", (F.col("at") + 1).alias("line"), line.alias("signature"))
    func = F.regexp_extract("signature", r"^func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", 1)
    kind = F.regexp_extract("signature", r"^type\s+(\w+)\s", 1)
    value = F.regexp_extract("signature", r"^(?:const|var)\s+(\w+)", 1)
    named = rows.withColumns({"kind": F.when(func != "", "func").when(kind != "", "type").when(value != "", F.substring_index("signature", " ", 1)), "name": F.when(func != "", func).when(kind != "", kind).otherwise(value)})
    named = named.where("kind is not null").withColumn("key", F.concat_ws(":", "kind", "name"))
    return named.groupBy("path", "key").agg(*[F.max_by(c, "line").alias(c) for c in ("kind", "name", "signature")], F.max("line").alias("line"))


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, key, change`` (new, removed, changed) between two sets of ``path, content``."""
    a = declarations(old).select("path", "key", F.col("signature").alias("s1"))
    b = declarations(new).select("path", "key", F.col("signature").alias("s2"))
    change = F.when(F.col("s1").isNull(), "new").when(F.col("s2").isNull(), "removed").when(F.col("s1") != F.col("s2"), "changed")
    return a.join(b, ["path", "key"], "full").withColumn("change", change).where("change is not null").select("path", "key", "change", F.col("s1").alias("old_signature"), F.col("s2").alias("new_signature"))


def dead_code(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols of files whose directory nothing imports: exported ones may be an interface, the others are dead."""
    exported = F.col("name").rlike(r"^\p{Lu}")
    return importless_files(symbols, edges).select("path", "name", "kind", "start_line", F.when(exported, "public-api").otherwise("confirmed").alias("confidence"))


def dead_code_stats(found: DataFrame) -> DataFrame:
    """A12."""
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("confidence") == "confirmed").alias("confirmed"), F.count_if(F.col("confidence") == "public-api").alias("public_api"))


def symbol_at(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each ``path, line`` the symbol whose lines hold it, else the nearest that starts above, else the file's first.

    Of symbols on equal lines only the first by name can be the answer, so only that one meets the places.
    """
    w = Window.partitionBy("path", "start_line", "end_line").orderBy("name")
    j = places.join(symbols.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), "path")
    holds = (F.col("start_line") <= F.col("line")) & (F.col("end_line") >= F.col("line"))
    above = F.col("start_line") <= F.col("line")
    order = [holds.desc(), above.desc(), F.when(above, -F.col("start_line")).otherwise(F.col("start_line")), F.col("name")]
    w = Window.partitionBy("path", "line").orderBy(*order)
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def explain(place: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """A place's symbol with what its file imports, who imports its directory, and tests that mention it."""
    at = symbol_at(place, symbols)
    imports = edges.groupBy(F.col("source_file").alias("path")).agg(F.sort_array(F.collect_set("target_file")).alias("imports"))
    importers = edges.groupBy(F.col("target_file").alias("_dir")).agg(F.sort_array(F.collect_set("source_file")).alias("importers"))
    tests = files.where(F.lower("path").rlike(r"(_test\.|test_|\.test\.|\.spec\.|/tests?/)")).select(F.col("path").alias("test"), "content")
    named = at.select("path", "line", "name").distinct()
    words = tests.select("test", F.explode(F.array_distinct(F.split("content", r"\W+"))).alias("name"))
    said = named.join(words, "name").groupBy("path", "line").agg(F.sort_array(F.collect_set("test")).alias("tests"))
    shown = F.concat(basename(dirname(F.col("path"))), F.lit("."), F.col("name"))
    return at.withColumns({"display": shown, "_dir": F.concat(dirname(F.col("path")), F.lit("/"))}).join(imports, "path", "left").join(importers, "_dir", "left").join(said, ["path", "line"], "left").drop("_dir")


DEPENDENCY = "struct<ecosystem:string,name:string,constraint_text:string,resolved_version:string,scope:string,source:string>"


def _deps(found: Column, ecosystem: str, name, constraint, version, scope, source) -> Column:
    lit = lambda x, m: x(m) if callable(x) else F.lit(x)
    return F.transform(found, lambda m: F.struct(F.lit(ecosystem).alias("ecosystem"), lit(name, m).alias("name"), lit(constraint, m).alias("constraint_text"), lit(version, m).alias("resolved_version"), lit(scope, m).alias("scope"), lit(source, m).alias("source")))


def manifest_dependencies(path: Column, content: Column) -> Column:
    """A manifest's dependencies by its name, as regular expressions and JSON; an empty array for other files."""
    whole = lambda p: F.regexp_extract_all(content, F.lit(p), F.lit(0))
    part = lambda p, g=1: lambda m: F.regexp_extract(m, p, g)
    base = basename(path)
    bare = F.regexp_replace(content, r"//[^\n]*", "")
    go_lines = F.concat(
        F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(r"(?s)\brequire \(([^)]*)\)"), F.lit(1)), lambda b: F.split(b, "\n"))),
        F.regexp_extract_all(bare, F.lit(r"(?m)^\s*require[ \t]+([^\s(]+[ \t]+\S+)"), F.lit(1)),
    )
    go = _deps(F.filter(F.transform(go_lines, trim_space), lambda x: x.rlike(r"^\S+\s+\S+")), "go", part(r"^(\S+)"), part(r"^\S+\s+(\S+)"), "", "direct", "go modules")
    doc = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, pins array<struct<identity:string,package:string,location:string,state:struct<version:string>>>")
    entries = lambda f, scope: F.coalesce(F.transform(F.map_entries(doc[f]), lambda e: F.struct(F.lit("npm").alias("ecosystem"), F.trim(e["key"]).alias("name"), F.trim(e["value"]).alias("constraint_text"), F.lit("").alias("resolved_version"), F.lit(scope).alias("scope"), F.lit("npm manifest").alias("source"))), F.array().cast(f"array<{DEPENDENCY}>"))
    npm = F.concat(entries("dependencies", "runtime"), entries("devDependencies", "development"), entries("peerDependencies", "peer"))
    field = lambda m, f: F.regexp_extract(m, rf"(?s)<{f}>\s*([^<]+?)\s*</{f}>", 1)
    pom = F.filter(
        _deps(whole(r"(?s)<dependency>.*?</dependency>"), "maven", lambda m: F.when((field(m, "groupId") != "") & (field(m, "artifactId") != ""), F.concat(field(m, "groupId"), F.lit(":"), field(m, "artifactId"))), lambda m: field(m, "version"), "", lambda m: F.when(field(m, "scope") == "", "compile").otherwise(field(m, "scope")), "maven manifest"),
        lambda d: d["name"].isNotNull(),
    )
    gradle_re = r"\b(implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|classpath|kapt|annotationProcessor)\s*\(?\s*[\"']([^\"':]+:[^\"':]+)(?::([^\"']+))?[\"']"
    gradle = _deps(whole(gradle_re), "gradle", part(gradle_re, 2), part(gradle_re, 3), "", part(gradle_re, 1), "gradle manifest")
    swift_re = r"\.package\s*\(\s*(?:url:\s*)?[\"']([^\"']+)[\"'](?:\s*,\s*(?:from|exact|upToNextMajor|upToNextMinor):\s*[\"']([^\"']+)[\"'])?"
    swift = _deps(whole(swift_re), "swift", lambda m: F.regexp_replace(basename(F.regexp_replace(F.regexp_extract(m, swift_re, 1), r"\.git$", "")), "/$", ""), part(swift_re, 2), "", "runtime", part(swift_re, 1))
    pins = F.coalesce(F.transform(doc["pins"], lambda p: F.struct(F.lit("swift").alias("ecosystem"), F.coalesce(F.when(p["identity"] != "", p["identity"]), p["package"]).alias("name"), F.lit("").alias("constraint_text"), F.coalesce(p["state"]["version"], F.lit("")).alias("resolved_version"), F.lit("resolved").alias("scope"), F.coalesce(p["location"], F.lit("")).alias("source"))), F.array().cast(f"array<{DEPENDENCY}>"))
    pod_re = r"(?m)^\s*pod\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?"
    pods = _deps(whole(pod_re), "cocoapods", part(pod_re), part(pod_re, 2), "", "runtime", "cocoapods manifest")
    lock_re = r"(?m)^\s*-\s+([^ (]+)\s*\(([^)]+)\)"
    locked = _deps(whole(lock_re), "cocoapods", part(lock_re), "", part(lock_re, 2), "resolved", "cocoapods lockfile")
    return (
        F.when(base == "go.mod", go).when(base == "package.json", npm).when(base == "pom.xml", pom).when(base.isin("build.gradle", "build.gradle.kts"), gradle)
        .when(base == "Package.swift", swift).when(base == "Package.resolved", pins).when(base == "Podfile", pods).when(base == "Podfile.lock", locked)
        .otherwise(F.array().cast(f"array<{DEPENDENCY}>"))
    )


def catalog(files: DataFrame) -> DataFrame:
    """One row a dependency of ``path, content`` rows, with its normalised name and manifest."""
    d = files.select(F.col("path").alias("manifest"), F.explode(manifest_dependencies(F.col("path"), F.col("content"))).alias("d")).select("manifest", "d.*")
    return d.withColumns({"normalized_name": normalize_dependency(F.col("ecosystem"), F.col("name")), "direct": F.lit(True)}).where("coalesce(name, '') <> ''")


def resolver_output(kind: Column, text: Column) -> Column:
    """``name@version`` lines of a resolver's printed tree; the tools themselves are never run."""
    every = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    pair = lambda names, versions: F.zip_with(names, versions, lambda a, b: F.concat(a, F.lit("@"), b))
    go = pair(every(r"(?m)^(\S+) (v\S+)", 1), every(r"(?m)^(\S+) (v\S+)", 2))
    maven_re = r"([\w.-]+:[\w.-]+):(?:jar|war|pom|aar):(?:[\w.-]+:)?([\w.-]+):(?:compile|runtime|test|provided|system)"
    maven = pair(every(maven_re, 1), every(maven_re, 2))
    gradle_re = r"--- ([\w.-]+:[\w.-]+):(?:[\w.+-]+ -> )?([\w.+-]+)"
    gradle = pair(every(gradle_re, 1), every(gradle_re, 2))
    return F.when(kind == "go", go).when(kind == "maven", maven).when(kind == "gradle", gradle).otherwise(F.array().cast("array<string>"))


def replace_dependencies(old: DataFrame, new: DataFrame) -> DataFrame:
    """A project's rows are those of ``new`` if it has any there."""
    return old.join(new.select("tenant_id", "project_id").distinct(), ["tenant_id", "project_id"], "left_anti").unionByName(new)


def sbom_components(edges: DataFrame, versions: DataFrame, module: str, module_version: str = "") -> DataFrame:
    """``name, version``: distinct targets with the module file's versions where known, and the module itself."""
    own = edges.select(F.rtrim(F.col("target_file"), F.lit("/")).alias("name")).distinct()
    named = own.join(versions.select("name", "version"), "name", "full").select("name", F.coalesce("version", F.lit("")).alias("version"))
    head = edges.sparkSession.range(1).select(F.lit(module).alias("name"), F.lit(module_version).alias("version"))
    return head.unionByName(named.where(F.col("name") != module)).orderBy("name")


def cyclonedx(components: DataFrame) -> DataFrame:
    """One JSON document; a bounded list of components."""
    rows = F.sort_array(F.collect_list(F.struct("name", "version")))
    part = F.transform(rows, lambda c: F.struct(F.lit("library").alias("type"), c["name"].alias("name"), c["version"].alias("version")))
    return components.agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), part.alias("components"))).alias("document"))


def spdx(components: DataFrame, name: str) -> DataFrame:
    """E11."""
    rows = F.sort_array(F.collect_list(F.struct("name", "version")))
    part = F.transform(rows, lambda c: F.struct(F.concat(F.lit("SPDXRef-"), F.regexp_replace(c["name"], r"[^A-Za-z0-9.-]", "-")).alias("SPDXID"), c["name"].alias("name"), c["version"].alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation")))
    return components.agg(F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"), part.alias("packages"))).alias("document"))


#: Rules of our own for secrets; any finding makes a text sensitive.
SECRET_RULES = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "access_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "bearer_token": r"\b[Bb]earer\s+[A-Za-z0-9._~+/-]{20,}",
    "assigned_secret": r"(?i)\b(?:api[_-]?key|secret|token|passwd|password)\b\s*[:=]\s*[\"'][^\"'\s]{12,}[\"']",
    "signed_token": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
}


def secret_findings(content: Column) -> Column:
    """Names of the rules that a text matches."""
    return F.filter(F.array(*[F.when(content.rlike(p), name) for name, p in SECRET_RULES.items()]), lambda x: x.isNotNull())

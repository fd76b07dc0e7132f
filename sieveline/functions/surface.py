"""The engine's functions by name in SQL text (M10): scalar functions, a table function, an embedder.

Scalar functions are SQL functions over built-ins, so Catalyst inlines them; only the embedder
runs in Python, over Arrow batches. All are temporary functions of the session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udf import UserDefinedFunction

from ..operators.writepath import hashed_embedding

#: Name, parameters, result and body of the SQL functions.
SCALARS = [
    ("sieve_norm", "v ARRAY<FLOAT>", "DOUBLE", "sqrt(aggregate(v, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * x))"),
    ("sieve_dot", "u ARRAY<FLOAT>, v ARRAY<FLOAT>", "DOUBLE", "CASE WHEN size(u) = size(v) THEN aggregate(zip_with(u, v, (x, y) -> CAST(x AS DOUBLE) * y), CAST(0 AS DOUBLE), (a, x) -> a + x) ELSE 0 END"),
    ("sieve_cosine", "u ARRAY<FLOAT>, v ARRAY<FLOAT>", "DOUBLE", "CASE WHEN sieve_norm(u) = 0 OR sieve_norm(v) = 0 THEN 0 ELSE sieve_dot(u, v) / (sieve_norm(u) * sieve_norm(v)) END"),
    ("sieve_dirname", "path STRING", "STRING", "CASE WHEN instr(path, '/') = 0 THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END"),
    ("sieve_rrf", "place INT", "DOUBLE", "CASE WHEN place IS NULL THEN 0 ELSE 1 / (60 + place) END"),
]
TABLES = [("sieve_paragraphs", "body STRING", "TABLE(chunk_index INT, content STRING)", r"SELECT pos, p FROM (SELECT pos, regexp_replace(col, '^\\s+|\\s+$', '') AS p FROM posexplode(split(body, '\\n[ \\t\\r]*\\n'))) WHERE p <> ''")]


def embedder(model=hashed_embedding) -> UserDefinedFunction:
    """``sieve_embed``: any ``str -> list[float]``; the model is loaded once a worker."""

    @F.pandas_udf("array<float>")
    def sieve_embed(texts):
        return texts.map(model)

    return sieve_embed


def register_functions(spark: SparkSession, model=hashed_embedding) -> list[str]:
    """Names of the functions that SQL text can use from now on in this session."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("sieve_embed", embedder(model))
    return [*(s[0] for s in SCALARS), *(t[0] for t in TABLES), "sieve_embed"]

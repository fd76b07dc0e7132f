"""sieveline: hybrid retrieval, code-graph and usage analytics as Spark plans.

Modules by family: ``sources`` (scans, extraction), ``functions`` (scalar
expressions), ``operators`` (joins, ranking, graph, catalogs, evaluation),
``plans`` (whole requests), ``streaming`` (continuous forms).
"""

"""G14 walks a graph in which two hops reach every file and directory, up to the hundred that it lists."""

from pyspark.sql import functions as F

from sieveline.plans import registry


def test_expansion_reaches_the_whole_graph(spark, sf):
    got = {r.path: (r.score, r.depth) for r in registry.QUERIES["G14_expand"](spark, sf).collect()}
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    near = {f"pkg{r.l_suppkey % 40}/f{r.l_suppkey}.go" for r in li.where("l_partkey % 40 = 1").select("l_suppkey").distinct().collect()}
    dirs = {f"pkg{r.d}/" for r in li.join(li.where("l_partkey % 40 = 1").select("l_suppkey").distinct(), "l_suppkey").select((F.col("l_partkey") % 40).alias("d")).distinct().collect()} - {"pkg1/"}
    assert len(near) + len(dirs) <= 100
    assert got == {path: (0.85, 1) for path in near} | {path: (0.7225, 2) for path in dirs}
    assert len(dirs) == 39

"""files are made of a small table's rows on all cores, not in the few tasks that its scan has."""

from sieveline.plans.formats_queries import _parts


def test_a_small_table_is_dealt_over_all_cores(spark, sf):
    rows = _parts(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    held = rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert len(held) == tasks and max(held) < 3 * sum(held) / tasks

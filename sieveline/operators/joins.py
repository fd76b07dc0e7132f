"""Range joins by buckets (J11): an equality on buckets of lines instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_overlap(chunks: DataFrame, symbols: DataFrame, width: int = 64, on: str = "path") -> DataFrame:
    """Pairs whose lines overlap (``start_line, end_line`` on both sides; the symbols' as ``sym_start, sym_end``).

    Only distinct lines meet in buckets: both sides' go to every bucket they
    touch, and a pair counts only in the first bucket that both touch, so nothing
    has to be made distinct again. Rows then meet by equal lines alone, so no row
    is compared with one it doesn't overlap.
    """
    own, theirs = [on, "start_line", "end_line"], [on, "sym_start", "sym_end"]
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(a, b) / width)))
    symbols = symbols.withColumnsRenamed({"start_line": "sym_start", "end_line": "sym_end"})
    c = chunks.select(*own).distinct().withColumn("_b", spread(F.col("start_line"), F.col("end_line")))
    s = symbols.select(*theirs).distinct().withColumn("_b", spread(F.col("sym_start"), F.col("sym_end")))
    first = F.greatest(F.floor(F.col("start_line") / width), F.floor(F.col("sym_start") / width))
    touching = (F.col("sym_start") <= F.col("end_line")) & (F.col("sym_end") >= F.col("start_line")) & (F.col("_b") == first)
    lines = c.join(s, [on, "_b"]).where(touching).drop("_b")
    return chunks.join(lines, own).join(symbols, theirs)

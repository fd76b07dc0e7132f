"""Joins and frames over time: as-of joins, running frames, lags, bursts.

No key's whole history is ever one task's. Rows go to (key, time bucket) cells;
what a cell needs from before it comes either as a carry, one row a cell, or as a
copy of the few rows of the bucket before that a frame reaches.

``width`` is a bucket's length in seconds. ``bucket_width`` measures one for given
tables, so that the fullest (key, bucket) cell holds about ``most`` rows if a key's rows are
spread evenly in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a cell of the busiest key should hold.
CELL_ROWS = 200_000


def micros(ts: str | Column) -> Column:
    """A timestamp's microseconds; also takes dates and numbers of seconds."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def bucket(ts: str | Column, width: int) -> Column:
    """The number of the bucket of ``width`` seconds that a time lies in."""
    return F.floor(micros(ts) / F.lit(width * 1_000_000)).cast("long")


def bucket_width(df: DataFrame, keys: list[str], ts: str, most: int = CELL_ROWS, least: int = 60) -> int:
    """Seconds a bucket: the busiest key's rows, and its time span, by one aggregate."""
    held = df.groupBy(*keys).agg(F.count("*").alias("n"), ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("span"))
    row = held.agg(F.max("n").alias("n"), F.max_by("span", "n").alias("span")).first()
    if not row.n or not row.span:
        return max(least, 86_400)
    return int(max(least, row.span * most / row.n + 1))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], *, tie: str, strict: bool = True, width: int | None = None, suffix: str = "_asof") -> DataFrame:
    """Each left row with ``columns`` of the last right row of its keys that is earlier (``strict``) or not later.

    Both sides become one table, in which the last right row is filled forward within
    each (keys, bucket) cell; a cell that begins without one takes the carry of the
    cells before. Right rows of one time: the largest ``tie`` counts. No match: nulls.
    Left rows with a null key or time match nothing and stay. Columns come back as ``<name><suffix>``.
    """
    width = width or min(bucket_width(left, keys, ts), bucket_width(right, keys, ts))
    sound = _all_there(left, [*keys, ts])  # the others match nothing and go past the windows
    found_columns = [c + suffix for c in columns]
    rest = left.where(~sound).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c + suffix) for c in columns])
    left = left.where(sound)
    whole = F.struct(*[left[f"`{c}`"].alias(c) for c in left.columns])
    # of one time, what a left row may not see comes after it
    mine = left.select(*[left[k].alias(f"_k{i}") for i, k in enumerate(keys)], micros(left[ts]).alias("_t"), F.lit(1 if not strict else 0).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), whole.alias("_row"))
    seen = F.struct(*[right[c].alias(c) for c in columns])
    right = right.where(_all_there(right, [*keys, ts]))
    theirs = right.select(*[right[k].alias(f"_k{i}") for i, k in enumerate(keys)], micros(right[ts]).alias("_t"), F.lit(0 if not strict else 1).alias("_side"), right[tie].alias("_tie"), seen.alias("_seen"))
    names = [f"_k{i}" for i in range(len(keys))]
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_cell", F.floor(F.col("_t") / F.lit(width * 1_000_000)).cast("long"))
    cell = Window.partitionBy(*names, "_cell").orderBy("_t", "_side", "_tie")
    filled = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(cell.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_row").isNotNull())
    # carries: one row a cell, so a key's window holds its cells, not its rows
    last = theirs.withColumn("_cell", F.floor(F.col("_t") / F.lit(width * 1_000_000)).cast("long")).groupBy(*names, "_cell").agg(F.max_by("_seen", F.struct("_t", "_tie")).alias("_seen"))
    cells = mine.select(*names, F.floor(F.col("_t") / F.lit(width * 1_000_000)).cast("long").alias("_cell")).distinct()
    every = cells.unionByName(last, allowMissingColumns=True).groupBy(*names, "_cell").agg(F.any_value("_seen", F.lit(True)).alias("_seen"))
    before = Window.partitionBy(*names).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.withColumn("_carry", F.last("_seen", ignorenulls=True).over(before)).where("_carry is not null").select(*names, "_cell", "_carry")
    joined = filled.join(carry, [*names, "_cell"], "left")
    found = F.coalesce("_last", "_carry")
    return joined.select("_row.*", *[found[c].alias(name) for c, name in zip(columns, found_columns)]).unionByName(rest)


def _all_there(df: DataFrame, columns: list[str]) -> Column:
    """No null among the columns."""
    there = F.lit(True)
    for c in columns:
        there = there & df[f"`{c}`"].isNotNull()
    return there


def time_frame(df: DataFrame, keys: list[str], ts: str, seconds: int, aggregates: dict[str, Column], *, width: int | None = None) -> DataFrame:
    """Aggregates over each row's frame: rows of its keys from ``seconds`` before it up to its own time (``RANGE``).

    A row goes to its own bucket and, as a guest, to each later one whose frames reach
    it; with buckets at least as long as the frame that is one copy at most. Guests
    are left out of the result, and so are rows without a time, which have no frame.
    """
    width = max(seconds, width or 0)
    own = bucket(ts, width)
    # the last own bucket in which a frame can still begin at or before this row
    reach = F.floor((micros(ts) + F.lit(seconds * 1_000_000)) / F.lit(width * 1_000_000)).cast("long")
    spread = df.withColumn("_own", own).withColumn("_cell", F.explode(F.sequence(F.col("_own"), reach))).withColumn("_us", micros(ts))
    frame = Window.partitionBy(*keys, "_cell").orderBy("_us").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    framed = spread.withColumns({name: a.over(frame) for name, a in aggregates.items()})
    return framed.where(F.col("_cell") == F.col("_own")).drop("_own", "_cell", "_us")


def previous_time(df: DataFrame, keys: list[str], ts: str, tie: str, *, width: int = 86_400, name: str = "previous") -> DataFrame:
    """``lag`` of the time within the keys: inside a cell a window, at a cell's start the last time of the cells before."""
    marked = df.withColumn("_cell", bucket(ts, width))
    last = marked.groupBy(*keys, "_cell").agg(F.max(ts).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_cell")
    carry = last.withColumn("_carry", F.lag("_last").over(before)).drop("_last")
    inside = Window.partitionBy(*keys, "_cell").orderBy(ts, tie)
    lagged = marked.withColumn(name, F.lag(ts).over(inside)).join(carry, [*keys, "_cell"])
    return lagged.withColumn(name, F.coalesce(name, "_carry")).drop("_carry", "_cell")


def bursts(df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: int, *, width: int = 86_400) -> DataFrame:
    """Runs of rows whose gaps are at most ``gap_seconds``: ``keys, started, ended, n``.

    A row begins a run if what is before it is further away. Runs are numbered by
    counting their beginnings: within a cell by a window, over cells by carried sums.
    Rows with a null key or time are in no run.
    """
    rows = previous_time(df, keys, ts, tie, width=width).select(*keys, F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), "previous")
    begins = F.when(F.col("previous").isNull() | (micros("_ts") - micros("previous") > gap_seconds * 1_000_000), 1).otherwise(0)
    rows = rows.withColumn("_begins", begins).withColumn("_cell", bucket("_ts", width))
    held = rows.groupBy(*keys, "_cell").agg(F.sum("_begins").alias("_in"))
    before = held.withColumn("_before", F.sum("_in").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_in")).drop("_in")
    inside = Window.partitionBy(*keys, "_cell").orderBy("_ts", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_run", F.sum("_begins").over(inside)).join(before, [*keys, "_cell"])
    return numbered.groupBy(*keys, (F.col("_run") + F.col("_before")).alias("_run")).agg(F.min("_ts").alias("started"), F.max("_ts").alias("ended"), F.count("*").alias("n")).drop("_run")

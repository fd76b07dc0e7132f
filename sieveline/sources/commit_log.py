"""A data source of its own for commit logs (S22): ``spark.read.format("commit_log").load(folder)``.

A log is a folder of segments, text as ``git log -p`` prints it, and an ``index.json`` that says
for each run of commits where it stands: segment, byte range, first and last number, first and
last time. The reader's partitions are such runs; those outside the wanted numbers and times
are dropped before a byte is read. Bounds come as options (``read_log``), or with
``option("pushdown", "true")`` from Spark's filters; Spark keeps what it has pushed with the
loaded table, so then each plan needs a ``load`` of its own. The stream reader's offsets are
commit numbers, so a log that grows is read once.

``write_log`` writes segments from a table, one task a segment. Folders are paths that driver
and executors both see (a shared mount), with or without ``file://``.

Columns: ``seq long, commit string, author string, committed timestamp, subject string, patch
string``. A damaged entry (no commit line, no number) is an error that names its segment; an
empty log has no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "seq long, commit string, author string, committed timestamp, subject string, patch string"
#: Commits in a run of the index.
RUN = 1000
_HEAD = re.compile(r"commit (\S+) (\d+)\nAuthor: (.*)\nDate: (.*)\n\n    (.*)\n\n")
_TIME = "%Y-%m-%dT%H:%M:%S.%f+00:00"


def timestamp(value: datetime) -> str:
    """As it stands in the log: UTC; without a zone it is UTC already."""
    return (value.astimezone(timezone.utc) if value.tzinfo else value).strftime(_TIME)


def local_path(path: str) -> str:
    return path[7:] if path.startswith("file://") else path


def entry(seq: int, commit: str, author: str, committed: str, subject: str, patch: str) -> str:
    """A commit as text; lines of the patch are indented, so no line of it begins an entry."""
    body = "".join(f" {line}\n" for line in patch.split("\n"))
    return f"commit {commit} {seq}\nAuthor: {author}\nDate: {committed}\n\n    {subject}\n\n{body}\n"


def parse(text: str, where: str) -> Iterator[tuple]:
    """The rows of a run's text."""
    for part in re.split(r"(?m)^(?=commit \S+ \d+$)", text):
        if not part.strip():
            continue
        head = _HEAD.match(part)
        if not head:
            raise ValueError(f"damaged entry in {where}: {part[:80]!r}")
        commit, seq, author, date, subject = head.groups()
        patch = "\n".join(line[1:] for line in part[head.end() :].removesuffix("\n").removesuffix("\n").split("\n"))
        yield int(seq), commit, author, datetime.strptime(date, _TIME).replace(tzinfo=timezone.utc), subject, patch


def write_log(commits: DataFrame, folder: str, segments: int = 8) -> int:
    """Write ``commits`` (the schema's columns; ``seq`` numbers them without repeats) as a log of ``segments`` segments; returns their number.

    Ranges of ``seq`` are the segments. The driver gets one row a run for the index.
    """
    root = local_path(folder)
    os.makedirs(root, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, out, name, run = [], None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                when = timestamp(row["committed"])
                if out is None:
                    name = f"segment-{row['seq']:012d}.log"
                    out = open(f"{root}/{name}.tmp", "wb")
                if run is None or run["n"] >= RUN:
                    run = {"segment": name, "start": out.tell(), "end": 0, "first": row["seq"], "last": 0, "since": when, "until": when, "n": 0}
                    runs.append(run)
                out.write(entry(row["seq"], row["commit"], row["author"] or "", when, (row["subject"] or "").replace("\n", " "), row["patch"] or "").encode("utf-8", "surrogatepass"))
                run.update(end=out.tell(), last=row["seq"], since=min(run["since"], when), until=max(run["until"], when), n=run["n"] + 1)
        if out is not None:
            out.close()
            os.replace(f"{root}/{name}.tmp", f"{root}/{name}")  # a task that is run again replaces its segment
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in runs], pa.string())], names=["run"])

    placed = commits.where("seq is not null and committed is not null").select("seq", "commit", "author", "committed", "subject", "patch").repartitionByRange(segments, "seq").sortWithinPartitions("seq")
    runs = sorted((json.loads(r.run) for r in placed.mapInArrow(write, "run string").collect()), key=lambda r: r["first"])
    held = {r["segment"] for r in runs}
    old = [r for r in read_index(folder) if r["segment"] not in held]
    with open(f"{root}/index.json.tmp", "w", encoding="utf-8") as f:
        json.dump(sorted(old + runs, key=lambda r: r["first"]), f)
    os.replace(f"{root}/index.json.tmp", f"{root}/index.json")
    return len(held)


def read_index(folder: str) -> list[dict]:
    path = f"{local_path(folder)}/index.json"
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class CommitRun(InputPartition):
    """A run of commits; ``first`` and ``last`` may be narrower than the run."""

    def __init__(self, run: dict, first: int, last: int):
        self.run, self.first, self.last = run, first, last


def rows_of(folder: str, part: CommitRun) -> Iterator[tuple]:
    run = part.run
    with open(f"{local_path(folder)}/{run['segment']}", "rb") as f:
        f.seek(run["start"])
        text = f.read(run["end"] - run["start"]).decode("utf-8", "surrogatepass")
    for row in parse(text, run["segment"]):
        if part.first <= row[0] <= part.last:
            yield row


class CommitLogReader(DataSourceReader):
    """Reads the runs that the options ``first``, ``last`` (numbers), ``since``, ``until`` (times) leave."""

    def __init__(self, folder: str, options: dict):
        self.folder = folder
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", (1 << 63) - 1))
        self.since, self.until = options.get("since"), options.get("until")

    def partitions(self) -> list[CommitRun]:
        return [
            CommitRun(r, self.first, self.last) for r in read_index(self.folder)
            if r["last"] >= self.first and r["first"] <= self.last and (self.since is None or r["until"] >= self.since) and (self.until is None or r["since"] <= self.until)
        ] or [CommitRun({}, 1, 0)]

    def read(self, partition: CommitRun) -> Iterator[tuple]:
        if partition.run:
            yield from rows_of(self.folder, partition)


class PushdownReader(CommitLogReader):
    """The same, with bounds from the filters that Spark pushes."""

    def pushFilters(self, filters) -> Iterator:
        """Bounds on ``seq`` are kept exactly, those on ``committed`` by runs; so Spark still checks the latter."""
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            exact = False
            if name == ("seq",) and value is not None:
                exact = True
                if isinstance(f, EqualTo):
                    self.first, self.last = max(self.first, value), min(self.last, value)
                elif isinstance(f, GreaterThan):
                    self.first = max(self.first, value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.first = max(self.first, value)
                elif isinstance(f, LessThan):
                    self.last = min(self.last, value - 1)
                elif isinstance(f, LessThanOrEqual):
                    self.last = min(self.last, value)
                else:
                    exact = False
            elif name == ("committed",) and isinstance(value, datetime):
                when = timestamp(value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.since = max(self.since or when, when)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.until = min(self.until or when, when)
            if not exact:
                yield f


class CommitLogStream(DataSourceStreamReader):
    """Offsets are numbers of the next commit; a batch takes the runs that were added since the last one."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max((r["last"] + 1 for r in read_index(self.folder)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[CommitRun]:
        return [CommitRun(r, start["next"], end["next"] - 1) for r in read_index(self.folder) if r["last"] >= start["next"] and r["first"] < end["next"]]

    def read(self, partition: CommitRun) -> Iterator[tuple]:
        yield from rows_of(self.folder, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for batches that are over."""


class CommitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CommitLogReader:
        kind = PushdownReader if self.options.get("pushdown", "false") == "true" else CommitLogReader
        return kind(self.options["path"], self.options)

    def streamReader(self, schema) -> CommitLogStream:
        return CommitLogStream(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, and let its readers take filters if they ask for them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommitLog)
    return spark


def read_log(spark: SparkSession, folder: str, *, first: int | None = None, last: int | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The log between numbers and times, both ends included; runs outside are never opened."""
    bounds = {"first": first, "last": last, "since": since and timestamp(since), "until": until and timestamp(until)}
    reader = register(spark).read.format("commit_log")
    for name, value in bounds.items():
        if value is not None:
            reader = reader.option(name, str(value))
    log = reader.load(folder)
    if since is not None:
        log = log.where(F.col("committed") >= F.lit(since))
    return log if until is None else log.where(F.col("committed") <= F.lit(until))


def runs_read(df: DataFrame) -> int:
    """How many runs a read of the log touches: its partitions."""
    return df.rdd.getNumPartitions()

"""Small helpers shared by the training-data operators.

Lineage is cut only through files in the folder that the session names in
``spark.checkpoint.dir`` (a local session that names none gets one, as in tests), so that a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import trim

_STAGED: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of this machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A narrow table written to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the driver's process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str, compression: str = "zstd", by: tuple[str, ...] = ()) -> DataFrame:
    """A wide table written as compressed Parquet into the shared folder, in folders ``by`` columns if given."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_staged() -> None:
    for spark, path in _STAGED:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def ship(spark: SparkSession) -> None:
    """Make the package importable for Python workers started in another folder."""
    root = Path(__file__).resolve().parents[2]
    on_path = [Path(p or os.curdir).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in on_path:
        return
    target = Path(tempfile.mkdtemp(prefix="sieveline-")) / "sieveline.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted((root / "sieveline").rglob("*.py")):
            out.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named input columns under fixed names: ``only(df, doc_id="id", text="body")``.

    Extra columns, whatever they are called, are left behind.
    """
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Entries of a vector that travel as one row, and rows that travel at once.
PART, PARTS = 64, 4096


def vector_rows(vectors) -> "object":
    """A task's partial sums, ``{key: float64 or int64 vector}``, as Arrow batches ``key, part, total``.

    Parts that are all zero are left out.
    """
    import numpy as np
    import pyarrow as pa

    for key, vector in vectors.items():
        for start in range(0, len(vector), PART * PARTS):
            some = vector[start : start + PART * PARTS]
            padded = np.zeros(-(-len(some) // PART) * PART)
            padded[: len(some)] = some
            blocks = padded.reshape(-1, PART)
            full = np.flatnonzero(blocks.any(axis=1))
            if len(full):
                values = [blocks[i].tobytes() for i in full]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(full), pa.int32()), pa.array((full + start // PART).tolist(), pa.int32()), pa.array(values, pa.binary())], names=["key", "part", "total"])


VECTOR_ROWS = "key int, part int, total binary"


def sum_vectors(partials: DataFrame, sizes: dict) -> dict:
    """Sums of tasks' partial vectors, added up on the executors; ``sizes``: each key's length.

    What reaches the driver is one vector a key, however large the corpus is.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        totals: dict = {}
        for batch in batches:
            for key, part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = np.frombuffer(raw.as_py())
                at = (key, part)
                totals[at] = totals[at] + values if at in totals else values
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in totals], pa.int32()), pa.array([p for _, p in totals], pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], names=["key", "part", "total"])

    n = shuffle_partitions(partials.sparkSession)
    out = {key: np.zeros(-(-size // PART) * PART) for key, size in sizes.items()}
    for row in partials.repartition(n, "key", "part").mapInArrow(run, VECTOR_ROWS).collect():
        out[row.key][row.part * PART : (row.part + 1) * PART] += np.frombuffer(bytes(row.total))
    trim()
    return {key: out[key][:size] for key, size in sizes.items()}

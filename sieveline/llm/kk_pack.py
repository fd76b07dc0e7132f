"""Packing: Karmarkar-Karp multiway differencing of document tails.

Each document's ids are cut into full windows and one tail. Tails are packed in
groups of ``GROUP`` (in the order in which a task meets them, so nothing is
shuffled and memory is bounded): the differencing method keeps partial
partitions, each a list of window sums, and always merges the two with the
largest imbalance in opposing order, largest sum onto smallest. It ends with one
partition of near-equal windows. It starts with the fewest windows that could
hold the group (by its sum, and by its tails over half the capacity); whenever a window exceeds the capacity, the window count rises
by one and the group is packed anew.

Each id lies in exactly one piece. A null or empty text is its end id alone; an
empty table gives no rows. Repeated rows are packed once each. A very long text is
tokenised whole and cut into windows one after another; other columns than the id and
the text, whatever they are called, are left behind.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import only, ship
from .tokens import tokenizer, trim

CAPACITY = 2048
GROUP = 512


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers in each of ``windows`` near-equal windows."""
    # a partial partition: its nonempty windows as (sum, items), largest first; the others are empty
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tag = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        meet = len(a) + len(b) - windows  # windows that aren't empty in either
        if meet > 0:  # the smallest of one take the largest of the other
            joined = [(x + y, p + q) for (x, p), (y, q) in zip(a[len(a) - meet :], reversed(b[len(b) - meet :]))]
            merged = a[: len(a) - meet] + b[: len(b) - meet] + joined
        else:
            merged = a + b
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], tag, merged))
        tag += 1
    return [items for _, items in heap[0][2]] if heap else []


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none over ``capacity``; no size may be over it."""
    windows = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))  # two over half never share one
    while True:
        packed = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in packed):
            return packed
        windows += 1


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces: ``doc_id, start, length, ids`` (u32, little-endian), ``doc_tokens, sequence_id, offset``.

    ``sequence_id`` has the task's number in its upper bits and counts windows in
    the lower 32; input splits are the same in each attempt of a task.
    """
    ship(docs.sparkSession)
    tail_id = struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        encoder, base = tokenizer(vocabulary), TaskContext.get().partitionId() << 32
        used = 0
        rows: list[tuple] = []
        tails: list[tuple] = []

        def close():
            nonlocal used
            for window in pack_group([t[2] for t in tails], capacity):
                offset = 0
                for i in window:
                    rows.append((*tails[i], base + used, offset))
                    offset += tails[i][2]
                used += 1
            tails.clear()

        def table():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + tail_id
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    piece = (doc_id, start, length, ids[4 * start : 4 * (start + length)], n)
                    if length == capacity:
                        rows.append((*piece, base + used, 0))
                        used += 1
                    else:
                        tails.append(piece)
                if len(tails) >= group:
                    close()
                if len(rows) >= 2 * group:
                    yield table()
        if tails:
            close()
        if rows:
            yield table()
        trim()  # the tokenizer stays for the worker's next task

    kinds = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, kinds)


def padding(lengths: np.ndarray, capacity: int = CAPACITY) -> float:
    """Share of padded places when sequences have these lengths."""
    return 1 - lengths.sum() / (len(lengths) * capacity) if len(lengths) else 0.0

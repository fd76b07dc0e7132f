"""Token-id output: static range asymmetric numeral system (rANS) blocks.

Documents are dealt by ranges of ``doc_id`` into shards, tokenized once, and
grouped into blocks of whole documents. One pass counts all ids of the corpus;
the counts, scaled to 2**20, are the frequency table that all blocks share.
Each block is then encoded on its own by ``LANES`` interleaved 64-bit coders
which emit 32-bit words, so any block can be decoded alone, on any executor.

File format: a folder of three Parquet tables, all that a reader needs.
``table`` (``token, freq``) is the frequency table, ``about`` (one row: ``vocabulary,
end_id, bits``) says what the ids mean, and ``blocks`` (``shard, block, start, doc_ids,
doc_lens, n_ids, payload``) holds the ids; ``start`` counts the shard's ids before the
block. ``payload`` is little-endian::

    magic "SRA2" | lanes u32 | n_ids u64 | steps between checkpoints u32
    | n_checkpoints u32 | n_words u32
    | checkpoints: (word offset u64, crc32 u32, 0 u32, lanes x state u64) each | words u32

Checkpoint ``k`` lets a reader begin at id ``k * every * lanes``; its checksum is that of
the ids (as u32) from there to the next one. ``read`` decodes blocks of more than
``PART_IDS`` ids, those of very long documents, in parts of about as many, each of
them a task's row of its own, and puts the documents together again.

Nulls: a null text is an empty one (the end id alone); null ``doc_id`` rows sort
first. Repeated rows are encoded once each. Texts of any length are encoded whole.
Extra columns are left behind. An empty table gives no block. Ids must be below 2**32 and at most 2**20 of them distinct.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, only, ship, shuffle_partitions, stage
from .tokens import tokenizer

BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
EVERY = 128  # steps between checkpoints
BLOCK_IDS = 1 << 19
PART_IDS = 1 << 21  # ids of a large block that are decoded together
_HEAD = struct.Struct("<4sIQIII")
_MARK = struct.Struct("<QII")


def scaled(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies that sum to 2**BITS, at least 1 for each id that occurs."""
    order = np.argsort(ids)
    ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
    total = 1 << BITS
    if len(ids) > total:
        raise ValueError(f"{len(ids)} distinct ids; the table has room for {total}")
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    free = total - len(ids)
    share = counts / counts.sum() * free
    freq = np.floor(share).astype(np.int64) + 1
    rest = total - int(freq.sum())
    freq[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]] += 1
    return ids, freq


class Table:
    """Lookup arrays of a frequency table."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids = ids.astype(np.uint32)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.index = np.zeros(size, np.int32)
        self.index[ids] = np.arange(len(ids), dtype=np.int32)
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
        self.slot = np.repeat(np.arange(len(ids), dtype=np.int32), freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block of unsigned ids of any width."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 16))
    steps = -(-n // lanes)
    symbols = table.index[ids]
    freq, first = table.freq[symbols], table.first[symbols]
    limit = freq << np.uint64(31 - BITS + 32)
    state = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written, shift, half = 0, np.uint64(BITS), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x = state[: b - a]
        full = x >= limit[a:b]
        words = x[full].astype(np.uint32)
        if len(words):
            out.append(words)
            written += len(words)
            x[full] >>= half
        f = freq[a:b]
        q = x // f
        x[:] = (q << shift) + (x - q * f) + first[a:b]
        if step % every == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    span = every * lanes
    crcs = [zlib.crc32(ids[a : a + span].astype("<u4").tobytes()) for a in range(0, n, span)]
    body = b"".join(_MARK.pack(len(words) - at, crc, 0) + s.astype("<u8").tobytes() for (at, s), crc in zip(reversed(marks), crcs))
    return _HEAD.pack(b"SRA2", lanes, n, every, len(marks), len(words)) + body + words.astype("<u4").tobytes()


def decode(payload: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """All ids of a block, or those from checkpoint ``part`` to the next; each part is checked against its checksum."""
    magic, lanes, n, every, n_marks, n_words = _HEAD.unpack_from(payload)
    if magic != b"SRA2":
        raise ValueError("not a block of this format")
    size = _MARK.size + 8 * lanes
    words = np.frombuffer(payload, "<u4", n_words, _HEAD.size + n_marks * size)
    begin = _HEAD.size + (part or 0) * size
    at = struct.unpack_from("<Q", payload, begin)[0] if n_marks else 0
    state = np.frombuffer(payload, "<u8", lanes, begin + _MARK.size).astype(np.uint64) if n_marks else np.zeros(0, np.uint64)
    steps = -(-n // lanes)
    from_step, to_step = (0, steps) if part is None else (part * every, min(steps, (part + 1) * every))
    out = np.empty(min(n, to_step * lanes) - from_step * lanes, np.int32)
    mask, shift, half, done = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), 0
    for step in range(from_step, to_step):
        count = min(n, (step + 1) * lanes) - step * lanes
        x = state[:count]
        low = x & mask
        s = table.slot[low.astype(np.int64)]
        out[done : done + count] = s
        done += count
        x[:] = table.freq[s] * (x >> shift) + low - table.first[s]
        need = x < LOW
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << half) | words[at : at + k]
            at += k
    ids = table.ids[out]
    for k in range(from_step // every, -(-to_step // every)):
        crc = _MARK.unpack_from(payload, _HEAD.size + k * size)[1]
        here = (k - from_step // every) * every * lanes
        if zlib.crc32(ids[here : here + every * lanes].astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids don't have its checksum")
    return ids


def ids_in(payload: bytes) -> int:
    return _HEAD.unpack_from(payload)[2]


def split(payload: bytes, part_ids: int) -> list[tuple[int, bytes]]:
    """A block as several of about ``part_ids`` ids, each with the number of ids before it: its checkpoints and the words between them."""
    _, lanes, n, every, n_marks, n_words = _HEAD.unpack_from(payload)
    size, step, out = _MARK.size + 8 * lanes, max(1, part_ids // (every * lanes)), []
    marks = [payload[_HEAD.size + k * size : _HEAD.size + (k + 1) * size] for k in range(n_marks)]
    at = [_MARK.unpack_from(m)[0] for m in marks] + [n_words]
    words = memoryview(payload)[_HEAD.size + n_marks * size :]
    for a in range(0, n_marks, step):
        b = min(n_marks, a + step)
        own = min(n, b * every * lanes) - a * every * lanes
        body = b"".join(_MARK.pack(at[k] - at[a], _MARK.unpack_from(marks[k])[1], 0) + marks[k][_MARK.size :] for k in range(a, b))
        out.append((a * every * lanes, _HEAD.pack(b"SRA2", lanes, own, every, b - a, at[b] - at[a]) + body + bytes(words[4 * at[a] : 4 * at[b]])))
    return out


_BLOCKS = "shard int, block int, start long, doc_ids array<long>, doc_lens array<long>, width int, ids binary, counts binary"
_FILE = "shard int, block int, start long, doc_ids array<long>, doc_lens array<long>, n_ids long, payload binary"
_ABOUT = "vocabulary string, end_id long, bits int"


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ARROW = [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64()))]


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS, shards: int | None = None) -> DataFrame:
    """``doc_id, text`` -> blocks of whole documents' ids (of ``width`` bytes) in ascending ``doc_id`` order, by shard.

    A block closes at the first document that brings it to ``block_ids``; one of
    any length is never split, as its row holds it whole in the input too.
    """
    ship(docs.sparkSession)
    tail = struct.pack("<I", end_id)
    schema = pa.schema([*_ARROW, ("width", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        encoder, shard = tokenizer(vocabulary), TaskContext.get().partitionId()
        names, lens, parts, held, start, block = [], [], [], 0, 0, 0
        total = np.zeros(encoder.whole.get_vocab_size() + end_id + 1, np.int64)

        def row():
            ids = np.frombuffer(b"".join(parts), "<u4")
            counts = np.bincount(ids)
            total[: len(counts)] += counts
            return _rows([{"shard": shard, "block": block, "start": start, "width": 2 if narrow else 4, "doc_ids": names, "doc_lens": lens, "ids": (ids.astype("<u2") if narrow else ids).tobytes()}], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + tail
                names.append(doc_id)
                lens.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= block_ids:
                    yield row()
                    start, block = start + held, block + 1
                    names, lens, parts, held = [], [], [], 0
        if names:
            yield row()
        if total.any():
            yield _rows([{"shard": shard, "block": -1, "start": start + held, "doc_ids": [], "doc_lens": [], "counts": total.tobytes()}], schema)

    n = shards or shuffle_partitions(docs.sparkSession)
    narrow = tokenizer(vocabulary).whole.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
    return docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _BLOCKS)


def corpus_counts(blocks: DataFrame) -> DataFrame:
    """``token, n``: how often each id occurs in all shards; reads their counts only."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                counts = np.frombuffer(raw.as_py(), np.int64)
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], schema=schema)

    return blocks.select("counts").where("counts is not null").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequency_table(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled frequencies; one row for each id of the vocabulary reaches the driver."""
    rows = corpus_counts(blocks).collect()
    return scaled(np.array([r.token for r in rows], np.int64), np.array([r.n for r in rows], np.int64))


def encode_blocks(blocks: DataFrame, ids: np.ndarray, freq: np.ndarray, lanes: int = LANES, every: int = EVERY) -> DataFrame:
    """Blocks of ids -> the table of the file format."""
    ship(blocks.sparkSession)
    shared = blocks.sparkSession.sparkContext.broadcast((ids, freq))  # at most 2**20 entries
    schema = pa.schema([*_ARROW, ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        table = Table(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                payload = encode(np.frombuffer(batch.column("ids")[i].as_py(), f"<u{batch.column('width')[i].as_py()}"), table, lanes, every)
                part = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c, _ in _ARROW), pa.array([ids_in(payload)], pa.int64()), pa.array([payload], pa.binary())], schema=schema)

    return blocks.where("block >= 0").drop("counts").mapInArrow(run, _FILE)


def decode_blocks(encoded: DataFrame, ids: np.ndarray, freq: np.ndarray) -> DataFrame:
    """Blocks -> ``doc_id, shard, block, place`` (in its block), ``start`` (in its shard), ``ids`` (u32, little-endian), ``n_tokens``."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast((ids, freq))
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("block", pa.int32()), ("place", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        table = Table(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                raw = decode(batch.column("payload")[i].as_py(), table).astype("<u4").tobytes()
                lens = np.array(batch.column("doc_lens")[i].as_py(), np.int64)
                ends = np.cumsum(lens)
                start, n = batch.column("start")[i].as_py(), len(lens)
                first = batch.column("first")[i].as_py()
                columns = [batch.column("doc_ids")[i].values, *(pa.array([batch.column(c)[i].as_py()] * n, pa.int32()) for c in ("shard", "block")), pa.array(first + np.arange(n)), pa.array(start + ends - lens), pa.array(lens), pa.array([raw[4 * a : 4 * b] for a, b in zip(ends - lens, ends)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return encoded.mapInArrow(run, "doc_id long, shard int, block int, place long, start long, n_tokens long, ids binary")


def parts_of_blocks(encoded: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """Large blocks as rows of their parts, with the pieces of documents that each holds; ``first`` numbers its first document in the block."""
    ship(encoded.sparkSession)
    schema = pa.schema([*_ARROW, ("first", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, block, start, names, lens = (batch.column(c)[i].as_py() for c, _ in _ARROW)
                ends = np.cumsum(np.array(lens, np.int64))
                for before, payload in split(batch.column("payload")[i].as_py(), part_ids):
                    after = before + ids_in(payload)
                    a, b = int(np.searchsorted(ends, before, "right")), int(np.searchsorted(ends, after, "left")) + 1
                    pieces = [min(int(ends[j]), after) - max(int(ends[j]) - lens[j], before) for j in range(a, b)]
                    yield pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "start": start + before, "doc_ids": names[a:b], "doc_lens": pieces, "first": a, "payload": payload}], schema)

    return encoded.mapInArrow(run, "shard int, block int, start long, doc_ids array<long>, doc_lens array<long>, first long, payload binary")


def write(docs: DataFrame, vocabulary: str, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None, lanes: int = LANES, every: int = EVERY) -> str:
    """Tokenize, count, encode and write; returns the folder of the file format (a fresh one in the shared folder unless ``path`` is given)."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "rans")
    blocks = stage(token_blocks(only(docs, doc_id=id_col, text=text_col), vocabulary, end_id, shards=shards), "token-blocks", "snappy")
    ids, freq = frequency_table(blocks)
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, freq)], "token long, freq long").coalesce(1).write.parquet(f"{path}/table")
    spark.createDataFrame([(vocabulary.rsplit("/", 1)[-1], end_id, BITS)], _ABOUT).coalesce(1).write.parquet(f"{path}/about")
    encode_blocks(blocks, ids, freq, lanes, every).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str, part_ids: int = PART_IDS) -> DataFrame:
    """Documents of a written folder: ``doc_id, start`` (over all shards), ``n_tokens, ids``.

    The shards' totals, one row a shard, give where each one starts.
    """
    about = spark.read.schema(_ABOUT).parquet(f"{path}/about").first()
    if about.bits != BITS:
        raise ValueError(f"a frequency table of {about.bits} bits; this reader takes {BITS}")
    rows = spark.read.schema("token long, freq long").parquet(f"{path}/table").orderBy("token").collect()  # at most 2**BITS rows
    ids, freq = np.array([r.token for r in rows], np.int64), np.array([r.freq for r in rows], np.int64)
    encoded = spark.read.schema(_FILE).parquet(f"{path}/blocks")
    totals = encoded.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    whole = decode_blocks(encoded.where(F.col("n_ids") <= part_ids).withColumn("first", F.lit(0).cast("long")), ids, freq)
    docs = whole.select("doc_id", "shard", "start", "n_tokens", "ids")
    large = encoded.where(F.col("n_ids") > part_ids)
    if not large.select("n_ids").isEmpty():
        parts = parts_of_blocks(large, part_ids).repartition(shuffle_partitions(spark), "shard", "block", "start")
        pieces = decode_blocks(parts, ids, freq).groupBy("shard", "block", "place").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("p"))
        docs = docs.unionByName(pieces.select("doc_id", "shard", "start", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
    docs = docs.join(F.broadcast(before), "shard")  # one row a shard
    return docs.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")

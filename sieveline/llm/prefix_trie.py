"""Conversation prefix trie by partition refinement.

``classes`` starts with one class, all conversations. A round splits the active
classes turn by turn for a block of turns, twice as many as the round before:
members of a class that agree in their next turn stay together. A class's name is
a digest chained over its turns, so equal names of one depth are equal sequences.
Classes of one member retire: what is left of their conversations is a unary chain,
whose nodes have no members, children or sums to compare and are emitted straight
from the turns. Rounds grow with the logarithm of the longest shared prefix (beyond
``MAX_BLOCK`` turns, linearly in blocks of that length).

``fold`` then adds up what hangs below each shared node. A node's weight stands at its
smallest member; a member's weights are summed from its deepest shared turn upwards,
and a node gets its members' sums at its depth. So no level waits for the one below.

Large groups: members are counted with partial aggregates; a conversation that holds
a large part of all turns is numbered through ranges of (conversation, turn) and
summed in buckets of turns; children and members are joined by keys whose hot side
Spark splits; a node's list of ends is streamed in sorted pieces.

Nulls: a null role or text is empty, a null turn comes first, rows without a
conversation id are left out. Ties of turn go by role, then text (64 code points of
each, then a digest of both whole); repeated rows are repeated turns. An empty table
has no nodes, not even a root. Texts of any length count whole (their SHA-256 and code
points). Extra columns are left behind.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only, ship, shuffle_partitions, stage

#: Turns in the first round's block and at most; turns in a bucket of running sums; ids in a piece of a list.
FIRST_BLOCK, MAX_BLOCK, BUCKET, PIECE = 2, 1 << 14, 1024, 1 << 14
ROOT = b""


def turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, key, chars``: each conversation's turns numbered from 1, a digest of role and text, the text's code points.

    Rows are sorted by ranges of (conversation, turn, role, text), so a long
    conversation takes several tasks; counts by range carry its numbers on.
    """
    rows = only(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"), F.char_length(text).cast("long").alias("chars"))
    rows = rows.withColumns({"role": F.substring("role", 1, 64), "text": F.substring("text", 1, 64), "row": F.monotonically_increasing_id()})  # a conversation of equal rows can be cut too
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "key", "row"]
    placed = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    at = stage(placed.select("conv_id", "key", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    held = at.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part")
    held = held.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "first", (F.sum("n").over(before) - F.col("n")).alias("before"))
    numbered = at.join(held, (at.conv_id == held["_conv"]) & (at.part == held["_part"]))
    return numbered.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "key", "chars")


def classes(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and nodes of the refinement, from ``conv_id, pos, key, chars`` and ``conv_id, length``.

    Members: ``conv_id, depth, name`` of each active conversation's turns. Nodes:
    ``depth, name, parent, conv_id, n_convs, chars, length``, those of singleton
    classes as far as their block reached (``length`` is the longest member's).
    """
    spark = rows.sparkSession
    ship(spark)
    schema = "conv_id long, depth long, parent binary, name binary, chars long, length long"
    arrow = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()), ("name", pa.binary()), ("chars", pa.int64()), ("length", pa.int64())])

    def split(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for conv, name, length, block in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    for turn in block:
                        parent, name = name, hashlib.blake2b(name + turn["key"], digest_size=16).digest()
                        out.append((conv, turn["pos"], parent, name, turn["chars"], length))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("chars"), "length")
    members, nodes = [root], [cut(named(root))]
    active = lengths.where("length > 0").select("conv_id", F.lit(ROOT).alias("name"), "length")
    active = cut(active if nodes[0].where("n_convs > 1").count() else active.where("false"))
    done, block = 0, FIRST_BLOCK
    while not active.isEmpty():
        rows = rows.where(F.col("pos") > done)
        part = rows.where(F.col("pos") <= done + block).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("block"))  # at most ``block`` turns
        found = stage(active.join(part, "conv_id").select("conv_id", "name", "length", "block").mapInArrow(split, schema), "members")
        groups = cut(named(found))
        members.append(found)
        nodes.append(groups)
        done += block
        block = min(2 * block, MAX_BLOCK)
        shared = groups.where(F.col("depth") == done).where("n_convs > 1 and length > depth").select(F.col("name").alias("_name"))
        last = found.where(F.col("depth") == done).where("length > depth")
        active = cut(last.join(shared, last["name"] == shared["_name"], "left_semi").select("conv_id", "name", "length"))
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    all_members = members[0].select("conv_id", "depth", "name", "length")
    for more in members[1:]:
        all_members = all_members.unionByName(more.select("conv_id", "depth", "name", "length"))
    return all_members, every


def named(members: DataFrame) -> DataFrame:
    """A node for each class."""
    return members.groupBy("depth", "name").agg(F.any_value("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("chars").alias("chars"), F.max("length").alias("length"))


def fold(members: DataFrame, shared: DataFrame, alone: DataFrame) -> DataFrame:
    """``depth, name, n_leaves, saved_tokens`` of the shared nodes.

    ``shared``: nodes of two members or more with ``n_children``; ``alone``: ``conv_id`` of conversations that end in a chain of their own.
    """
    weight = shared.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), ((F.col("n_convs") - 1) * F.col("chars")).alias("weight"), (F.col("n_children") == 0).cast("int").alias("end"))
    rows = members.join(weight, (members.conv_id == weight["_conv"]) & (members.depth == weight["_depth"]), "left")
    rows = cut(rows.select("conv_id", "depth", "name", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("end", F.lit(0)).alias("end"), F.floor(F.col("depth") / BUCKET).alias("bucket")))
    sums = rows.groupBy("conv_id", "bucket").agg(F.sum("weight").alias("w"), F.sum("end").alias("e"))
    later = Window.partitionBy("conv_id").orderBy(F.col("bucket").desc())
    alone = alone.select(F.col("conv_id").alias("_own"), F.lit(1).alias("one"))
    carried = sums.join(alone, sums.conv_id == alone["_own"], "left").select(
        F.col("conv_id").alias("_conv"), F.col("bucket").alias("_bucket"), (F.sum("w").over(later) - F.col("w")).alias("more_w"), (F.sum("e").over(later) - F.col("e") + F.coalesce("one", F.lit(0))).alias("more_e")
    )
    below = Window.partitionBy("conv_id", "bucket").orderBy(F.col("depth").desc())
    own = rows.withColumns({"weight": F.sum("weight").over(below), "end": F.sum("end").over(below)})
    total = own.join(carried, (own.conv_id == carried["_conv"]) & (own.bucket == carried["_bucket"]))
    return total.groupBy("depth", "name").agg(F.sum(F.col("end") + F.col("more_e")).alias("n_leaves"), F.sum(F.col("weight") + F.col("more_w")).alias("saved_tokens"))


def digests(ends: DataFrame) -> DataFrame:
    """``depth, name, conv_id`` -> ``depth, name, ends_sha256`` of the ascending, comma-joined ids.

    Ids are joined in sorted pieces by range; a node's pieces, in order, go
    through one running SHA-256, a piece in memory at a time.
    """
    ship(ends.sparkSession)
    n = shuffle_partitions(ends.sparkSession)
    piece = pa.schema([("depth", pa.int64()), ("name", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    digest = pa.schema([("depth", pa.int64()), ("name", pa.binary()), ("ends_sha256", pa.string())])

    def pieces(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                out: dict = {}
                for depth, name, conv in zip(*(c.to_pylist() for c in batch.slice(at, PIECE).columns)):
                    out.setdefault((depth, name), []).append(conv)
                columns = zip(*((d, k, ids[0], ",".join(map(str, ids)).encode()) for (d, k), ids in out.items()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, piece)], schema=piece)

    def joined(batches):
        last, running, out = None, None, []
        for batch in batches:
            for depth, name, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (depth, name) != last:
                    if last is not None:
                        out.append((*last, running.hexdigest()))
                    last, running = (depth, name), hashlib.sha256(ids)
                else:
                    running.update(b"," + ids)
            if len(out) >= PIECE:
                yield rows(out)
                out = []
        if last is not None:
            out.append((*last, running.hexdigest()))
        if out:
            yield rows(out)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), digest)], schema=digest)

    sorted_ends = ends.select("depth", "name", "conv_id").repartitionByRange(n, "depth", "name", "conv_id").sortWithinPartitions("depth", "name", "conv_id")
    cuts = sorted_ends.mapInArrow(pieces, "depth long, name binary, first long, ids binary")
    return cuts.repartition(n, "depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(joined, "depth long, name binary, ends_sha256 string")


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie's nodes from numbered turns (``conv_id, pos, key, chars``, as of ``turns`` or ``spliced``) and all ``conv_id``s.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. ``conv_id`` and ``depth`` name a node;
    its last turn is turn ``depth`` of that conversation.
    """
    known = ids.select("conv_id").distinct()
    counted = rows.groupBy("conv_id").agg(F.max("pos").alias("length"))
    lengths = cut(known.join(counted, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).cast("long").alias("length")))
    members, nodes = classes(rows, lengths)
    parents = nodes.where("n_convs > 1").select((F.col("depth") + 1).alias("_depth"), F.col("name").alias("_name"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut(nodes.join(parents, (nodes.depth == parents["_depth"]) & (nodes.parent == parents["_name"]), "left").drop("_depth", "_name"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("_depth"), F.col("parent").alias("_name")).agg(F.count("*").alias("n_children"))
    shared = nodes.where("n_convs > 1")
    shared = cut(shared.join(children, (shared.depth == children["_depth"]) & (shared.name == children["_name"]), "left").drop("_depth", "_name").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    single = nodes.where("n_convs = 1")
    alone = single.where("parent_conv_id is not null").select("conv_id", "depth").unionByName(single.where("depth = 0").select("conv_id", "depth"))
    sums = fold(members, shared, alone)
    ended = digests(members.where("length = depth").join(alone.select(F.col("conv_id").alias("_conv")), F.col("conv_id") == F.col("_conv"), "left_anti"))

    def with_name(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"depth": "_depth", "name": "_name"})
        return left.join(right, (left["depth"] == right["_depth"]) & (left["name"] == right["_name"]), how).drop("_depth", "_name")

    out = with_name(with_name(shared, sums, "inner"), ended, "left")
    nothing = F.sha2(F.lit(""), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).select(columns)
    # singleton classes: the first node of each is in the refinement, the tail is emitted from the turns
    tails = rows.join(alone.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_first")), F.col("conv_id") == F.col("_conv")).where("pos > _first").select("conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    heads = single.join(alone.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth")), (single.conv_id == F.col("_conv")) & (single.depth == F.col("_depth")), "left_semi").select("conv_id", "depth", "parent_conv_id")
    chains = heads.unionByName(tails)
    size = lengths.select(F.col("conv_id").alias("_conv"), "length")
    chains = chains.join(size, chains.conv_id == size["_conv"])
    last = F.col("depth") == F.col("length")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = chains.select("conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return out.unionByName(chains)


def spliced(rows: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Rebuilt conversations: the first ``shared`` turns of conversation ``base``, then a conversation's own after its first ``shared``.

    ``base`` and ``shared`` (0 to ``most``) are made from ``conv_id``. A base lends its
    first ``most`` turns at most, so what is copied is bounded by the conversations.
    """
    ids = rows.select("conv_id").distinct().select("conv_id", base.alias("_base"), shared.alias("_shared"))
    lent = rows.where(F.col("pos") <= most).select(F.col("conv_id").alias("_of"), "pos", "key", "chars")
    heads = ids.join(lent, F.col("_base") == F.col("_of")).where("pos <= _shared").select("conv_id", "pos", "key", "chars")
    sizes = lent.groupBy("_of").agg(F.count("*").alias("_lent"))
    offsets = ids.join(sizes, F.col("_base") == F.col("_of"), "left").select(F.col("conv_id").alias("_conv"), "_shared", F.least("_shared", F.coalesce("_lent", F.lit(0))).cast("long").alias("_lent"))
    own = rows.join(offsets, F.col("conv_id") == F.col("_conv")).where("pos > _shared")
    return heads.unionByName(own.select("conv_id", (F.col("pos") - F.col("_shared") + F.col("_lent")).alias("pos"), "key", "chars"))

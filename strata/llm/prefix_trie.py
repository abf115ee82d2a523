"""Prefix trie of conversations by van Emde Boas recursion.

Sequences of turns are cut at half depth, again and again. A cut prefix gets a name, a hash of 128 bits, and what lies
under it is a forest of its own that hangs on that name; so the upper trie and the lower forests are named side by side,
each half in its own rows, and no conversation has to lie in one task. Down to blocks of 64 turns the halves are rows of
tables: names of blocks are joined upwards in pairs, names of cut prefixes downwards. Inside a block a task names the
prefixes one after the other.

Totals are grafted upwards along the same cuts. A node at a depth that 2**k divides (and no more) is a root of the lower
half of some cut of 2 * 2**k levels; once everything below it has reported, it reports once, to all its ancestors in the
upper half. So there is a round for each k, with half the nodes of the round before and twice the ancestors each, and
what children of one node report is summed before it is dealt out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import release, small_batches, stored, table

#: Turns of a block, a power of two.
BLOCK = 64
#: The name of the prefix without turns.
ROOT = bytes(16)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv, ...) with part, row and place: their place in the task and in the conversation, as far as it
    lies in the task."""
    part, rows, last, length = TaskContext.get().partitionId(), 0, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        start = np.flatnonzero(np.append(last is None or conv[0] != last, conv[1:] != conv[:-1]))
        place = np.arange(n) + length if not len(start) or start[0] else np.arange(n)
        for_run = np.zeros(n, np.int64)
        for_run[start] = place[start]
        place = place - np.maximum.accumulate(for_run)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(place)], [*batch.schema.names, "part", "row", "place"])
        rows, last, length = rows + n, conv[-1], int(place[-1]) + 1
    release()


def ordered(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, key, bytes) with their place in the conversation, from 0: by turn, nulls first, equal ones by
    key. Tasks hold ranges of all turns, however long a conversation is; one that spans tasks goes on counting where the
    task before stopped, which takes a row for each task on the driver."""
    spread = turns.repartitionByRange("conv", "turn", "key").sortWithinPartitions("conv", "turn", "key").select("conv", "key", "bytes")
    rows = stored(spread.mapInArrow(_placed, "conv long, key binary, bytes long, part int, row long, place long"), "turns")
    ends = rows.groupBy("part").agg(F.min_by("conv", "row").alias("first"), F.max_by(F.struct("conv", "place"), "row").alias("last")).orderBy("part").collect()
    shifts, conv, length = [], None, 0
    for e in ends:
        before = length if e.first == conv else 0
        if before:
            shifts.append((e.part, e.first, before))
        conv, length = e.last.conv, e.last.place + 1 + (before if e.last.conv == e.first else 0)
    kept = rows.select("conv", "key", "bytes", "part", "place")
    if not shifts:
        return kept.drop("part")
    moved = F.broadcast(rows.sparkSession.createDataFrame(shifts, "part int, conv long, shift long"))  # a row for each task at most
    return kept.join(moved, ["part", "conv"], "left").select("conv", "key", "bytes", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"))


def _hash(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _block_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv, block, depth, key) to the names of the whole blocks among them."""
    now, names = None, []
    for batch in batches:
        out = []
        for conv, block, depth, key in zip(*(batch.column(n).to_pylist() for n in ("conv", "block", "depth", "key")), strict=True):
            if now != (conv, block):
                now, names = (conv, block), []
            names.append(key)
            if depth == (block + 1) * BLOCK:
                out.append((conv, block, hashlib.md5(b"".join(names)).digest()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["conv", "block", "name"])


def contexts(blocks: DataFrame, most: int) -> DataFrame:
    """conv, block, context: the name of the prefix before each block but the first. blocks: conv, block (from 0), name,
    no block beyond `most`. Names of 2, 4, 8, ... blocks are made of pairs; then every cut, the largest first, gives the
    lower half the name of the prefix before the cut, which is that before the upper half and the upper half's own."""
    names = [stored(blocks, "names")]
    while 1 << len(names) <= most:
        width = 1 << (len(names) - 1)
        upper = names[-1].where(F.col("block") % (2 * width) == 0)
        lower = names[-1].where(F.col("block") % (2 * width) == width).select("conv", (F.col("block") - width).alias("block"), F.col("name").alias("lower"))
        names.append(stored(upper.join(lower, ["conv", "block"]).select("conv", "block", _hash("name", "lower").alias("name")), "names"))
    known = names[0].select("conv").distinct().select("conv", F.lit(0).cast("long").alias("block"), F.lit(ROOT).alias("context"))
    for k in range(len(names) - 1, -1, -1):
        cut = known.join(names[k], ["conv", "block"]).select("conv", (F.col("block") + (1 << k)).alias("block"), _hash("context", "name").alias("context"))
        known = stored(known.unionByName(cut), "contexts")
    return known.where("block > 0")


_NAMED = "a long, b long, above_a long, above_b long, conv long, depth long, bytes long, last boolean, ups_a array<long>, ups_b array<long>"
_NAMED_NAMES = [x.split()[0] for x in _NAMED.split(", ")]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv, block, depth, key, bytes, total, context, following) to nodes: name, parent's name, and for a
    node of odd depth from which the conversation goes on, the ancestors (itself included) to which its children report,
    as far as they lie in the block. The last node of a whole block is the next block's context."""
    now, names = None, []
    for batch in batches:
        own, above, ups, sizes = [], [], [], []
        for conv, block, depth, key, total, context, following in zip(*(batch.column(n).to_pylist() for n in ("conv", "block", "depth", "key", "total", "context", "following")), strict=True):
            if now != (conv, block):
                now, names = (conv, block), [context or ROOT]
            above.append(names[-1])
            names.append(following if depth == (block + 1) * BLOCK else hashlib.md5(names[-1] + key).digest())
            own.append(names[-1])
            if depth % 2 and depth < total:
                at = len(names)
                ups += names[at - min((depth + 1) & -(depth + 1), BLOCK) : at]
            sizes.append(len(ups))

        def pair(x: list[bytes]) -> list[pa.Array]:
            flat = np.frombuffer(b"".join(x), np.int64).reshape(-1, 2)
            return [pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)]

        offsets = pa.array([0, *sizes], pa.int32())
        last = np.array(batch.column("depth")) == np.array(batch.column("total"))
        arrays = [pa.ListArray.from_arrays(offsets, x) for x in pair(ups)]
        yield pa.RecordBatch.from_arrays([*pair(own), *pair(above), batch.column("conv"), batch.column("depth"), batch.column("bytes"), pa.array(last), *arrays], _NAMED_NAMES)
    release()


def _end_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv) to pieces of each node's ids, joined by commas, with their place: task and number."""
    part, seq, now, ids, size, out = TaskContext.get().partitionId(), 0, None, [], 0, []

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        rows = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, ["a", "b", "part", "seq", "ids"])

    for batch in batches:
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and (now != (a, b) or size >= 4096):
                out.append((*now, part, seq, ",".join(ids)))
                seq, ids, size = seq + 1, [], 0
            now = (a, b)
            ids.append(str(conv))
            size += 1
        if len(out) > 2000:
            yield flush()
    if now:
        out.append((*now, part, seq, ",".join(ids)))
        yield flush()


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (a, b, part, seq, ids) to the hash of each node's ids."""
    now, sha, out = None, None, []

    def flush() -> pa.RecordBatch:
        rows = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, ["a", "b", "ends"])

    for batch in batches:
        for a, b, _, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (a, b):
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        if len(out) > 5000:
            yield flush()
    if now:
        out.append((*now, sha.hexdigest()))
        yield flush()


def end_hashes(ended: DataFrame) -> DataFrame:
    """a, b, ends: the hash of the ids (conv) that end in each node, ascending, joined by commas. Tasks hold ranges of all
    (node, id), so that the ids of one node are written out by many; the hash itself is a chain over their pieces, a row for
    4096 ids, as many as a task has of the node."""
    pieces = ended.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(_end_texts, "a long, b long, part int, seq long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "part", "seq").mapInArrow(_end_hashes, "a long, b long, ends string")


def _sums(rows: DataFrame, *more: Column, by: tuple[str, str] = ("a", "b")) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), *more)


def grafted(stats: DataFrame, named: DataFrame, deepest: int) -> DataFrame:
    """a, b, leaves, saved: for each node the sums of both over its subtree. stats: a, b, above_a, above_b, conv (a
    member), depth, leaves, saved. named: the nodes on each conversation's way (conv, depth, ups_a, ups_b)."""
    reports: list[DataFrame] = []
    nothing = [F.lit(None).cast("long").alias(c) for c in ("above_a", "above_b", "conv")]
    for k in range(deepest.bit_length()):
        step = 1 << k
        turn = F.col("depth") % (2 * step) == step
        own = stats.where(turn).select("a", "b", "above_a", "above_b", "conv", "leaves", "saved", "depth")
        heard = [r.where(turn).select("a", "b", *nothing, "leaves", "saved", "depth") for r in reports]
        whole = _sums(reduce(DataFrame.unionByName, heard, own), *[F.max(c).alias(c) for c in ("above_a", "above_b", "conv", "depth")])
        # Children of one node report to the same ancestors: they are summed first.
        told = _sums(whole, F.min("conv").alias("conv"), (F.min("depth") - 1).alias("depth"), by=("above_a", "above_b"))
        if k == 0:
            told = told.select(F.col("above_a").alias("a"), F.col("above_b").alias("b"), "depth", "leaves", "saved")
        else:
            low = F.col("depth") + 1 - step + min(step, BLOCK) - 1  # the last depth of the first block on the way
            each = told.select("conv", "leaves", "saved", F.explode(F.sequence(low, F.col("depth"), F.lit(min(step, BLOCK)).cast("long"))).alias("depth"))
            way = named.where(F.size("ups_a") > 0).select("conv", "depth", "ups_a", "ups_b")
            way = way.where((F.col("depth") + 1) % BLOCK == 0) if step > BLOCK else way.where((F.col("depth") + 1) % (2 * step) == step)
            met = each.join(way, ["conv", "depth"]).select("leaves", "saved", F.col("depth").alias("end"), F.posexplode(F.arrays_zip("ups_a", "ups_b")).alias("place", "up"))
            rows = met.select(F.col("up.ups_a").alias("a"), F.col("up.ups_b").alias("b"), "leaves", "saved", (F.col("end") + 1 - min(step, BLOCK) + F.col("place")).alias("depth"))
            told = _sums(rows, F.min("depth").alias("depth")).select("a", "b", "depth", "leaves", "saved")
        reports.append(stored(told, "reports"))
    parts = [stats, *reports]
    return _sums(reduce(DataFrame.unionAll, [p.select("a", "b", "leaves", "saved") for p in parts]))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of all sequences: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, a row for each distinct prefix, the empty one included. turns: conv, depth (1 to
    total, without gaps), key (16 bytes that stand for the turn), bytes (of its text), total. convs: conv, total, also
    for conversations without turns. Without convs there is no trie and no row. Everything is summed before it is
    shuffled; the hash of many ids, a chain, is fed with pieces of 4096."""
    spark = turns.sparkSession
    small_batches(spark, 2000)
    deepest = convs.agg(F.max("total")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    turns = turns.withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
    unnamed = [F.lit(None).cast("binary").alias(c) for c in ("context", "following")]
    columns = ["conv", "block", "depth", "key", "bytes", "total"]
    if deepest >= BLOCK:
        long = turns.where(F.col("total") >= BLOCK)
        blocks = long.select("conv", "block", "depth", "key").repartition("conv", "block").sortWithinPartitions("conv", "block", "depth").mapInArrow(_block_names, "conv long, block long, name binary")
        known = contexts(blocks, int(deepest) // BLOCK)
        after = known.select("conv", (F.col("block") - 1).alias("block"), F.col("context").alias("following"))
        met = long.join(known, ["conv", "block"], "left").join(after, ["conv", "block"], "left").select(*columns, "context", "following")
        turns = turns.where(F.col("total") < BLOCK).select(*columns, *unnamed).unionByName(met)
    else:
        turns = turns.select(*columns, *unnamed)
    named = stored(turns.repartition("conv", "block").sortWithinPartitions("conv", "block", "depth").mapInArrow(_names, _NAMED), "named")
    of = [F.min(c).alias(c) for c in ("above_a", "above_b", "depth", "bytes")]
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv", "n", *[F.lit(None if c.startswith("above") else 0).cast("long").alias(c) for c in ("above_a", "above_b", "depth", "bytes")])
    nodes = stored(named.groupBy("a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), *of).unionByName(root), "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("above_a").alias("a"), F.col("above_b").alias("b")).agg(F.count("*").alias("children"))
    parents = nodes.select(F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("conv").alias("parent"))
    counted = nodes.join(kids, ["a", "b"], "left").join(parents, ["above_a", "above_b"], "left")
    stats = stored(counted.select("a", "b", "above_a", "above_b", "conv", "parent", "depth", "n", F.coalesce("children", F.lit(0)).alias("children"), F.col("children").isNull().cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved")), "stats")
    ended = named.where("last").select("a", "b", "conv").unionByName(convs.where("total = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv"))
    ends = end_hashes(stored(ended, "ended"))
    sums = grafted(stats, named, int(deepest)).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    done = stats.join(sums, ["a", "b"]).join(ends, ["a", "b"], "left")
    return done.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def light_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, key, bytes: a key of 128 bits for role and text, and the bytes of the text, which is not read again.
    Null roles and texts are empty; rows without conversation take no part. Other columns are not read."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv).isNotNull())
    return stored(rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), _hash(F.length(r).cast("string"), F.lit(":"), r, t).alias("key"), F.octet_length(t).cast("long").alias("bytes")), "light")


def in_order(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The turns and conversations of a table as they are, for prefix_trie."""
    turns = ordered(light_turns(conversations, **columns))
    convs = stored(turns.groupBy("conv").agg(F.count("*").alias("total")), "convs")
    return turns.join(convs, "conv").select("conv", (F.col("place") + 1).alias("depth"), "key", "bytes", "total"), convs


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations for prefix_trie, in which conversation c begins with the first h turns of conversation
    c - c % 5 (all if it has fewer, none if there is none; % has the sign of c), h = crc32(c) % 9, and goes on with its
    own turns after its first h."""
    turns = ordered(light_turns(conversations))
    sizes = stored(turns.groupBy("conv").agg(F.count("*").alias("own")), "sizes")
    lent = F.crc32(F.col("conv").cast("string")) % 9
    plan = sizes.select("conv", "own", lent.alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    there = sizes.select(F.col("conv").alias("base"), F.col("own").alias("most"))
    begun = F.least("h", F.coalesce("most", F.lit(0)))
    plan = stored(plan.join(there, "base", "left").select("conv", "h", "base", begun.alias("begun"), (begun + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "plan")
    own = turns.join(plan, "conv").where("place >= h").select("conv", (F.col("begun") + F.col("place") - F.col("h") + 1).alias("depth"), "key", "bytes", "total")
    first = turns.where("place < 8").withColumnRenamed("conv", "base")  # h is 8 at most
    taken = first.join(plan, "base").where("place < h").select("conv", (F.col("place") + 1).alias("depth"), "key", "bytes", "total")
    return own.unionByName(taken), plan.select("conv", "total")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))

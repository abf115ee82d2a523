"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import release, shared_dir, slices, small_batches, table
from strata.llm.encoding import text_ids, vocabulary

MAGIC = 0x31444954
#: Bytes of the four values that each control byte describes, two bits a value.
WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def _places(sizes: np.ndarray) -> np.ndarray:
    """Where each value's width stands among those of all control bytes: a document's first control byte is its own."""
    groups = -(-sizes // 4)
    return np.arange(int(sizes.sum())) + np.repeat(4 * (np.cumsum(groups) - groups) - (np.cumsum(sizes) - sizes), sizes)


def encode_ranks(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of the 32-bit values of documents, `sizes` values each; where each document's control
    bytes and data bytes begin (and after the last, the end)."""
    widths = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control_at = np.concatenate([[0], np.cumsum(-(-sizes // 4))])
    padded = np.zeros(4 * int(control_at[-1]), np.uint8)
    padded[_places(sizes)] = widths - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < widths[:, None]]
    return control, control_at, data, np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], np.cumsum(sizes)])]


def decode_ranks(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The values back, by table lookup: widths of all values from the control bytes, places by prefix sums."""
    widths = WIDTHS[np.frombuffer(control, np.uint8)].ravel()[_places(sizes)]
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))
    at = np.cumsum(widths) - widths
    values = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(widths > k)
        values[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def encode_block(keys: list[int | None], sizes: np.ndarray, control: bytes, data: bytes) -> bytes:
    """Header (magic, documents, ids, control bytes), keys and their null marks, ids per document, control bytes and data
    bytes of the ranks of all documents."""
    head = np.array([MAGIC, len(keys), sizes.sum(), len(control)], "<u4").tobytes()
    null = np.array([k is None for k in keys], np.uint8)
    return b"".join([head, np.array([k or 0 for k in keys], "<i8").tobytes(), null.tobytes(), sizes.astype("<u4").tobytes(), control, data])


def decode_block(block: bytes, by_rank: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, ids per document and all ids. by_rank: the id of each rank."""
    magic, docs, n, controls = np.frombuffer(block, "<u4", 4).tolist()
    sizes = np.frombuffer(block, "<u4", docs, 16 + 9 * docs).astype(np.int64)
    if magic != MAGIC or sizes.sum() != n:
        raise ValueError("not a block of token ids")
    null = np.frombuffer(block, np.uint8, docs, 16 + 8 * docs)
    keys = [None if x else k for k, x in zip(np.frombuffer(block, "<i8", docs, 16).tolist(), null, strict=True)]
    at = 16 + 13 * docs
    return keys, sizes, by_rank[decode_ranks(block[at : at + controls], block[at + controls :], sizes)]


def _binary(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Byte strings between neighbouring places of flat."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of little-endian unsigned 32-bit ids, and their number in each row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<u4")[at[0] // 4 : at[-1] // 4], np.diff(at) // 4


def _token_ids(docs: DataFrame, path: str, folder: str, end: int, text: str, key: str) -> DataFrame:
    """Write key, h (hash of the text) and ids of every document, the id `end` last; each text is tokenised once. The last
    row of a task has no document but counts: how often the task has seen each id, as 64-bit numbers."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in slices(batches):
            ids, at = text_ids(part.column(1), path)
            flat = np.insert(ids, at[1:], end).astype("<u4")
            n = np.bincount(flat, minlength=len(total))
            n[: len(total)] += total
            total = n
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _binary(flat, 4 * (at + np.arange(len(at)))), pa.nulls(part.num_rows, pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)
        release()

    names = ["key", "h", "ids", "counts"]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    schema = "key long, h long, ids binary, counts binary"
    rows.mapInArrow(tokenised, schema).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def _ranked(tokens: DataFrame, folder: str) -> None:
    """Write rank, id: the ids by their number in all documents, the most frequent first, ties to the smaller id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0):
                total = np.frombuffer(one.as_py(), "<i8")
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    counts = tokens.where("counts is not null").select("counts").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1  # over the ids of a vocabulary
    counts.select(place.alias("rank"), "id").write.parquet(folder)


def _by_rank(spark: SparkSession, folder: str) -> np.ndarray:
    """The id of each rank: as many as the vocabulary has at most."""
    return np.array([r.id for r in spark.read.schema("rank int, id long").parquet(folder).orderBy("rank").collect()], np.uint32)


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = 2, text: str = "text", key: str = "doc_id", block_ids: int = 1 << 20) -> None:
    """Write the ids of all texts, each with the id `end` after it, in ascending order of key (nulls first, equal keys
    by a hash of their text, then by their codes).

    Every text is tokenised once, into the table folder/ids. Ids are counted on the way; folder/ranks has them by frequency. folder/blocks has the ranks of documents in order: blocks (shard, block, n_docs, n_ids, payload)
    of about `block_ids` ids, more only for a longer document. Spark's committer writes all three."""
    spark = docs.sparkSession
    small_batches(spark)
    tokens = _token_ids(docs, path, f"{folder}/ids", end, text, key)
    _ranked(tokens, f"{folder}/ranks")
    by_rank = _by_rank(spark, f"{folder}/ranks")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)  # a number for each id of the vocabulary

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 4 << 20):
            ids, sizes = _ids(part.column(2))
            control, control_at, data, data_at = encode_ranks(sent.value[ids], sizes)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), _binary(control, control_at), _binary(data, data_at)], ["key", "h", "n_ids", "control", "data"])
        release()

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        sizes: list[int] = []
        control: list[bytes] = []
        data: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            payload = encode_block(keys, np.array(sizes, np.int64), b"".join(control), b"".join(data))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], ["shard", "block", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for k, n, c, d in zip(*(batch.column(name) for name in ("key", "n_ids", "control", "data")), strict=True):
                keys.append(k.as_py())
                sizes.append(n.as_py())
                control.append(c.as_py())
                data.append(d.as_py())
                held += sizes[-1]
                if held >= block_ids:
                    yield flush()
                    number, keys, sizes, control, data, held = number + 1, [], [], [], [], 0
        if keys:
            yield flush()
        release()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes = tokens.where("ids is not null").select("key", "h", "ids").mapInArrow(coded, "key long, h long, n_ids long, control binary, data binary")
    order = [F.col("key").asc_nulls_first(), "h"]  # equal keys may go to several shards, in order
    ordered = codes.repartitionByRange(n, *order).sortWithinPartitions(*order, "data", "control")
    ordered.mapInArrow(blocked, "shard int, block long, n_docs long, n_ids long, payload binary").write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: shard, block, doc (its place in the block), key, before (ids before it in the block),
    n_tokens, ids (little-endian unsigned 32-bit)."""
    sent = spark.sparkContext.broadcast(_by_rank(spark, f"{folder}/ranks"))  # a number for each id of the vocabulary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(*batch.columns, strict=True):
                keys, sizes, ids = decode_block(payload.as_py(), sent.value)
                shard, number, at = shard.as_py(), number.as_py(), np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(keys), pa.int32()), pa.array([number] * len(keys), pa.int64()), pa.array(range(len(keys)), pa.int64()), pa.array(keys, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(sizes, pa.int64()), _binary(ids.astype("<u4"), 4 * at)],
                    ["shard", "block", "doc", "key", "before", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "payload")
    return blocks.mapInArrow(read, "shard int, block long, doc long, key long, before long, n_tokens long, ids binary")


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids before each block, from prefix sums over shards and then over the blocks of each: shard, block, block0."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "n_ids")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard0"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(shards, "shard").select("shard", "block", (F.col("shard0") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("block0"))


def token_file_round_trip(docs: DataFrame, path: str, end: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write docs as token files in the shared folder, read them back, and return per document: key, start (ids of all
    documents before it), n_tokens (with the end id), ids_crc32.

    Null texts count as empty (the end id alone). Equal keys are ordered by a hash of their text and then the text;
    null keys come first; an empty table gives no rows. Other columns of docs are not read."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/strata-token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, folder, end, text, key)
    digest = F.crc32("ids").alias("ids_crc32")
    read = read_token_files(spark, folder).select("shard", "block", "key", "before", "n_tokens", digest)
    return read.join(block_starts(spark, folder), ["shard", "block"]).select(F.col("key").alias(key), (F.col("block0") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))

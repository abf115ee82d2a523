"""What the operators of this subpackage share: table reading, shared scratch tables, Arrow batches and word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: ASCII white space: 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII characters that are neither letters nor digits separate words, too.
PUNCT = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_GRAM = _rng.integers(1, 2**63, 16, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_UNBASE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: The C library, where it can trim its heap.
_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-strata-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing
    that came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Spark hand at most so many rows at a time to Arrow functions in this session (a smaller setting stays): batches
    are counted in rows, and rows with texts or sets of shingles are large on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers live on, and keep what their heaps held."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about `target` bytes of the given text column (at least a row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // target)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers


def word_spans(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of every word; rows end words."""
    solid = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.empty_like(solid), np.empty_like(solid)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = ~solid[:-1] | edge[1:-1]
        after[:-1] = ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))


def word_hashes(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, off, gaps)
    return span_hashes(data, starts, ends, fold), rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of every span, A-Z lower-cased if fold. Polynomial prefix sums modulo 2**64 over random byte
    codes, brought to position 0 by the inverse power, then mixed with the length."""
    up, down = _power_tables(max(1, len(data)))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[LOWER[data] if fold else data] * up[: len(data)], dtype=U64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words and their rows. A row with fewer words, but one at least, gives the run of
    all its words."""
    per_row = np.bincount(rows, minlength=n_rows)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        value = np.zeros(n, U64)
        for k in range(width):
            value += hashes[k : n + k] * _GRAM[k]
        whole = rows[:n] == rows[width - 1 :]
        value, owner = mix(value[whole]), rows[:n][whole]
    else:
        value, owner = np.zeros(0, U64), np.zeros(0, rows.dtype)
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per_row)])[short]
        extra = np.zeros(len(short), U64)
        for k in range(width - 1):
            has = per_row[short] > k
            extra[has] += hashes[first[has] + k] * _GRAM[k]
        value = np.concatenate([value, mix(extra + per_row[short].astype(U64) * _GRAM[15])])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def sorted_set(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if not len(values):
        return values
    new = np.empty(len(values), bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct shingle hashes."""
    n_rows = len(off) - 1
    value, owner = shingles(*word_hashes(data, off), n_rows, width)
    cuts = np.searchsorted(owner, np.arange(n_rows + 1))
    return [sorted_set(value[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

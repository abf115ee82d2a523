"""Packing token sequences into windows by non-negative least squares over length combinations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import release, slices, stored, table
from strata.llm.encoding import encoder, text_ids, vocabulary

#: A slot: the documents of one tail length whose ranks lie in [low, high) put `length` ids from `start` of their tail
#: into sequence `sequence + rank - low` at `offset`.
SLOT = ("tail", "low", "high", "start", "length", "sequence", "offset")


def combinations(window: int, depth: int = 4) -> list[dict[int, int]]:
    """Shallow combinations of lengths that fill the window: up to `depth` equal ones and one more."""
    found = [{a: k, window - k * a: 1} for k in range(1, depth + 1) for a in range(1, (window - 1) // k + 1) if window - k * a != a]
    found += [{window // k: k} for k in range(2, depth + 2) if window % k == 0]
    return list({tuple(sorted(c.items())): c for c in found}.values())


def nnls(columns: list[dict[int, int]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings A x near the target (least squares): accelerated projected gradient on the sparse columns."""
    row = np.array([a for c in columns for a in c])
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    val = np.array([float(k) for c in columns for k in c.values()])
    norm = np.bincount(row, val, len(target)).max() * np.bincount(col, val, len(columns)).max()
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        gap = np.bincount(row, val * y[col], len(target)) - target
        new = np.maximum(0, y - np.bincount(col, val * gap[row], len(columns)) / norm)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


class _Stock:
    """Tails not yet placed, by their length now: intervals of ranks of an original tail length, and how many ids of
    their front are placed."""

    def __init__(self, histogram: np.ndarray):
        self.held = {n: [(n, 0, int(c), 0)] for n, c in enumerate(histogram) if n and c}
        self.count = histogram.astype(np.int64).copy()
        self.count[0] = 0

    def take(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        self.count[length] -= number
        got, held = [], self.held[length]
        while number:
            tail, low, high, start = held.pop()
            n = min(number, high - low)
            if high - low > n:
                held.append((tail, low + n, high, start))
            got.append((tail, low, low + n, start))
            number -= n
        return got

    def put(self, length: int, items: list[tuple[int, int, int, int]]) -> None:
        self.held.setdefault(length, []).extend(items)
        self.count[length] += sum(high - low for _, low, high, _ in items)


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, ...]], int]:
    """Slots for all tails, and the number of sequences. histogram: tails by length, 0 to window - 1.

    Non-negative least squares over shallow combinations give how often to use each; rounded, the largest first, as far
    as the tails last. What is left is packed greedily, the longest first with the longest that fit; where none fits
    exactly, a longer tail is cut. The last tails, fewer ids than a window, are cut into powers of two, which need no
    padding. All of it works on counts by length, so that its cost does not depend on the number of documents."""
    stock, slots, sequences = _Stock(histogram), [], 0

    def place(parts: list[tuple[int, int]], number: int) -> None:
        """Fill `number` sequences with parts (length now, ids used of it); what is left of cut ones goes back."""
        nonlocal sequences
        offset = 0
        for length, used in parts:
            first, back = sequences, []
            for tail, low, high, start in stock.take(length, number):
                slots.append((tail, low, high, start, used, first, offset))
                back.append((tail, low, high, start + used))
                first += high - low
            if length > used:
                stock.put(length - used, back)
            offset += used
        sequences += number

    columns = [c for c in combinations(window) if all(histogram[n] >= k for n, k in c.items())]
    if columns:
        times = nnls(columns, histogram.astype(float))
        for j in np.argsort(-times, kind="stable"):
            number = min(int(times[j] + 0.5), *(int(stock.count[n]) // k for n, k in columns[j].items()))
            if number > 0:
                place([(n, n) for n, k in columns[j].items() for _ in range(k)], number)
    lengths = np.arange(window)
    while (left := int(stock.count @ lengths)) >= window:
        free, parts, room = stock.count.copy(), [], window
        while room and (fits := np.flatnonzero(free[1 : room + 1])).size:
            length = int(fits[-1]) + 1
            free[length] -= 1
            parts.append((length, length))
            room -= length
        if room:
            length = int(np.argmax(free))
            parts.append((length, room))
        needs = {n: sum(length == n for length, _ in parts) for n, _ in parts}
        place(parts, min(int(stock.count[n]) // k for n, k in needs.items()))
    sizes = [1 << b for b in range(window.bit_length(), -1, -1) if left >> b & 1]
    for size in sizes:
        parts, room = [], size
        free = stock.count.copy()
        while room:
            length = int(np.flatnonzero(free)[-1])
            free[length] -= 1
            parts.append((length, min(room, length)))
            room -= parts[-1][1]
        place(parts, 1)
    return slots, sequences


def _by_rank(slots: list[tuple[int, ...]]) -> dict[int, tuple[np.ndarray, list[list[tuple[int, ...]]]]]:
    """Per tail length: where runs of ranks with the same slots begin, and each run's slots."""
    found = {}
    for tail in {s[0] for s in slots}:
        mine = sorted(s[1:] for s in slots if s[0] == tail)
        edges = sorted({e for s in mine for e in s[:2]})
        at = {e: k for k, e in enumerate(edges)}
        runs: list[list[tuple[int, ...]]] = [[] for _ in edges]
        for low, high, start, length, sequence, offset in mine:
            for k in range(at[low], at[high]):
                runs[k].append((start, length, sequence - low, offset))
        found[tail] = np.array(edges), [sorted(r) for r in runs]
    return found


def pack(docs: DataFrame, path: str, window: int = 1024, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack the token ids of all texts, each followed by the id `end`, into sequences of at most `window` ids.

    Whole windows of a document are sequences of their own; its tail is placed by `plan`, from the histogram of tail
    lengths (window - 1 counts, all that reaches the driver). Ranks among tails of one length come from ranks within a
    task and prefix sums of the tasks' counts, so no length, however frequent, meets in one task.

    Returns one row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each id of each document
    lies in exactly one piece; every sequence is full but the last few, whose sizes are powers of two. Null and empty
    texts are documents of the end id alone; repeated rows and null keys are packed each; an empty table gives none.
    Other columns of docs are not read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, full_seen = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for part in slices(batches):
            ids, ends = text_ids(part.column(1), path)
            kind = "<u2" if len(encoder(path).opens) <= 65536 and end < 65536 else "<u4"
            n, crcs, tails, tail_crc = [], [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                whole = len(own) // window * window
                n.append(len(own))
                crcs.append([zlib.crc32(own[k : k + window].tobytes()) for k in range(0, whole, window)])
                tails.append(own[whole:].astype(kind).tobytes())
                tail_crc.append(zlib.crc32(own[whole:].tobytes()))
            count = np.array(n)
            tail, whole = count % window, count // window
            order = np.argsort(tail, kind="stable")
            inner = np.empty(len(tail), np.int64)
            inner[order] = np.arange(len(tail)) - np.searchsorted(tail[order], tail[order])
            seq = seen[tail] + inner
            seen += np.bincount(tail, minlength=window)
            before = full_seen + np.cumsum(whole) - whole
            full_seen += int(whole.sum())
            same = pa.array(np.full(len(n), task), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(count, pa.int64()), pa.array(tail, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(tail_crc, pa.int64()), same, pa.array(seq, pa.int64()), pa.array(before, pa.int64())],
                ["key", "n", "tail", "crcs", "ids", "tail_crc", "task", "seq", "before"])
        release()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    cuts = stored(rows.mapInArrow(cut, "key long, n long, tail long, crcs array<long>, ids binary, tail_crc long, task int, seq long, before long"), "cut")
    counts = cuts.groupBy("tail", "task").agg(F.count("*").alias("c"), F.sum(F.size("crcs")).alias("f"))
    histogram = np.zeros(window, np.int64)
    for tail, c in counts.groupBy("tail").agg(F.sum("c")).collect():  # at most `window` rows
        histogram[tail] = c
    slots, sequences = plan(histogram, window)
    runs = _by_rank(slots)
    parted = sorted({s[0] for s in slots if s[4] != s[0]})  # lengths of which some tails are cut

    ahead = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("tail", "task", F.coalesce(F.sum("c").over(ahead.partitionBy("tail")), F.lit(0)).alias("rank0"))
    fulls = counts.groupBy("task").agg(F.sum("f").alias("f")).select("task", F.coalesce(F.sum("f").over(ahead), F.lit(0)).alias("full0"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            out = []
            for doc, n, tail, crcs, ids, tail_crc, rank, full in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(doc, k * window, window, crc, n, sequences + full + k, 0) for k, crc in enumerate(crcs)]
                if tail:
                    edges, kept = runs[tail]
                    for start, length, sequence, offset in kept[int(np.searchsorted(edges, rank, "right")) - 1]:
                        if length == tail:
                            crc = tail_crc
                        else:
                            kind = kind or ("<u2" if len(ids) == 2 * tail else "<u4")
                            crc = zlib.crc32(np.frombuffer(ids, kind)[start : start + length].astype("<u4").tobytes())
                        out.append((doc, n - tail + start, length, crc, n, sequence + rank, offset))
            for a in range(0, len(out), 50_000):
                cols = list(zip(*out[a : a + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = (
        cuts.withColumn("ids", F.when(F.col("tail").isin(parted), F.col("ids")) if parted else F.lit(None).cast("binary"))
        .join(ranks, ["tail", "task"]).join(fulls, "task")
        .select("key", "n", "tail", "crcs", "ids", "tail_crc", (F.col("rank0") + F.col("seq")).alias("rank"), (F.col("full0") + F.col("before")).alias("full"))
    )
    return placed.mapInArrow(pieces, "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("key", key)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))

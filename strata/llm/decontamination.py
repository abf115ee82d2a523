"""Benchmark decontamination: pigeonhole edit matching on words, verified by Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import PUNCT, U64, mix, release, slices, small_batches, span_hashes, stored, table, text_bytes, word_spans

_STEP = 0xD6E8FEB86659FD93
_UNSTEP = pow(_STEP, -1, 2**64)


def folded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts and where each text's words begin. Words are runs of letters, digits and
    non-ASCII characters; A-Z and the capitals of Latin-1 are lower-cased."""
    data, off = text_bytes(column)
    data = data.copy()
    if len(data):
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[capital] += 0x20
    starts, ends, rows = word_spans(data, off, PUNCT)
    return span_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(off)))


def search(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance between the pattern and any part of the text, and where the first such part ends
    (Myers, one machine operation per text symbol on as many bits as the pattern has symbols)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for k, symbol in enumerate(pattern):
        places[symbol] = places.get(symbol, 0) | 1 << k
    up, down, score, best, end = full, 0, m, m, 0
    for j, symbol in enumerate(text):
        equal = places.get(symbol, 0)
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        more, less = down | ~(diagonal | up) & full, up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = (less | ~(vertical | more)) & full, more & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Test items as word hashes, with the hashes of their pieces by piece length."""

    def __init__(self, keys: list[int], words: list[np.ndarray], rate: float, min_words: int):
        kept = [(k, w) for k, w in zip(keys, words, strict=True) if len(w) >= max(1, min_words)]
        self.keys, self.words = [k for k, _ in kept], [w.tolist() for _, w in kept]
        self.budget = [int(rate * len(w)) for _, w in kept]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item, (_, w) in enumerate(kept):
            cuts = np.linspace(0, len(w), self.budget[item] + 2).astype(int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found.setdefault(b - a, []).append((int(run_hashes(w[a:b], b - a)[0]), item, a))
        self.pieces = {}
        for length, rows in found.items():
            rows.sort()
            self.pieces[length] = tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (U64, np.int64, np.int64), strict=True))
        self.maybe = {n: np.zeros(1 << 16, bool) for n in self.pieces}
        for n, (hashes, _, _) in self.pieces.items():
            self.maybe[n][hashes & U64(0xFFFF)] = True


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    value = np.zeros(n, U64)
    for k in range(length):
        value = value * U64(_STEP) + words[k : n + k]
    return mix(value)


def find(column: pa.Array, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, word after the last) of the best place of each item in each text that has it
    within the item's budget. With one piece more than errors, one piece at least is hit exactly; around each hit the
    whole item is searched for."""
    words, begin = folded_words(column)
    places: dict[tuple[int, int], set[int]] = {}
    for length, (hashes, owner, at) in items.pieces.items():
        runs = run_hashes(words, length)
        some = np.flatnonzero(items.maybe[length][runs & U64(0xFFFF)])
        low, high = np.searchsorted(hashes, runs[some], "left"), np.searchsorted(hashes, runs[some], "right")
        hit = high > low
        rows = np.searchsorted(begin, some, "right") - 1
        for place, row, a, b in zip(some[hit].tolist(), rows[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
            if place + length <= begin[row + 1]:
                for k in range(a, b):
                    places.setdefault((row, int(owner[k])), set()).add(place - int(at[k]))
    out = []
    for (row, item), starts in places.items():
        pattern, budget, best = items.words[item], items.budget[item], None
        first, last = int(begin[row]), int(begin[row + 1])
        reach, windows = len(pattern) + 2 * budget, []
        for s in sorted(starts):
            low, high = max(first, s - budget), min(last, s + len(pattern) + budget)
            if windows and low <= windows[-1][1] and high - windows[-1][0] <= 4 * reach:
                windows[-1][1] = high
            else:
                windows.append([low, high])
        for low, high in windows:
            text = words[low:high].tolist()
            distance, end = search(pattern, text)
            if distance <= budget and (best is None or distance < best[0]):
                back = search(pattern[::-1], text[:end][::-1])[1]
                best = distance, low + end - back - first, low + end - first
        if best:
            out.append((row, item, *best))
    return out


def blocks(items: DataFrame, rate: float, min_words: int, text: str, key: str, block_words: int) -> Iterator[tuple[bool, Items]]:
    """The items in blocks of about `block_words` words, each of which may be broadcast, and whether there are others; the
    driver has one at a time."""
    small_batches(items.sparkSession)
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // (2 * block_words) + 1  # a word takes two characters at least, with the gap after it
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == b).distinct().orderBy("key", "text").toArrow().combine_chunks()
        if part.num_rows:
            words, begin = folded_words(part.column("text").combine_chunks())
            block = Items(part.column("key").to_pylist(), [words[a:z] for a, z in zip(begin[:-1], begin[1:], strict=True)], rate, min_words)
            if block.pieces:
                yield n > 1, block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.2, min_words: int = 1, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", block_words: int = 2_000_000) -> DataFrame:
    """Documents that hold a test item with at most floor(rate * words) word edits (insertions, deletions, changes).

    Returns one row per input row and item that it holds: key, item key, n_errors (the least), first_word and end_word
    of the first such place. Case and punctuation don't count. Items too short for an error must be there exactly;
    those of fewer than `min_words` words, items without words, null items and null item keys are never found. Null and empty texts hold none; repeated rows are
    judged each; equal items with several keys are each reported. Other columns are not read. Items reach the tasks in
    blocks of bounded size, one pass over the documents each."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    schema = "key long, item long, n_errors int, first_word long, end_word long"
    found = None
    for more, block in blocks(items, rate, min_words, item_text, item_key, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def judge(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, target=1 << 20):
                if hits := find(part.column(1), sent.value):
                    row, item, *rest = map(list, zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([sent.value.keys[k] for k in item], pa.int64()), pa.array(rest[0], pa.int32()), pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.int64())], ["key", "item", "n_errors", "first_word", "end_word"])
            release()

        one = rows.mapInArrow(judge, schema)
        if more:  # one block after the other: what it finds is written, and it leaves the executors
            one = stored(one, "leaks")
            sent.destroy()
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("key", key).withColumnRenamed("item", item_key)


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = 0.2, min_words: int = 1, text: str = "text", item_text: str = "text", item_key: str = "item_id", block_words: int = 2_000_000) -> DataFrame:
    """docs, all columns, without the rows that `contaminated` reports; no shuffle. Several blocks of items take a stored
    table each."""
    place, schema = docs.columns.index(text), docs.schema
    for more, block in blocks(items, rate, min_words, item_text, item_key, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, place, 1 << 20):
                clean = np.ones(part.num_rows, bool)
                clean[[hit[0] for hit in find(part.column(place), sent.value)]] = False
                yield part.filter(pa.array(clean))
            release()

        docs = docs.mapInArrow(keep, schema)
        if more:
            docs = stored(docs, "clean")
            sent.destroy()
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import PUNCT, U64, mix, release, slices, small_batches, span_hashes, table, text_bytes, word_spans

#: Frequent function words, by which a text's language is told (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in a is that it for was on are as with be this by from at or an which not have",
    "de": "der die das und in den von zu mit ist des im nicht ein eine dem auf für als auch es an wird sich",
    "fr": "le la les de des et un une du en que qui dans pour est sur au par pas plus ce il elle avec",
    "es": "el la los las de y en que un una por con del se para es como al lo más su no pero sus",
}
LANGUAGES = [*FUNCTION_WORDS, ""]


#: First and last bytes of a word that count as parts of it, as inflected forms share them.
ENDS = 4


def _buckets_of(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word of every text, of its beginning and of its end, and how many words each text has."""
    data, off = text_bytes(column)
    starts, ends, rows = word_spans(data, off, PUNCT)
    spans = (starts, ends, U64(0)), (starts, np.minimum(ends, starts + ENDS), U64(0x5851F42D4C957F2D)), (np.maximum(starts, ends - ENDS), ends, U64(0x14057B7EF767814F))
    found = [mix(span_hashes(data, a, b) ^ kind) % U64(buckets) for a, b, kind in spans]
    return np.stack(found, 1).astype(np.int32), np.bincount(rows, minlength=len(off) - 1)


@dataclass
class Cnn:
    """Windows of 1, 2, ... words, rectified, their maxima over the whole text, and a linear layer. A word's vector is
    the sum of the hashed embeddings of the word, its beginning and its end. Only buckets that `least` texts of the
    sample share have a vector; all others, and the padding after each text, have row 0, which stays zero."""

    buckets: int = 1 << 22
    dims: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    least: int = 3
    seed: int = 7
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def begin(self, known: np.ndarray) -> None:
        """Random weights and a vector for each of the known buckets."""
        rng = np.random.default_rng(self.seed)
        self.known = known
        w = self.weights = {"e": rng.normal(0, 0.1, (len(known) + 1, self.dims)).astype(np.float32)}
        w["e"][0] = 0
        for n in self.widths:
            w[f"k{n}"] = rng.normal(0, 1 / np.sqrt(n * self.dims), (n, self.dims, self.filters)).astype(np.float32)
            w[f"b{n}"] = np.zeros(self.filters, np.float32)
        w["out"] = rng.normal(0, 0.3, len(self.widths) * self.filters).astype(np.float32)
        w["bias"] = np.full(1, -2, np.float32)

    def lookups(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and language of every bucket."""
        row, language = np.zeros(self.buckets, np.int32), np.full(self.buckets, len(LANGUAGES) - 1, np.int8)
        row[self.known] = np.arange(1, len(self.known) + 1)
        for k, words in enumerate(FUNCTION_WORDS.values()):
            b = _buckets_of(pa.array([words]), self.buckets)[0][:, 0]
            language[b[language[b] == len(LANGUAGES) - 1]] = k  # a word of two languages counts for the first
        return row, language

    def padded(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with padding after each text, where each text begins there, and its windows' number."""
        pad = max(self.widths) - 1
        windows = np.maximum(counts, 1)
        begin = np.cumsum(windows + pad) - windows - pad
        out = np.zeros((int((windows + pad).sum()), 3), np.int32)
        out[np.arange(len(rows)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)] = rows
        return out, begin, windows

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        seq, begin, windows = self.padded(rows, counts)
        w, f, size = self.weights, self.filters, len(seq)
        total = np.full(len(counts), w["bias"][0], np.float64)
        if not len(counts):
            return total
        vectors = w["e"][seq[:, 0]]
        for j in (1, 2):
            vectors += w["e"][seq[:, j]]
        owned = np.zeros(size, bool)
        owned[np.arange(int(windows.sum())) + np.repeat(begin - (np.cumsum(windows) - windows), windows)] = True
        for at, n in enumerate(self.widths):
            value = vectors @ w[f"k{n}"][0]
            for j in range(1, n):
                value[: size - j] += vectors[j:] @ w[f"k{n}"][j]
            value[~owned] = -np.inf
            total += np.maximum(np.maximum.reduceat(value, begin) + w[f"b{n}"], 0) @ w["out"][at * f : (at + 1) * f]
        return total

    def languages(self, words: np.ndarray, counts: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The language with most function words; the last entry if there are none."""
        k = len(LANGUAGES)
        texts = np.repeat(np.arange(len(counts)), counts)
        votes = np.bincount(texts * k + language[words[:, 0]], minlength=len(counts) * k).reshape(-1, k)[:, : k - 1]
        return np.where(votes.max(1) > 0, votes.argmax(1), k - 1)

    def scores(self, words: np.ndarray, counts: np.ndarray, lookups: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probability-like scores: 0.5 is the calibrated threshold of the text's own language."""
        if not self.weights:
            return np.zeros(len(counts))
        row, language = lookups
        z = self.logits(row[words], counts) - self.offsets[self.languages(words, counts, language)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, words: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, decay: float = 1e-3) -> Cnn:
        """Adam on the logistic loss; only the windows that reach a maximum have gradients. A fifth of the sample sets
        the thresholds by language and takes no part before."""
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(words))
        held, used = order[: len(order) // 5], order[len(order) // 5 :]
        seen, times = np.unique(np.concatenate([np.unique(words[i]) for i in used] or [np.zeros(0, np.int32)]), return_counts=True)
        self.begin(seen[times >= self.least])
        row, _ = self.lookups()
        rows_of = {i: row[words[i]] for i in used}
        w, f = self.weights, self.filters
        first = {k: np.zeros_like(v) for k, v in w.items()}
        second = {k: np.zeros_like(v) for k, v in w.items()}
        step = 0
        heavy = np.clip((labels[used] == 0).sum() / max(1, (labels[used] == 1).sum()), 1, 8) ** 0.5
        for epoch in range(epochs):
            used = rng.permutation(used)
            for a in range(0, len(used), batch):
                mine = used[a : a + batch]
                counts = np.array([len(words[i]) for i in mine])
                seq, begin, windows = self.padded(np.concatenate([rows_of[i] for i in mine]), counts)
                grad = {k: np.zeros_like(v) for k, v in w.items() if k != "e"}
                pooled, where = [], []
                rows = w["e"][seq].sum(1)
                for n in self.widths:
                    value = rows @ w[f"k{n}"][0]
                    for j in range(1, n):
                        value[: len(seq) - j] += rows[j:] @ w[f"k{n}"][j]
                    top = np.array([value[b : b + c].argmax(0) + b for b, c in zip(begin, windows, strict=True)])
                    where.append(top)
                    pooled.append(np.take_along_axis(value, top, 0) + w[f"b{n}"])
                pooled = np.concatenate(pooled, 1)
                shown = np.maximum(pooled, 0)
                drop = rng.random(shown.shape[1]) > 0.2  # whole filters rest by turns
                p = 1 / (1 + np.exp(-np.clip(shown * drop @ w["out"] / 0.8 + w["bias"], -30, 30)))
                gap = (p - labels[mine]) * np.where(labels[mine] == 1, heavy, 1) / len(mine)
                grad["out"], grad["bias"] = (shown * drop).T @ gap / 0.8 + decay * w["out"], np.array([gap.sum()])
                back = gap[:, None] * w["out"] * drop / 0.8 * (pooled > 0)
                touched, pulls = [], []
                for at, n in enumerate(self.widths):
                    g = back[:, at * f : (at + 1) * f]
                    grad[f"b{n}"] = g.sum(0)
                    for j in range(n):
                        place = where[at] + j
                        grad[f"k{n}"][j] = np.einsum("ifd,if->df", rows[place], g) + decay * w[f"k{n}"][j]
                        touched.append(seq[place].reshape(-1, 3))
                        pulls.append((g[:, :, None] * w[f"k{n}"][j].T[None]).reshape(-1, self.dims))
                hit, back_to = np.unique(np.concatenate(touched), return_inverse=True)
                sums, pulled = np.zeros((len(hit), self.dims), np.float32), np.concatenate(pulls)
                for j in range(3):
                    np.add.at(sums, back_to.reshape(-1, 3)[:, j], pulled)
                sums[hit == 0] = 0
                step += 1
                bent = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] -= bent * first[k] / (np.sqrt(second[k]) + 1e-8)
                first["e"][hit] = 0.9 * first["e"][hit] + 0.1 * sums
                second["e"][hit] = 0.999 * second["e"][hit] + 0.001 * sums * sums
                w["e"][hit] -= bent * first["e"][hit] / (np.sqrt(second["e"][hit]) + 1e-8)
        if len(held):
            self.calibrate([words[i] for i in held], labels[held])
        return self

    def calibrate(self, words: list[np.ndarray], labels: np.ndarray, enough: int = 8) -> None:
        """The threshold of best F1 for each language; the one of all where a language has under `enough` of a class."""
        counts, (row, table_of) = np.array([len(x) for x in words]), self.lookups()
        flat = np.concatenate(words)
        z, language = self.logits(row[flat], counts), self.languages(flat, counts, table_of)

        def best(mine: np.ndarray) -> float | None:
            pos = labels[mine] == 1
            if min(pos.sum(), (~pos).sum()) < enough:
                return None
            order = np.argsort(-z[mine], kind="stable")
            sorted_z, hits = z[mine][order], np.cumsum(pos[order])
            f1 = 2 * hits / (np.arange(1, len(order) + 1) + pos.sum())
            k = int(np.argmax(f1))
            return float((sorted_z[k] + sorted_z[min(k + 1, len(order) - 1)]) / 2)

        overall = best(np.ones(len(labels), bool)) or 0.0
        own = [best(language == k) for k in range(len(LANGUAGES))]
        self.offsets = np.array([overall if x is None else x for x in own])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample_rows: int = 8000, **shape) -> Cnn:
    """A classifier from at most `sample_rows` labelled documents, drawn by a hash of the key. Their words are hashed on
    the executors; bucket numbers alone reach the driver. Null labels, keys and texts are left out; of several labels of
    a key the largest counts. Without any labelled document the classifier is untrained and scores 0."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    model = Cnn(**shape)
    n = model.buckets

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            words, counts = _buckets_of(part.column(2), n)
            ends = np.cumsum(counts)
            raw = [words[b - c : b].tobytes() for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["key", "label", "words"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    sample = rows.join(F.broadcast(chosen), "key").select("key", "label", "text").mapInArrow(hashed, "key long, label int, words binary")  # broadcast: sample_rows at most
    got = sample.toArrow()
    found = sorted(zip(*(got.column(c).to_pylist() for c in ("key", "words", "label")), strict=True))[:sample_rows]
    del got
    if found:
        model.fit([np.frombuffer(words, np.int32).reshape(-1, 3) for _, words, _ in found], np.array([label for *_, label in found]))
    del found
    release()
    return model


def score(docs: DataFrame, model: Cnn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of every whole text (null and empty texts, too), one row per input row; other columns are not read."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as its sample at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, lookups = sent.value, sent.value.lookups()
        for part in slices(batches, target=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.scores(*_buckets_of(part.column(1), made.buckets), lookups))], ["key", "score"])
        release()

    return rows.mapInArrow(judge, "key long, score double").withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Cnn, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score 0.5 or more; no shuffle."""
    place, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, lookups = sent.value, sent.value.lookups()
        for part in slices(batches, place, 1 << 20):
            yield part.filter(pa.array(made.scores(*_buckets_of(part.column(place), made.buckets), lookups) < 0.5))
        release()

    return docs.mapInArrow(keep, docs.schema)


def held_out(key: str = "doc_id", fold: int = 0) -> Column:
    """Whether crc32(key as text) mod 5 is the fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == fold, F.lit(False))


def learned(spark: SparkSession, sf_dir: str) -> Cnn:
    """The classifier of the labelled documents that are not held out."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), learned(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

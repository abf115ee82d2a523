"""Language-model scores: a Katz backoff model of all trigrams, in Elias-Fano tries that each hold some middle words.

Every n-gram of the training texts counts, however rare. Trigrams (a, b, w) go to the shard of their middle word b, so
that a shard has all that scoring w after (a, b) takes: successors of b, heads (a, b) and their successors. The counts of
single words, which all shards need, are summed up in shards of their own first and sent to where they are asked for.
Texts send each n-gram once per chunk, as packed blocks of local word numbers; shards send back sums per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import SPACE, U64, mix, release, slices, sorted_set, stored, table, text_bytes, word_hashes
from strata.llm.trie import Trie, packed_trie

END = U64(0x454E444F46544558)
#: Stands before the first token of a text; never counted.
BEGIN = U64(0x424547494E4F4654)
DISCOUNT = 0.75
#: Tokens that are sorted, and n-grams that are looked up, at a time.
_RUN, _PIECE = 1_500_000, 500_000
#: Words that have short names in blocks, at most.
_COMMON = 1 << 20
_CODEC = pa.Codec("zstd")


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (the words, A-Z lower-cased, then one end per text), each token's text, and tokens per text."""
    found, counted = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for part in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 0, 1 << 20):
        data, off = text_bytes(part.column(0))
        words, rows = word_hashes(data, off, SPACE)
        counts = np.bincount(rows, minlength=len(off) - 1)
        found.append(np.insert(words, np.cumsum(counts), END))
        counted.append(counts + 1)
    sizes = np.concatenate(counted)
    return np.concatenate(found), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), sizes


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers from 0 up as bytes: each in the fewest bytes that hold it, byte plane by byte plane, compressed."""
    head, body = [], []
    for x in arrays:
        width = next(k for k in (1, 2, 4, 8) if k == 8 or int(x.max(initial=0)) < 1 << 8 * k)
        head += [len(x), width]
        body.append(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    raw = b"".join(body)
    return np.array([len(arrays), len(raw), *head], "<i8").tobytes() + _CODEC.compress(raw, asbytes=True)


def unsqueezed(data: bytes) -> list[np.ndarray]:
    n, size = np.frombuffer(data, "<i8", 2).tolist()
    head = np.frombuffer(data, "<i8", 2 * n, 16).tolist()
    raw, at, out = np.frombuffer(_CODEC.decompress(data[16 + 16 * n :], size, asbytes=True), np.uint8), 0, []
    for length, width in zip(head[::2], head[1::2], strict=True):
        out.append(np.ascontiguousarray(raw[at : at + length * width].reshape(width, length).T).view(f"<u{width}").ravel())
        at += length * width
    return out


class Names:
    """Sorted word hashes as bytes: common words by their place in a list that all tasks know, the others as they are."""

    def __init__(self, common: np.ndarray):
        self.common = common

    def packed(self, words: np.ndarray) -> bytes:
        place = np.minimum(np.searchsorted(self.common, words), max(0, len(self.common) - 1))
        known = self.common[place] == words if len(self.common) else np.zeros(len(words), bool)
        return squeezed([np.diff(place[known], prepend=0), np.diff(words[~known], prepend=U64(0))])

    def unpacked(self, data: bytes) -> np.ndarray:
        known, rest = unsqueezed(data)
        return np.sort(np.concatenate([self.common[np.cumsum(known.astype(np.int64))], np.cumsum(rest.astype(U64), dtype=U64)]))


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each key's place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    code = np.empty(len(keys), np.int64)
    code[order] = np.cumsum(new) - 1
    return ordered[new], code


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    distinct, code = _coded(keys)
    return distinct, np.bincount(code, counts, len(distinct)).astype(np.int64)


def _places(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the sorted values, looked up in order, which spares the cache."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(values, keys[order])
    return out


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((mix(hashes) >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


class Hot:
    """Words, and pairs of them, that are too frequent for one shard: sorted hashes of the words, and pairs in order of
    their words' places. A pair is known by a hash of both."""

    def __init__(self, words: np.ndarray, first: np.ndarray | None = None, second: np.ndarray | None = None):
        self.words = words
        code = np.zeros(0, np.int64) if first is None else first * len(words) + second
        self.code = np.sort(code)
        self.first, self.second = np.divmod(self.code, max(1, len(words)))
        self.names = mix(words[self.second] ^ mix(words[self.first]))
        self.order = np.argsort(self.names)

    def index(self, words: np.ndarray) -> np.ndarray:
        """Places of words among the hot ones, -1 for the others."""
        return _found(self.words, words)

    def pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of pairs of places, -1 for those that are not hot."""
        return np.where((first >= 0) & (second >= 0), _found(self.code, first * len(self.words) + second), -1)

    def named(self, names: np.ndarray) -> np.ndarray:
        """Numbers of the pairs with these names, -1 for other names."""
        k = _found(self.names[self.order], names)
        return np.where(k >= 0, np.append(self.order, -1)[k], -1)


def _found(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the sorted distinct values, -1 for keys that are not there."""
    if not len(values):
        return np.full(len(keys), -1)
    place = np.minimum(np.searchsorted(values, keys), len(values) - 1)
    return np.where(values[place] == keys, place, -1)


class Events:
    """Of a run of tokens the distinct (a, b, w) by shard: numbers of the words before the last, before, and itself in
    `words` (hashes in order), how often it occurs in training texts, and the texts of all its occurrences."""

    def __init__(self, tokens: np.ndarray, rows: np.ndarray, train: np.ndarray, first: int, last: int, shards: int, hot: Hot):
        """Tokens first to last; those before serve as contexts. Contexts that begin outside the text are BEGIN. A shard
        has all trigrams of a middle word; of a hot one those of some first words; of BEGIN, of a hot pair, and of a hot
        word at a text's beginning, those of some last ones."""
        lead = min(first, 2)
        coded = pa.array(np.append(tokens[first - lead : last], BEGIN)).dictionary_encode()
        found = coded.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(found)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = found[order]
        ids, begin = rank[coded.indices.to_numpy(zero_copy_only=False)][:-1], int(np.searchsorted(self.words, BEGIN))
        own = rows[first - lead : last]
        a, b = np.full(len(ids), begin), np.full(len(ids), begin)
        b[1:] = np.where(own[1:] == own[:-1], ids[:-1], begin)
        a[2:] = np.where(own[2:] == own[:-2], ids[:-2], begin)
        a, b, w, own = a[lead:], b[lead:], ids[lead:], own[lead:]
        bits = max(1, int(len(self.words) - 1).bit_length())
        key = (b << 2 * bits) | (a << bits) | w  # a run has at most two million tokens: 63 bits
        by = np.argsort(key)
        key = key[by]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.b, self.a, self.w = key[start] >> 2 * bits, key[start] >> bits & (1 << bits) - 1, key[start] & (1 << bits) - 1
        times = np.diff(np.append(start, len(key)))
        count = np.add.reduceat(train[own[by]].astype(np.int64), start)
        middle = self.words[self.b]
        hot_place = hot.index(self.words)
        self.hot, self.pair, self.pair_names = hot_place >= 0, hot.pair(hot_place[self.a], hot_place[self.b]), hot.names
        name = np.where(self.b == begin, self.words[self.w], np.where(self.hot[self.b], mix(middle ^ mix(self.words[self.a])), middle))
        spread = (self.pair >= 0) | (self.a == begin) & self.hot[self.b]
        name = np.where(spread, mix(name ^ mix(self.words[self.w])), name)
        shard = _shard(name, shards)
        to = np.argsort(shard, kind="stable")
        self.a, self.b, self.w, self.count, self.times, self.shard, self.pair = self.a[to], self.b[to], self.w[to], count[to], times[to], shard[to], self.pair[to]
        ends = np.cumsum(self.times)
        self.texts = own[by][np.repeat(start[to] - (ends - self.times), self.times) + np.arange(len(key))]
        self.begin = begin

    def blocks(self, shards: int, names: Names) -> Iterator[tuple[int, bytes, bytes]]:
        """Per shard: number, names of the words used, and the events."""
        cuts, ahead = np.searchsorted(self.shard, np.arange(shards + 1)), np.concatenate([[0], np.cumsum(self.times)])
        place = np.empty(len(self.words), np.int64)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            x = slice(cuts[s], cuts[s + 1])
            used = sorted_set(np.concatenate([self.a[x], self.b[x], self.w[x]]))
            place[used] = np.arange(len(used))
            a, b, w = (place[c[x]] for c in (self.a, self.b, self.w))
            yield s, names.packed(self.words[used]), squeezed([np.diff(b, prepend=0), a, w, self.count[x], self.times[x] - 1, self.texts[ahead[cuts[s]] : ahead[cuts[s + 1]]]])

    def requests(self, shards: int, parts: int, names: Names) -> Iterator[tuple[int, bytes, bytes]]:
        """Per part of the counts: number, names of words, and their items: the word's number, 0 or the hash of the hot word
        or hot pair before it, training count; then items' numbers and the shards that ask for them. Hot words are known
        to all shards and asked for by none, and of hot pairs all shards know the sums."""
        n = len(self.words)
        hot = np.flatnonzero(self.hot)
        place = np.zeros(n, np.int64)
        place[hot] = np.arange(1, len(hot) + 1)
        paired = self.pair >= 0
        pairs = np.unique(self.pair[paired])
        span = len(hot) + 1 + len(pairs)
        before = np.concatenate([np.zeros(1, U64), self.words[hot], self.pair_names[pairs]])
        cold, after = ~self.hot[self.w], place[self.b] > 0
        key = self.w * span
        item, code = _coded(np.concatenate([key, (key + place[self.b])[after], key[paired] + len(hot) + 1 + np.searchsorted(pairs, self.pair[paired])]))
        count = np.bincount(code, np.concatenate([self.count, self.count[after], self.count[paired]]), len(item)).astype(np.int64)
        asked = np.append(code[: len(key)][cold], code[len(key) : len(key) + int(after.sum())])
        pair = sorted_set(asked * shards + np.append(self.shard[cold], self.shard[after]))
        part = _shard(self.words[item // span], parts)
        asked_part = part[pair // shards]
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            new = np.full(len(item), -1, np.int64)
            new[mine] = np.arange(len(mine))
            used, back = _coded(item[mine] // span)
            own = pair[asked_part == p]
            yield p, names.packed(self.words[used]), squeezed([back, before[item[mine] % span], count[mine], new[own // shards], own % shards])


def _tallies(rows: pa.Table, hot: Hot, names_of: Names) -> pa.Table:
    """Sums of a part's items: what each shard asked for, the totals, hot words' counts, and how many successors hot words
    and pairs have and what these add up to (after a pair: as successors of its second word)."""
    words, before, counts, items, asked, at = [], [], [], [], [], 0
    for w, data in zip(rows.column("words").to_pylist(), rows.column("data").to_pylist(), strict=True):
        number, context, n, who, to = unsqueezed(data)
        words.append(names_of.unpacked(w)[number])
        before.append(context.astype(U64))
        counts.append(n.astype(np.int64))
        items.append(who.astype(np.int64) + at)
        asked.append(to.astype(np.int64))
        at += len(n)
    word, before, count = (np.concatenate(x) for x in (words, before, counts))
    names, number = _coded(word)
    hots = sorted_set(before)  # the first, 0, is none
    key, place = _coded(number * len(hots) + np.searchsorted(hots, before))
    n = np.bincount(place, count, len(key)).astype(np.int64)
    single = key[key % len(hots) == 0]
    total = np.zeros(len(names), np.int64)
    total[single // len(hots)] = n[np.searchsorted(key, single)]
    out = [(_TOTAL, 0, 0, int(total.sum()), int((total > 0).sum()), None)]
    pair_of = hot.named(hots)
    pair_of[0] = -1  # no context
    middle = np.searchsorted(hots, np.append(hot.words[hot.second], U64(0))[pair_of])
    kind, number = key % len(hots), key // len(hots)
    seen = np.flatnonzero((kind > 0) & (n > 0))
    paired = pair_of[kind[seen]] >= 0
    value = total[number[seen]]
    value[paired] = n[np.searchsorted(key, number[seen[paired]] * len(hots) + middle[kind[seen[paired]]])]
    some, sums = np.bincount(kind[seen], minlength=len(hots)), np.bincount(kind[seen], value, len(hots)).astype(np.int64)
    out += [(_AFTER if pair_of[k] < 0 else _PAIR, 0, int(hots[k].view(np.int64)), int(some[k]), int(sums[k]), None) for k in np.flatnonzero(some).tolist()]
    known = np.flatnonzero(np.isin(names, hot.words))
    out += [(_WORD, 0, h, c, 0, None) for h, c in zip(names[known].view(np.int64).tolist(), total[known].tolist(), strict=True)]
    pair = sorted_set(np.concatenate(asked) * len(key) + place[np.concatenate(items)])
    for s, own in zip(*_grouped(pair // len(key), pair % len(key)), strict=True):
        used, back = _coded(key[own] // len(hots))
        data = squeezed([back, hots[key[own] % len(hots)], n[own]])
        out.append((_COUNTS, int(s), 0, 0, 0, (names_of.packed(names[used]), data)))
    cols = list(zip(*out, strict=True))
    return pa.table({
        "kind": pa.array(cols[0], pa.int32()), "shard": pa.array(cols[1], pa.int64()), "word": pa.array(cols[2], pa.int64()), "n": pa.array(cols[3], pa.int64()), "m": pa.array(cols[4], pa.int64()),
        "words": pa.array([x and x[0] for x in cols[5]], pa.binary()), "data": pa.array([x and x[1] for x in cols[5]], pa.binary()),
    })


_TOTAL, _AFTER, _WORD, _COUNTS, _PAIR = range(5)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, which come in order, and the values of each."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.split(values, start[1:]) if len(keys) else []


class Totals:
    """Training tokens, distinct ones; of the hot words hashes in order, counts, and backoff weights; of the hot pairs
    hashes of both words, counts, and backoff weights."""

    def __init__(self, tokens: int, distinct: int, hot: Hot, counts: np.ndarray, after: np.ndarray, pair_counts: np.ndarray, after_pair: np.ndarray, discount: float):
        """after: number of a word's or pair's successors, and what their counts a level below add up to."""
        self.tokens, self.distinct, self.hot, self.counts, self.pair_counts = tokens, distinct, hot.words, counts, pair_counts
        self.first, self.second = hot.words[hot.first], hot.words[hot.second]
        free = 1 - (after[:, 1] + 0.5 * after[:, 0]) / (tokens + 0.5 * (distinct + 1))
        self.backoff = np.where(after[:, 0] > 0, _weight(discount * after[:, 0] / np.maximum(1, counts), free), 0.0)
        free = 1 - (after_pair[:, 1] - discount * after_pair[:, 0]) / np.maximum(1, counts[hot.second])
        self.pair_backoff = np.where(after_pair[:, 0] > 0, _weight(discount * after_pair[:, 0] / np.maximum(1, pair_counts), free), 0.0)

    def p(self, counts: np.ndarray) -> np.ndarray:
        """(c + 0.5) / (N + 0.5 (V + 1))."""
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


def _weight(left: np.ndarray, free: np.ndarray) -> np.ndarray:
    """log10 of what contexts leave to unseen successors over what these have a level below; 0 where that is nothing."""
    return np.where(free > 1e-12, np.log10(np.maximum(left, 1e-12) / np.maximum(free, 1e-12)), 0.0)


def shard_trie(words: np.ndarray, p1: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, count: np.ndarray, after: tuple, totals: Totals, discount: float) -> Trie:
    """The trie of a shard. a, b, w: words of its training n-grams by number (-1 for BEGIN), after: key (b, w) and count
    of the successors of hot words, whose bigrams other shards have, too. Hot pairs bring their count and weight."""
    n = len(words)
    place = _found(totals.hot, words)
    hot = place >= 0
    ok = (b >= 0) & ~hot[b]
    two, c2 = _sums(np.concatenate([b[ok].astype(np.int64) * n + w[ok], after[0]]), np.concatenate([count[ok], after[1]]))
    of = two // n
    c1 = np.bincount(of, c2, n)
    c1[hot] = totals.counts[place[hot]]
    p2 = (c2 - discount) / c1[of]
    backoff = np.where(np.bincount(of, minlength=n) > 0, _weight(1 - np.bincount(of, p2, n), 1 - np.bincount(of, p1[two % n], n)), 0.0)
    backoff[hot] = totals.backoff[place[hot]]
    ok = (a >= 0) & (b >= 0)
    a, b, w, count = a[ok], b[ok], w[ok], count[ok]
    b = b.astype(np.int64) * n
    pair = np.stack([_found(words, totals.second), _found(words, totals.first)])
    here = (pair >= 0).all(0)
    heads, head = _coded(np.append(b + a, pair[0, here] * n + pair[1, here]))
    head, wide = head[: len(a)], head[len(a) :]
    first = np.searchsorted(of, np.arange(n))
    rank = _places(two, b + w) - first[b // n]
    span = int(rank.max(initial=0)) + 1
    three, c3 = _sums(head * span + rank, count)
    head, rank = three // span, three % span
    del b, w, count
    size = np.bincount(head, c3, len(heads))
    size[wide] = totals.pair_counts[here]
    p3 = (c3 - discount) / size[head]
    lower = p2[first[heads[head] // n] + rank]
    weight = _weight(1 - np.bincount(head, p3, len(heads)), 1 - np.bincount(head, lower, len(heads)))
    weight[wide] = totals.pair_backoff[here]
    return Trie(packed_trie(np.log10(p1), (of, two % n, np.log10(p2), backoff), (heads // n, heads % n, weight), (head, rank, np.log10(p3))))


def _solver(totals: Totals, discount: float, sent: Broadcast):
    """A shard's blocks and counts to sums of its events by chunk and text."""

    def run(rows: pa.Table) -> pa.Table:
        names_of = sent.value
        names = ["chunk", "keys", "data", "base", "score"]
        if rows.num_rows and rows.column("shard")[0].as_py() < 0:  # the keys of a chunk's texts
            return pa.table([rows.column("chunk"), rows.column("words"), rows.column("data"), *[pa.nulls(rows.num_rows, pa.binary())] * 2], names)
        chunks = rows.column("chunk").to_pylist()
        own = [names_of.unpacked(x) for x in rows.column("words").to_pylist()]
        words = sorted_set(np.concatenate(own))
        n, begin = len(words), int(np.searchsorted(words, BEGIN)) if BEGIN in words else -1
        counts, after, blocks = np.zeros(n, np.int64), [(np.zeros(0, np.int64),) * 2], []
        known = np.isin(words, totals.hot)
        counts[known] = totals.counts[np.searchsorted(totals.hot, words[known])]
        for chunk, mine, data in zip(chunks, own, rows.column("data").to_pylist(), strict=True):
            ids = np.searchsorted(words, mine)
            parts = unsqueezed(data)
            if chunk >= 0:
                blocks.append((chunk, ids, parts))
                continue
            w, before, c = ids[parts[0]], parts[1].astype(U64), parts[2].astype(np.int64)
            alone = before == 0
            counts[w[alone]] = c[alone]
            some = ~alone & (c > 0)
            after.append((np.searchsorted(words, before[some]) * n + w[some], c[some]))
        p1 = totals.p(counts)
        a, b, w, count = ([] for _ in range(4))
        for _, ids, (step, first, last, n_train, *_) in blocks:
            ids = ids.astype(np.int32)
            for column, x in ((a, ids[first]), (b, ids[np.cumsum(step, dtype=np.int32)]), (w, ids[last]), (count, n_train.astype(np.int32))):
                column.append(x)
        a, b, w, count = (np.concatenate(x) for x in (a, b, w, count))
        keys, c2 = _sums(*(np.concatenate(x) for x in zip(*after, strict=True)))
        some = np.flatnonzero(count)
        trie = shard_trie(words, p1, *(np.where(x[some] == begin, -1, x[some]) for x in (a, b, w)), count[some], (keys, c2), totals, discount)
        log_p, at, out = np.log10(p1), 0, []
        scores = np.concatenate([trie.score(*(x[k : k + _PIECE].astype(np.int64) for x in (a, b, w))) for k in range(0, len(a), _PIECE)])
        del a, b, count, some, trie, keys, c2
        for chunk, _, (*_, times, texts) in blocks:
            mine, at = slice(at, at + len(times)), at + len(times)
            which = np.flatnonzero(np.bincount(texts))
            sums = [np.bincount(texts, np.repeat(v, times.astype(np.int64) + 1))[which] for v in (counts[w[mine]] > 0, log_p[w[mine]], scores[mine])]
            out.append((chunk, squeezed([which, sums[0].astype(np.int64)]), sums[1].tobytes(), sums[2].tobytes()))
        release()
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(cols[0], pa.int64()), pa.nulls(len(out), pa.binary()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    return run


def _gathered(rows: pa.Table) -> pa.Table:
    """The texts of a chunk with the sums of all shards."""
    keys = null = sizes = None
    for k, data in zip(rows.column("keys").to_pylist(), rows.column("data").to_pylist(), strict=True):
        if k is not None:
            null, sizes = unsqueezed(data)
            keys = np.frombuffer(k, np.int64)
    sums = [np.zeros(len(keys)) for _ in range(3)]
    for k, data, base, score in zip(*(rows.column(c).to_pylist() for c in ("keys", "data", "base", "score")), strict=True):
        if k is None:
            which, known = unsqueezed(data)
            for total, value in zip(sums, (known, np.frombuffer(base), np.frombuffer(score)), strict=True):
                total[which] += value
    return pa.table([pa.array(keys, mask=null.astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["key", "n_tokens", "n_known", "base_score", "score"])


def score_corpus(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", discount: float = DISCOUNT, shard_tokens: int = 1_250_000, hot_tokens: int = 2_500_000, chunk_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """Score every text of docs by the model of those in which `train` holds: key, n_tokens, n_known (training words),
    base_score (unigrams), score (log10 P of the whole text), and the number of training tokens.

    One row per input row; null texts count as empty, whose only token is the end; null keys stay; a null `train` counts
    as false; repeated rows are learned and scored each; no rows give none; other columns are not read. Without training
    texts all scores are those of unseen words.

    Words are runs between ASCII white space, A-Z lower-cased, known by 64-bit hashes. Level 1 has half a count more for
    each word; seen n-grams of two and three tokens are discounted by a constant, which their context gives to the
    shorter n-gram (Katz). Shards hold about `shard_tokens` tokens' n-grams. A word of `hot_tokens` tokens or more is
    spread over shards by the word before it; the counts of its bigrams then are summed like those of single words, and
    sent to the shards that ask for them. A pair of such words that is itself so frequent is spread by the word after it,
    and the sums that its weight takes are found on the way. All tasks know the hot words and pairs, tokens / hot_tokens
    of each at most, and a list of 2**20 common words at most, which only names words in blocks. What is not split is one
    trigram: its occurrences, summed by text and chunk, meet in one shard."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chars, texts = rows.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)), F.count("*")).first()
    share = hot_tokens / (chars / 2 + texts + 1)  # a word takes two characters at least: more than all tokens

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of the task, and those of its words that occur thrice or make up the share of a hot word; such a word does
        somewhere."""
        words, counts, total = np.zeros(0, U64), np.zeros(0, np.int64), 0
        for part in slices(batches, target=chunk_bytes):
            tokens = token_hashes(part.column(1))[0]
            coded = pa.array(tokens).value_counts()
            words, counts = _sums(np.concatenate([words, coded.field(0).to_numpy(zero_copy_only=False)]), np.concatenate([counts, coded.field(1).to_numpy(zero_copy_only=False)]))
            total += len(tokens)
            if len(words) > 1 << 22:
                words, counts = words[counts > 1], counts[counts > 1]
        keep = (counts > total * share) | (counts > 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(words[keep], BEGIN).view(np.int64)), pa.array(np.append(counts[keep], total))], ["word", "n"])
        release()

    seen = stored(rows.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    begin = int(BEGIN.view(np.int64))
    size = seen.where(F.col("word") == begin).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = seen.where(F.col("word") != begin)
    least, held = 1, 0  # the least count of a common word
    for r in seen.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect():  # 10,000 rows at most
        held += r["count"]
        if held > _COMMON:
            least = r.n + 1
            break
    common = seen.where(F.col("n") >= least).toArrow()
    order = np.argsort(common.column("word").to_numpy().view(U64))
    names = Names(common.column("word").to_numpy().view(U64)[order])
    hot = Hot(names.common[common.column("n").to_numpy()[order] >= hot_tokens])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of hot words in the task's texts, and how often they occur, in all and in training texts."""
        keys, counts = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        for part in slices(batches, target=chunk_bytes):
            tokens, owners, _ = token_hashes(part.column(1))
            place = hot.index(tokens)
            at = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0) & (owners[1:] == owners[:-1]) & (tokens[1:] != END))
            train_too = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[owners[at]]
            keys, code = _coded(np.append(keys, place[at] * len(hot.words) + place[at + 1]))
            counts = np.stack([np.bincount(code, np.append(c, new), len(keys)).astype(np.int64) for c, new in zip(counts, (np.ones(len(at), np.int64), train_too), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, counts)], ["pair", "n", "train"])
        release()

    pair_counts = np.zeros(0, np.int64)
    if len(hot.words):
        found = rows.mapInArrow(pairs, "pair long, n long, train long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("train").alias("train")).where(F.col("n") >= hot_tokens).orderBy("pair").toArrow()  # tokens / hot_tokens rows at most
        hot, pair_counts = Hot(hot.words, *np.divmod(found.column("pair").to_numpy(), len(hot.words))), found.column("train").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(names)  # 8 MB at most
    shards = int(size // shard_tokens) + 2
    parts = shards // 4 + 1

    def chunks(batches: Iterator[pa.RecordBatch], start: int) -> Iterator[tuple[int, pa.RecordBatch | None, Events | None, np.ndarray | None]]:
        """Chunk numbers with, first, the texts and their sizes, and then their events, two million tokens at most at a time."""
        chunk = start
        for part in slices(batches, target=chunk_bytes):
            tokens, owners, sizes = token_hashes(part.column(1))
            yield chunk, part, None, sizes
            flags = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first in range(0, len(tokens), _RUN):
                yield chunk, None, Events(tokens, owners, flags, first, min(len(tokens), first + _RUN), shards, hot), None
            chunk += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, events, _ in chunks(batches, 0):
            if events is not None:
                cols = list(zip(*events.requests(shards, parts, sent.value), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["part", "words", "data"])
        release()

    def sums(table_: pa.Table) -> pa.Table:
        out = _tallies(table_, hot, sent.value)
        release()
        return out

    tallies = stored(rows.mapInArrow(ask, "part long, words binary, data binary").groupBy("part").applyInArrow(sums, "kind int, shard long, word long, n long, m long, words binary, data binary"), "lm-counts")
    tokens, distinct = tallies.where(F.col("kind") == _TOTAL).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    small = tallies.where(F.col("kind").isin(_WORD, _AFTER, _PAIR)).groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect() if len(hot.words) else []  # hot words and pairs alone
    sums_of = {(r.kind, r.word): (r.n, r.m) for r in small}

    def known(kind: int, names_: np.ndarray) -> np.ndarray:
        return np.array([sums_of.get((kind, x), (0, 0)) for x in names_.view(np.int64).tolist()], np.int64).reshape(-1, 2)

    totals = Totals(tokens, distinct, hot, known(_WORD, hot.words)[:, 0], known(_AFTER, hot.words), pair_counts, known(_PAIR, hot.names), discount)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part, events, sizes in chunks(batches, TaskContext.get().partitionId() << 32):
            if part is not None:
                keys = part.column(0)
                null = keys.is_null().to_numpy(zero_copy_only=False)
                cols = [[-1 - chunk], [keys.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], [squeezed([null, sizes])]]
            else:
                cols = list(zip(*events.blocks(shards, sent.value), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([chunk] * len(cols[0]), pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["shard", "chunk", "words", "data"])
        release()

    dealt = rows.mapInArrow(deal, "shard long, chunk long, words binary, data binary")
    counts = tallies.where(F.col("kind") == _COUNTS).select("shard", F.lit(-1).cast("long").alias("chunk"), "words", "data")
    solved = dealt.unionAll(counts).groupBy("shard").applyInArrow(_solver(totals, discount, sent), "chunk long, keys binary, data binary, base binary, score binary")
    scored = solved.groupBy("chunk").applyInArrow(_gathered, "key long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumnRenamed("key", key), tokens


def held_out(key: str = "doc_id", fold: int = 1) -> Column:
    """Whether crc32(key as text) mod 5 is the fold; a null key never is."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == fold, F.lit(False))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_corpus over all documents, learned from those that are not held out."""
    scored, tokens = score_corpus(table(spark, sf_dir, "documents"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")

"""An n-gram trie in Elias-Fano coding: monotone pointers, context-relative successors, quantised values, one memory map."""

from __future__ import annotations

import json
import tempfile

import numpy as np

U64 = np.uint64
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the r-th one in a byte.
_SELECT = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """Code a non-decreasing sequence: the low bits of each value as they are (0, 8, 16 or 32 of them), the high parts
    as ones in a bit vector at place high + index, with a count of ones before every 64 bits."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    bits = max(0, (top // max(1, n)).bit_length())
    bits = next(b for b in (0, 8, 16, 32, 64) if b >= bits)
    low = (values & U64((1 << bits) - 1)).astype({0: "u1", 8: "u1", 16: "u2", 32: "u4", 64: "u8"}[bits]) if bits else np.zeros(0, np.uint8)
    high = (values >> U64(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
    places = high + np.arange(n)
    words = (int(places[-1]) if n else 0) // 64 + 1
    flags = np.zeros(words * 64, np.uint8)
    flags[places] = 1
    vector = np.packbits(flags, bitorder="little")
    ahead = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(1, dtype=np.int64))])[:-1]
    return {"low": low, "high": vector, "ahead": ahead.astype(np.int64), "bits": np.array([bits, n])}


class Sequence:
    """A coded sequence, read at many indexes at a time or as a whole."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.high, self.ahead = parts["low"], parts["high"].reshape(-1, 8), parts["ahead"]
        self.bits, self.n = (int(x) for x in parts["bits"])

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ahead, index, "right") - 1
        rest = index - self.ahead[word]
        row = self.high[word]
        sums = np.cumsum(_ONES[row], 1, dtype=np.int64)
        byte = (sums <= rest[:, None]).sum(1)
        lines = np.arange(len(index))
        inside = rest - np.where(byte > 0, sums[lines, byte - 1], 0)
        place = word * 64 + byte * 8 + _SELECT[row[lines, byte], inside]
        return self._joined(place - index, self.low[index] if self.bits else None)

    def all(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(np.asarray(self.high).ravel(), bitorder="little"))
        return self._joined(place - np.arange(self.n), np.asarray(self.low) if self.bits else None)

    def _joined(self, high: np.ndarray, low: np.ndarray | None) -> np.ndarray:
        value = high.astype(U64) << U64(self.bits % 64)
        return (value if low is None else value | low.astype(U64)).astype(np.int64)


def quantised(values: np.ndarray, levels: int = 4096) -> dict[str, np.ndarray]:
    """Each value's code and the codebook: 0 for zeros, means of bins of equal count for all others."""
    some = np.flatnonzero(values)
    codes = np.zeros(len(values), np.uint16)
    codes[some[np.argsort(values[some])]] = 1 + np.arange(len(some)) * min(levels, max(1, len(some))) // max(1, len(some))
    n = int(codes.max(initial=0)) + 1
    return {"code": codes, "book": np.bincount(codes, values, n) / np.maximum(1, np.bincount(codes, minlength=n))}


def level_of(contexts: np.ndarray, names: np.ndarray, n_contexts: int) -> dict:
    """Pointers and successors of a level from its n-grams in order of (context, name). The successors of context i lie
    at places pointers[i] to pointers[i + 1]; names are made to rise over the whole level by adding, in each group, the
    last value of the group before, and one."""
    pointers = np.searchsorted(contexts, np.arange(n_contexts + 1)).astype(np.int64)
    last = np.zeros(n_contexts + 1, np.int64)
    full = np.flatnonzero(np.diff(pointers) > 0)
    last[full + 1] = names[pointers[full + 1] - 1] + 1
    base = np.cumsum(last)
    return {"pointers": elias_fano(pointers.astype(U64)), "successors": elias_fano((base[contexts] + names + 1).astype(U64))}


def pack(levels: dict[str, dict]) -> bytes:
    """All arrays of all levels in one block, each aligned to 8 bytes, behind a JSON directory."""
    directory, blocks, at = {}, [], 0
    for level, parts in levels.items():
        entry = directory[level] = {}
        for name, value in parts.items():
            for part, array in (value.items() if isinstance(value, dict) else [("", value)]):
                raw = np.ascontiguousarray(array).tobytes()
                raw += b"\0" * (-len(raw) % 8)
                entry[f"{name}/{part}"] = [str(array.dtype), len(array), at]
                blocks.append(raw)
                at += len(raw)
    head = json.dumps(directory).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *blocks])


class Level:
    """One level of a mapped trie: contexts' pointers, named successors, and quantised values of either."""

    def __init__(self, parts: dict):
        self.values = {k: v for k, v in parts.items() if k not in ("pointers", "successors")}
        self.pointers = Sequence(parts["pointers"]).all()
        self.successors = Sequence(parts["successors"])

    def find(self, contexts: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Places of the named successors of contexts, -1 where there is none. A name is relative to its context: the
        value before the context's group, added to it, gives what is searched for in the rising sequence."""
        out = np.full(len(contexts), -1, np.int64)
        ok = np.flatnonzero((contexts >= 0) & (names >= 0))
        if not len(ok) or not self.successors.n:
            return out
        value = self.successors.all()
        low, end = self.pointers[contexts[ok]], self.pointers[contexts[ok] + 1]
        target = np.where(low > 0, value[low - 1], 0) + names[ok] + 1
        place = np.searchsorted(value, target)
        hit = place < end
        hit[hit] = value[place[hit]] == target[hit]
        out[ok[hit]] = place[hit]
        return out

    def value(self, name: str, places: np.ndarray) -> np.ndarray:
        coded = self.values[name]
        return coded["book"][coded["code"][places]]


class Trie:
    """Trigrams (a, b, w) of a set of middle words b, mapped from a temporary file that is gone once mapped.

    Level `two` has the successors w of each b, level `heads` the words a before each b, level `three` the successors of
    each head (a, b), named by their rank among the successors of b alone. Words are ids from 0 to n - 1, in the order
    of their hashes; `words` has their log10 probabilities and the backoff weights of those that are contexts."""

    def __init__(self, packed: bytes):
        with tempfile.NamedTemporaryFile(prefix="strata-trie-") as f:
            f.write(packed)
            f.flush()
            memory = np.memmap(f.name, np.uint8, "r")
        size = int.from_bytes(memory[:8].tobytes(), "little")
        found: dict[str, dict] = {}
        for level, entry in json.loads(memory[8 : 8 + size].tobytes()).items():
            parts = found[level] = {}
            for name, (kind, n, at) in entry.items():
                outer, _, inner = name.partition("/")
                array = memory[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind)
                if inner:
                    parts.setdefault(outer, {})[inner] = array
                else:
                    parts[outer] = array
        self.words = found["words"]
        self.two, self.heads, self.three = (Level(found[k]) for k in ("two", "heads", "three"))

    def places(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of (b, w), of the head (a, b) and of (a, b, w) in their levels, -1 for what isn't there."""
        two, head = self.two.find(b, w), self.heads.find(b, a)
        return two, head, self.three.find(head, np.where(two >= 0, two - self.two.pointers[b], -1))

    def score(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | a b): the longest n-gram that is there, with the weights of the contexts that it lacks."""
        two, head, three = self.places(a, b, w)
        coded = self.words["backoff"]
        lowest = np.asarray(self.words["probability"])[w] + coded["book"][coded["code"][b]]
        if (some := np.flatnonzero(two >= 0)).size:
            lowest[some] = self.two.value("probability", two[some])
        if (some := np.flatnonzero(head >= 0)).size:
            lowest[some] += self.heads.value("backoff", head[some])
        if (some := np.flatnonzero(three >= 0)).size:
            lowest[some] = self.three.value("probability", three[some])
        return lowest


def packed_trie(log_p: np.ndarray, two: tuple, heads: tuple, three: tuple) -> bytes:
    """A trie for Trie from: log10 probabilities of all words; (contexts, words, log10 p, log10 weight of every word) of
    level two; (middle words, words before, log10 weight) of the heads; (heads, ranks, log10 p) of level three; each in
    order."""
    n = len(log_p)
    return pack({
        "words": {"probability": log_p, "backoff": quantised(two[3])},
        "two": level_of(two[0], two[1], n) | {"probability": quantised(two[2])},
        "heads": level_of(heads[0], heads[1], n) | {"backoff": quantised(heads[2])},
        "three": level_of(three[0], three[1], len(heads[0])) | {"probability": quantised(three[2])},
    })

"""Tokenising whole texts by way of their distinct chunks.

Both vocabularies split text before they merge, so a text may be cut at a safe boundary and its parts tokenised alone.
Prose repeats most of its chunks: numpy hashes them (64 bits), the library encodes each new one once, and ids or their
number are gathered back."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from strata.llm.common import SPACE, U64, span_hashes, text_bytes, word_spans

BLANK = np.zeros(256, bool)
BLANK[32] = True
_HEAD = U64(0xA5A5A5A5DEADBEEF)
#: A cut before a blank that a word follows: white space before it is a token of its own either way, and the blank
#: belongs to the word.
_BEFORE_BLANK = re.compile(r" (?=\S)")
#: Bytes with which white space beyond ASCII may begin, or that only Python counts as white space.
_MAYBE_SPACE = SPACE.copy()
_MAYBE_SPACE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_encoders: dict[str, Encoder] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary: loading takes a while."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids of chunks by their hash, kept from batch to batch up to `keep` chunks; beyond that the store starts anew."""

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.keep = Tokenizer.from_file(path), keep
        words = self.library.get_vocab()
        self.opens = np.zeros(max(words.values()) + 1, bool)  # ids that begin with a blank
        self.opens[[i for w, i in words.items() if w.startswith("Ġ")]] = True
        self._clear()

    def _clear(self) -> None:
        self.key, self.place = np.zeros(0, U64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count, self.held = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has. Chunks that all begin with their only blank are encoded joined, as
        the text that they would form, and parted again at the ids that begin with a blank."""
        joined = all(c[:1] == " " for c in chunks)
        texts = ["".join(chunks[a : a + 512]) for a in range(0, len(chunks), 512)] if joined else chunks
        parts = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((i for one in parts for i in one), np.uint32, int(counts.sum()))
        if joined:
            starts = np.flatnonzero(self.opens[flat])
            if len(starts) != len(chunks):
                halves = [[c] for c in chunks] if len(chunks) < 64 else [chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :]]
                both = [self._singly(h) if len(h) == 1 else self.encode(h) for h in halves]
                return np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
            counts = np.diff(np.append(starts, len(flat)))
        return flat, counts

    def _singly(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.library.encode(chunks[0], add_special_tokens=False).ids, np.uint32)
        return ids, np.array([len(ids)])

    def add(self, chunks: list[str]) -> np.ndarray:
        """Encode chunks; their places."""
        for a in range(0, len(chunks), 8192):
            part = chunks[a : a + 8192]
            flat, counts = self.encode(part)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while self.held + len(part) > len(self.first):
                self.first, self.count = np.tile(self.first, 2), np.tile(self.count, 2)
            self.ids[self.used : self.used + len(flat)] = flat
            self.first[self.held : self.held + len(part)] = self.used + np.cumsum(counts) - counts
            self.count[self.held : self.held + len(part)] = counts
            self.used, self.held = self.used + len(flat), self.held + len(part)
        return np.arange(self.held - len(chunks), self.held, dtype=np.int32)

    def places(self, hashes: np.ndarray, strings: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Places of chunks in the store. strings: gives the texts of the chunks at the given indexes."""
        if self.held > self.keep:
            self._clear()
        coded = pa.array(hashes).dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        at = np.searchsorted(self.key, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = at < len(self.key)
        fresh[inside] = self.key[at[inside]] != distinct[inside]
        if fresh.any():
            new = np.flatnonzero(fresh)
            place = self.add(strings(first[new]))
            order = np.argsort(distinct[new])
            where = at[new][order]
            self.key, self.place = np.insert(self.key, where, distinct[new][order]), np.insert(self.place, where, place[order])
            at = np.searchsorted(self.key, distinct)
        return self.place[at][code]

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of the chunks at these places, one after the other."""
        counts = self.count[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.first[places] - (ends - counts), counts) + np.arange(total)]


def _row_sums(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, values, n_rows).astype(np.int64)


def token_counts(column: pa.Array, path: str) -> np.ndarray:
    """Tokens per text, for a vocabulary that drops white space: ASCII white space is a safe boundary, as no token,
    composition or special string reaches across it."""
    data, off = text_bytes(column)
    starts, ends, rows = word_spans(data, off)
    raw = data.tobytes()
    hashes = span_hashes(data, starts, ends, fold=False)
    enc = encoder(path)
    places = enc.places(hashes, lambda k: [raw[a:b].decode() for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)])
    return _row_sums(enc.count[places], rows, len(off) - 1)


def _irregular(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows in which a blank comes before (what may be) white space or the row's end."""
    odd = np.zeros(len(off) - 1, bool)
    if len(data):
        before = np.flatnonzero((data[:-1] == 32) & _MAYBE_SPACE[data[1:]])
        odd[np.searchsorted(off, before, "right") - 1] = True
        full = np.flatnonzero(off[1:] > off[:-1])
        odd[full[data[off[full + 1] - 1] == 32]] = True
    return np.flatnonzero(odd)


def text_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """For a byte-level vocabulary whose words carry the blank before them: all ids of all texts, and where each text's
    ids begin (and after the last, the end)."""
    enc = encoder(path)
    data, off = text_bytes(column)
    n_rows = len(off) - 1
    odd = _irregular(data, off)
    starts, ends, rows = word_spans(data, off, BLANK)
    head = starts == off[rows]
    raw = data.tobytes()
    hashes = span_hashes(data, starts, ends, fold=False)
    hashes[head] ^= _HEAD
    keep = ~np.isin(rows, odd) if len(odd) else np.ones(len(rows), bool)
    starts, ends, rows, hashes, head = starts[keep], ends[keep], rows[keep], hashes[keep], head[keep]

    def strings(k: np.ndarray) -> list[str]:
        return [raw[a:b].decode() for a, b in zip((starts[k] - ~head[k]).tolist(), ends[k].tolist(), strict=True)]

    for want in (True, False):  # heads and the rest apart, as only the latter can be encoded joined
        if (mine := np.flatnonzero(head == want)).size:
            got = enc.places(hashes[mine], lambda k, mine=mine: strings(mine[k]))
            if want:
                cleared, at_head = enc.held, got
            else:
                rest = got
    places = np.zeros(len(rows), np.int64)
    if (~head).any():
        places[~head] = rest
    if head.any():
        if enc.held < cleared:  # the store started anew between the two
            at_head = enc.places(hashes[head], lambda k, mine=np.flatnonzero(head): strings(mine[k]))
        places[head] = at_head
    counts = _row_sums(enc.count[places], rows, n_rows)
    if not len(odd):
        return enc.gather(places), np.concatenate([[0], np.cumsum(counts)])
    flat, cuts = enc.gather(places), np.concatenate([[0], np.cumsum(counts)])
    pieces = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for row in odd.tolist():
        text = raw[off[row] : off[row + 1]].decode()
        at = [0, *(m.start() for m in _BEFORE_BLANK.finditer(text)), len(text)]
        pieces[row] = np.concatenate([np.array(e.ids, np.uint32) for e in enc.library.encode_batch_fast(
            [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)])
    counts = np.fromiter(map(len, pieces), np.int64, n_rows)
    return np.concatenate(pieces) if pieces else flat, np.concatenate([[0], np.cumsum(counts)])

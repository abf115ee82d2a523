"""Near copies by SuperMinHash: signatures, bands, exact verification, union-find.

Each shingle draws a random permutation of the signature's places, a place a round, and offers rounds + a fraction there;
the signature keeps the least offer of each place. Offers of one shingle never meet in a place, which is what lowers the
variance against independent hashes, and a document whose places all hold less than the next round's offers is done,
which takes most documents one to four rounds. Signatures are cut into bands of four; documents that agree in a band are
candidates, and their full sets of shingles decide."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import U64, mix, table
from strata.llm.components import union_find
from strata.llm.jaccard_join import keyed_components

#: Places of a signature and of a band: two sets of similarity 0.8 agree in no band with a probability of 5e-8.
PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_ODD = mix(np.arange(1, ROWS + 1, dtype=U64)) | U64(1)
_LOW = U64(0xFFFFFFFF)


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """A signature (a row of `places` numbers) for each set of 64-bit hashes; the highest number throughout for an empty
    set. Two sets agree in a place with the probability of their Jaccard similarity."""
    out = np.full((len(sets), places), ~U64(0))
    if not len(sets):
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least, order = out.reshape(-1), None
    for k in range(places):
        if not len(flat):
            break
        draw = mix(flat + U64(_STEP * (k + 1) & _MASK))
        to = k + (((draw & _LOW) * U64(places - k)) >> U64(32)).astype(np.int64)
        if k:
            at = np.arange(len(flat))
            place = order[at, to].astype(np.int64)
            order[at, to] = order[:, k]
            order[:, k] = place
        else:
            place = to
        np.minimum.at(least, owner * places + place, (U64(k) << U64(32)) | (draw >> U64(32)))
        open_ = (out.max(1) >> U64(32)) > k  # a later offer could still count
        stay = open_[owner]
        if k == 0:
            flat, owner, place = flat[stay], owner[stay], place[stay]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(flat), 1))
            order[np.arange(len(flat)), place] = 0
            order[:, 0] = place
        elif not stay.all():
            flat, owner, order = flat[stay], owner[stay], order[stay]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = signatures.shape[1] // ROWS
    value = (signatures.reshape(-1, bands, ROWS) * _ODD).sum(2, dtype=U64)
    return mix(mix(value) + np.arange(1, bands + 1, dtype=U64) * U64(_STEP))


def offered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all bands of all sets, and whose they are."""
    return band_keys(superminhash(sets)).reshape(-1), np.repeat(np.arange(len(sets)), BANDS)


def near_copies(docs: DataFrame, percent: int = 80, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents linked by shingle sets of Jaccard similarity percent / 100 or more, directly or by way of others.

    Words are runs between ASCII white space, A-Z lower-cased; a document's set has its distinct runs of `width` words,
    or all its words as one run if it has fewer. Returns one row per input row: key, n_shingles, component_id (the least
    key reachable, its own included) and kept (it is that document). Null, empty and blank texts have empty sets and link
    with nothing; null keys count as no key (component and kept of null keys alone are null); repeated rows are members
    like others. Other columns are not read. Equal sets are one class from the start and never missed; other links are
    found by bands, and missed with a probability of 5e-8 each at the threshold, less above. No bucket is capped: of a
    band's bucket all members meet the least one, and those that are then still apart are compared block by block. Keys
    travel packed, 48 bits of each."""
    found = keyed_components(docs, percent, width, key, text, 8_000_000, lambda _: offered, union_find)
    return found.select(F.col("key").alias(key), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their set, their component and whether they stay."""
    return near_copies(table(spark, sf_dir, "documents"))

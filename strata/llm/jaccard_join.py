"""N-gram Jaccard join by parity sketches.

Each document's distinct word shingles are XOR-hashed into a sparse bit sketch: a shingle flips the bit its hash names.
Shingles that two documents share cancel, so the Hamming distance of their sketches is at most the size of the symmetric
difference, and a Jaccard similarity of J bounds that by (1 - J) / (1 + J) of the sum of sizes. Within a band of sizes
all sketches are cut into the same parts; two that differ in d bits at most agree in all parts but d. Of M parts each
document offers d + 1, in an order common to all (fullest first), and two similar ones offer an equal part (pigeonhole
with slack, which keeps empty parts out of the keys). Equal parts make candidates, exact shingle sets decide.

A part's key is 48 bits of the XOR of its shingles' hashes with the number of the part and of the band, on the map side
and where keys meet. It says more than the part's bits do: sets that agree in a part of a sketch by chance, not by
their shingles, don't meet. Bits proper are compared after that, in sketches of whole sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import U64, mix, release, shingle_sets, slices, small_batches, sorted_set, stored, table, text_bytes
from strata.llm.components import components

#: A key with more different documents than this is resolved by stars and, where these leave a doubt, by blocks.
MANY = 8
#: Rows up to which a table of ids is broadcast; beyond, Spark joins by shuffling.
FEW = 2_000_000
#: Bits of the smallest dense sketch.
_DENSE = 2048


class Bands:
    """Bands of set sizes: band b has sizes from low[b] to high[b], and no similar pair spans more than two bands.
    Group b joins the smaller documents of band b with all that are similar in size, hence of band b or b + 1."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.low, self.high = percent, [], []
        size = 1
        while size <= largest:
            self.low.append(size)
            self.high.append(size * 100 // percent)
            size = self.high[-1] + 1
        self.starts = np.array(self.low)
        top = np.array(self.high)
        self.reach = top * 100 // percent  # largest partner
        #: Largest symmetric difference of a similar pair of the group: (1 - J) / (1 + J) of both sizes.
        self.errors = (100 - percent) * (top + self.reach) // (100 + percent)
        self.parts = np.maximum(-(-3 * (self.errors + 1) // 2), self.errors + 8)

    def groups(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, their group) for the band of each document and the band below. A group whose pairs differ in
        no element has none, as equal sets are one class."""
        band = np.searchsorted(self.starts, sizes, "right") - 1
        out = []
        for b in (band, band - 1):
            ok = np.flatnonzero((sizes > 0) & (b >= 0))
            ok = ok[(self.errors[b[ok]] > 0) & (sizes[ok] <= self.reach[b[ok]])]
            out.append((ok, b[ok]))
        return out


def part_keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts that each set offers, and whose they are."""
    sizes = np.array([len(s) for s in sets])
    keys, owners = [], []
    for docs, group in bands.groups(sizes):
        if not len(docs):
            continue
        flat = np.concatenate([sets[k] for k in docs])
        of = np.repeat(np.arange(len(docs)), sizes[docs])
        parts, need = bands.parts[group], bands.errors[group] + 1
        part = ((flat >> U64(32)) * parts[of].astype(U64)) >> U64(32)  # sets are sorted, and so are their parts
        new = np.append(True, (of[1:] != of[:-1]) | (part[1:] != part[:-1]))
        start = np.flatnonzero(new)
        value = np.bitwise_xor.reduceat(mix(flat ^ U64(0xC2B2AE3D27D4EB4F)), start)
        full = np.minimum(np.diff(np.append(start, len(flat))), 63)
        whose = of[start]
        key = mix(value ^ mix((group[whose].astype(U64) << U64(32)) | part[start]))
        order = np.argsort((whose.astype(U64) << U64(44)) | ((63 - full).astype(U64) << U64(38)) | (key >> U64(26)))
        sorted_by = whose[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_by, sorted_by)
        chosen = order[rank < need[sorted_by]]
        keys.append(key[chosen])
        owners.append(docs[whose[chosen]])
        for k in np.flatnonzero(np.bincount(whose, minlength=len(docs)) < need):  # too few full parts: empty ones, too
            empty = np.setdiff1d(np.arange(parts[k]), part[start][whose == k].astype(np.int64)).astype(U64)
            rest = np.sort(mix(mix((U64(group[k]) << U64(32)) | empty)))[: need[k] - (whose == k).sum()]
            keys.append(rest)
            owners.append(np.full(len(rest), docs[k]))
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set's contents; texts of equal sets are one class."""
    return mix(np.array([int(mix(s).sum(dtype=U64)) for s in sets], U64) ^ mix(np.array([len(s) for s in sets], U64)))


def pairs_of_keys(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From distinct (key, member) in order: pairs (all of a key of few members, a star for the others), then key and
    member of the latter."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    run = np.repeat(np.arange(len(start)), size)
    many = size[run] > MANY
    u, v = [], []
    for gap in range(1, min(MANY, len(keys))):
        a = np.flatnonzero(~many[: len(keys) - gap] & (run[:-gap] == run[gap:]))
        u.append(members[a])
        v.append(members[a + gap])
    hub = np.flatnonzero(many & (np.arange(len(keys)) != start[run]))
    u.append(members[start[run[hub]]])
    v.append(members[hub])
    return np.concatenate(u), np.concatenate(v), keys[many], members[many]


def _tallied(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller first."""
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])) if len(u) else np.zeros(0, bool)
    return u[new], v[new]


#: What gives the keys of a list of sets (none empty), and whose each is.
Offer = Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]
_FIELDS = ["bucket", "kind", "a", "b", "c", "d", "high", "low", "whose", "classes"]
_SCHEMA = "bucket long, kind int, a long, b long, c long, d long, high binary, low binary, whose binary, classes binary"
_DOC, _PAIR, _MEMBER, _KEYS = 0, 1, 2, 3


def _plain(bucket: int, kind: int, *columns) -> pa.RecordBatch:
    n = len(columns[0])
    own = [c if isinstance(c, pa.Array) else pa.array(np.asarray(c).view(np.int64)) for c in columns]
    own += [pa.nulls(n, pa.int64())] * (4 - len(own)) + [pa.nulls(n, pa.binary())] * 4
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int64)), pa.array(np.full(n, kind, np.int32)), *own], _FIELDS)


def _mapper(width: int, offer: Offer, buckets: int):
    """Texts to classes and packed keys by bucket. Equal sets of a task are seen once; of a key that a task has in many
    documents only a few go on, as its star and its members are known here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = -1 - TaskContext.get().partitionId()
        seen: set[int] = set()
        keys, owners, classes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            # 48 bits of a key, here and where keys meet, and 16 of its class by order of ids, sorted as one number.
            order = np.argsort(np.array(classes, U64))
            ids, rank = np.array(classes, U64)[order], np.empty(len(order), U64)
            rank[order] = np.arange(len(order), dtype=U64)
            both = np.concatenate(keys)
            keys.clear()
            both &= ~U64(0xFFFF)
            both |= rank[np.concatenate(owners)]
            owners.clear()
            both = sorted_set(both)
            key, who = both >> U64(16), (both & U64(0xFFFF)).astype(np.int32)
            del both
            start = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(start).astype(np.int32)
            size = np.diff(np.append(first, np.int32(len(key))))
            crowd = np.repeat(size > MANY, size)
            send = np.arange(len(key), dtype=np.int32) - np.repeat(first, size) <= MANY
            del start, first, size
            if crowd.any():
                u, v, k, m = pairs_of_keys(key[crowd], ids[who[crowd]])
                yield _plain(own, _PAIR, *_tallied(u, v))
                yield _plain(own, _MEMBER, k, m)
            key, who = key[send], who[send]
            del crowd, send
            bucket = ((key >> U64(16)) * U64(buckets)) >> U64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
            for b in range(buckets):
                part = slice(cuts[b], cuts[b + 1])
                if cuts[b + 1] > cuts[b]:
                    used, back = np.unique(who[part], return_inverse=True)
                    blobs = [pa.array([x.tobytes()], pa.binary()) for x in ((key[part] >> U64(16)).astype(np.uint32), key[part].astype(np.uint16), back.astype(np.uint16), ids[used])]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([_KEYS], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, *blobs], _FIELDS)

        for part in slices(batches, target=1 << 20):
            sets = shingle_sets(*text_bytes(part.column(1)), width)
            ids = class_ids(sets)
            yield _plain(own, _DOC, part.column(0), np.array([len(s) for s in sets], np.int64), ids, part.column(2))
            new = []
            for k, i in enumerate(ids.tolist()):
                if len(sets[k]) and i not in seen:
                    seen.add(i)
                    new.append(k)
            for a in range(0, len(new), 20_000):
                some = new[a : a + 20_000]
                if classes and (len(classes) + len(some) > 60_000 or held > 1_500_000):
                    yield from flush() if held else ()
                    keys, owners, classes, held = [], [], [], 0
                key, who = offer([sets[k] for k in some])
                keys.append(key)
                owners.append((who + len(classes)).astype(np.int32))
                classes += ids[some].tolist()
                held += len(key)
        if held:
            yield from flush()
        release()

    return run


def _reduce(rows: pa.Table) -> pa.Table:
    """Pairs and members of the keys of a bucket; documents and what tasks already know pass."""
    plain = rows.select(["kind", "a", "b", "c", "d"])
    if rows.num_rows and rows.column("kind")[0].as_py() != _KEYS:
        return plain
    keys, members = [], []
    for high, low, whose, classes in zip(*(rows.column(c).to_pylist() for c in ("high", "low", "whose", "classes")), strict=True):
        keys.append(np.frombuffer(high, np.uint32).astype(U64) << U64(16) | np.frombuffer(low, np.uint16))
        members.append(np.frombuffer(classes, U64)[np.frombuffer(whose, np.uint16)])
    key, member = np.concatenate(keys), np.concatenate(members)
    del keys, members
    ids, least = sorted_set(member), key.min()
    bits = U64(max(1, (len(ids) - 1).bit_length()))
    key -= least
    if int(key.max()).bit_length() + int(bits) <= 64:  # keys of a bucket are close: sorted with their member as one number
        key <<= bits
        key |= np.searchsorted(ids, member).astype(U64)
        del member
        key = sorted_set(key)
        member = ids[key & ((U64(1) << bits) - U64(1))]
        key >>= bits
    else:
        order = np.lexsort((member, key))
        key, member = key[order], member[order]
        new = np.append(True, (key[1:] != key[:-1]) | (member[1:] != member[:-1]))
        key, member = key[new], member[new]
    key += least
    u, v, k, m = pairs_of_keys(key, member)
    del key, member, ids
    u, v = _tallied(u, v)
    kind = np.concatenate([np.full(len(u), _PAIR, np.int32), np.full(len(k), _MEMBER, np.int32)])
    nothing = pa.nulls(len(kind), pa.int64())
    release()
    return pa.table([pa.array(kind), pa.array(np.concatenate([u, k]).view(np.int64)), pa.array(np.concatenate([v, m]).view(np.int64)), nothing, nothing], ["kind", "a", "b", "c", "d"])


def dense_sketch(values: np.ndarray) -> bytes:
    """A parity sketch of a power of two of bits, four per shingle or more and 2048 at least."""
    bits = max(_DENSE, 1 << int(4 * len(values) - 1).bit_length())
    return np.packbits((np.bincount((values & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch that fewer bits would have given: its parts, added modulo two."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words))


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v whose sizes and sketches allow that they are similar: sketches differ in no more bits than a
    similar pair has elements in one set alone."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for k in np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m)).tolist():
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), U64) for c in (4, 5))
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                ok[k] = (100 + percent) * apart <= (100 - percent) * int(n[k] + m[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok))

    first = sketches.select(F.col("class").alias("u"), F.col("size").alias("size_u"), F.col("sketch").alias("sketch_u"))
    second = sketches.select(F.col("class").alias("v"), F.col("size").alias("size_v"), F.col("sketch").alias("sketch_v"))
    return pairs.join(second, "v").join(first, "u").select("u", "v", "size_u", "size_v", "sketch_u", "sketch_v").mapInArrow(judge, "u long, v long")


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v whose sets are similar: 100 * intersection >= percent * union."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(a) > len(b):
                    a, b = b, a
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                ok[k] = 100 * shared >= percent * (len(a) + len(b) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok))

    second = sets.select(F.col("class").alias("v"), F.col("set").alias("set_v"))
    first = sets.select(F.col("class").alias("u"), F.col("set").alias("set_u"))
    return pairs.join(second, "v").join(first, "u").select("u", "v", "set_u", "set_v").mapInArrow(judge, "u long, v long")


def _doubts(members: DataFrame, parts: DataFrame, sketches: DataFrame, percent: int, forest: bool, block: int = 1024) -> DataFrame:
    """Pairs u, v of documents of a crowded key that are in different components still and whose sketches allow that
    they are similar. Each pair of blocks of a key's documents is a group of its own, of bounded size."""
    placed = members.join(parts.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y")
    blocks = open_.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = placed.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [folded(np.frombuffer(x.as_buffer(), U64), _DENSE // 64).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["member", "size", "sketch"])

    sketches = sketches.select("class", "size", "sketch").mapInArrow(short, "member long, size long, sketch binary")
    dealt = rows.join(sketches, "member").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    # Keys of one block share a group with others, keys of more have a group for each pair of blocks.
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(members.count() // 8_000 + 1))).otherwise(F.xxhash64("key", i, j))
    cells = dealt.select(group.alias("group"), (F.col("blocks") == 1).alias("whole"), "key", i.alias("i"), j.alias("j"), "mine", "member", "component", "size", "sketch")

    def near(rows: pa.Table) -> pa.Table:
        key, i, j, mine, ids, comp, size = (rows.column(c).to_numpy() for c in ("key", "i", "j", "mine", "member", "component", "size"))
        bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), U64).reshape(len(ids), -1)
        order = np.lexsort((j, i, key))
        new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0))
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cell in np.split(order, np.flatnonzero(new)[1:]):
            left = cell[mine[cell] == i[cell]]
            right = left if i[cell[0]] == j[cell[0]] else cell[mine[cell] != i[cell]]
            of = comp.copy() if forest else comp  # components as joined so far in this cell
            for k in left.tolist():
                some = right[of[right] != of[k]]
                some = some[100 * np.minimum(size[k], size[some]) >= percent * np.maximum(size[k], size[some])]
                if len(some):
                    apart = np.bitwise_count(bits[some] ^ bits[k]).sum(1).astype(np.int64)
                    some = some[(100 + percent) * apart <= (100 - percent) * (size[k] + size[some])]
                if forest and len(some):
                    joined, first = np.unique(of[some], return_index=True)
                    some = some[first]
                    of[cell[np.isin(of[cell], joined)]] = of[k]
                u.append(np.full(len(some), ids[k]))
                v.append(ids[some])
        u, v = _tallied(np.concatenate(u), np.concatenate(v))
        del bits, order
        release()
        return pa.table([pa.array(u), pa.array(v)], ["u", "v"])

    return cells.groupBy("group", "whole").applyInArrow(near, "u long, v long").distinct()


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def linked_classes(rows: DataFrame, own: DataFrame, pairs: DataFrame, members: DataFrame, percent: int, width: int, group: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """key, n_shingles and component_id of all documents, with hash and component (a name that no other component has, null
    without shingles), from candidates. rows: text, hash (of the text). own: key, n_shingles, class (of equal sets), hash.
    pairs: u, v, classes to compare. members: key, member, classes that meet under one key in numbers; pairs link them by
    stars only, and where that leaves several components they are compared block by block. group: components of edges."""
    sources = stored(own.where("n_shingles > 0").groupBy("class").agg(F.min("hash").alias("hash")), "sources")

    def gather(linked: DataFrame, kind: str, content) -> DataFrame:
        """class, size and content of all classes in the pairs, each from one of its texts, which are read again: only
        small columns are ever shuffled for it."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for part in slices(batches, 0, 1 << 20):
                new = [k for k, h in enumerate(part.column(1).to_pylist()) if not (h in seen or seen.add(h))]
                sets = shingle_sets(*text_bytes(part.column(0).take(pa.array(new, pa.int64()))), width)
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(sets).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array([content(s) for s in sets], pa.binary())], ["class", "size", kind])
            release()

        asked = linked.select(F.col("u").alias("class")).unionAll(linked.select(F.col("v").alias("class"))).distinct()
        wanted = stored(sources.join(asked, "class").select("hash").distinct(), "wanted")
        texts = rows.join(_few(wanted), "hash", "left_semi").select("text", "hash")
        return stored(texts.mapInArrow(read, f"class long, size long, {kind} binary").dropDuplicates(["class"]), kind)

    def check(linked: DataFrame) -> DataFrame:
        return stored(_checked(linked, gather(linked, "set", np.ndarray.tobytes), percent), "edges")

    sketches = gather(pairs, "sketch", dense_sketch)
    edges = check(stored(_likely(pairs, sketches, percent), "likely"))
    parts = stored(group(edges), "parts")
    tested = pairs
    for forest in (True, False):  # at first a few links, which mostly suffice, then whatever is still open
        near = stored(_doubts(members, parts, sketches, percent, forest), "near")
        if not near.limit(1).count():
            break
        doubts = stored(_likely(near.join(tested, ["u", "v"], "left_anti"), sketches, percent), "doubts")
        tested = tested.unionAll(near)
        more = check(doubts) if doubts.limit(1).count() else doubts
        if more.limit(1).count():
            edges = edges.unionAll(more)
            parts = stored(group(edges), "parts")
    classes = own.where("n_shingles > 0").groupBy("class").agg(F.min("key").alias("least"))
    joined = classes.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    label = joined.join(least, "component").select("class", "component_id", "component")
    linked = own.where("n_shingles > 0").join(label, "class").select("key", "n_shingles", "component_id", "hash", "component")
    alone = own.where("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"), "hash", F.lit(None).cast("long").alias("component"))
    return linked.unionAll(alone)


def keyed_components(docs: DataFrame, percent: int, width: int, key: str, text: str, bucket_chars: int, offers: Callable[[int], Offer], group: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """What linked_classes gives for documents, whose sets are candidates where they offer the same key. offers: for the
    most shingles that a text can have, what gives a set's keys."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    chars, longest = rows.agg(F.sum(F.length("text").cast("long")), F.max(F.length("text"))).first()
    packed = rows.mapInArrow(_mapper(width, offers(max(1, (longest or 0) // 2 + 2)), int((chars or 0) // bucket_chars) + 4), _SCHEMA)
    found = stored(packed.groupBy("bucket").applyInArrow(_reduce, "kind int, a long, b long, c long, d long"), "keys")
    own = found.where(F.col("kind") == _DOC).select(F.col("a").alias("key"), F.col("b").alias("n_shingles"), F.col("c").alias("class"), F.col("d").alias("hash"))
    pairs = stored(found.where(F.col("kind") == _PAIR).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "pairs")
    members = found.where(F.col("kind") == _MEMBER).select(F.col("a").alias("key"), F.col("b").alias("member")).distinct()
    return linked_classes(rows, own, pairs, members, percent, width, group)


def _parts(percent: int) -> Callable[[int], Offer]:
    def offers(largest: int) -> Offer:
        bands = Bands(percent, largest)
        return lambda sets: part_keys(sets, bands)

    return offers


def jaccard_components(docs: DataFrame, percent: int = 75, width: int = 5, key: str = "doc_id", text: str = "text", bucket_chars: int = 8_000_000) -> DataFrame:
    """Documents linked by shingle sets of Jaccard similarity percent / 100 or more, directly or by way of others.

    Words are runs between ASCII white space, A-Z lower-cased; a document's set has its distinct runs of `width` words,
    or all its words as one run if it has fewer. Returns one row per input row: key, n_shingles (size of the set) and
    component_id (the least key reachable, its own included). Null, empty and blank texts have empty sets and link with
    nothing; null keys count as no key (a component of null keys alone is null); repeated rows are members like others.
    Other columns are not read. Every link counts: nothing is sampled or capped. Sets hold 64-bit hashes of shingles.

    Equal sets are one class from the start. Keys travel packed, in buckets sized by the input; a key in many documents
    is cut down before the shuffle, its documents linked by a star, and where that leaves several components, block by
    block. Only ids and links are ever joined, and the sets of candidates."""
    return keyed_components(docs, percent, width, key, text, bucket_chars, _parts(percent)).select(F.col("key").alias(key), "n_shingles", "component_id")


def one_per_component(docs: DataFrame, percent: int = 75, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component: that of the least key, and among its texts that of the least
    hash. Documents without shingles or without key stay; of rows with equal key and text one stays. Rows go by key and
    text, so that a key that stands for several texts loses only those that another document stands for."""
    found = stored(keyed_components(docs, percent, width, key, text, 8_000_000, _parts(percent)).where(F.col("key").isNotNull()).select("key", "hash", "component_id", "component"), "components")
    first = found.where("key = component_id and component is not null")
    ties = first.groupBy("component").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least < most")
    later = first.join(ties, "component").where("hash > least").select("key", "hash")
    gone = stored(found.where("component_id < key").select("key", "hash").unionAll(later).distinct(), "gone")
    twice = stored(found.groupBy("key", "hash").count().where("count > 1").select("key", "hash"), "twice")
    marked = docs.withColumns({"_key": F.col(key).cast("long"), "_hash": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})

    def met(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        rows = _few(rows.select(F.col("key").alias("_key"), F.col("hash").alias("_hash")))
        return df.join(rows, ["_key", "_hash"], how).select(*df.columns)

    left = met(marked, gone, "left_anti")
    if not twice.limit(1).count():
        return left.select(*docs.columns)
    return met(left, twice, "left_anti").unionAll(met(left, twice, "left_semi").dropDuplicates(["_key", "_hash"])).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their set and their component."""
    return jaccard_components(table(spark, sf_dir, "documents"))

"""Repair of conversations' structure by a rank-convergent parallel Viterbi search.

A conversation is right if its roles read `(s?(ua)+)?`. The cheapest edits that make it so are a shortest path through
four states (nothing yet, after the system turn, after a user turn, after an assistant turn). Costs to the end are
vectors of four numbers; a row maps the vector after it to the vector before it. Turns are sorted over the cluster and
cut into chunks wherever a task or a chunk ends, so that no conversation has to lie in one task. Every chunk starts from
a speculative vector, as if the conversation ended there. Fix-up passes then hand each chunk the vector that the next
one found: it runs from the old and the new vector side by side until they differ by a constant only, from where on its
earlier work stands. When nothing changes any more, the stitched costs say at every row which edits are cheapest, and
each chunk traces the least audit from all four states, of which the chunk before it picks one.

Only codes of a byte a row take part in this; texts are shuffled once, to be written out with their edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import release, small_batches, stored, table

#: ASCII white space: 0x20 and 0x09-0x0D.
WHITE = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, BROKEN = 2, 5, 1, 5
#: State after a turn of the only role that may be put there: nothing yet, system, user and assistant last.
FOLLOWS = (2, 2, 3, 2)
#: Costs from each state when no row is left: a user turn needs its answer.
END = (0, 10, 5, 0)
#: Initials by code; all others are one.
INITIALS = "sua"
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


class Search:
    """Cost vectors up to a constant, numbered as they turn up, and what a row makes of each. There are few of them, as
    inserts bound the differences, so a row is a look-up. Codes: 0 must be deleted, else 1 + 4 * truncated + initial."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[int, tuple[int, list[tuple[str, int, int]]]] = {}
        self.end = self.number(END)

    def number(self, vector) -> int:
        """The number of a vector, whatever its constant."""
        least = min(vector)
        vector = tuple(int(x - least) for x in vector)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    def step(self, after: int, code: int) -> tuple[int, list[tuple[str, int, int]]]:
        """The vector before a row, and for each state the row's letters in the least audit, the state after and what
        they cost."""
        known = self.steps.get(after * 9 + code)
        if known is None:
            known = self.steps[after * 9 + code] = self._step(self.vectors[after], code)
        return known

    def _step(self, after: tuple[int, ...], code: int) -> tuple[int, list[tuple[str, int, int]]]:
        edits = []  # by state: (letter, state after, cost), letters ascending
        for state in range(4):
            own = [("D", state, DELETE)]
            if code:
                broken, initial = (BROKEN if code > 4 else 0), (code - 1) % 4
                if (initial == 0 and state == 0) or (initial == 1 and state != 2) or (initial == 2 and state == 2):
                    own.append(("K", initial + 1, broken))
                own.append(("R", FOLLOWS[state], REROLE + broken))
            edits.append(own)
        here = [min(cost + after[to] for _, to, cost in own) for own in edits]
        for _ in range(3):  # inserts before the row
            here = [min(here[s], INSERT + here[FOLLOWS[s]]) for s in range(4)]
        traced = []
        for state in range(4):
            letters, cost, at = "", 0, state
            while True:
                options = [*edits[at], ("I", -1, INSERT)]
                best = min(x for x, to, c in options if c + (here[FOLLOWS[at]] if x == "I" else after[to]) == here[at])
                letters += best
                if best != "I":
                    _, to, c = next(e for e in edits[at] if e[0] == best)
                    traced.append((letters, to, cost + c))
                    break
                cost, at = cost + INSERT, FOLLOWS[at]
        return self.number(here), traced

    def backward(self, codes: bytes, after: int) -> list[int]:
        """The vectors before each row, and that after the last."""
        out = [after]
        for code in reversed(codes):
            out.append(self.step(out[-1], code)[0])
        return out[::-1]

    def rerun(self, codes: bytes, was: int, now: int) -> int | None:
        """The vector before the first row if `now` and not `was` comes after the last; None if that changes nothing,
        because both runs meet in vectors that differ by a constant."""
        for code in reversed(codes):
            if was == now:
                return None
            was, now = self.step(was, code)[0], self.step(now, code)[0]
        return None if was == now else now

    def trace(self, codes: bytes, vectors: list[int], state: int) -> tuple[str, int, int]:
        """Letters, state after and cost of the least audit through the rows."""
        out, cost = [], 0
        for k, code in enumerate(codes):
            letters, state, more = self.step(vectors[k + 1], code)[1][state]
            out.append(letters)
            cost += more
        return "".join(out), state, cost

    def finish(self, state: int) -> tuple[str, int]:
        """Inserts at the end."""
        n = END[state] // INSERT
        return "I" * n, n * INSERT


_PIECE = "conv long, part int, seq int, open boolean, codes binary, first long, last long, turns long, head int, tail int, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _piece_types() -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return [kinds[x.split()[1]] for x in _PIECE.split(", ")]


def _pieces(chunk: int):
    """Sorted light rows to a row for each chunk. A conversation that lies in the middle of a task and in one chunk is
    settled there; the others stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, search, done = TaskContext.get().partitionId(), Search(), []
        now: list | None = None  # conv, seq, touches an edge, codes, first, last, turns, head, tail, counts
        before = None  # of the row before: conv, no conv, turn, no turn, key, initial

        def close(ends: bool, edge: bool) -> None:
            conv, seq, touches, codes, first, last, turns, head, tail, counts = now
            codes = b"".join(codes)
            open_, cost, audit = not ends or edge or touches or seq > 0, None, None
            if not open_:
                audit, state, cost = search.trace(codes, search.backward(codes, search.end), 0)
                more, extra = search.finish(state)
                audit, cost = audit + more, cost + extra
            done.append((conv, part, seq, open_, codes, first, last, turns, head, tail, *counts, cost, audit))

        def flush() -> pa.RecordBatch:
            rows = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), _piece_types(), strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(rows, _NAMES)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, turn, key, initial, blank, broken, later = (batch.column(k) for k in range(7))
            no_conv, no_turn = conv.is_null().to_numpy(zero_copy_only=False), turn.is_null().to_numpy(zero_copy_only=False)
            conv, turn = conv.fill_null(0).to_numpy(), turn.fill_null(0).to_numpy()
            initial = initial.to_numpy()
            blank, broken, later = (x.to_numpy(zero_copy_only=False) for x in (blank, broken, later))
            key = np.frombuffer(b"".join(key.to_pylist()), np.uint64).reshape(n, 2)

            def shifted(x, first, n=n):
                return np.concatenate([np.array([x[0] if first is None else first], x.dtype).reshape(1, *x.shape[1:]), x[: n - 1]])

            b = before or (None,) * 6
            same = (shifted(conv, b[0]) == conv) & (shifted(no_conv, b[1]) == no_conv)
            if before is None:
                same[0] = False
            same_turn = same & (shifted(turn, b[2]) == turn) & (shifted(no_turn, b[3]) == no_turn)
            again = same_turn & (shifted(key, b[4]) == key).all(1)
            wrong = same & ~_LEGAL[shifted(initial, b[5]), initial]
            copy = ~blank & (later | again)
            cut = ~blank & ~copy & broken
            code = np.where(blank | copy, 0, 1 + 4 * broken + initial).astype(np.uint8)
            new_turn = ~no_turn & ~same_turn
            sums = np.zeros((n + 1, 5), np.int64)
            np.cumsum(np.stack([blank, copy, cut, wrong, new_turn], 1), axis=0, out=sums[1:])
            before = (conv[-1], no_conv[-1], turn[-1], no_turn[-1], key[-1], initial[-1])
            starts = [0, *np.flatnonzero(~same[1:]) + 1, n]
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                if not same[a]:
                    if now is not None:
                        close(True, False)
                    now = [None if no_conv[a] else int(conv[a]), 0, now is None, [], None, None, 0, int(initial[a]), 0, [0] * 4]
                while a < z:
                    size = sum(map(len, now[3]))
                    if size >= chunk:
                        close(False, False)
                        now = [now[0], now[1] + 1, now[2], [], None, None, 0, int(initial[a]), 0, [0] * 4]
                        size = 0
                    to = min(z, a + chunk - size)
                    now[3].append(code[a:to].tobytes())
                    has = np.flatnonzero(~no_turn[a:to])
                    if len(has):
                        now[4] = int(turn[a + has[0]]) if now[4] is None else now[4]
                        now[5] = int(turn[a + has[-1]])
                    more = (sums[to] - sums[a]).tolist()
                    if not size and now[1]:  # pairs and turns across chunks are counted when they are stitched
                        more[3] -= int(wrong[a])
                        more[4] += int(same_turn[a] and not no_turn[a])
                    now[6] += more[4]
                    now[8] = int(initial[to - 1])
                    now[9] = [x + y for x, y in zip(now[9], more, strict=False)]
                    a = to
            if len(done) >= 2000:
                yield flush()
        if now is not None:
            close(True, True)
        if done:
            yield flush()
        release()

    return run


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = Search()
    for batch in batches:
        out = [list(search.vectors[search.backward(c, search.end)[0]]) for c in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(END)] * batch.num_rows, pa.list_(pa.int32())), pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "used", "out"])


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, part, seq, codes, used, out, want: chunks whose next chunk now starts with another vector run anew."""
    search = Search()
    for batch in batches:
        codes, used, out, want = (batch.column(k).to_pylist() for k in range(3, 7))
        for k, (c, was, now) in enumerate(zip(codes, used, want, strict=True)):
            if was != now and (found := search.rerun(c, search.number(was), search.number(now))) is not None:
                out[k] = list(search.vectors[found])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(6), pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names[:4], "used", "out"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, part, seq, codes, used: letters, state after and cost of each chunk from each of the four states."""
    search = Search()
    for batch in batches:
        rows = []
        for codes, used in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            vectors = search.backward(codes, search.number(used))
            rows.append([search.trace(codes, vectors, s) for s in range(4)])
        kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([[t[k] for t in r] for r in rows], kind) for k, kind in enumerate(kinds)]], [*batch.schema.names, "letters", "after", "costs"])


_DECISION = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _stitch(rows: pa.Table) -> pa.Table:
    """One conversation's chunks in order: the state that each ends in picks the next one's trace. A byte or so a row of
    the conversation, as its audit, which is one value, has that, too. Chunks whose vectors still aren't right after all
    passes, which takes long runs of rows that fit nowhere, are run again here."""
    search, chunks = Search(), sorted(rows.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    after, again = search.end, {}
    for k in range(len(chunks) - 1, -1, -1):
        c = chunks[k]
        if search.number(c["used"]) == after:
            after = search.number(c["out"])
        else:
            again[k] = search.backward(c["codes"], after)
            after = again[k][0]
    state, cost, audit, counts, turns, first, last, tail = 0, 0, [], [0] * 4, 0, None, None, None
    for k, c in enumerate(chunks):
        letters, state, more = search.trace(c["codes"], again[k], state) if k in again else (c["letters"][state], c["after"][state], c["costs"][state])
        audit.append(letters)
        cost += more
        counts = [x + c[n] for x, n in zip(counts, _COUNTS, strict=True)]
        counts[3] += int(tail is not None and not _LEGAL[tail, c["head"]])
        turns += c["turns"] - int(last is not None and c["first"] == last)
        first, last, tail = c["first"] if first is None else first, last if c["last"] is None else c["last"], c["tail"]
    letters, more = search.finish(state)
    gaps = last - first + 1 - turns if turns else 0
    values = [chunks[0]["conv"], gaps, *counts, cost + more, "".join(audit) + letters]
    return pa.table([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], [x.split()[0] for x in _DECISION.split(", ")])


#: A chunk's place under other names, for joins of chunks with what was found about them.
_OTHER = ["conv_2", "part_2", "seq_2"]
_SAME = "conv <=> conv_2 and part = part_2 and seq = seq_2"


def _other() -> list[Column]:
    return [F.col(c[:-2]).alias(c) for c in _OTHER]


def decide(light: DataFrame, chunk: int = 2048, passes: int = 8) -> DataFrame:
    """conv, counts, cost and audit of every conversation. light: conv, turn (long), key (16 bytes for role and text),
    initial (0 to 3), blank, broken (truncated), later (an earlier turn of the conversation has the same key)."""
    spark = light.sparkSession
    order = ["conv", "turn", "key"]
    spread = light.select(*order, "initial", "blank", "broken", "later").repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(spread.mapInArrow(_pieces(chunk), _PIECE), "pieces")
    gaps = F.when(F.col("turns") > 0, F.col("last") - F.col("first") + 1 - F.col("turns")).otherwise(0)
    settled = pieces.where("not open").select("conv", gaps.alias("gaps"), *_COUNTS, "cost", "audit")
    open_ = pieces.where("open")
    if not open_.limit(1).count():
        return settled
    vectors = "conv long, part int, seq int, codes binary, used array<int>, out array<int>"
    state = stored(open_.select("conv", "part", "seq", "codes").mapInArrow(_first_pass, vectors), "vectors")
    following = Window.partitionBy("conv").orderBy("part", "seq")
    for _ in range(passes):
        # Chunks' vectors only; their codes stay where they are and are met again by chunk.
        want = state.select(*_other(), F.coalesce(F.lead("out").over(following), F.array(*[F.lit(x) for x in END])).alias("want"))
        joined = state.join(want, F.expr(_SAME)).select("conv", "part", "seq", "codes", "used", "out", "want")
        state = stored(joined.withColumn("moved", F.col("used") != F.col("want")), "passes")
        if not state.where("moved").limit(1).count():
            break
        state = stored(state.drop("moved").mapInArrow(_fix_up, vectors), "vectors")
    traced = state.select("conv", "part", "seq", "codes", "used").mapInArrow(_traces, "conv long, part int, seq int, codes binary, used array<int>, letters array<string>, after array<int>, costs array<long>")
    whole = traced.join(state.select(*_other(), "out"), F.expr(_SAME)).drop(*_OTHER)
    whole = whole.join(open_.select(*_other(), "first", "last", "turns", "head", "tail", *_COUNTS), F.expr(_SAME)).drop(*_OTHER)
    return settled.unionByName(whole.groupBy("conv").applyInArrow(_stitch, _DECISION))


def _light(rows: DataFrame) -> DataFrame:
    """Turns (conv, turn, key, role, text) without their texts: what the search has to know of them."""
    bare = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = stored(rows.select("conv", "turn", "key", code.cast("int").alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("broken")), "turns")
    # A key is the conversation's, too. Within a turn equal rows are neighbours; only keys of several turns are looked up.
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))
    spans = light.groupBy("key").agg(F.min(when).alias("least"), F.max(when).alias("most")).where("least < most").select(F.col("key").alias("k"), "least")
    first = stored(spans, "spans")
    later = F.coalesce(when > F.col("least"), F.lit(False))
    return light.join(first, light.key == first.k, "left").select(*light.columns, later.alias("later"))


def _written(digest: bool):
    """Sorted turns, each conversation's decision first (kind 0: counts in role, audit in text), to its repaired turns or
    to one row with their hash. Turns pass by one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        none = object()
        conv, audit, at, state, place, counts, sha = none, "", 0, 0, 0, [0] * 6, hashlib.sha256()

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place
            if digest:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            else:
                out.append((conv, place, edit, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = FOLLOWS[state]
                put("I", "user" if state == 2 else "assistant", "")
                at += 1

        def end() -> None:
            if conv is not none:
                inserts()
                if digest:
                    out.append((conv, *counts, audit, sha.hexdigest()))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2 if digest else [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            rows = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, _DIGEST_NAMES if digest else _TURN_NAMES)

        for batch in batches:
            for c, kind, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text")), strict=True):
                if conv is none or c != conv:
                    end()
                    conv, audit, at, state, place, counts, sha = c, "", 0, 0, 0, [0] * 6, hashlib.sha256()
                if kind == 0:
                    audit, counts = text, [int(x) for x in role.split(",")]
                elif kind == 1:
                    inserts()
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        state = INITIALS.index(role[0]) + 1
                        put(edit, role, text)
                    elif edit == "R":
                        state = FOLLOWS[state]
                        put(edit, "user" if state == 2 else "assistant", text)
            if len(out) >= (2000 if digest else 200):
                yield flush()
        end()
        if out:
            yield flush()
        release()

    return run


_DIGEST = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DIGEST_NAMES = [x.split()[0] for x in _DIGEST.split(", ")]
_TURNS = "conv long, place long, edit string, role string, text string"
_TURN_NAMES = [x.split()[0] for x in _TURNS.split(", ")]


def repair(turns: DataFrame, convs: DataFrame | None = None, digest: bool = False, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 2048) -> DataFrame:
    """The turns of all conversations after the cheapest edits: conv_id, place (from 0), edit (K kept, R given another
    role, I inserted), role, text. With digest=True a row for each conversation instead: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256, the hash of its turns as `role:text`, joined by newlines.

    Turns are taken by number, those without one first; of equal numbers by a hash of role and text, so that the order
    never depends on how rows are stored. Null roles and texts count as one space, a null conversation is one of its own.
    Roles count by their first letter; a role that doesn't begin with s, u or a (an empty one, too) can't be kept as it
    is. Repeated rows are duplicates like others. convs (first column: ids) adds conversations that have no turns: zeros,
    no audit, the hash of nothing; without turns and convs the result is empty. Other columns are not read, so their
    names don't matter.

    A hash over a whole conversation is a chain: one task reads a conversation's turns for it, in order, a batch at a
    time. The search itself is cut anywhere."""
    small_batches(turns.sparkSession, 1000)
    space = F.lit(" ")
    flat = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = flat.withColumn("key", F.unhex(F.md5(name)))
    decisions = stored(decide(_light(rows), chunk), "decisions")
    said = F.concat_ws(",", *[F.col(c).cast("string") for c in ("gaps", *_COUNTS, "cost")])
    nothing = [F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key")]
    told = rows.select("conv", F.lit(1).alias("kind"), "turn", "key", "role", "text").unionByName(decisions.select("conv", F.lit(0).alias("kind"), *nothing, said.alias("role"), F.col("audit").alias("text")))
    if convs is not None:
        told = told.unionByName(convs.select(F.col(convs.columns[0]).cast("long").alias("conv"), F.lit(2).alias("kind"), *nothing, F.lit("").alias("role"), F.lit("").alias("text")))
    ordered = told.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "key").select("conv", "kind", "role", "text")
    return ordered.mapInArrow(_written(digest), _DIGEST if digest else _TURNS).withColumnRenamed("conv", conv)


def lot(rows: DataFrame) -> Column:
    """crc32(`conv_id:turn`) % 20, nulls as one space."""
    return F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20


def damaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) damaged by lot: 0 drops a row, 1 empties its text, 2 takes out its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Also the ids of dropped rows."""
    space, n = F.lit(" "), F.col("lot")
    drawn = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), lot(rows).alias("lot"))
    text = F.when(n == 1, "").when(n == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = drawn.where(n != 0).select("conv_id", "turn", F.when(n == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(n == 3, 2).otherwise(1))).alias("copy"))
    return hurt.drop("copy"), drawn.where(n == 0).select("conv_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: a row for each conversation, those that lost all turns included."""
    hurt, lost = damaged(table(spark, sf_dir, "conversations"))
    return repair(hurt, lost, digest=True)

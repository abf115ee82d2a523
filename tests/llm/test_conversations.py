"""Repair and prefix trie of conversations against brute force, with nulls, ties, odd roles, long and empty ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strata.llm import conversation_repair as repair
from strata.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"
FOLLOWS = (2, 2, 3, 2)


def table(spark, rows, parts=5):
    """Rows with extra columns of names that the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit("x") for c in ("key", "conv", "kind", "place", "part", "seq", "lot", "copy")})


def damaged_rows(rows):
    """conv: [(order, role, text)] after damage, in order."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if n == 1 else re.sub("[.!?]", "", x) if n == 2 else x
        r = "user" if n == 4 else r
        key = hashlib.md5(f"{'-' if c is None else c}:{len(r)}:{r}{x}".encode()).digest()
        by[c] += [((t is not None, t or 0, key), r, x)] * (0 if n == 0 else 2 if n == 3 else 1)
    return {c: sorted(rs, key=lambda z: z[0]) for c, rs in by.items()}


def cheapest(rows, faults):
    """cost, audit and repaired turns by a forward search over whole audits."""
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for s, (cost, audit, out) in list(best.items()):
                to = FOLLOWS[s]
                new = cost + 5, audit + "I", (*out, "user:" if to == 2 else "assistant:")
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (cost, audit, out) in inserted(best).items():
            found = [(s, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (role[:1] == "s" and s == 0) or (role[:1] == "u" and s != 2) or (role[:1] == "a" and s == 2):
                    found.append(("sua".index(role[0]) + 1, (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                found.append((FOLLOWS[s], (cost + 1 + more, audit + "R", (*out, f"{'user' if FOLLOWS[s] == 2 else 'assistant'}:{text}"))))
            for to, way in found:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = new
    best = inserted(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda z: z[:2])


def repaired_by_brute_force(rows):
    out = {}
    for c, rs in damaged_rows(rows).items():
        turns = {z[0][1] for z in rs if z[0][0]}
        seen, faults = set(), []
        for _, r, x in rs:
            faults.append("blank" if not x.strip(WHITE) else "duplicate" if (r, x) in seen else "truncated" if x.rstrip(WHITE)[-1] not in ".!?" else "")
            seen.add((r, x))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit, kept = cheapest(rs, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def some_conversations(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(rng.choice([0, 1, 2, 3, 8, 30, 120])):
            text = rng.choice(["a.", "b!", "c", " ", "", "d?  ", "x. y", "q.\n", "é!"]) + (str(t) + rng.choice([".", ""]) if rng.random() < 0.6 else "")
            rows.append((c, rng.choice([t, t, t, t, None, t // 2]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", ""]), text))
    return rows + [(c, 5, "user", None) for c in range(5)]


@pytest.mark.parametrize("chunk", [3, 2048])
def test_repairs_equal_brute_force_wherever_chunks_are_cut(spark, chunk):
    rows = some_conversations(chunk)
    hurt, lost = repair.damaged(table(spark, rows))
    got = [tuple(r) for r in repair.repair(hurt, lost, digest=True, chunk=chunk).collect()]
    assert {r[0]: r for r in got} == repaired_by_brute_force(rows) and len(got) == len({r[0] for r in rows})


def test_runs_that_never_converge_and_repeated_rows(spark):
    """All rows truncated: the chunks' vectors pass through unchanged, so no fix-up settles them."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"no end {i}") for i in range(700)] + [(2, None, "user", "x.")] * 30
    hurt, lost = repair.damaged(table(spark, rows))
    assert {r.conv_id: tuple(r) for r in repair.repair(hurt, lost, digest=True, chunk=20).collect()} == repaired_by_brute_force(rows)


def test_repaired_turns_read_as_they_should(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "assistant", "c!"), (3, 0, "system", "s."), (3, 1, "user", "u."), (3, 2, "assistant", "word " * 200_000 + ".")]
    got = sorted((r.conv_id, r.place, r.edit, r.role, len(r.text)) for r in repair.repair(table(spark, rows)).collect())
    assert got == [(1, 0, "K", "user", 2), (1, 1, "R", "assistant", 2), (3, 0, "K", "system", 2), (3, 1, "K", "user", 2), (3, 2, "K", "assistant", 1_000_001)]
    assert repair.repair(table(spark, rows).limit(0)).count() == 0
    assert [tuple(r)[1:8] for r in repair.repair(table(spark, rows).limit(0), spark.createDataFrame([(9,)], "c long"), digest=True).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_rank_convergence_keeps_what_it_has():
    search = repair.Search()
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.choices(range(9), [1, 1, 9, 9, 1, 1, 2, 2, 1], k=rng.randrange(1, 60)))
        was, now = (search.number([rng.randrange(12) for _ in range(4)]) for _ in range(2))
        found = search.rerun(codes, was, now)
        a, b = (search.backward(codes, v)[0] for v in (was, now))
        assert (found is None) == (a == b) and found in (None, b)


def trie_by_brute_force(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append(((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest()), r, x))
    own = {c: [z[1:] for z in sorted(v, key=lambda z: z[0])] for c, v in by.items()}
    whole = {}
    for c in own:
        h, rest = zlib.crc32(str(c).encode()) % 9, abs(c) % 5 * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(c - rest, [])[:h] + own[c][h:])
    members, kids = defaultdict(list), defaultdict(int)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode())
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = {p: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def trie_rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def test_trie_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(-12, 40), None, 1000]:
        for t in range(rng.choice([0, 1, 2, 3, 8, 9, 30])) if c not in (15, 22) else ():
            rows.append((c, rng.choice([t, t, t, t, None, t // 2]), rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else "user", rng.choice(["a", "é", None])))
    assert trie_rows(trie.prefix_trie(*trie.rebuilt(table(spark, rows)))) == trie_by_brute_force(rows)
    assert trie.prefix_trie(*trie.rebuilt(table(spark, rows).limit(0))).count() == 0


def test_deep_tries_are_cut_and_grafted(spark):
    rows = [(c, t, "user", f"t{t}" if t < cut else f"t{t}-{c}") for c, n, cut in ((5, 260, 260), (6, 200, 190), (7, 129, 129), (8, 64, 64), (1000, 260, 128), (1001, 65, 10)) for t in range(n)]
    rows += [(c, t, "user", "same") for c in range(100, 150) for t in range(2)] + [(100, 1, "user", "same")] * 2
    assert trie_rows(trie.prefix_trie(*trie.rebuilt(table(spark, rows)))) == trie_by_brute_force(rows)


def test_places_go_on_across_tasks(spark):
    light = spark.createDataFrame([(c, t, bytes([t % 250] * 16), 1) for c, n in ((1, 500), (2, 3), (3, 400)) for t in range(n)], "conv long, turn long, key binary, bytes long")
    got = defaultdict(list)
    for r in trie.ordered(light).collect():
        got[r.conv].append(r.place)
    assert {c: sorted(p) == list(range(len(p))) for c, p in got.items()} == {1: True, 2: True, 3: True}

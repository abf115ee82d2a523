"""SuperMinHash against its definition, near copies against brute force; and the cases that other operators were mended for."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import components, html_text, jaccard_join, superminhash, url_filter
from strata.llm.common import U64, mix


def by_definition(elements, places):
    """One element after the other, one place after the other."""
    out = [2**64 - 1] * places
    for e in elements:
        order = list(range(places))
        for k in range(places):
            draw = int(mix(np.array([(int(e) + 0x9E3779B97F4A7C15 * (k + 1)) % 2**64], U64))[0])
            to = k + (((draw % 2**32) * (places - k)) >> 32)
            order[k], order[to] = order[to], order[k]
            out[order[k]] = min(out[order[k]], (k << 32) | (draw >> 32))
    return out


def test_signatures_are_as_defined():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(U64)) for n in (1, 2, 5, 30, 200, 700, 0)]
    got = superminhash.superminhash(sets, 64)
    assert [g.tolist() for g in got] == [by_definition(s, 64) for s in sets]
    assert superminhash.superminhash([]).shape == (0, superminhash.PLACES)


def test_variance_is_below_that_of_independent_hashes():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(150):
        x = rng.integers(0, 2**63, 50).astype(U64)
        a, b = superminhash.superminhash([np.sort(x[:45]), np.sort(x[5:])])
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.9 * (0.8 * 0.2 / superminhash.PLACES) ** 0.5


def brute(rows, percent=80, width=4):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
        for x in s:
            holders[x].append(k)
    least = {}
    for k, (key, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, key), key)
    return sorted((key, len(sets[k]), least[find(k)], key == least[find(k)]) for k, (key, _) in enumerate(rows))


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "one", "One", "one two three", "a b c d", "A b\tc d"]
    passage = [f"p{k}" for k in range(60)]
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, len(words) // 25 + 2)):
                words[rng.randrange(len(words))] = rng.choice(["x", "y", "zz"])
            texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(3, "one"), (len(texts) + 5, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"key": F.lit(1), "class": F.lit(2), "hash": F.lit(3), "component": F.lit(4)})
    assert sorted(tuple(r) for r in superminhash.near_copies(df).collect()) == brute(rows)
    assert superminhash.near_copies(df.limit(0)).count() == 0


def test_null_keys_count_as_none(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "q r s t")], "doc_id long, text string")
    assert sorted((tuple(r) for r in superminhash.near_copies(df).collect()), key=str) == sorted([(None, 2, 4, None), (4, 2, 4, True), (None, 1, None, None)], key=str)


def test_one_document_stays_of_each_component_whatever_its_key(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t", "completely different words of another document here"
    rows = [(1, a), (5, a), (5, b), (7, a + " u"), (9, b), (9, b), (None, a), (8, "")]
    kept = jaccard_join.one_per_component(spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")))
    assert kept.columns == ["doc_id", "text", "hash"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (None, a), (8, "")], key=str)
    same = spark.createDataFrame([(5, a), (5, a + " u"), (6, a + " v")], "doc_id long, text string")
    assert jaccard_join.one_per_component(same).count() == 1


@pytest.mark.parametrize("page", ["<a" * 300_000, "<a href=\"" * 60_001, "<div>" * 60_000 + "x", "<div>" * 60_000 + "</span>" * 60_000, "<p>x<div>" * 60_000, "<!-- " * 100_000, "<ul>" + "<li>a" * 60_000])
def test_broken_pages_cost_their_length(page):
    began = time.time()
    read = html_text.read_page(page)
    best = read.best()
    assert best is None or isinstance(read.text(best[0]), str)
    assert time.time() - began < 20


def test_long_hosts_are_split_like_others(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghij") for _ in range(5_000))
    hosts = [long + "casino.org", "bigcasino.com", "big.net", "ab" * 100 + "x.net"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    paths = spark.createDataFrame([("/casino/news",), ("/" + "ab" * 100 + "/q",), ("/casino",)], "path string")
    counts = Counter(w for h in hosts for w in re.findall("[a-z]+", h)) + Counter(w for p in ("/casino/news", "/" + "ab" * 100 + "/q", "/casino") for w in re.findall("[a-z]+", p))
    in_paths = Counter(["casino", "news", "ab" * 100, "q", "casino"])
    total = sum(counts.values())
    want = {}
    for h in hosts:
        want[h] = [w for name in re.findall("[a-z]+", h) for w in url_filter.viterbi(name, {w: (in_paths[w] if w == name else n) for w, n in counts.items() if len(w) >= 3 and w in name and (w != name or in_paths[w])}, total)]
    got = {r.host: r.words for r in url_filter.host_words(df, paths).collect()}
    assert got == want and got[hosts[0]][-2:] == ["casino", "org"] and got[hosts[3]][:2] == ["ab" * 100, "x"]


def least_reachable(edges):
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = start
                    todo += near[x]
    return out


def test_union_find_and_stars_find_the_same_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (-3, 400)]
    want = least_reachable((u, v) for u, v in edges if u != v)
    df = spark.createDataFrame(edges, "u long, v long")
    for size in (1_000_000, 50):
        found = [tuple(r) for r in components.union_find(df, task_edges=size).collect()]
        assert dict(found) == want and len(found) == len(want)
    assert components.union_find(df.limit(0)).count() == 0
    u, v = (np.array(x) for x in zip(*[e for e in edges if e[0] != e[1]]))
    nodes, roots = components.joined(u, v)
    assert {n: r for n, r in want.items() if n != r} == dict(zip(nodes.tolist(), roots.tolist()))

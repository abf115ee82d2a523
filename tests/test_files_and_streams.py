"""Whole-file digests, ingest of changed files, long metrics, runs that end when drained, and small mends."""

import hashlib
import random
import threading
import time

from pyspark.sql import functions as F

from strata.operators import cdc, marts, quality
from strata.sources import raw
from strata.streaming import stream


def test_files_are_judged_by_their_bytes(spark, tmp_path):
    landing, manifest = tmp_path / "landing", f"{tmp_path}/manifest"
    landing.mkdir()
    for name, text in (("a.csv", "h\n1\n2\n"), ("b.csv", "h\n1\n"), ("empty.csv", "")):
        (landing / name).write_text(text)
    prints = {r["name"]: (r.sha, r.length) for r in raw.fingerprints(spark, str(landing)).collect()}
    assert prints == {n: (hashlib.sha256(t.encode()).hexdigest(), len(t)) for n, t in (("a.csv", "h\n1\n2\n"), ("b.csv", "h\n1\n"))}

    def run():
        return {(r["name"], r.action, r.n_rows) for r in raw.ingest(spark, str(landing), manifest).collect()}

    assert run() == {("a.csv", "loaded", 3), ("b.csv", "loaded", 2)}
    assert {a for _, a, _ in run()} == {"skipped"}
    (landing / "b.csv").write_text("h\n2\n")  # one byte, same size
    assert run() == {("a.csv", "skipped", 0), ("b.csv", "loaded", 2)}
    (landing / "b.csv").write_text("h\n1\n")  # back to what is known
    assert {a for _, a, _ in run()} == {"skipped"}


def test_digests_compared(spark):
    a = spark.createDataFrame([("same", "1"), ("other", "1"), ("gone", "1")], "name string, said string")
    b = spark.createDataFrame([("same", "1"), ("other", "2"), ("new", "1")], "name string, seen string")
    assert {tuple(r) for r in raw.compared(a, b, "name", "said", "seen").collect()} == {("same", "equal"), ("other", "differs"), ("gone", "missing"), ("new", "unexpected")}


def test_metrics_have_rows_for_empty_layers(spark):
    s = spark.createDataFrame([("bronze", "a", 3, 30), ("bronze", "b", 4, 40)], "layer string, table string, rows long, bytes long")
    got = {tuple(r) for r in raw.metrics(s, ["rows", "bytes"], ["bronze", "gold"]).collect()}
    assert {("bronze", "TOTAL", "rows", 7), ("bronze", "TOTAL", "bytes", 70), ("gold", "TOTAL", "rows", 0), ("gold", "TOTAL", "bytes", 0), ("bronze", "a", "rows", 3)} <= got and len(got) == 8


def test_a_run_ends_when_it_is_drained_and_not_before(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def put(first, last):
        spark.range(first, last).select(F.lit("t").alias("topic"), F.lit(0).cast("long").alias("partition"), F.col("id").alias("offset"), F.lit("v").alias("value")).coalesce(1).write.mode("append").parquet(src)

    put(0, 40)
    source = spark.readStream.schema("topic string, partition long, offset long, value string").parquet(src)
    late = threading.Thread(target=lambda: (time.sleep(4), put(40, 70)))
    late.start()
    why, rows = stream.until_drained(stream.running_stream(source, out, str(tmp_path / "progress"), 25), lambda seen: 70 - seen, idle_seconds=1.0, most_seconds=120)
    late.join()
    assert (why, rows) == ("drained", 70)
    assert spark.read.parquet(out).agg(F.count("*"), F.countDistinct("offset"), F.max("offset")).first()[:] == (70, 70, 69)
    why, rows = stream.until_drained(stream.running_stream(source, out, str(tmp_path / "progress"), 25), lambda seen: 5, idle_seconds=0.5, most_seconds=4)
    assert (why, rows) == ("out of time", 0)


def test_change_log_state_needs_no_window(spark):
    rng = random.Random(2)
    rows = [(k, s, rng.choice(["INSERT", "UPDATE", "DELETE"]), rng.choice(["p", None])) for s, k in enumerate(rng.choices(range(40), k=300))]
    df = spark.createDataFrame(rows, "card long, seq long, op string, profile string").repartition(4)
    state = cdc.apply_log(df, "card", "seq", "op", ["profile"])
    assert "Window" not in state._jdf.queryExecution().executedPlan().toString()
    for r in state.collect():
        own = [x for x in rows if x[0] == r.card]
        inserts, flags = 0, [False] * 3
        for _, _, op, _ in own:
            flags[0] |= op == "UPDATE" and not inserts
            flags[1] |= op == "INSERT" and inserts > 0
            flags[2] |= op == "DELETE" and not inserts
            inserts += op == "INSERT"
        assert [r.implicit_insert, r.repeated_insert, r.delete_without_insert] == flags
        assert r.state == ("INACTIVE" if own[-1][2] == "DELETE" else "ACTIVE") and r.profile == next((x[3] for x in own[::-1] if x[3]), None)


def test_distinct_cards_add_up_from_bitmaps(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(2), rng.choice([None, *range(0, 200_000, 7001)])) for _ in range(500)]
    f = spark.createDataFrame(rows, "day int, mode int, card long")
    maps = marts.card_bitmaps(f, ["day", "mode"], "card")
    for keys, pick in ((["day"], lambda r: r[0]), (["mode"], lambda r: r[1])):
        got = {r[keys[0]]: r.cards for r in marts.distinct_cards(maps, keys).collect()}
        assert got == {k: len({r[2] for r in rows if pick(r) == k and r[2] is not None}) for k in {pick(r) for r in rows}}
    assert marts.distinct_cards(maps, []).first().cards == len({r[2] for r in rows} - {None})


def test_unique_ignores_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, 1), (2, 1), (2, 1), (3, None), (3, None)], "a int, b int")
    assert quality.unique(df, ["a"]).first()[0] == 2 and quality.unique(df, ["a", "b"]).first()[0] == 1

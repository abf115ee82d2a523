import hashlib
import hmac
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from strata.functions import parsing as P
from strata.operators import cdc, features, identity, marts, ml, quality
from strata.plans import ingest, tables
from strata.streaming import stream


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_fields_and_casts_turn_errors_into_null(spark):
    df = spark.createDataFrame([("a, ,3",), ("x",), ('"q",1,2,',), (None,)], "raw string")
    got = df.select(*[P.field(F.col("raw"), i).alias(f"f{i}") for i in range(4)]).collect()
    assert [tuple(r) for r in got] == [("a", None, "3", None), ("x", None, None, None), ('"q"', "1", "2", None), (None,) * 4]
    one = spark.range(1).select(P.safe(F.lit("1.0"), "bigint").alias("a"), P.parse_time(F.lit("31/02/2024"), "dd/MM/yyyy").alias("b"), P.minor_units(F.lit(250)).cast("double").alias("c")).first()
    assert tuple(one) == (None, None, 2.5)


def test_json_tells_object_from_null_and_survives_garbage(spark):
    df = spark.createDataFrame([('{"exit":{"station":3}}',), ('{"exit":null}',), ("{oops",), (None,)], "j string")
    got = df.select(P.json_is_object(F.col("j"), "$.exit").alias("o"), P.json_field(F.col("j"), "$.exit.station", "bigint").alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, 3), (False, None), (False, None), (False, None)]


def test_truncation_hides_what_lies_beyond(spark):
    t = datetime
    df = spark.createDataFrame([(1, t(2024, 1, 1), t(2024, 1, 9), 5), (2, t(2024, 1, 5), None, 6), (3, None, None, 7), (4, t(2024, 1, 8), None, 8)], "id int, a timestamp_ntz, b timestamp_ntz, fare int")
    got = rows(P.truncate_at(df, "a", "2024-01-05", {"b": "b,fare"}).select("id", "b", "fare"))
    assert got == [(1, None, None), (2, None, 6), (3, None, 7)]


LOG = [  # card, seq, op, profile
    (1, 1, "INSERT", "a"), (1, 2, "UPDATE", "b"), (1, 3, "DELETE", None),
    (2, 4, "UPDATE", "c"), (3, 5, "DELETE", None), (4, 6, "INSERT", "d"), (4, 7, "INSERT", None),
    (5, 8, "INSERT", "e"), (5, 9, "DELETE", None), (5, 10, "UPDATE", None),
]


def log(spark):
    df = spark.createDataFrame(LOG, "card long, seq long, op string, profile string")
    return df.withColumn("t", F.timestamp_seconds(F.when(F.col("seq") == 2, 0).otherwise(F.col("seq"))).cast("timestamp_ntz"))


def test_change_log_state_and_anomalies(spark):
    got = {r.card: r for r in cdc.apply_log(log(spark), "card", "seq", "op", ["profile"]).collect()}
    assert {k: (r.state, r.profile) for k, r in got.items()} == {1: ("INACTIVE", "b"), 2: ("ACTIVE", "c"), 3: ("INACTIVE", None), 4: ("ACTIVE", "d"), 5: ("ACTIVE", "e")}
    assert [k for k, r in got.items() if r.implicit_insert] == [2]
    assert [k for k, r in got.items() if r.repeated_insert] == [4]
    assert [k for k, r in got.items() if r.delete_without_insert] == [3]


def test_history_balance_and_asof_agree(spark):
    df = log(spark)
    hist = cdc.scd2(df, "card", "seq", "op", "t", ["profile"])
    assert hist.where("is_current").count() == 5
    assert [r.seq for r in hist.where("clock_back").collect()] == [2]
    for bucket in (1, 3, 100):
        got = rows(cdc.balance(df, "card", "seq", "op", bucket).select("seq", "balance"))
        assert got == [(1, 1), (2, 1), (3, 0), (4, 1), (5, 1), (6, 2), (7, 2), (8, 3), (9, 2), (10, 3)]
    asof = cdc.as_of(hist.withColumn("t0", F.col("valid_from")), ["1970-01-02"], "card", "t0", "seq", ["op"])
    assert {r.card: r.op for r in asof.collect()}[1] == "DELETE"


def test_first_failing_rule_wins_and_repeats_compete_among_survivors(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "x", -1), (3, "x", 5), (4, "x", 6), (5, None, -1)], "id int, key string, n int")
    rules = [quality.Rule("R1", F.col("key").isNull(), "no key"), quality.Rule("R2", F.col("n") < 0, "negative")]
    done = quality.label_repeats(quality.label(df, rules), [F.col("key")], [F.col("id")], "R9", "again")
    assert rows(done.select("id", "rule_id")) == [(1, "R1"), (2, "R2"), (3, None), (4, "R9"), (5, "R1")]
    assert quality.valid(done).count() == 1


def test_summary_has_total_without_rejects(spark):
    df = quality.label(spark.createDataFrame([(1,), (2,)], "key int"), [quality.Rule("R", F.col("key") > 9, "x")])
    assert rows(quality.summary({"s": df})) == [("s", "TOTAL", 0, 2, 0.0)]


def test_hmac_equals_an_independent_one(spark):
    key = b"k" * 20
    got = spark.createDataFrame([("año 1",), ("",), (None,)], "m string").select(identity.hmac_sha256(F.col("m"), identity.hmac_pads(key)).alias("h")).collect()
    assert [r.h for r in got] == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() if m is not None else None for m in ("año 1", "", None)]
    rows = spark.createDataFrame([("a", "año 1", True), ("a", "", True), ("b", None, True), ("b", "x", False), (None, None, False)], "part string, m string, right boolean")
    digest = F.when(F.col("right"), identity.hmac_sha256(F.col("m"), identity.hmac_pads(key))).otherwise("0")
    found = identity.hmac_mismatches(rows, "part", F.col("m"), digest, key).collect()
    assert {tuple(r) for r in found} == {("a", 2, 0, True), ("b", 2, 1, False), (None, 1, 1, False)}
    assert identity.hmac_mismatches(rows.limit(0), "part", F.col("m"), digest, key).count() == 0
    with pytest.raises(ValueError):
        identity.hmac_pads(b"x" * 65)


def test_pick_latest_keeps_a_null_of_the_winner(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None)], "k int, seq int, v string")
    assert rows(identity.pick_latest(df, ["k"], ["seq"], ["v"])) == [(1, None)]


def test_mode_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (2, "z"), (2, "a"), (3, None)], "k int, v string")
    assert rows(marts.mode_of(df, ["k"], "v", "m")) == [(1, "a"), (2, "z")]


def test_window_edges_and_unobserved_horizon(spark):
    clock = features.Clock((("A", "2024-01-10"), ("B", "2024-01-20")), 7, 3, "2024-01-20")
    days = [(1, date(2024, 1, 3)), (1, date(2024, 1, 2)), (1, date(2024, 1, 10)), (1, date(2024, 1, 13)), (1, date(2024, 1, 9))]
    tagged = features.at_cutoffs(spark.createDataFrame(days, "unit int, day date"), clock)
    assert rows(tagged.where("letter = 'A'").select("days", "part")) == [(0, "horizon"), (1, "window"), (7, "window")]
    people = features.population(tagged, spark.createDataFrame([], "unit int, since date"), "unit")
    got = {r.letter: r.label for r in features.labels(people, tagged, clock, "unit").collect()}
    assert got["A"] == 0 and got.get("B") is None


def test_table_diff_tolerance_and_nulls(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0000001, "x"), (2, 2.00001, None), (4, 3.0, "y")], "k int, v double, s string")
    assert dict(rows(features.table_diff(a, b, ["k"]))) == {"only_left": 1, "only_right": 1, "v": 1, "s": 0}


def test_average_precision_and_auc_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    r = ml.metrics(df).first()
    assert r.average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3, abs=1e-6) and r.roc_auc == pytest.approx(0.875)


def test_gain_ties_go_to_the_larger_threshold(spark):
    df = spark.createDataFrame([(0.5, 1), (0.25, 0)], "score double, label int")
    best = ml.best_threshold(ml.gain_curve(df, 15.0, 5.0)).first()
    assert (best.threshold, best.gain) == (0.5, 10.0)


def test_windows_do_not_depend_on_arrival(spark):
    rows_ = [("t", 0, o) for o in range(2000)]
    for order in (rows_, rows_[::-1]):
        got = rows(stream.offset_windows(spark.createDataFrame(order, "topic string, partition int, offset long"), 1500))
        assert got == [("t", 0, 0, 0, 1499, 1500, True), ("t", 0, 1, 1500, 1999, 500, False)]


def test_redelivery_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("t", 0, o, str(o)) for o in range(250)], "topic string, partition long, offset long, value string")
    out = str(tmp_path / "out")
    for part in (df.where("offset < 120"), df.where("offset >= 100"), df.where("offset >= 100")):
        stream.merge_windows(part, out, 100)
    assert rows(spark.read.parquet(out).groupBy("window").count()) == [(0, 100), (1, 100), (2, 50)]


def test_windows_share_files_and_partial_batches_are_completed(spark, tmp_path):
    df = spark.createDataFrame([(t, p, o, f"{t}{p}{o}") for t in "ab" for p in (0, 1) for o in range(3000)], "topic string, partition long, offset long, value string")
    out = tmp_path / "out"
    for part in (df.where("offset % 3 = 0"), df.where("topic = 'a' and offset < 100"), df, df.where("offset < 0"), df.unionAll(df)):
        stream.merge_windows(part, str(out), 10, span_rows=1000)
    assert len(list(out.rglob("*.parquet"))) <= 3 * 2 * 2 * 3  # a file for each span and batch that adds rows to it, not for each of 1200 windows
    got = spark.read.parquet(str(out))
    assert rows(got.select("topic", "partition", "offset", "value")) == rows(df)
    assert got.where("window <> floor(offset / 10) or span <> floor(offset / 1000)").count() == 0


def test_trips_of_larger_tables_meet_in_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "timestamp_ntz'2024-01-02' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(6000).selectExpr("id % 3500 as l_orderkey", "cast(id as int) as l_linenumber", "id % 5 as l_suppkey", "1D as l_extendedprice", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 4 as int)) as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    few = tables.trips(spark, str(tmp_path))
    monkeypatch.setattr(tables, "TRIP_ROWS", 300)
    many = tables.trips(spark, str(tmp_path))
    assert many.repartition(1).count() == few.count() == 5500 and rows(many) == rows(few)
    assert many.rdd.getNumPartitions() == 6000 // 300 + 1 > few.rdd.getNumPartitions()


def test_sources_are_counted_in_one_pass_each(spark):
    df = spark.createDataFrame([(1, None), (2, "R"), (3, None)], "id long, rule_id string")
    got = quality.layer_counts({"a": df, "b": df.where("id = 2"), "none": df.where("id > 9")})
    assert rows(got) == [("a", 3, 2, 1), ("b", 1, 0, 1)]
    plan = ingest.aud_conservation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Relation") and "l_shipdate" in line for line in plan.splitlines()) == 1

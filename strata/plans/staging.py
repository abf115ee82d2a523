"""Queries of typing raw text and of the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import parsing as P
from strata.operators import cdc
from strata.plans.register import registry
from strata.plans.tables import EV, LOG, TRIPS, change_log, events, table, trips

QUERIES, ORACLE, query = registry()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw lines, every eleventh with a blank field, every thirteenth cut short."""
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_id") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type")))
    full = F.concat_ws(",", F.col("event_id"), F.col("user_id"), kind, F.col("k"))
    return e.select("event_id", F.when(F.col("event_id") % 13 == 0, F.concat_ws(",", "event_id", "user_id")).otherwise(full).alias("raw"))


@query(f"""WITH {EV} SELECT event_id, CAST(event_id AS VARCHAR) AS f0, CAST(user_id AS VARCHAR) AS f1,
  CASE WHEN event_id % 13 = 0 OR event_id % 11 = 0 THEN NULL ELSE event_type END AS f2,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS f3, CAST(NULL AS VARCHAR) AS f9 FROM ev""")
def stg_split_fields(spark, sf_dir):
    raw = F.col("raw")
    return _lines(spark, sf_dir).select("event_id", *[P.field(raw, i).alias(f"f{i}") for i in (0, 1, 2, 3, 9)])


@query(f"""WITH {EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN k::BIGINT END AS as_long, CASE WHEN k % 3 < 2 THEN k::DOUBLE END AS as_double,
  CASE WHEN k % 3 < 2 THEN CAST(CAST(k AS DECIMAL(38,9)) AS DOUBLE) END AS as_money FROM ev""")
def stg_safe_cast(spark, sf_dir):
    k = F.col("k").cast("string")
    text = F.when(F.col("k") % 3 == 0, k).when(F.col("k") % 3 == 1, F.concat(k, F.lit(".0"))).otherwise("n/a")
    return events(spark, sf_dir).select("event_id", P.safe(text, "bigint").alias("as_long"), P.safe(text, "double").alias("as_double"), P.safe(text, P.MONEY).cast("double").alias("as_money"))


@query("""SELECT event_id, date_trunc('second', ts) AS plain, date_trunc('second', ts) AS day_first, date_trunc('second', ts) AS iso, date_trunc('second', ts) AS zulu, CAST(NULL AS TIMESTAMP) AS impossible FROM events""")
def stg_parse_datetime(spark, sf_dir):
    t = F.col("ts")
    texts = {"plain": "yyyy-MM-dd HH:mm:ss", "day_first": "dd/MM/yyyy HH:mm:ss", "iso": "yyyy-MM-dd'T'HH:mm:ss", "zulu": "yyyy-MM-dd'T'HH:mm:ss'Z'"}
    parsed = {name: P.parse_time(F.date_format(t, p), p) for name, p in texts.items()}
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in parsed.items()], P.parse_time(F.concat(F.lit("31/02/"), F.year("ts").cast("string")), "dd/MM/yyyy").alias("impossible"))


@query("SELECT event_id, ts - INTERVAL 6 HOUR AS local_ts, CAST(ts - INTERVAL 6 HOUR AS DATE) AS local_day FROM events")
def stg_local_time(spark, sf_dir):
    local = P.local_time(F.col("ts"), "America/Guatemala")
    return table(spark, sf_dir, "events").select("event_id", local.alias("local_ts"), F.to_date(local).alias("local_day"))


@query(f"WITH {EV} SELECT event_id, CAST(CAST(k * 7 AS DECIMAL(38,9)) / 100 AS DOUBLE) AS amount FROM ev")
def stg_minor_units(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", P.minor_units(F.col("k") * 7).cast("double").alias("amount"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' ELSE 'unknown' END AS description,
  o_orderstatus IN ('F', 'P') AS successful FROM orders""")
def stg_code_map(spark, sf_dir):
    code = F.col("o_orderstatus")
    names = F.when(code == "F", "filled").when(code == "O", "open").when(code == "P", "partial").otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.alias("description"), code.isin("F", "P").alias("successful"))


@query(f"""WITH {TRIPS}, t AS (SELECT *, (trip + leg) % 17 = 0 AS broken FROM trips)
SELECT trip, leg, CASE WHEN NOT broken THEN person END AS person, CASE WHEN NOT broken THEN station END AS entry_station,
  NOT broken AND exit IS NOT NULL AS has_exit, CASE WHEN NOT broken AND exit IS NOT NULL THEN station + 1 END AS exit_station FROM t""")
def stg_json_fields(spark, sf_dir):
    closed = F.when(F.col("exit").isNotNull(), F.format_string('{"station":%d}', F.col("station") + 1)).otherwise("null")
    line = F.concat(F.format_string('{"card":%d,"entry":{"station":%d},"exit":', "person", "station"), closed, F.when((F.col("trip") + F.col("leg")) % 17 == 0, "").otherwise("}"))
    t = trips(spark, sf_dir).withColumn("line", line)
    j = F.col("line")
    return t.select("trip", "leg", P.json_field(j, "$.card", "bigint").alias("person"), P.json_field(j, "$.entry.station", "bigint").alias("entry_station"), P.json_is_object(j, "$.exit").alias("has_exit"), P.json_field(j, "$.exit.station", "bigint").alias("exit_station"))


@query("SELECT event_id, sha256(concat_ws(',', CAST(event_id AS VARCHAR), event_type, props)) AS row_hash FROM events")
def stg_row_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.row_hash(F.concat_ws(",", F.col("event_id").cast("string"), "event_type", "props")).alias("row_hash"))


@query(f"""WITH {EV}, t AS (SELECT event_type AS file, concat_ws(',', CAST(user_id AS VARCHAR), CAST(k AS VARCHAR)) AS raw FROM ev)
SELECT file, raw, row_number() OVER (PARTITION BY file, raw ORDER BY raw) AS repetition FROM t""")
def stg_repetition(spark, sf_dir):
    t = events(spark, sf_dir).select(F.col("event_type").alias("file"), F.concat_ws(",", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("raw"))
    return t.withColumn("repetition", F.row_number().over(Window.partitionBy("file", "raw").orderBy("raw")).cast("long"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'TC-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0')
  WHEN 2 THEN 'MR' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE substr(md5('am' || c_custkey), 1, 12) END AS card FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'TM' WHEN 1 THEN 'TU' WHEN 2 THEN 'MR' ELSE 'AM' END AS operator,
  CASE WHEN c_custkey % 4 < 3 THEN c_custkey END AS base_id FROM t WHERE NOT (c_custkey % 4 = 3 AND regexp_full_match(card, '[0-9]{10}'))""")
def stg_key_format(spark, sf_dir):
    n = F.col("c_custkey")
    cards = F.when(n % 4 == 0, F.format_string("TC-%08d", n)).when(n % 4 == 1, F.format_string("%010d", n)).when(n % 4 == 2, F.format_string("MR%07d", n)).otherwise(F.substring(F.md5(F.concat(F.lit("am"), n.cast("string")).cast("binary")), 1, 12))
    t = table(spark, sf_dir, "customer").select("c_custkey", cards.alias("card"))
    operator, base = cdc.key_format(F.col("card"))
    return t.select("c_custkey", operator.alias("operator"), base.alias("base_id"))


@query("SELECT event_type AS operator, user_id AS card, count(*) AS n_rows FROM events GROUP BY ALL")
def stg_key_catalog(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("operator"), F.col("user_id").alias("card")).agg(F.count("*").alias("n_rows"))


@query(f"""WITH {TRIPS} SELECT trip, leg, entry, CASE WHEN CAST(exit AS DATE) <= DATE '1998-06-30' THEN exit END AS exit,
  CASE WHEN exit IS NULL OR CAST(exit AS DATE) <= DATE '1998-06-30' THEN fare END AS fare FROM trips WHERE entry IS NULL OR CAST(entry AS DATE) <= DATE '1998-06-30'""")
def stg_truncate(spark, sf_dir):
    # The fare goes with the exit; the exit itself is cut last, as it decides.
    return P.truncate_at(trips(spark, sf_dir).withColumn("left", F.col("exit")), "entry", "1998-06-30", {"left": "exit,fare"}).select("trip", "leg", "entry", "exit", "fare")


@query(f"""WITH {LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY seq) AS rn,
  count(*) FILTER (op = 'INSERT') OVER (PARTITION BY card ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ins FROM log)
SELECT card, CASE WHEN arg_max(op, seq) = 'DELETE' THEN 'INACTIVE' ELSE 'ACTIVE' END AS state, arg_max(profile, seq) FILTER (profile IS NOT NULL) AS profile,
  arg_max(area, seq) FILTER (area IS NOT NULL) AS area, arg_min(op, seq) AS first_op, arg_max(op, seq) AS last_op, min(seq) AS first_seq, max(seq) AS last_seq,
  count(*) FILTER (op = 'INSERT') AS inserts, count(*) FILTER (op = 'UPDATE') AS updates, count(*) FILTER (op = 'DELETE') AS deletes,
  bool_or(op = 'UPDATE' AND ins = 0) AS implicit_insert, bool_or(op = 'INSERT' AND ins > 0) AS repeated_insert, bool_or(op = 'DELETE' AND ins = 0) AS delete_without_insert
FROM w GROUP BY card""")
def cdc_apply(spark, sf_dir):
    return cdc.apply_log(change_log(spark, sf_dir), "card", "seq", "op", ["profile", "area"])


@query(f"""WITH {LOG}, s AS (SELECT card, arg_max(op, seq) AS last_op, count(*) FILTER (op = 'INSERT') AS i, count(*) FILTER (op = 'DELETE') AS d FROM log GROUP BY card)
SELECT (SELECT count(*) FROM log) AS operations, (SELECT count(*) FROM log WHERE op = 'INSERT') AS inserts, (SELECT count(*) FROM log WHERE op = 'UPDATE') AS updates,
  (SELECT count(*) FROM log WHERE op = 'DELETE') AS deletes, (SELECT count(*) FROM log WHERE card IS NULL) AS unkeyed, count(*) AS cards,
  count(*) FILTER (last_op <> 'DELETE') AS active, count(*) FILTER (last_op = 'DELETE') AS inactive, count(*) FILTER (d > 0) AS ever_deleted FROM s""")
def cdc_summary(spark, sf_dir):
    return cdc.summarise(change_log(spark, sf_dir), "card", "seq", "op")


_SCD2 = f"""{LOG}, hist AS (SELECT card, seq, op, row_number() OVER w AS version, commit_ts AS valid_from, lead(commit_ts) OVER w AS valid_to,
  lead(seq) OVER w IS NULL AS is_current, last_value(profile IGNORE NULLS) OVER f AS profile, last_value(area IGNORE NULLS) OVER f AS area,
  coalesce(commit_ts < lag(commit_ts) OVER w, FALSE) AS clock_back FROM log WINDOW w AS (PARTITION BY card ORDER BY seq),
  f AS (PARTITION BY card ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_SCD2} SELECT * FROM hist")
def scd2_history(spark, sf_dir):
    return cdc.scd2(change_log(spark, sf_dir), "card", "seq", "op", "commit_ts", ["profile", "area"])


@query(f"""WITH {_SCD2}, c AS (SELECT * FROM (VALUES (DATE '2024-01-11'), (DATE '2024-01-18'), (DATE '2024-01-29')) t(cutoff))
SELECT cutoff, card, arg_max(version, seq) AS version, arg_max(op, seq) AS op, arg_max(seq, seq) AS seq FROM hist JOIN c ON valid_from < cutoff GROUP BY cutoff, card""")
def asof_state(spark, sf_dir):
    hist = cdc.scd2(change_log(spark, sf_dir), "card", "seq", "op", "commit_ts", ["profile", "area"])
    return cdc.as_of(hist, ["2024-01-11", "2024-01-18", "2024-01-29"], "card", "valid_from", "seq", ["version", "op", "seq"])


@query(f"""WITH {LOG}, d AS (SELECT seq, card, op, lag(op) OVER (PARTITION BY card ORDER BY seq) AS previous_op FROM log),
x AS (SELECT *, CAST(CASE WHEN op <> 'DELETE' AND coalesce(previous_op, 'DELETE') = 'DELETE' THEN 1 WHEN op = 'DELETE' AND coalesce(previous_op, 'DELETE') <> 'DELETE' THEN -1 ELSE 0 END AS BIGINT) AS delta FROM d)
SELECT seq, card, op, previous_op, delta, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS balance FROM x""")
def cdc_balance(spark, sf_dir):
    return cdc.balance(change_log(spark, sf_dir), "card", "seq", "op")


@query(f"""WITH {_SCD2} SELECT sha256('person|' || h.card) AS person_key, h.version, h.valid_from, h.valid_to, h.is_current, h.profile, h.area FROM hist h JOIN (SELECT DISTINCT c_custkey FROM customer) c ON c.c_custkey = h.card""")
def scd2_dim(spark, sf_dir):
    hist = cdc.scd2(change_log(spark, sf_dir), "card", "seq", "op", "commit_ts", ["profile", "area"])
    persons = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card")).distinct()
    key = F.sha2(F.concat(F.lit("person|"), F.col("card").cast("string")), 256)
    return hist.join(persons, "card").select(key.alias("person_key"), "version", "valid_from", "valid_to", "is_current", "profile", "area")

"""Queries of quality rules and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import identity, quality
from strata.operators.quality import Rule
from strata.plans.register import registry
from strata.plans.tables import EV, TRIPS, change_log, events, table, trips

QUERIES, ORACLE, query = registry()
KEY = b"strata demonstration key"
PADS = identity.hmac_pads(KEY)
CUTOFFS = ["2024-01-11", "2024-01-18", "2024-01-29"]


def _rules():
    return [
        Rule("R07", F.col("user_id").isNull(), "no key"), Rule("R08", F.col("ts").isNull(), "no time"),
        Rule("R03", F.col("day") >= F.lit("2024-01-29").cast("date"), "future date"), Rule("R02", F.col("event_type") == "error", "null code"),
        Rule("R06", ~F.col("known"), "not in catalog"), Rule("R09", (F.col("value") <= 1) | F.col("value").isNull(), "bad amount"), Rule("R05", F.col("zone") == 25, "unmapped zone"),
    ]


def _labelled(spark, sf_dir):
    e = events(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_size").cast("int"))  # sizes play the station catalog
    return quality.label(quality.in_catalog(e, "k", parts, "known"), _rules())


_LAB = f"""{EV}, sizes AS (SELECT DISTINCT p_size FROM part), l0 AS (SELECT ev.*, p_size IS NOT NULL AS known FROM ev LEFT JOIN sizes ON k = p_size),
lab AS (SELECT *, CASE WHEN user_id IS NULL THEN 'R07' WHEN ts IS NULL THEN 'R08' WHEN day >= DATE '2024-01-29' THEN 'R03' WHEN event_type = 'error' THEN 'R02'
  WHEN NOT known THEN 'R06' WHEN value <= 1 OR value IS NULL THEN 'R09' WHEN zone = 25 THEN 'R05' END AS rule_id FROM l0)"""
_WHY = "CASE rule_id WHEN 'R07' THEN 'no key' WHEN 'R08' THEN 'no time' WHEN 'R03' THEN 'future date' WHEN 'R02' THEN 'null code' WHEN 'R06' THEN 'not in catalog' WHEN 'R09' THEN 'bad amount' WHEN 'R05' THEN 'unmapped zone' END"


@query(f"WITH {_LAB} SELECT event_id, rule_id, {_WHY} AS reason FROM lab")
def dq_label(spark, sf_dir):
    return _labelled(spark, sf_dir).select("event_id", "rule_id", "reason")


@query(f"""WITH {_LAB} SELECT * FROM (SELECT 'R07' AS rule, count(*) FILTER (user_id IS NULL) AS failing FROM lab UNION ALL SELECT 'R08', count(*) FILTER (ts IS NULL) FROM lab
  UNION ALL SELECT 'R03', count(*) FILTER (day >= DATE '2024-01-29') FROM lab UNION ALL SELECT 'R02', count(*) FILTER (event_type = 'error') FROM lab UNION ALL SELECT 'R06', count(*) FILTER (NOT known) FROM lab
  UNION ALL SELECT 'R09', count(*) FILTER (value <= 1 OR value IS NULL) FROM lab UNION ALL SELECT 'R05', count(*) FILTER (zone = 25) FROM lab)""")
def dq_rules_each(spark, sf_dir):
    rules = _rules()
    one = _labelled(spark, sf_dir).agg(*[F.count_if(F.coalesce(r.fails, F.lit(False))).alias(r.name) for r in rules])
    return one.unpivot([], [r.name for r in rules], "rule", "failing")


@query(f"""WITH {TRIPS}, cat AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT trip, leg, station IN (SELECT s_suppkey FROM cat) AS entry_known, exit IS NULL OR station + 1 IN (SELECT s_suppkey FROM cat) AS exit_known,
  CASE WHEN station NOT IN (SELECT s_suppkey FROM cat) OR (exit IS NOT NULL AND station + 1 NOT IN (SELECT s_suppkey FROM cat)) THEN 'R06' WHEN exit IS NULL THEN 'R04' END AS rule_id FROM trips""")
def dq_two_catalogs(spark, sf_dir):
    catalog = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    t = trips(spark, sf_dir).withColumn("exit_station", F.when(F.col("exit").isNotNull(), F.col("station") + 1))
    both = quality.in_catalog(quality.in_catalog(t, "station", catalog, "entry_known"), "exit_station", catalog, "exit_known").withColumn("exit_known", F.col("exit").isNull() | F.col("exit_known"))
    rules = [Rule("R06", ~F.col("entry_known") | ~F.col("exit_known"), "not in catalog"), Rule("R04", F.col("exit").isNull(), "no exit")]
    return quality.label(both, rules).select("trip", "leg", "entry_known", "exit_known", "rule_id")


@query(f"""WITH {_LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day, rule_id IS NULL ORDER BY event_id) AS n FROM lab)
SELECT event_id, CASE WHEN rule_id IS NULL AND n > 1 THEN 'R01' ELSE rule_id END AS rule_id FROM r""")
def dq_dup_business_key(spark, sf_dir):
    key = [F.col("user_id"), F.col("event_type"), F.col("day")]
    return quality.label_repeats(_labelled(spark, sf_dir), key, [F.col("event_id")], "R01", "repeated").select("event_id", "rule_id")


@query(f"""WITH {_LAB} SELECT event_id, sha256(event_type || '|' || CAST(k AS VARCHAR)) AS station_key, n_name AS zone_name, value AS amount FROM lab LEFT JOIN nation ON n_nationkey = zone WHERE rule_id IS NULL""")
def silver_valid(spark, sf_dir):
    zones = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("zone_name"))
    key = F.sha2(F.concat("event_type", F.lit("|"), F.col("k").cast("string")), 256)
    return quality.valid(_labelled(spark, sf_dir)).join(F.broadcast(zones), "zone", "left").select("event_id", key.alias("station_key"), "zone_name", F.col("value").alias("amount"))


def _sources(spark, sf_dir):
    e = _labelled(spark, sf_dir).withColumn("key", F.col("event_id")).withColumn("record", F.col("props"))
    t = trips(spark, sf_dir)
    t = quality.label(t, [Rule("R04", F.col("exit").isNull(), "no exit")]).withColumn("key", F.concat_ws("-", "trip", "leg")).withColumn("record", F.concat_ws(",", "trip", "leg", "station"))
    s = quality.label(table(spark, sf_dir, "supplier"), [Rule("R07", F.col("s_suppkey").isNull(), "no key")]).withColumn("key", F.col("s_suppkey")).withColumn("record", F.col("s_name"))
    return {"events": e, "trips": t, "stations": s}


_SRC = f"""{_LAB}, {TRIPS}, src AS (SELECT 'events' AS source, CAST(event_id AS VARCHAR) AS key, props AS record, rule_id, {_WHY} AS reason FROM lab
UNION ALL SELECT 'trips', trip || '-' || leg, trip || ',' || leg || ',' || station, CASE WHEN exit IS NULL THEN 'R04' END, CASE WHEN exit IS NULL THEN 'no exit' END FROM trips
UNION ALL SELECT 'stations', CAST(s_suppkey AS VARCHAR), s_name, NULL, NULL FROM supplier)"""


@query(f"WITH {_SRC} SELECT *, 'run-1' AS run_id, TIMESTAMP '2024-01-31 00:00:00' AS rejected_at FROM src WHERE rule_id IS NOT NULL")
def quarantine_rows(spark, sf_dir):
    return quality.quarantine(_sources(spark, sf_dir), "run-1", "2024-01-31 00:00:00")


@query(f"""WITH {_SRC}, t AS (SELECT source, count(*) AS total FROM src GROUP BY source), r AS (SELECT source, rule_id, count(*) AS n FROM src WHERE rule_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT source, 'TOTAL', count(rule_id) FROM src GROUP BY source) SELECT source, rule_id, n, total, round(100.0::DOUBLE * n / total, 3) AS pct FROM r JOIN t USING (source)""")
def quarantine_summary(spark, sf_dir):
    return quality.summary(_sources(spark, sf_dir))


@query("""SELECT *, failing = 0 AS passed FROM (SELECT 'unique orders' AS check, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS failing
UNION ALL SELECT 'not null customer', (SELECT count(*) FROM customer WHERE c_name IS NULL OR c_custkey IS NULL)
UNION ALL SELECT 'accepted status', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
UNION ALL SELECT 'customer exists', (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'quantity range', (SELECT count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 40)
UNION ALL SELECT 'unique line', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'unique where known', (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'as many suppliers as customers', (SELECT abs((SELECT count(*) FROM supplier) - (SELECT count(*) FROM customer))))""")
def dq_expectations(spark, sf_dir):
    o, c, l, s = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "supplier"))
    return quality.expect({
        "unique orders": quality.unique(o, ["o_orderkey"]), "not null customer": quality.not_null(c, ["c_name", "c_custkey"]), "accepted status": quality.accepted(o, "o_orderstatus", ["F", "O"]),
        "customer exists": quality.related(o, "o_custkey", c, "c_custkey"), "quantity range": quality.in_range(l, "l_quantity", 1, 40), "unique line": quality.unique(l, ["l_orderkey", "l_linenumber"]),
        "unique where known": quality.unique(o.withColumn("urgent", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_custkey"))), ["urgent"]), "as many suppliers as customers": quality.same_count(s, c),
    })


_IN, _OUT = (p.hex() for p in PADS)


def _hmac(text: str) -> str:
    return f"sha256(from_hex('{_OUT}') || from_hex(sha256(from_hex('{_IN}') || encode({text}))))"


@query(f"SELECT c_custkey, {_hmac('CAST(c_custkey AS VARCHAR)')} AS pseudonym FROM customer")
def hmac_pseudonym(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", identity.hmac_sha256(F.col("c_custkey").cast("string"), PADS).alias("pseudonym"))


@query("SELECT c_mktsegment AS part, count(*) AS checked, count(*) FILTER (c_custkey % 50 = 0) AS differing, count(*) FILTER (c_custkey % 50 = 0) = 0 AS passed FROM customer GROUP BY 1")
def hmac_selfcheck(spark, sf_dir):
    """All stored pseudonyms against those of another implementation, by segment; fiftieths of the stored ones are planted
    with a changed digit."""
    stored_ones = hmac_pseudonym(spark, sf_dir).withColumn("pseudonym", F.when(F.col("c_custkey") % 50 == 0, F.translate("pseudonym", "0123456789abcdef", "123456789abcdef0")).otherwise(F.col("pseudonym")))
    both = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("part")).join(stored_ones, "c_custkey")
    return identity.hmac_mismatches(both, "part", F.col("c_custkey").cast("string"), F.col("pseudonym"), KEY)


@query("SELECT c_custkey, substr(md5('am' || c_custkey), 1, 12) AS hash, CASE WHEN c_custkey BETWEEN 1 AND (SELECT max(s_suppkey) * 10 FROM supplier) THEN c_custkey END AS id FROM customer")
def hash_dictionary(spark, sf_dir):
    last = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] * 10
    short = F.substring(F.md5(F.concat(F.lit("am"), F.col("c_custkey").cast("string")).cast("binary")), 1, 12)
    hashed = table(spark, sf_dir, "customer").select("c_custkey", short.alias("hash"))
    return hashed.join(identity.hash_dictionary(spark, "am", last), "hash", "left").select("c_custkey", "hash", "id")


def _directory(spark, sf_dir):
    used = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("user_id").alias("card"))
    registered = table(spark, sf_dir, "customer").select(F.lit("registry").alias("mode"), F.col("c_custkey").alias("card"), F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("segment"))
    return identity.directory(used, registered, PADS)


_DIR = f"""dir AS (SELECT mode, card, CASE WHEN c_custkey IS NOT NULL THEN 'registry' ELSE 'operation' END AS link_method, {_hmac("mode || '|' || card")} AS card_key,
  {_hmac("'person|' || card")} AS person_key, coalesce(c_mktsegment, 'UNKNOWN') AS segment
  FROM (SELECT event_type AS mode, user_id AS card FROM events UNION SELECT 'registry', c_custkey FROM customer) LEFT JOIN customer ON c_custkey = card)"""


@query(f"WITH {_DIR} SELECT * FROM dir")
def user_directory(spark, sf_dir):
    return _directory(spark, sf_dir)


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def pick_latest(spark, sf_dir):
    return identity.pick_latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


def unified(spark, sf_dir):
    """All modes' boardings in common columns: events of four kinds and orders, charges that succeeded only."""
    e, o = events(spark, sf_dir), table(spark, sf_dir, "orders")
    kinds = [e.where(F.col("event_type") == k).select(F.lit(k).alias("mode"), F.concat(F.lit(k + "-"), F.col("event_id").cast("string")).alias("boarding"), F.col("user_id").alias("card"), "ts", F.col("value").alias("amount")) for k in ("purchase", "view", "click")]
    orders = o.where("o_orderstatus <> 'P'").select(F.lit("order").alias("mode"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("boarding"), F.col("o_custkey").alias("card"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"))
    out = orders
    for k in kinds:
        out = out.unionByName(k)
    return out


UNIFIED = """uni AS (SELECT event_type AS mode, event_type || '-' || event_id AS boarding, user_id AS card, ts, value AS amount FROM events WHERE event_type IN ('purchase', 'view', 'click')
UNION ALL SELECT 'order', 'order-' || o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus <> 'P')"""


@query(f"WITH {UNIFIED} SELECT uni.*, c_mktsegment AS segment FROM uni LEFT JOIN customer ON c_custkey = card")
def unified_events(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card"), F.col("c_mktsegment").alias("segment"))
    return unified(spark, sf_dir).join(people, "card", "left")


@query(f"""WITH {EV}, c AS (SELECT unnest(['{CUTOFFS[0]}', '{CUTOFFS[1]}', '{CUTOFFS[2]}'])::DATE AS cutoff),
s AS (SELECT DISTINCT cutoff, user_id // 3 AS person, event_type || ':' || user_id AS name FROM ev JOIN c ON ts < cutoff)
SELECT cutoff, person, string_agg(name, ',' ORDER BY name) AS cards, count(*) AS n_cards FROM s GROUP BY ALL""")
def cards_asof(spark, sf_dir):
    seen = events(spark, sf_dir).select(F.floor(F.col("user_id") / 3).alias("person"), F.col("event_type").alias("mode"), F.col("user_id").alias("card"), "ts")
    return identity.known_cards(seen, CUTOFFS)


@query("""SELECT DISTINCT s_suppkey, sha256('supplier|' || s_suppkey) AS station_key, sha256('tables|supplier.parquet|' || coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, '')) AS source_key FROM supplier""")
def surrogate_keys(spark, sf_dir):
    named = F.when(F.col("s_acctbal") > 0, F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.sha2(F.concat(F.lit("supplier|"), F.col("s_suppkey").cast("string")), 256).alias("station_key"), F.sha2(F.concat(F.lit("tables|supplier.parquet|"), F.coalesce(named, F.lit(""))), 256).alias("source_key")).distinct()


@query(f"""WITH {_DIR}, k AS (SELECT user_id AS k FROM events UNION SELECT c_custkey FROM customer), l AS (SELECT 'user_directory' AS t, unnest([{{'c': 'mode', 'v': mode}}, {{'c': 'card', 'v': CAST(card AS VARCHAR)}}, {{'c': 'link_method', 'v': link_method}}, {{'c': 'card_key', 'v': card_key}}, {{'c': 'person_key', 'v': person_key}}, {{'c': 'segment', 'v': segment}}]) AS x FROM dir
UNION ALL SELECT 'pseudonyms', {{'c': 'pseudonym', 'v': {_hmac('CAST(c_custkey AS VARCHAR)')}}} FROM customer)
SELECT t AS "table", x.c AS "column", count(x.v) AS n, count(*) FILTER (x.v IN (SELECT CAST(k AS VARCHAR) FROM k)) AS native FROM l WHERE x.v IS NOT NULL GROUP BY ALL""")
def guard_native_keys(spark, sf_dir):
    """Values of each published column that are card numbers: all of the directory's inner `card`, none of the rest."""
    cards = table(spark, sf_dir, "events").select("user_id").unionAll(table(spark, sf_dir, "customer").select("c_custkey"))
    return identity.native_key_values({"user_directory": _directory(spark, sf_dir), "pseudonyms": hmac_pseudonym(spark, sf_dir).select("pseudonym")}, cards)

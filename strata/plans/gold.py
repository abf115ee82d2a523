"""Queries of dimensions, facts, aggregates and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.storage import scratch, stored
from strata.operators import cdc, marts
from strata.plans.register import registry
from strata.plans.silver import UNIFIED, unified
from strata.plans.tables import EV, LOG, REFERENCE_DAY, TRIPS, change_log, events, table, trips
from strata.sources import raw

QUERIES, ORACLE, query = registry()
#: Hours of each band, and which are peak (fixed values).
BANDS = [(h, "night" if h < 5 else "morning" if h < 12 else "afternoon" if h < 19 else "evening", h in (6, 7, 8, 16, 17, 18)) for h in range(24)]
HOLIDAYS = ["2024-01-01", "2024-01-15"]
BANDS_SQL = "bands AS (SELECT h AS hour, CASE WHEN h < 5 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 19 THEN 'afternoon' ELSE 'evening' END AS band, h IN (6, 7, 8, 16, 17, 18) AS is_peak FROM range(24) t(h))"
HOL_SQL = "hol AS (SELECT unnest(['2024-01-01', '2024-01-15'])::DATE AS hday)"


def whole():
    """All rows of a small result."""
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def bands(spark):
    return spark.createDataFrame(BANDS, "hour int, band string, is_peak boolean")


def holidays(spark):
    return spark.createDataFrame([(d, "h") for d in HOLIDAYS], "day string, holiday string").withColumn("day", F.col("day").cast("date"))


@query(f"""WITH {BANDS_SQL}, {HOL_SQL}, r AS (SELECT least(min(CAST(ts AS DATE)), DATE '2023-12-30') AS a, max(CAST(ts AS DATE)) AS b FROM events),
d AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM r)
SELECT CAST(strftime(day, '%Y%m%d') AS BIGINT) * 100 + hour AS time_key, day, CAST(hour AS INTEGER) AS hour, band, is_peak, hday IS NOT NULL AS is_holiday, isodow(day)::BIGINT AS iso_dow,
  hday IS NULL AND isodow(day) <= 5 AS working_day, week(day)::BIGINT AS iso_week, strftime(day, '%Y-%m') AS year_month FROM d CROSS JOIN bands LEFT JOIN hol ON hday = day""")
def dim_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    early = e.select(F.lit("2023-12-30").cast("date").alias("ts"))
    return marts.dim_time([(e, "ts"), (early, "ts")], bands(spark), holidays(spark))


@query("""WITH u AS (SELECT n_nationkey AS zone, n_name AS name FROM nation UNION ALL SELECT 99, 'NOWHERE'), s AS (SELECT s_nationkey AS zone, count(*) AS stations FROM supplier GROUP BY 1),
m AS (SELECT DISTINCT c_nationkey AS zone, o_orderpriority AS mode FROM orders JOIN customer ON c_custkey = o_custkey), a AS (SELECT zone, count(*) AS modes, string_agg(mode, ',' ORDER BY mode) AS mode_list FROM m GROUP BY 1)
SELECT u.zone, name, coalesce(stations, 0) AS stations, coalesce(modes, 0) AS modes, mode_list FROM u LEFT JOIN s USING (zone) LEFT JOIN a USING (zone)""")
def dim_zone(spark, sf_dir):
    zones = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("name")).unionAll(spark.createDataFrame([(99, "NOWHERE")], "zone int, name string"))
    stations = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(F.count("*").alias("stations"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("zone"))
    seen = table(spark, sf_dir, "orders").join(people, "o_custkey").select("zone", F.col("o_orderpriority").alias("mode")).distinct()
    modes = seen.groupBy("zone").agg(F.count("*").alias("modes"), F.array_join(F.array_sort(F.collect_list("mode")), ",").alias("mode_list"))
    return zones.join(stations, "zone", "left").join(modes, "zone", "left").select("zone", "name", F.coalesce("stations", F.lit(0)).alias("stations"), F.coalesce("modes", F.lit(0)).alias("modes"), "mode_list")


@query("SELECT s_suppkey AS station, s_name AS name, s_nationkey AS zone, sha256('supplier|' || s_suppkey) AS station_key FROM supplier")
def dim_station(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("zone"), F.sha2(F.concat(F.lit("supplier|"), F.col("s_suppkey").cast("string")), 256).alias("station_key"))


@query(f"""WITH {EV}, u AS (SELECT 'events' AS source, event_type AS file, day AS landed FROM ev UNION ALL SELECT 'orders', o_orderstatus, CAST(date_trunc('year', o_orderdate) AS DATE) FROM orders)
SELECT source, file, landed, count(*) AS n_rows, CASE source WHEN 'events' THEN 'stream' ELSE 'batch' END AS route FROM u GROUP BY ALL""")
def dim_source(spark, sf_dir):
    e = events(spark, sf_dir).select(F.lit("events").alias("source"), F.col("event_type").alias("file"), F.col("day").alias("landed"))
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderstatus").alias("file"), F.to_date(F.date_trunc("year", "o_orderdate")).alias("landed"))
    return e.unionAll(o).groupBy("source", "file", "landed").agg(F.count("*").alias("n_rows")).withColumn("route", F.when(F.col("source") == "events", "stream").otherwise("batch"))


@query("SELECT m.mode, m.name, count(event_id) AS n FROM (VALUES ('purchase', 'Purchase'), ('view', 'View'), ('click', 'Click'), ('fax', 'Fax')) m(mode, name) LEFT JOIN events ON event_type = m.mode GROUP BY ALL")
def dim_constant(spark, sf_dir):
    modes = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("mode"), F.lit(n).alias("name")) for k, n in (("purchase", "Purchase"), ("view", "View"), ("click", "Click"), ("fax", "Fax"))])))
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("n"))
    return modes.join(counts, "mode", "left").select("mode", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {UNIFIED}, c AS (SELECT card, count(*) AS n, count(DISTINCT mode) AS modes FROM uni GROUP BY 1)
SELECT c_custkey AS card, c_mktsegment AS segment, coalesce(n, 0) AS boardings, coalesce(modes, 0) AS modes, coalesce(modes, 0) >= 2 AS is_multimodal FROM customer LEFT JOIN c ON card = c_custkey""")
def dim_user(spark, sf_dir):
    use = unified(spark, sf_dir).groupBy("card").agg(F.count("*").alias("n"), F.countDistinct("mode").alias("m"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card"), F.col("c_mktsegment").alias("segment"))
    modes = F.coalesce("m", F.lit(0))
    return people.join(use, "card", "left").select("card", "segment", F.coalesce("n", F.lit(0)).alias("boardings"), modes.alias("modes"), (modes >= 2).alias("is_multimodal"))


def fact(spark, sf_dir):
    """Boardings with band, peak and working day of their hour."""
    e = events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    joined = e.join(F.broadcast(bands(spark)), "hour", "left").join(F.broadcast(holidays(spark)), "day", "left")  # 24 rows; a row per holiday
    working = F.col("holiday").isNull() & (F.weekday("day") < 5)
    return joined.select("event_id", F.col("user_id").alias("card"), F.col("event_type").alias("mode"), F.col("k").alias("station"), "zone", "day", "hour", (F.date_format("day", "yyyyMMdd").cast("long") * 100 + F.col("hour")).alias("time_key"), "band", "is_peak", working.alias("working_day"), F.col("value").alias("amount"))


_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def built(spark, sf_dir, name, make):
    """A gold table, built once a session and read from then on, as dashboards do; by day and sorted within if it has days."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        df, path = make(spark, sf_dir), scratch(spark, f"gold-{name}")
        if "day" in df.columns:
            raw.write_partitioned(df, path, "day", [c for c in ("zone", "card") if c in df.columns])
        else:
            df.write.parquet(path)
        _BUILT[key] = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    return _BUILT[key]


def gold_fact(spark, sf_dir):
    return built(spark, sf_dir, "fact", fact)


def gold_multimodal(spark, sf_dir):
    return built(spark, sf_dir, "multimodal", agg_multimodal)


FACT = f"""{EV}, {BANDS_SQL}, {HOL_SQL}, fct AS (SELECT event_id, user_id AS card, event_type AS mode, k AS station, zone, day, CAST(extract(hour FROM ts) AS INTEGER) AS hour,
  CAST(strftime(day, '%Y%m%d') AS BIGINT) * 100 + extract(hour FROM ts) AS time_key, band, is_peak, hday IS NULL AND isodow(day) < 6 AS working_day, value AS amount
  FROM ev LEFT JOIN bands ON bands.hour = extract(hour FROM ts) LEFT JOIN hol ON hday = day)"""


@query(f"WITH {FACT} SELECT * FROM fct")
def fct_event(spark, sf_dir):
    return fact(spark, sf_dir)


@query(f"""WITH {TRIPS} SELECT trip, leg, a.s_nationkey AS from_zone, b.s_nationkey AS to_zone, exit IS NOT NULL AND b.s_nationkey IS NOT NULL AND a.s_nationkey <> b.s_nationkey AS changes_zone,
  CAST(epoch(exit - entry) / 60 AS BIGINT) AS minutes FROM trips LEFT JOIN supplier a ON a.s_suppkey = station LEFT JOIN supplier b ON exit IS NOT NULL AND b.s_suppkey = station + 1""")
def fct_trip_od(spark, sf_dir):
    t = trips(spark, sf_dir).withColumn("exit_station", F.when(F.col("exit").isNotNull(), F.col("station") + 1))
    s = table(spark, sf_dir, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("from_zone")), s.select(F.col("s_suppkey").alias("exit_station"), F.col("s_nationkey").alias("to_zone"))
    changes = F.coalesce(F.col("from_zone") != F.col("to_zone"), F.lit(False))
    minutes = F.timestamp_diff("SECOND", F.col("entry"), F.col("exit")) / 60
    return t.join(a, "station", "left").join(b, "exit_station", "left").select("trip", "leg", "from_zone", "to_zone", changes.alias("changes_zone"), minutes.cast("long").alias("minutes"))


@query(f"""WITH {FACT}, g AS (SELECT card, day, mode, count(*) AS n, sum(amount) AS amount, count(*) FILTER (is_peak) AS peak, count(DISTINCT station) AS stations, min(hour) AS first_hour, max(hour) AS last_hour FROM fct GROUP BY ALL),
z AS (SELECT card, day, mode, zone, row_number() OVER (PARTITION BY card, day, mode ORDER BY count(*) DESC, zone) AS r FROM fct GROUP BY card, day, mode, zone) SELECT g.*, z.zone AS usual_zone FROM g JOIN z USING (card, day, mode) WHERE r = 1""")
def fct_user_day(spark, sf_dir):
    f = fact(spark, sf_dir)
    keys = ["card", "day", "mode"]
    sums = f.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.count_if("is_peak").alias("peak"), F.countDistinct("station").alias("stations"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    return sums.join(marts.mode_of(f, keys, "zone", "usual_zone"), keys)


@query("SELECT s_nationkey AS zone, CASE WHEN s_acctbal > 0 THEN 'rail' ELSE 'bus' END AS mode, count(*) AS stations, count(DISTINCT s_suppkey % 7) AS lines FROM supplier GROUP BY ALL")
def fct_coverage(spark, sf_dir):
    mode = F.when(F.col("s_acctbal") > 0, "rail").otherwise("bus").alias("mode")
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone"), mode).agg(F.count("*").alias("stations"), F.countDistinct(F.col("s_suppkey") % 7).alias("lines"))


@query(f"WITH {FACT} SELECT day, hour, mode, zone, count(*) AS boardings, sum(amount) AS amount, count(DISTINCT card) AS cards, count(DISTINCT station) AS stations FROM fct GROUP BY ALL")
def agg_demand(spark, sf_dir):
    return marts.demand(fact(spark, sf_dir), ["day", "hour", "mode", "zone"])


@query(f"""WITH {FACT}, c AS (SELECT 'day and mode' AS level, strftime(day, '%Y-%m-%d') || ' ' || mode AS name, count(DISTINCT card) AS cards FROM fct GROUP BY day, mode
UNION ALL SELECT 'month', strftime(day, '%Y-%m'), count(DISTINCT card) FROM fct GROUP BY 2 UNION ALL SELECT 'zone', CAST(zone AS VARCHAR), count(DISTINCT card) FROM fct GROUP BY 2 UNION ALL SELECT 'all', '', count(DISTINCT card) FROM fct) SELECT * FROM c""")
def agg_distinct_rollup(spark, sf_dir):
    """Distinct cards of four levels from one stored cube of bitmaps; the boardings are read once."""
    f = fact(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM"))
    cube = stored(marts.card_bitmaps(f, ["day", "month", "mode", "zone"], "card"), "cards")
    name = F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), "mode")
    levels = [("day and mode", ["day", "mode"], name), ("month", ["month"], F.col("month")), ("zone", ["zone"], F.col("zone").cast("string")), ("all", [], F.lit(""))]
    out = None
    for level, keys, text in levels:
        one = marts.distinct_cards(cube, keys).select(F.lit(level).alias("level"), text.alias("name"), "cards")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH s AS (SELECT s_nationkey AS zone, count(*) AS stations FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), d AS (SELECT c_nationkey AS zone, count(*) AS demand FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT n_nationkey AS zone, coalesce(stations, 0) AS stations, coalesce(demand, 0) AS demand, coalesce(stations, 0) = 0 AS no_service, coalesce(stations, 0) > 0 AND coalesce(demand, 0) = 0 AS no_demand FROM nation LEFT JOIN s ON s.zone = n_nationkey LEFT JOIN d ON d.zone = n_nationkey""")
def agg_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("zone")).agg(F.count("*").alias("s"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("zone"))
    d = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(c, "o_custkey").groupBy("zone").agg(F.count("*").alias("d"))
    n, m = F.coalesce("s", F.lit(0)), F.coalesce("d", F.lit(0))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone")).join(s, "zone", "left").join(d, "zone", "left").select("zone", n.alias("stations"), m.alias("demand"), (n == 0).alias("no_service"), ((n > 0) & (m == 0)).alias("no_demand"))


@query(f"""WITH {FACT}, p AS (SELECT zone, count(*) FILTER (mode = 'purchase') AS purchase, count(*) FILTER (mode = 'view') AS view, count(*) FILTER (mode = 'click') AS click, count(*) AS total FROM fct GROUP BY 1)
SELECT *, round(100.0::DOUBLE * click / total, 4) AS click_pct, rank() OVER (ORDER BY click DESC, zone) AS place FROM p""")
def agg_zone_pivot(spark, sf_dir):
    wide = gold_fact(spark, sf_dir).groupBy("zone").agg(*[F.count_if(F.col("mode") == m).alias(m) for m in ("purchase", "view", "click")], F.count("*").alias("total"))
    return wide.withColumn("click_pct", F.round(F.lit(100.0) * F.col("click") / F.col("total"), 4)).withColumn("place", F.rank().over(Window.orderBy(F.desc("click"), "zone")).cast("long"))


_MULTI = f"""{UNIFIED}, multi AS (SELECT card, count(DISTINCT mode) AS modes, string_agg(DISTINCT mode, ',' ORDER BY mode) AS mode_list, count(DISTINCT CAST(ts AS DATE)) FILTER (mode = 'order') AS order_days,
  count(DISTINCT CAST(ts AS DATE)) FILTER (mode = 'click') AS click_days FROM uni GROUP BY card)"""


@query(f"WITH {_MULTI} SELECT * FROM multi")
def agg_multimodal(spark, sf_dir):
    day = F.to_date("ts")
    return unified(spark, sf_dir).groupBy("card").agg(F.countDistinct("mode").alias("modes"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("mode_list"), F.countDistinct(F.when(F.col("mode") == "order", day)).alias("order_days"), F.countDistinct(F.when(F.col("mode") == "click", day)).alias("click_days"))


@query(f"""WITH {FACT} SELECT card, day, mode AS usual_mode FROM (SELECT card, day, mode, row_number() OVER (PARTITION BY card, day ORDER BY count(*) DESC, mode) AS r FROM fct GROUP BY card, day, mode) WHERE r = 1""")
def mode_tiebreak(spark, sf_dir):
    return marts.mode_of(fact(spark, sf_dir), ["card", "day"], "mode", "usual_mode")


@query(f"""WITH {_MULTI}, c AS (SELECT modes, mode_list, count(*) AS n FROM multi GROUP BY ALL), s AS (SELECT modes, sum(n)::BIGINT AS persons, arg_min(mode_list, (-n, mode_list)) AS usual FROM c GROUP BY modes)
SELECT modes, persons, round(100.0::DOUBLE * persons / sum(persons) OVER (), 4) AS pct, usual FROM s""")
def agg_multimodal_summary(spark, sf_dir):
    c = gold_multimodal(spark, sf_dir).groupBy("modes", "mode_list").agg(F.count("*").alias("n"))
    s = c.groupBy("modes").agg(F.sum("n").alias("persons"), F.min_by("mode_list", F.struct(-F.col("n"), "mode_list")).alias("usual"))
    return s.select("modes", "persons", F.round(F.lit(100.0) * F.col("persons") / F.sum("persons").over(whole()), 4).alias("pct"), "usual")


@query(f"""WITH {FACT} SELECT CASE WHEN grouping(mode) = 1 THEN 'GRAND TOTAL' ELSE mode END AS mode, CASE WHEN grouping(mode) = 1 THEN 'ALL' WHEN grouping(hour) = 1 THEN 'SUBTOTAL' ELSE CAST(hour AS VARCHAR) END AS hour, count(*) AS boardings,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM fct), 4) AS pct FROM fct GROUP BY ROLLUP (mode, hour)""")
def q_rollup_labels(spark, sf_dir):
    r = gold_fact(spark, sf_dir).rollup("mode", "hour").agg(F.count("*").alias("boardings"), F.grouping("mode").alias("gm"), F.grouping("hour").alias("gh"))
    total = F.max(F.when(F.col("gm") == 1, F.col("boardings"))).over(whole())
    hour = F.when(F.col("gm") == 1, "ALL").when(F.col("gh") == 1, "SUBTOTAL").otherwise(F.col("hour").cast("string"))
    return r.select(F.when(F.col("gm") == 1, "GRAND TOTAL").otherwise(F.col("mode")).alias("mode"), hour.alias("hour"), "boardings", F.round(F.lit(100.0) * F.col("boardings") / total, 4).alias("pct"))


@query("""WITH z AS (SELECT n_name AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT name, n, rank() OVER (ORDER BY n DESC) AS place, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS pct, round(100.0::DOUBLE * sum(n) OVER (ORDER BY n DESC, name ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS running_pct FROM z""")
def q_rank_cumulative(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return marts.rank_cumulative(table(spark, sf_dir, "orders").join(c, "o_custkey").join(n, "n_nationkey").groupBy("name").agg(F.count("*").alias("n")), "name", "n")


@query("""WITH s AS (SELECT s_nationkey AS zone, count(*) AS stations FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), p AS (SELECT c_nationkey AS zone, count(*) AS residents FROM customer GROUP BY 1), j AS (SELECT n_nationkey AS zone, coalesce(stations, 0) AS stations, coalesce(residents, 0) AS residents FROM nation LEFT JOIN s ON s.zone = n_nationkey LEFT JOIN p ON p.zone = n_nationkey)
SELECT *, count(*) FILTER (stations = 0) OVER () AS zones_without_service, count(*) OVER () AS zones FROM j""")
def q_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("zone")).agg(F.count("*").alias("s"))
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.count("*").alias("p"))
    j = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone")).join(s, "zone", "left").join(p, "zone", "left").select("zone", F.coalesce("s", F.lit(0)).alias("stations"), F.coalesce("p", F.lit(0)).alias("residents"))
    return j.withColumn("zones_without_service", F.count_if(F.col("stations") == 0).over(whole())).withColumn("zones", F.count("*").over(whole()))


@query(f"""WITH {_MULTI}, a AS (SELECT 'summary' AS level, CAST(modes AS VARCHAR) AS name, count(*) AS n FROM multi GROUP BY 2 UNION ALL SELECT 'combination', mode_list, count(*) FROM multi WHERE modes >= 2 GROUP BY 2)
SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY level), 4) AS pct FROM a""")
def q_two_level(spark, sf_dir):
    m = gold_multimodal(spark, sf_dir)
    a = m.groupBy(F.col("modes").cast("string").alias("name")).agg(F.count("*").alias("n")).withColumn("level", F.lit("summary"))
    b = m.where("modes >= 2").groupBy(F.col("mode_list").alias("name")).agg(F.count("*").alias("n")).withColumn("level", F.lit("combination"))
    return a.unionByName(b).select("level", "name", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("level")), 4).alias("pct"))


@query(f"""WITH {TRIPS}, t AS (SELECT a.s_nationkey AS f, b.s_nationkey AS g FROM trips JOIN supplier a ON a.s_suppkey = station JOIN supplier b ON b.s_suppkey = station + 1 WHERE exit IS NOT NULL)
SELECT (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '1%') AS in_group, (SELECT count(*) FROM orders) AS total, round(100.0::DOUBLE * (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '1%') / (SELECT count(*) FROM orders), 4) AS pct,
  count(*) AS closed, round(100.0::DOUBLE * count(*) FILTER (f <> g) / count(*), 4) AS change_pct FROM t""")
def q_share_of_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("in_group"), F.count("*").alias("total"))
    od = built(spark, sf_dir, "trip-od", fct_trip_od).where("minutes is not null and from_zone is not null and to_zone is not null").agg(F.count("*").alias("closed"), F.count_if("changes_zone").alias("c"))
    return o.crossJoin(od).select("in_group", "total", F.round(F.lit(100.0) * F.col("in_group") / F.col("total"), 4).alias("pct"), "closed", F.round(F.lit(100.0) * F.col("c") / F.col("closed"), 4).alias("change_pct"))


@query(f"""WITH {EV} SELECT count(*) AS boardings, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (day >= DATE '2024-01-11' AND day < DATE '2024-01-18') AS active_week, count(*) FILTER (day >= DATE '2024-01-11') AS since,
  (SELECT count(*) FROM nation) AS zones, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS closed_stations FROM ev""")
def q_kpis(spark, sf_dir):
    e = events(spark, sf_dir)
    week = (F.col("day") >= F.lit("2024-01-11").cast("date")) & (F.col("day") < F.lit("2024-01-18").cast("date"))
    k = e.agg(F.count("*").alias("boardings"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(week, F.col("user_id"))).alias("active_week"), F.count_if(F.col("day") >= F.lit("2024-01-11").cast("date")).alias("since"))
    n = table(spark, sf_dir, "nation").agg(F.count("*").alias("zones"))
    s = table(spark, sf_dir, "supplier").agg(F.count_if(F.col("s_acctbal") < 0).alias("closed_stations"))
    return k.crossJoin(n).crossJoin(s)  # a row each


@query(f"""WITH {EV}, f AS (SELECT event_type AS file, user_id % 3 AS part, count(*) AS n, min(event_id) AS first_offset, max(event_id) AS last_offset FROM ev WHERE day = DATE '2024-01-15' GROUP BY ALL)
SELECT *, sum(n) OVER ()::BIGINT AS figure FROM f""")
def q_lineage(spark, sf_dir):
    e = events(spark, sf_dir).where(F.col("day") == F.lit("2024-01-15").cast("date"))
    f = e.groupBy(F.col("event_type").alias("file"), (F.col("user_id") % 3).alias("part")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_offset"), F.max("event_id").alias("last_offset"))
    return f.withColumn("figure", F.sum("n").over(whole()))


@query(f"""WITH {FACT}, m AS (SELECT zone, card FROM fct GROUP BY ALL HAVING count(DISTINCT mode) >= 2), z AS (SELECT zone, count(*) AS persons FROM m GROUP BY 1),
s AS (SELECT zone, mode, station, count(*) AS n FROM fct SEMI JOIN m USING (zone, card) GROUP BY ALL), b AS (SELECT zone, mode, arg_min(station, (-n, station)) AS busiest FROM s GROUP BY ALL),
l AS (SELECT zone, string_agg(mode || '=' || busiest, ';' ORDER BY mode) AS stations FROM b GROUP BY 1) SELECT zone, persons, stations, rank() OVER (ORDER BY persons DESC, zone) AS place FROM z JOIN l USING (zone)""")
def q_transfer_candidate(spark, sf_dir):
    f = gold_fact(spark, sf_dir)
    m = f.groupBy("zone", "card").agg(F.countDistinct("mode").alias("d")).where("d >= 2").select("zone", "card")
    busiest = marts.mode_of(f.join(m, ["zone", "card"], "left_semi"), ["zone", "mode"], "station", "busiest")
    names = busiest.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("mode", "busiest"))).alias("x")).select("zone", F.array_join(F.transform("x", lambda s: F.concat(s["mode"], F.lit("="), s["busiest"].cast("string"))), ";").alias("stations"))
    z = m.groupBy("zone").agg(F.count("*").alias("persons"))
    return z.join(names, "zone").select("zone", "persons", "stations", F.rank().over(Window.orderBy(F.desc("persons"), "zone")).cast("long").alias("place"))


@query(f"""WITH {_MULTI} SELECT count(*) FILTER (mode_list = 'order') AS only_orders, count(*) FILTER (mode_list LIKE '%click%' AND mode_list LIKE '%view%') AS click_and_view, count(*) FILTER (modes >= 2) AS two_or_more FROM multi""")
def q_set_facts(spark, sf_dir):
    m = F.col("mode_list")
    return gold_multimodal(spark, sf_dir).agg(F.count_if(m == "order").alias("only_orders"), F.count_if(m.contains("click") & m.contains("view")).alias("click_and_view"), F.count_if(F.col("modes") >= 2).alias("two_or_more"))


_MONTH = "WITH m AS (SELECT event_type AS mode, count(*) AS n FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY ROLLUP (event_type)) SELECT coalesce(mode, 'TOTAL') AS mode, n FROM m"


@query(_MONTH)
def q_two_paths_a(spark, sf_dir):
    e = events(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-02-01").cast("timestamp_ntz")))
    return e.rollup(F.col("event_type").alias("mode")).agg(F.count("*").alias("n")).select(F.coalesce("mode", F.lit("TOTAL")).alias("mode"), "n")


@query(_MONTH)
def q_two_paths_b(spark, sf_dir):
    d = built(spark, sf_dir, "demand", agg_demand).where(F.date_format("day", "yyyy-MM") == "2024-01")
    by = d.groupBy("mode").agg(F.sum("boardings").alias("n"))
    return by.unionAll(by.agg(F.lit("TOTAL").alias("mode"), F.sum("n").alias("n")))


_RUNS = "runs AS (SELECT o_orderpriority AS metric, CAST(extract(year FROM o_orderdate) AS BIGINT) AS run, count(*) AS value FROM orders WHERE o_orderdate < '2001-01-01' GROUP BY ALL)"


@query(f"""WITH {_RUNS}, l AS (SELECT run, row_number() OVER (ORDER BY run DESC) AS r FROM (SELECT DISTINCT run FROM runs) ORDER BY run DESC LIMIT 2)
SELECT metric, max(value) FILTER (r = 2) AS before, max(value) FILTER (r = 1) AS last, CASE WHEN max(value) FILTER (r = 2) IS NOT DISTINCT FROM max(value) FILTER (r = 1) THEN 'equal' ELSE 'differs' END AS flag FROM runs JOIN l USING (run) GROUP BY metric""")
def q_compare_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    runs = o.groupBy(F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").cast("long").alias("run")).agg(F.count("*").alias("value"))
    last = runs.select("run").distinct().orderBy(F.desc("run")).limit(2).withColumn("r", F.dense_rank().over(Window.orderBy(F.desc("run"))))
    p = runs.join(F.broadcast(last), "run").groupBy("metric").agg(F.max(F.when(F.col("r") == 2, F.col("value"))).alias("before"), F.max(F.when(F.col("r") == 1, F.col("value"))).alias("last"))  # two rows
    return p.withColumn("flag", F.when(F.col("before").eqNullSafe(F.col("last")), "equal").otherwise("differs"))


@query(f"""WITH {LOG}, s AS (SELECT card, max(seq) FILTER (op = 'DELETE') IS NOT NULL AS gone FROM log GROUP BY card), u AS (SELECT card, count(*) AS n FROM (SELECT user_id AS card FROM events WHERE event_type = 'purchase') GROUP BY 1)
SELECT count(*) AS persons, count(*) FILTER (n IS NULL) AS without_use, count(*) FILTER (n < 15) AS too_few, count(*) FILTER (n >= 15 AND gone) AS removed, count(*) FILTER (n >= 15 AND NOT gone) AS eligible,
  round(100.0::DOUBLE * count(*) FILTER (n >= 15 AND NOT gone) / count(*), 4) AS eligible_pct FROM s LEFT JOIN u USING (card)""")
def q_funnel(spark, sf_dir):
    s = cdc.apply_log(change_log(spark, sf_dir), "card", "seq", "op", ["profile"]).select("card", (F.col("deletes") > 0).alias("gone"))
    u = events(spark, sf_dir).where("event_type = 'purchase'").groupBy(F.col("user_id").alias("card")).agg(F.count("*").alias("n"))
    ok = (F.col("n") >= 15) & ~F.col("gone")
    return s.join(u, "card", "left").agg(F.count("*").alias("persons"), F.count_if(F.col("n").isNull()).alias("without_use"), F.count_if(F.col("n") < 15).alias("too_few"), F.count_if((F.col("n") >= 15) & F.col("gone")).alias("removed"), F.count_if(ok).alias("eligible"), F.round(F.lit(100.0) * F.count_if(ok) / F.count("*"), 4).alias("eligible_pct"))


@query(f"""WITH {EV}, w AS (SELECT DISTINCT user_id AS card, user_id // 3 AS person FROM ev WHERE day < DATE '2024-01-11' AND event_type = 'purchase'), h AS (SELECT DISTINCT user_id AS card, user_id // 3 AS person FROM ev WHERE day >= DATE '2024-01-11' AND day < DATE '2024-01-14' AND event_type = 'purchase'),
j AS (SELECT w.card, w.person, h.card IS NOT NULL AS card_back, p.person IS NOT NULL AS person_back FROM w LEFT JOIN h ON h.card = w.card LEFT JOIN (SELECT DISTINCT person FROM h) p ON p.person = w.person)
SELECT 'cards' AS block, count(*) AS n FROM j UNION ALL SELECT 'persons', count(DISTINCT person) FROM j UNION ALL SELECT 'cards that left', count(*) FILTER (NOT card_back) FROM j UNION ALL SELECT 'false departures', count(*) FILTER (NOT card_back AND person_back) FROM j""")
def q_unit_cost(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("card"), F.floor(F.col("user_id") / 3).alias("person"), "day")
    cut, end = (F.lit(d).cast("date") for d in ("2024-01-11", "2024-01-14"))
    w = e.where(F.col("day") < cut).select("card", "person").distinct()
    h = e.where((F.col("day") >= cut) & (F.col("day") < end)).select("card", "person").distinct()
    j = w.join(h.select("card", F.lit(True).alias("cb")), "card", "left").join(h.select("person", F.lit(True).alias("pb")).distinct(), "person", "left")
    one = j.agg(F.count("*").alias("cards"), F.countDistinct("person").alias("persons"), F.count_if(F.col("cb").isNull()).alias("cards that left"), F.count_if(F.col("cb").isNull() & F.col("pb").isNotNull()).alias("false departures"))
    return one.unpivot([], one.columns, "block", "n")


@query(f"""WITH {FACT}, z AS (SELECT zone, count(*) AS boardings, count(*) FILTER (is_peak) AS peak, count(DISTINCT card) FILTER (day > DATE '2024-01-01' AND day <= DATE '2024-01-31') AS active, count(*) FILTER (day >= DATE '2024-01-01' AND day < DATE '2024-02-01') AS month, sum(round(amount * 100)::BIGINT)::BIGINT AS cents FROM fct GROUP BY 1)
SELECT zone, boardings, round(100.0::DOUBLE * boardings / sum(boardings) OVER (), 4) AS pct, round(peak::DOUBLE / boardings, 6) AS peak_share, active, month, cents FROM z""")
def q_measures(spark, sf_dir):
    """The dashboard's measures by zone: share of all boardings, share at peak hours, cards of the last 30 days, the month's
    boardings, amount in cents."""
    day = lambda d: F.lit(d).cast("date")
    recent = (F.col("day") > day("2024-01-01")) & (F.col("day") <= day(REFERENCE_DAY))
    z = gold_fact(spark, sf_dir).groupBy("zone").agg(
        F.count("*").alias("boardings"), F.count_if("is_peak").alias("peak"), F.countDistinct(F.when(recent, F.col("card"))).alias("active"),
        F.count_if((F.col("day") >= day("2024-01-01")) & (F.col("day") < day("2024-02-01"))).alias("month"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"),
    )
    share = F.round(F.lit(100.0) * F.col("boardings") / F.sum("boardings").over(whole()), 4)
    return z.select("zone", "boardings", share.alias("pct"), F.round(F.col("peak") / F.col("boardings"), 6).alias("peak_share"), "active", "month", "cents")

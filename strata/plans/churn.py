"""Queries of features, populations and labels, and the checks that hold them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from strata.functions.parsing import truncate_at
from strata.functions.storage import stored
from strata.operators import features as X
from strata.plans.register import registry
from strata.plans.tables import EV, events, table

QUERIES, ORACLE, query = registry()
DAILY = X.Clock((("A", "2024-01-11"), ("B", "2024-01-18"), ("C", "2024-01-29")), 7, 3, "2024-01-30")
LARGE = X.Clock((("A", "1999-01-01"), ("B", "2000-01-01"), ("C", "2001-06-01")), 728, 180, "2001-08-01")
_COLS = """events late_events week_1 week_2 week_3 week_4 active_days active_days_1 recency tenure active_weeks modes stations zones active_cards usual_mode usual_zone ratio weekly_cv mode_share_1 mode_share_2 mode_share_3 mode_share_4 peak_share
weekend_share holiday_share transfer_share spend mean_amount mean_hour sd_hour closed_trips mean_minutes registry_events profile has_registry""".split()
WEEKS = [(0, 182), (182, 364), (364, 546), (546, 728)]


def _cuts(clock: X.Clock) -> str:
    values = ", ".join(f"('{a}', DATE '{c}')" for a, c in clock.cutoffs)
    return f"cut AS (SELECT * FROM (VALUES {values}) t(letter, cutoff))"


def _churn_sql(clock: X.Clock, source: str) -> str:
    return f"""{_cuts(clock)}, tag AS (SELECT {source}.*, letter, cutoff, CAST(cutoff - day AS INTEGER) AS days, CASE WHEN cutoff > day THEN 'window' ELSE 'horizon' END AS part
  FROM {source} JOIN cut ON cutoff - day <= {clock.window} AND cutoff - day > -{clock.horizon})"""


def purchases(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("unit"), "event_id", "day")


def removals(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'error' AND k < 2").select(F.col("user_id").alias("unit"), F.col("day").alias("since"))


_P = f"""{EV}, pur AS (SELECT user_id AS unit, event_id, day FROM ev WHERE event_type = 'purchase'), {_churn_sql(DAILY, 'pur')},
rem AS (SELECT user_id AS unit, min(day) AS since FROM ev WHERE event_type = 'error' AND k < 2 GROUP BY 1),
pop AS (SELECT letter, cutoff, unit FROM (SELECT letter, cutoff, unit, count(*) AS n FROM tag WHERE part = 'window' GROUP BY ALL) LEFT JOIN rem USING (unit) WHERE n >= 2 AND (since IS NULL OR since >= cutoff)),
lab AS (SELECT letter, cutoff, unit, CAST(CASE WHEN cutoff + 3 <= DATE '2024-01-31' THEN CASE WHEN b.unit IS NULL THEN 1 ELSE 0 END END AS INTEGER) AS label
  FROM pop LEFT JOIN (SELECT DISTINCT letter, unit FROM tag WHERE part = 'horizon') b USING (letter, unit))"""


@query(f"WITH {_P} SELECT cut.letter, cut.cutoff, cut.cutoff - 7 AS first_day, cut.cutoff + 2 AS last_day, count(*) FILTER (part = 'window') AS in_window, count(*) FILTER (part = 'horizon') AS in_horizon, cut.cutoff + 3 <= DATE '2024-01-31' AS observed FROM cut LEFT JOIN tag ON tag.letter = cut.letter GROUP BY cut.letter, cut.cutoff")
def cutoffs(spark, sf_dir):
    """The cutoffs with their spans, the events in these, and whether the horizon was observed to its end."""
    seen = X.at_cutoffs(purchases(spark, sf_dir), DAILY).groupBy("letter").agg(F.count_if(F.col("part") == "window").alias("in_window"), F.count_if(F.col("part") == "horizon").alias("in_horizon"))
    whole = F.date_add("cutoff", DAILY.horizon) <= F.date_add(F.lit(DAILY.reference).cast("date"), 1)
    rows = X.cutoffs(spark, DAILY).join(seen, "letter", "left")
    return rows.select("letter", "cutoff", F.date_sub("cutoff", DAILY.window).alias("first_day"), F.date_add("cutoff", DAILY.horizon - 1).alias("last_day"), F.coalesce("in_window", F.lit(0)).alias("in_window"), F.coalesce("in_horizon", F.lit(0)).alias("in_horizon"), whole.alias("observed"))


@query(f"WITH {_P} SELECT letter, event_id, unit, part, days FROM tag")
def churn_events(spark, sf_dir):
    return X.at_cutoffs(purchases(spark, sf_dir), DAILY).select("letter", "event_id", "unit", "part", "days")


def _population(spark, sf_dir):
    return X.population(X.at_cutoffs(purchases(spark, sf_dir), DAILY), removals(spark, sf_dir), "unit")


@query(f"WITH {_P} SELECT * FROM pop")
def churn_population(spark, sf_dir):
    return _population(spark, sf_dir)


@query(f"WITH {_P} SELECT * FROM lab")
def churn_label(spark, sf_dir):
    return X.labels(_population(spark, sf_dir), X.at_cutoffs(purchases(spark, sf_dir), DAILY), DAILY, "unit")


MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def boardings(spark, sf_dir):
    """Orders as boardings of persons; the hour is the key's, as orders have none. Trips of the second mode have an exit
    some days later, unless the order is pending."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    hour = (key % 24).cast("long")
    closed = F.when((F.col("o_orderpriority") == MODES[1]) & (F.col("o_orderstatus") != "P"), F.date_add(day, (key % 5).cast("int")))
    return j.select(
        F.col("o_custkey").alias("unit"), day.alias("day"), F.col("o_orderpriority").alias("mode"), (key % 13).alias("station"), F.col("c_nationkey").alias("zone"), (key % 3).alias("card"), hour.alias("hour"), F.col("o_totalprice").alias("amount"),
        (key % 97).alias("minutes"), closed.alias("closed"), hour.isin(6, 7, 8, 16, 17, 18).alias("is_peak"), (F.weekday("o_orderdate") >= 5).alias("is_weekend"), F.date_format(day, "MM-dd").isin("01-01", "05-01", "12-25").alias("is_holiday"), (key % 7 == 0).alias("is_transfer"),
    )


def registry_log(spark, sf_dir):
    """Orders as changes of a registry: the status is the profile, the key the place in the log."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("unit"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3).alias("card"), F.col("o_orderstatus").alias("profile"))


_B = f"""brd AS (SELECT o_custkey AS unit, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS mode, o_orderkey % 13 AS station, c_nationkey AS zone, o_orderkey % 3 AS card, o_orderkey % 24 AS hour, o_totalprice AS amount, o_orderkey % 97 AS minutes,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) END AS closed, o_orderkey % 24 IN (6, 7, 8, 16, 17, 18) AS is_peak, isodow(o_orderdate) >= 6 AS is_weekend,
  strftime(o_orderdate, '%m-%d') IN ('01-01', '05-01', '12-25') AS is_holiday, o_orderkey % 7 = 0 AS is_transfer FROM orders LEFT JOIN customer ON c_custkey = o_custkey), {_churn_sql(LARGE, 'brd')},
pop AS (SELECT letter, cutoff, unit FROM tag WHERE part = 'window' GROUP BY ALL HAVING count(*) >= 2),
lab AS (SELECT letter, cutoff, unit, CAST(CASE WHEN cutoff + 180 <= DATE '2001-08-02' THEN CASE WHEN b.unit IS NULL THEN 1 ELSE 0 END END AS INTEGER) AS label FROM pop LEFT JOIN (SELECT DISTINCT letter, unit FROM tag WHERE part = 'horizon') b USING (letter, unit)),
agg AS (SELECT letter, unit, count(*) AS events, count(*) FILTER (days > 0 AND days <= 182) AS week_1, count(*) FILTER (days > 182 AND days <= 364) AS week_2, count(*) FILTER (days > 364 AND days <= 546) AS week_3, count(*) FILTER (days > 546 AND days <= 728) AS week_4,
  count(DISTINCT day) AS active_days, count(DISTINCT day) FILTER (days <= 182) AS active_days_1, min(days)::BIGINT AS recency, max(days)::BIGINT AS tenure, count(DISTINCT mode) AS modes, count(DISTINCT station) AS stations, count(DISTINCT zone) AS zones, count(DISTINCT card) AS active_cards,
  count(*) FILTER (mode = '1-URGENT') AS m1, count(*) FILTER (mode = '2-HIGH') AS m2, count(*) FILTER (mode = '3-MEDIUM') AS m3, count(*) FILTER (mode = '4-NOT SPECIFIED') AS m4,
  count(*) FILTER (is_peak) AS pk, count(*) FILTER (is_weekend) AS we, count(*) FILTER (is_holiday) AS ho, count(*) FILTER (is_transfer) AS tr, sum(round(amount * 100)::BIGINT)::BIGINT AS cents, sum(hour)::BIGINT AS h1, sum(hour * hour)::BIGINT AS h2,
  count(*) FILTER (closed < cutoff) AS closed_trips, (sum(minutes) FILTER (closed < cutoff))::BIGINT AS mins FROM tag WHERE part = 'window' GROUP BY ALL),
um AS (SELECT letter, unit, arg_min(mode, (-n, mode)) AS usual_mode FROM (SELECT letter, unit, mode, count(*) AS n FROM tag WHERE part = 'window' GROUP BY ALL) GROUP BY ALL),
uz AS (SELECT letter, unit, arg_min(zone, (-n, zone)) AS usual_zone FROM (SELECT letter, unit, zone, count(*) AS n FROM tag WHERE part = 'window' GROUP BY ALL) GROUP BY ALL),
reg AS (SELECT letter, o_custkey AS unit, count(*) FILTER (cutoff - CAST(o_orderdate AS DATE) <= 728) AS registry_events, arg_max(o_orderstatus, o_orderkey) AS profile FROM orders JOIN cut ON CAST(o_orderdate AS DATE) < cutoff GROUP BY ALL),
feat AS (SELECT letter, cutoff, unit, events, week_1 + week_2 AS late_events, week_1, week_2, week_3, week_4, active_days, active_days_1, recency, tenure, CAST((week_1 > 0)::INT + (week_2 > 0)::INT + (week_3 > 0)::INT + (week_4 > 0)::INT AS INTEGER) AS active_weeks, modes, stations, zones, active_cards, usual_mode, usual_zone,
  round((week_1 + week_2)::DOUBLE / nullif(week_3 + week_4, 0), 6) AS ratio, round(sqrt(greatest(4 * (week_1 * week_1 + week_2 * week_2 + week_3 * week_3 + week_4 * week_4) - events * events, 0)::DOUBLE) / events, 6) AS weekly_cv,
  round(m1::DOUBLE / events, 6) AS mode_share_1, round(m2::DOUBLE / events, 6) AS mode_share_2, round(m3::DOUBLE / events, 6) AS mode_share_3, round(m4::DOUBLE / events, 6) AS mode_share_4,
  round(pk::DOUBLE / events, 6) AS peak_share, round(we::DOUBLE / events, 6) AS weekend_share, round(ho::DOUBLE / events, 6) AS holiday_share, round(tr::DOUBLE / events, 6) AS transfer_share, round(cents::DOUBLE / 100, 6) AS spend, round(cents::DOUBLE / (events * 100), 6) AS mean_amount,
  round(h1::DOUBLE / events, 6) AS mean_hour, round(sqrt(greatest(events * h2 - h1 * h1, 0)::DOUBLE) / events, 6) AS sd_hour, closed_trips, round(mins::DOUBLE / nullif(closed_trips, 0), 6) AS mean_minutes, coalesce(registry_events, 0) AS registry_events, profile, registry_events IS NOT NULL AS has_registry
  FROM pop JOIN agg USING (letter, unit) JOIN um USING (letter, unit) JOIN uz USING (letter, unit) LEFT JOIN reg USING (letter, unit))"""


def _features(spark, sf_dir, boarded=None, letters=None):
    """Features and labels from one stored table of tagged rows, which five branches read; of some cutoffs only, if letters
    are given."""
    clock = LARGE if letters is None else replace(LARGE, cutoffs=tuple(c for c in LARGE.cutoffs if c[0] in letters))
    tagged = stored(X.at_cutoffs(boardings(spark, sf_dir) if boarded is None else boarded, clock), "tagged")
    nobody = spark.createDataFrame([], "unit long, since date")
    people = X.population(tagged, nobody, "unit")
    past = X.history(registry_log(spark, sf_dir), clock, "unit")
    return X.behaviour(people, tagged, past, "unit", WEEKS, MODES), X.labels(people, tagged, clock, "unit")


@query(f"WITH {_B} SELECT * FROM feat")
def churn_features(spark, sf_dir):
    return _features(spark, sf_dir)[0]


@query("WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 4 = 0) AS a, count(*) FILTER (o_orderkey % 4 = 1) AS b, count(*) FILTER (o_orderkey % 4 = 2) AS c, count(*) FILTER (o_orderkey % 4 = 3) AS d FROM orders GROUP BY 1) SELECT o_custkey, round(sqrt(greatest(4 * (a*a + b*b + c*c + d*d) - (a+b+c+d) * (a+b+c+d), 0)::DOUBLE) / (a+b+c+d), 6) AS cv FROM s")
def weekly_cv(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderkey") % 4 == i).alias(f"w{i}") for i in range(4)])
    return s.select("o_custkey", F.round(X.cv_of([F.col(f"w{i}") for i in range(4)]), 6).alias("cv"))


def dataset(spark, sf_dir, letters=None):
    f, y = _features(spark, sf_dir, letters=letters)
    return f.join(y, ["letter", "cutoff", "unit"]).withColumn("reference_day", F.lit(LARGE.reference).cast("date")).withColumn("run_id", F.lit("run-1"))


@query(f"WITH {_B} SELECT feat.*, label, DATE '2001-08-01' AS reference_day, 'run-1' AS run_id FROM feat JOIN lab USING (letter, cutoff, unit)")
def churn_dataset(spark, sf_dir):
    return dataset(spark, sf_dir)


_DAY = "DATE '2000-01-01'"


@query(f"""WITH o AS (SELECT o_custkey AS unit, CAST({_DAY} - CAST(o_orderdate AS DATE) AS INTEGER) AS days, o_orderpriority AS mode, o_totalprice AS amount FROM orders WHERE CAST(o_orderdate AS DATE) < {_DAY})
SELECT unit, count(*) FILTER (days <= 7) AS n_7, count(*) FILTER (days <= 30) AS n_30, count(*) FILTER (days <= 90) AS n_90, count(*) FILTER (days <= 30) - count(*) FILTER (days > 30 AND days <= 60) AS trend, min(days)::BIGINT AS recency, max(days)::BIGINT AS tenure,
  count(DISTINCT mode) AS modes, round(sum(round(amount * 100)::BIGINT)::DOUBLE / 100, 6) AS spend, min(days) <= 90 AS is_active FROM o GROUP BY unit""")
def user_features(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate")).alias("days"), F.col("o_orderpriority").alias("mode"), F.col("o_totalprice").alias("amount")).where("days > 0")
    d = F.col("days")
    n = {w: F.count_if(d <= w) for w in (7, 30, 90)}
    return o.groupBy("unit").agg(*[c.alias(f"n_{w}") for w, c in n.items()], (n[30] - F.count_if((d > 30) & (d <= 60))).alias("trend"), F.min("days").cast("long").alias("recency"), F.max("days").cast("long").alias("tenure"), F.countDistinct("mode").alias("modes"), F.round(F.sum(F.round(F.col("amount") * 100).cast("long")) / 100, 6).alias("spend"), (F.min("days") <= 90).alias("is_active"))


@query(f"""WITH {_B}, v AS (SELECT unnest([{", ".join("{'c': '" + c + "', 'v': " + c + " IS NOT NULL}" for c in ["letter", "cutoff", "unit", *_COLS])}]) AS x FROM feat)
SELECT x.c AS "column", CASE WHEN x.c = 'weekly_cv' THEN 'not described' END AS problem, count(*) FILTER (x.v) AS filled, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT 'gone', 'no such column', 0, (SELECT count(*) FROM feat)""")
def dictionary_coverage(spark, sf_dir):
    """Every feature with its values that are there, and what the dictionary lacks or has too much."""
    f = stored(churn_features(spark, sf_dir), "features")
    described = [(c, f"feature {c}") for c in f.columns if c != "weekly_cv"] + [("gone", "")]
    gaps = X.dictionary_gaps(spark.createDataFrame(described, "column string, description string"), f)
    one = f.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in f.columns])
    filled = one.unpivot(["n"], f.columns, "column", "filled")
    return filled.join(gaps, "column", "full").select("column", "problem", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("n", F.lit(f.count())).alias("n"))


@query("SELECT o_custkey AS unit, count(*) AS all_events, max(CAST(o_orderdate AS DATE)) AS last_day, count(DISTINCT o_orderpriority) AS all_modes FROM orders GROUP BY 1")
def leaky_features(spark, sf_dir):
    """The same measures without any time filter: they know the future, as the leak check must notice."""
    return boardings(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("all_events"), F.max("day").alias("last_day"), F.countDistinct("mode").alias("all_modes"))


@query(f"""WITH {_B}, b AS (SELECT unit FROM feat WHERE letter = 'B') SELECT measure, CASE measure WHEN 'only_left' THEN (SELECT count(*) FROM b WHERE unit % 50 = 0) WHEN 'tenure' THEN (SELECT count(*) FROM b WHERE unit % 50 = 1) ELSE 0 END AS n
FROM (SELECT unnest({["only_left", "only_right", "cutoff", *_COLS]}) AS measure)""")
def table_diff(spark, sf_dir):
    """Features of cutoff B from all rows and from rows before it only: nothing may differ but what is planted, units that
    are left out and tenures that are a day longer."""
    whole = boardings(spark, sf_dir)
    cut = truncate_at(whole, "day", "1999-12-31")
    a, b = (_features(spark, sf_dir, x, "B")[0] for x in (whole, cut))
    planted = b.where("unit % 50 <> 0").withColumn("tenure", F.col("tenure") + (F.col("unit") % 50 == 1).cast("long"))
    return X.table_diff(a, planted, ["letter", "unit"])


@query("""WITH a AS (SELECT o_custkey AS unit, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS d, count(DISTINCT o_orderpriority) AS m FROM orders GROUP BY 1), b AS (SELECT o_custkey AS unit, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS d, count(DISTINCT o_orderpriority) AS m FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '2000-01-01' GROUP BY 1)
SELECT 'only_left' AS measure, (SELECT count(*) FROM a WHERE unit NOT IN (SELECT unit FROM b)) AS n UNION ALL SELECT 'only_right', 0 UNION ALL SELECT 'all_events', (SELECT count(*) FROM a JOIN b USING (unit) WHERE a.n <> b.n) UNION ALL SELECT 'last_day', (SELECT count(*) FROM a JOIN b USING (unit) WHERE a.d <> b.d) UNION ALL SELECT 'all_modes', (SELECT count(*) FROM a JOIN b USING (unit) WHERE a.m <> b.m)""")
def leak_detector(spark, sf_dir):
    """The same comparison on the leaky measures: the differences show that the check fires."""
    def made(b):
        return b.groupBy("unit").agg(F.count("*").alias("all_events"), F.max("day").alias("last_day"), F.countDistinct("mode").alias("all_modes"))

    whole = boardings(spark, sf_dir)
    return X.table_diff(made(whole), made(truncate_at(whole, "day", "1999-12-31")), ["unit"])


@query(f"""WITH {_B} SELECT name AS check, (SELECT count(*) FROM feat WHERE unit % 100 = place) AS failing
FROM (VALUES ('recency under 1', 0), ('window too long', 1), ('tenure under recency', 2), ('windows not monotone', 3), ('undeclared cutoff', 4)) t(name, place)""")
def aud_leakage(spark, sf_dir):
    """Failures are planted, one kind in each of five hundredths of the units; all others must pass."""
    f, k = churn_features(spark, sf_dir), F.col("unit") % 100
    f = f.select("unit", "events", F.when(k == 0, 0).otherwise(F.col("recency")).alias("recency"), F.when(k == 1, 1000).when(k == 2, F.col("recency") - 1).otherwise(F.col("tenure")).alias("tenure"),
        F.when(k == 3, F.col("events") + 1).otherwise(F.col("week_1")).alias("week_1"), F.when(k == 4, F.date_add("cutoff", 1)).otherwise(F.col("cutoff")).alias("cutoff"))
    days = [F.lit(c).cast("date") for _, c in LARGE.cutoffs]
    bad = {"recency under 1": F.col("recency") < 1, "tenure under recency": F.col("tenure") < F.col("recency"), "windows not monotone": F.col("week_1") > F.col("events"), "window too long": F.col("tenure") > LARGE.window, "undeclared cutoff": ~F.col("cutoff").isin(days)}
    one = f.agg(*[F.count_if(c).alias(n) for n, c in bad.items()])
    return one.unpivot([], list(bad), "check", "failing")


@query(f"""WITH {_P} SELECT 'population differs' AS check, (SELECT count(*) FROM pop WHERE unit % 100 = 2) AS failing UNION ALL SELECT 'label without horizon', (SELECT count(*) FROM lab WHERE label IS NULL AND unit % 100 = 1)
UNION ALL SELECT 'no label with horizon', (SELECT count(*) FROM lab WHERE label IS NOT NULL AND unit % 100 = 0) UNION ALL SELECT 'window over bound', (SELECT count(*) FROM tag WHERE unit % 100 = 3)""")
def aud_churn(spark, sf_dir):
    """Failures are planted in some hundredths of the units: left out, labelled too early, not labelled, out of the window."""
    people, y = _population(spark, sf_dir).where("unit % 100 <> 2"), churn_label(spark, sf_dir)
    y = y.withColumn("label", F.when(F.col("unit") % 100 == 1, F.coalesce("label", F.lit(1))).when(F.col("unit") % 100 != 0, F.col("label")))
    p = purchases(spark, sf_dir)
    again = None  # the rule once more, a cutoff at a time
    for letter, day in DAILY.cutoffs:
        d = F.lit(day).cast("date")
        n = p.where((F.col("day") < d) & (F.col("day") >= F.date_sub(d, DAILY.window))).groupBy("unit").agg(F.count("*").alias("n")).where("n >= 2")
        one = n.join(removals(spark, sf_dir).where(F.col("since") < d), "unit", "left_anti").select(F.lit(letter).alias("letter"), "unit")
        again = one if again is None else again.unionAll(one)
    a, b = people.select("letter", "unit"), again
    differ = a.subtract(b).unionAll(b.subtract(a)).agg(F.count("*").alias("population differs"))
    seen = F.date_add("cutoff", DAILY.horizon) <= F.date_add(F.lit(DAILY.reference).cast("date"), 1)
    marks = y.agg(F.count_if(~seen & F.col("label").isNotNull()).alias("label without horizon"), F.count_if(seen & F.col("label").isNull()).alias("no label with horizon"))
    days = F.col("days") + F.when(F.col("unit") % 100 == 3, 100).otherwise(0)
    bound = churn_events(spark, sf_dir).agg(F.count_if(days > DAILY.window).alias("window over bound"))
    one = differ.crossJoin(marks).crossJoin(bound)  # a row each
    return one.unpivot([], one.columns, "check", "failing")

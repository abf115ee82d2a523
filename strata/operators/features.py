"""Point-in-time features, populations and labels: everything is a function of rows before the cutoff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.marts import mode_of


@dataclass(frozen=True)
class Clock:
    """Cutoff days by letter, days of the window before and of the horizon after, and the last day that was observed."""

    cutoffs: tuple[tuple[str, str], ...]
    window: int
    horizon: int
    reference: str


def cutoffs(spark, clock: Clock) -> DataFrame:
    return spark.createDataFrame(list(clock.cutoffs), "letter string, cutoff string").withColumn("cutoff", F.col("cutoff").cast("date"))


def at_cutoffs(events: DataFrame, clock: Clock, day: str = "day") -> DataFrame:
    """Events once per cutoff whose window or horizon has them: letter, cutoff, part, days (before the cutoff; 1 is the
    day before it, 0 and less is the horizon). Cutoffs are few, so each event carries them all and a filter follows."""
    days = F.array(*[F.struct(F.lit(a).alias("letter"), F.lit(c).cast("date").alias("cutoff")) for a, c in clock.cutoffs])
    rows = events.withColumn("_c", F.explode(days)).select(*events.columns, "_c.*").withColumn("days", F.datediff("cutoff", day))
    part = F.when(F.col("days") > 0, "window").otherwise("horizon")
    return rows.where((F.col("days") <= clock.window) & (F.col("days") > -clock.horizon)).withColumn("part", part)


def population(tagged: DataFrame, removed: DataFrame, unit: str, least: int = 2) -> DataFrame:
    """Units with `least` events in the window and no removal before the cutoff. removed: unit, since (day)."""
    active = tagged.where("part = 'window'").groupBy("letter", "cutoff", unit).agg(F.count("*").alias("events")).where(F.col("events") >= least)
    gone = removed.groupBy(unit).agg(F.min("since").alias("since"))
    return active.join(gone, unit, "left").where("since is null or since >= cutoff").select("letter", "cutoff", unit)


def labels(people: DataFrame, tagged: DataFrame, clock: Clock, unit: str) -> DataFrame:
    """1 if the unit has no event in the horizon, 0 if it has, NULL if the horizon was not observed to its end."""
    back = tagged.where("part = 'horizon'").select("letter", unit).distinct().withColumn("_back", F.lit(True))
    seen = F.date_add("cutoff", clock.horizon) <= F.date_add(F.lit(clock.reference).cast("date"), 1)
    return people.join(back, ["letter", unit], "left").select("letter", "cutoff", unit, F.when(seen, F.when(F.col("_back"), 0).otherwise(1)).cast("int").alias("label"))


def cv_of(counts: list[Column]) -> Column:
    """Population coefficient of variation of a fixed list of counts, zeros included, from integer sums."""
    n = F.lit(len(counts))
    total = sum(counts[1:], counts[0])
    squares = sum((c * c for c in counts[1:]), counts[0] * counts[0])
    return F.when(total > 0, F.sqrt(F.greatest(n * squares - total * total, F.lit(0)).cast("double")) / total)


def history(log: DataFrame, clock: Clock, unit: str, day: str = "day") -> DataFrame:
    """What a change log (unit, day, seq, card, profile) says of each unit before each cutoff: letter, unit, registry_events
    in the window, and the profile of the last change (ties to the smaller card)."""
    before = at_cutoffs(log, Clock(clock.cutoffs, 1 << 20, 0, clock.reference), day)
    last = F.min_by("profile", F.struct(-F.col("seq"), "card"))
    return before.groupBy("letter", unit).agg(F.count_if(F.col("days") <= clock.window).alias("registry_events"), last.alias("profile"))


def behaviour(people: DataFrame, tagged: DataFrame, past: DataFrame, unit: str, weeks: list[tuple[int, int]], shares: list[str]) -> DataFrame:
    """33 features of each (cutoff, unit): one wide conditional aggregation, modal values on the same key, and the history
    of the registry. tagged has mode, station, zone, card, hour, amount, minutes, closed (day on which the trip is known
    to have ended, or null), is_peak, is_weekend, is_holiday, is_transfer. Sets are of days, stations and the like, so they
    are small; means come from integer sums, so that the order of rows cannot matter."""
    w = tagged.where("part = 'window'")
    keys = ["letter", unit]
    d, n = F.col("days"), F.col("events")
    in_week = [F.count_if((d > a) & (d <= b)).alias(f"week_{i + 1}") for i, (a, b) in enumerate(weeks)]
    flags = ("is_peak", "is_weekend", "is_holiday", "is_transfer")
    ended = F.col("closed") < F.col("cutoff")

    def kinds(c, name: str) -> Column:
        return F.size(F.collect_set(c)).cast("long").alias(name)

    sums = w.groupBy(*keys).agg(
        F.count("*").alias("events"), *in_week, kinds("days", "active_days"), kinds(F.when(d <= weeks[0][1], d), "active_days_1"), F.min("days").cast("long").alias("recency"), F.max("days").cast("long").alias("tenure"),
        kinds("mode", "modes"), kinds("station", "stations"), kinds("zone", "zones"), kinds("card", "active_cards"), *[F.count_if(F.col("mode") == m).alias(f"_m{i + 1}") for i, m in enumerate(shares)],
        *[F.count_if(c).alias(f"_{c}") for c in flags], F.sum(F.round(F.col("amount") * 100).cast("long")).alias("_cents"), F.count("amount").alias("_paid"),
        F.sum("hour").alias("_hours"), F.sum(F.col("hour") * F.col("hour")).alias("_hours2"), F.count_if(ended).alias("closed_trips"), F.sum(F.when(ended, F.col("minutes"))).alias("_minutes"),
    )
    usual = mode_of(w, keys, "mode", "usual_mode").join(mode_of(w, keys, "zone", "usual_zone"), keys)
    weekly = [F.col(f"week_{i + 1}") for i in range(len(weeks))]
    half = len(weekly) // 2
    late, early = sum(weekly[1:half], weekly[0]), sum(weekly[half + 1 :], weekly[half])

    def six(c: Column) -> Column:
        return F.round(c, 6)

    wide = people.join(sums, keys).join(usual, keys).join(past, keys, "left")
    return wide.select(
        "letter", "cutoff", unit, "events", late.alias("late_events"), *weekly, "active_days", "active_days_1", "recency", "tenure",
        sum((F.when(c > 0, 1).otherwise(0) for c in weekly[1:]), F.when(weekly[0] > 0, 1).otherwise(0)).alias("active_weeks"), "modes", "stations", "zones", "active_cards", "usual_mode", "usual_zone",
        six(F.try_divide(late.cast("double"), early.cast("double"))).alias("ratio"), six(cv_of(weekly)).alias("weekly_cv"), *[six(F.col(f"_m{i + 1}") / n).alias(f"mode_share_{i + 1}") for i in range(len(shares))],
        *[six(F.col(f"_{c}") / n).alias(f"{c[3:]}_share") for c in flags], six(F.col("_cents") / 100).alias("spend"), six(F.try_divide(F.col("_cents"), F.col("_paid") * 100)).alias("mean_amount"),
        six(F.col("_hours") / n).alias("mean_hour"), six(F.sqrt(F.greatest(n * F.col("_hours2") - F.col("_hours") * F.col("_hours"), F.lit(0)).cast("double")) / n).alias("sd_hour"),
        "closed_trips", six(F.try_divide(F.col("_minutes").cast("double"), F.col("closed_trips"))).alias("mean_minutes"), F.coalesce("registry_events", F.lit(0)).alias("registry_events"), "profile", F.col("registry_events").isNotNull().alias("has_registry"),
    )


def dictionary_gaps(described: DataFrame, df: DataFrame) -> DataFrame:
    """column, problem: columns without a description and descriptions without a column."""
    here = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    a = here.join(described, "column", "left_anti").withColumn("problem", F.lit("not described"))
    b = described.select("column").join(here, "column", "left_anti").withColumn("problem", F.lit("no such column"))
    return a.unionByName(b)


def table_diff(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-6) -> DataFrame:
    """measure, n: keys on one side only, and per common column the rows that differ. Two NULLs are equal, numbers up
    to the tolerance. One full join and one aggregate."""
    shared = [c for c in a.columns if c in b.columns and c not in key]
    kinds = dict(a.dtypes)
    left, right = (df.select(*[F.col(k).alias(f"k_{k}") for k in key], F.struct(*shared).alias(side)) for df, side in ((a, "l"), (b, "r")))
    joined = left.join(right, [f"k_{k}" for k in key], "full")

    def differs(c: str) -> Column:
        x, y = F.col(f"l.{c}"), F.col(f"r.{c}")
        unequal = F.abs(x - y) > tolerance if kinds[c] in ("double", "float") else x != y
        return (x.isNull() != y.isNull()) | F.coalesce(unequal, F.lit(False))

    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    one = joined.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), *[F.count_if(both & differs(c)).alias(c) for c in shared])
    return one.unpivot([], one.columns, "measure", "n")

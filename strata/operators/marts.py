"""Dimensions, facts and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mode_of(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value per group, ties to the smallest: a count and a minimum, no sort or window."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(name))


def dim_time(ranges: list[tuple[DataFrame, str]], bands: DataFrame, holidays: DataFrame) -> DataFrame:
    """An hour per row from the first to the last day of all (table, column) ranges: key YYYYMMDDHH, band and peak of
    the hour, holiday, ISO day of week and week, working day, year-month."""
    spans = None
    for df, column in ranges:
        one = df.agg(F.min(F.to_date(column)).alias("a"), F.max(F.to_date(column)).alias("b"))
        spans = one if spans is None else spans.unionAll(one)
    days = spans.agg(F.min("a").alias("a"), F.max("b").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    hours = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    joined = hours.join(F.broadcast(bands), "hour", "left").join(F.broadcast(holidays), "day", "left")  # 24 rows; a row per holiday
    dow = F.weekday("day") + 1
    return joined.select(
        (F.date_format("day", "yyyyMMdd").cast("long") * 100 + F.col("hour")).alias("time_key"), "day", "hour", "band", "is_peak", F.col("holiday").isNotNull().alias("is_holiday"),
        dow.cast("long").alias("iso_dow"), (~F.col("holiday").isNotNull() & (dow <= 5)).alias("working_day"), F.weekofyear("day").cast("long").alias("iso_week"), F.date_format("day", "yyyy-MM").alias("year_month"),
    )


def demand(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Additive sums and distinct counts of cards and stations per cell."""
    return fact.groupBy(*keys).agg(F.count("*").alias("boardings"), F.sum("amount").alias("amount"), F.countDistinct("card").alias("cards"), F.countDistinct("station").alias("stations"))


def card_bitmaps(fact: DataFrame, keys: list[str], card: str) -> DataFrame:
    """keys, bucket, cards: for each cell bitmaps of the cards (whole numbers from 0) that it has, 32,768 a bucket. Bitmaps
    of cells are or-ed to those of any coarser cell, so distinct counts add up exactly, without the rows."""
    return fact.where(F.col(card).isNotNull()).groupBy(*keys, F.bitmap_bucket_number(card).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(card)).alias("cards"))


def distinct_cards(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cards: the distinct cards of each cell of some of the bitmaps' keys (none: of all cells)."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("cards").alias("cards"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("cards")).alias("cards"))


def rank_cumulative(df: DataFrame, name: str, measure: str) -> DataFrame:
    """Rank, share and running share of a small aggregate, ties by name."""
    order = Window.orderBy(F.desc(measure), name)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(measure).over(everything)
    running = F.sum(measure).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.select(name, measure, F.rank().over(Window.orderBy(F.desc(measure))).cast("long").alias("place"), F.round(F.lit(100.0) * F.col(measure) / total, 4).alias("pct"), F.round(F.lit(100.0) * running / total, 4).alias("running_pct"))

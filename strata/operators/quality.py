"""Quality rules: one label per row, quarantine, summaries, expectations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column
    reason: str


def label(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with rule_id and reason of the first rule that fails, in the order given; NULL for valid rows."""
    name, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        fails = F.coalesce(r.fails, F.lit(False))
        name, why = F.when(fails, r.name).otherwise(name), F.when(fails, r.reason).otherwise(why)
    return df.withColumn("rule_id", name).withColumn("reason", why)


def in_catalog(df: DataFrame, column: str, catalog: DataFrame, flag: str) -> DataFrame:
    """df with a flag: whether the column's value is in the catalog's only column. NULL is in none."""
    known = catalog.toDF("_known").where("_known is not null").distinct().withColumn(flag, F.lit(True))
    return df.join(known, df[column] == known["_known"], "left").drop("_known").withColumn(flag, F.coalesce(flag, F.lit(False)))


def label_repeats(labelled: DataFrame, key: list[Column], order: list[Column], name: str, reason: str) -> DataFrame:
    """Among rows that passed so far, label all of a key but the first in order; rows already labelled don't compete."""
    w = Window.partitionBy(*key, F.col("rule_id").isNull()).orderBy(*order)
    again = F.col("rule_id").isNull() & (F.row_number().over(w) > 1)
    out = labelled.withColumn("_again", again)
    return out.withColumn("reason", F.when(F.col("_again"), reason).otherwise(F.col("reason"))).withColumn("rule_id", F.when(F.col("_again"), name).otherwise(F.col("rule_id"))).drop("_again")


def valid(labelled: DataFrame) -> DataFrame:
    return labelled.where("rule_id is null").drop("rule_id", "reason")


def quarantine(labelled: dict[str, DataFrame], run: str, moment: str) -> DataFrame:
    """All rejects of all sources: source, key, record, rule_id, reason, run_id, rejected_at (a parameter, no clock)."""
    out = None
    for source, df in labelled.items():
        one = df.where("rule_id is not null").select(F.lit(source).alias("source"), F.col("key").cast("string").alias("key"), "record", "rule_id", "reason")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("run_id", F.lit(run)).withColumn("rejected_at", F.lit(moment).cast("timestamp_ntz"))


def layer_counts(labelled: dict[str, DataFrame]) -> DataFrame:
    """source, staged, valid, rejected: an aggregate a source, so that each source is read once; none of a source without rows."""
    out = None
    for source, df in labelled.items():
        one = df.groupBy(F.lit(source).alias("source")).agg(F.count("*").alias("staged"), F.count_if(F.col("rule_id").isNull()).alias("valid"), F.count("rule_id").alias("rejected"))
        out = one if out is None else out.unionByName(one)
    return out


def summary(labelled: dict[str, DataFrame]) -> DataFrame:
    """Rejects per source and rule, share of the source in percent, and a TOTAL row per source, with or without rejects."""
    out = None
    for source, df in labelled.items():
        one = df.groupBy("rule_id").count().withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    own, rejected = Window.partitionBy("source"), F.col("rule_id").isNotNull()  # a row a rule
    sums = out.select("source", "rule_id", F.col("count").alias("n"), F.sum("count").over(own).alias("total"), F.sum(F.when(rejected, F.col("count")).otherwise(0)).over(own).alias("all"), F.row_number().over(own.orderBy("rule_id")).alias("place"))
    both = F.filter(F.array(F.when(rejected, F.struct("rule_id", "n")), F.when(F.col("place") == 1, F.struct(F.lit("TOTAL").alias("rule_id"), F.col("all").alias("n")))), lambda x: x.isNotNull())
    rows = sums.select("source", "total", F.inline(both))
    return rows.select("source", "rule_id", "n", "total", F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")), 3).alias("pct"))


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once; a key with a NULL in it is none."""
    return df.dropna("any", subset=columns).groupBy(*columns).count().where("count > 1").agg(F.count("*").alias("failing"))


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1).alias("failing"))


def accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(values)).alias("failing"))


def in_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.agg(F.count_if((F.col(column) < low) | (F.col(column) > high)).alias("failing"))


def related(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    keys = other.select(F.col(key).alias("_k")).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti").agg(F.count("*").alias("failing"))


def same_count(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("a")).crossJoin(other.agg(F.count("*").alias("b"))).select(F.abs(F.col("a") - F.col("b")).alias("failing"))


def expect(checks: dict[str, DataFrame]) -> DataFrame:
    """check, failing, passed: a row per check."""
    out = None
    for name, failing in checks.items():
        one = failing.select(F.lit(name).alias("check"), F.col("failing").cast("long").alias("failing"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("failing") == 0)

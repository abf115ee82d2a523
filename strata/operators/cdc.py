"""Change logs: current state, summaries, versioned history, states as of a day, running balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_format(card: Column) -> tuple[Column, Column]:
    """The operator that issued a card, by its format, and the number inside it."""
    kinds = [("TM", "^TC-([0-9]{8})$"), ("TU", "^([0-9]{10})$"), ("MR", "^MR([0-9]{7})$"), ("AM", "^[0-9a-f]{12}$")]
    operator, base = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for name, pattern in reversed(kinds):
        operator = F.when(card.rlike(pattern), name).otherwise(operator)
        if "(" in pattern:
            base = F.when(card.rlike(pattern), F.regexp_extract(card, pattern, 1).try_cast("bigint")).otherwise(base)
    return operator, base


def apply_log(log: DataFrame, key: str, seq: str, op: str, attributes: list[str]) -> DataFrame:
    """Current state per key: the last operation decides, attributes are the last non-NULL ones (deletes have no body),
    with operation counts and anomaly flags. All of it adds up from partial sums, so a key of any size costs a task no
    more than a row: an operation came before any insert if the least place of its kind is before that of inserts."""
    last, first = F.max_by(op, seq), F.min_by(op, seq)
    kinds = (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes"))
    least = [F.min(F.when(F.col(op) == o, F.col(seq))).alias(f"_first_{n}") for o, n in kinds]
    found = log.groupBy(key).agg(
        F.when(last == "DELETE", "INACTIVE").otherwise("ACTIVE").alias("state"),
        *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col(seq))).alias(a) for a in attributes],
        first.alias("first_op"), last.alias("last_op"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
        *[F.count_if(F.col(op) == o).alias(n) for o, n in kinds], *least,
    )

    def before_inserts(n: str) -> Column:
        return F.col(f"_first_{n}").isNotNull() & (F.col("_first_inserts").isNull() | (F.col(f"_first_{n}") < F.col("_first_inserts")))

    flags = {"implicit_insert": before_inserts("updates"), "repeated_insert": F.col("inserts") > 1, "delete_without_insert": before_inserts("deletes")}
    return found.withColumns(flags).drop(*[f"_first_{n}" for _, n in kinds])


def summarise(log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """One row of totals: operations by kind, keyed and not, and keys by their last state."""
    kinds = [(F.col(op) == o).alias(n) for o, n in (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes"))]
    totals = log.select(*kinds, F.col(key).isNull().alias("unkeyed")).agg(F.count("*").alias("operations"), *[F.count_if(n).alias(n) for n in ("inserts", "updates", "deletes", "unkeyed")])
    per_key = log.groupBy(key).agg(F.max_by(op, seq).alias("last"), F.count_if(F.col(op) == "DELETE").alias("d"))
    states = per_key.agg(F.count("*").alias("cards"), F.count_if(F.col("last") != "DELETE").alias("active"), F.count_if(F.col("last") == "DELETE").alias("inactive"), F.count_if(F.col("d") > 0).alias("ever_deleted"))
    return totals.crossJoin(states)  # a row each


def scd2(log: DataFrame, key: str, seq: str, op: str, time: str, attributes: list[str]) -> DataFrame:
    """A version per operation, valid until the next; attributes are carried forward; a clock that runs back is flagged."""
    w = Window.partitionBy(key).orderBy(seq)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.select(
        key, seq, op, F.row_number().over(w).cast("long").alias("version"), F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"),
        F.lead(seq).over(w).isNull().alias("is_current"), *[F.last(a, ignorenulls=True).over(so_far).alias(a) for a in attributes],
        F.coalesce(F.col(time) < F.lag(time).over(w), F.lit(False)).alias("clock_back"),
    )


def as_of(history: DataFrame, days: list[str], key: str, since: str, seq: str, columns: list[str]) -> DataFrame:
    """The last version of each key that began before each day. A NULL of the winning version stays NULL."""
    cutoffs = F.array(*[F.lit(d).cast("date") for d in days])
    known = history.withColumn("cutoff", F.explode(cutoffs)).where(F.col(since) < F.col("cutoff"))
    won = known.groupBy("cutoff", key).agg(F.max_by(F.struct(*columns), seq).alias("v"))
    return won.select("cutoff", key, "v.*")


def balance(log: DataFrame, key: str, seq: str, op: str, bucket: int = 100_000) -> DataFrame:
    """Each operation's effect on the number of active keys, and the balance after it. The running sum is made inside
    buckets of the sequence; bucket totals get theirs apart, so that no window holds the whole log."""
    here = F.lag(op).over(Window.partitionBy(key).orderBy(seq))
    out = F.coalesce(F.col("previous_op"), F.lit("DELETE")) == "DELETE"
    delta = F.when((F.col(op) != "DELETE") & out, 1).when((F.col(op) == "DELETE") & ~out, -1).otherwise(0).cast("long")
    changes = log.select(seq, key, op, here.alias("previous_op")).withColumn("delta", delta).withColumn("_b", F.floor(F.col(seq) / bucket))
    totals = changes.groupBy("_b").agg(F.sum("delta").alias("t"))
    ahead = totals.select("_b", F.coalesce(F.sum("t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.withColumn("_sum", F.sum("delta").over(inside)).join(ahead, "_b").select(seq, key, op, "previous_op", "delta", (F.col("_before") + F.col("_sum")).alias("balance"))

"""Persons: keyed pseudonyms, inverted hashes, one directory for all kinds of cards."""

from __future__ import annotations

import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256 for a key of 64 bytes at most."""
    if len(key) > 64:
        raise ValueError("hash keys of more than 64 bytes first")
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(message: Column, pads: tuple[bytes, bytes]) -> Column:
    """Hex HMAC-SHA256 of a text in native expressions; NULL stays NULL. The key itself never enters the plan."""
    inner, outer = (F.lit(p) for p in pads)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def hmac_mismatches(df: DataFrame, part: str, message: Column, digest: Column, key: bytes) -> DataFrame:
    """Per part: rows checked, those whose digest is not the one of Python's own HMAC (a NULL message has the digest NULL),
    and whether there is none. Runs in Arrow batches; unlike pads, the key goes to the workers, so this is for checks."""

    @F.pandas_udf("string")
    def other(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hmac.digest(key, x.encode(), "sha256").hex(), na_action="ignore")

    differs = ~other(message).eqNullSafe(digest)
    return df.select(F.col(part).alias("part"), differs.alias("differs")).groupBy("part").agg(F.count("*").alias("checked"), F.count_if("differs").alias("differing"), (F.count_if("differs") == 0).alias("passed"))


def hash_dictionary(spark, prefix: str, last: int, length: int = 12, per_task: int = 1_000_000) -> DataFrame:
    """hash, id: the first characters of md5(prefix + id) for ids 1 to last, to invert an unsalted short hash."""
    ids = spark.range(1, last + 1, 1, max(1, last // per_task))
    return ids.select(F.substring(F.md5(F.concat(F.lit(prefix), F.col("id").cast("string")).cast("binary")), 1, length).alias("hash"), "id")


def pick_latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the last in order, without a sort or window."""
    won = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v"))
    return won.select(*keys, "v.*")


def directory(used: DataFrame, registered: DataFrame, pads: tuple[bytes, bytes]) -> DataFrame:
    """Cards seen in operation or in the registry (mode, card): person (base id), how it was found, pseudonyms of card
    and person, and the person's registry entry where there is one."""
    cards = used.select("mode", "card").unionByName(registered.select("mode", "card")).distinct()
    entry = pick_latest(registered, ["card"], ["seq", "mode"], ["segment"])
    joined = cards.join(entry.withColumn("_found", F.lit(True)), "card", "left")
    return joined.select(
        "mode", "card", F.when(F.col("_found"), "registry").otherwise("operation").alias("link_method"),
        hmac_sha256(F.concat_ws("|", F.col("mode"), F.col("card").cast("string")), pads).alias("card_key"),
        hmac_sha256(F.concat(F.lit("person|"), F.col("card").cast("string")), pads).alias("person_key"),
        F.coalesce("segment", F.lit("UNKNOWN")).alias("segment"),
    )


def known_cards(seen: DataFrame, days: list[str]) -> DataFrame:
    """cutoff, person, cards (ordered text), n_cards: the cards that each person had been seen with before each day."""
    cutoffs = F.array(*[F.lit(d).cast("date") for d in days])
    rows = seen.withColumn("cutoff", F.explode(cutoffs)).where(F.col("ts") < F.col("cutoff")).select("cutoff", "person", F.concat_ws(":", "mode", F.col("card").cast("string")).alias("name")).distinct()
    return rows.groupBy("cutoff", "person").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("cards"), F.count("*").alias("n_cards"))


def native_key_values(outputs: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """table, column, n, native: for each column of text or whole numbers of some outputs its values and how many of them
    are native keys (the only column of keys). What is to be published must have 0 everywhere. One pass and one join."""
    long, kinds = None, ("string", "int", "bigint")
    for name, df in outputs.items():
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c, t in df.dtypes if t in kinds])
        one = df.select(F.lit(name).alias("table"), F.inline(cells))
        long = one if long is None else long.unionAll(one)
    counts = long.where("value is not null").groupBy("table", "column", "value").agg(F.count("*").alias("n"))
    known = keys.toDF("_key").select(F.col("_key").cast("string").alias("value"), F.lit(True).alias("native")).distinct()
    met = counts.join(known, "value", "left")
    return met.groupBy("table", "column").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("native"), F.col("n")).otherwise(0)).alias("native"))

"""Typing of raw text: errors become NULL, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,9)"


def field(raw: Column, place: int, separator: str = ",") -> Column:
    """Field of a separated line, trimmed; NULL if blank or beyond the line's end. Quotes mean nothing."""
    return F.nullif(F.trim(F.get(F.split(raw, separator, -1), place)), F.lit(""))


def safe(value: Column, kind: str) -> Column:
    """The value as `kind`, NULL if it isn't one."""
    return value.try_cast(kind)


def parse_time(text: Column, pattern: str) -> Column:
    """Zone-less time by a pattern; NULL for impossible dates."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def local_time(utc: Column, zone: str) -> Column:
    """Wall-clock time in a zone of a zone-less UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def minor_units(units: Column) -> Column:
    """Cents to currency."""
    return (units.cast(MONEY) / 100).cast(MONEY)


def json_field(line: Column, path: str, kind: str) -> Column:
    """A value of a JSON line; NULL if the line is malformed, the path is absent or the value isn't of the kind."""
    return F.try_variant_get(F.try_parse_json(line), path, kind)


def json_is_object(line: Column, path: str) -> Column:
    """Whether the path holds an object, as opposed to JSON null or nothing."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), path, "variant")).startswith("OBJECT"), F.lit(False))


def row_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def truncate_at(df: DataFrame, time: str, day: str, later: dict[str, str] | None = None) -> DataFrame:
    """df as it was known at the end of a day: rows without time or up to the day. later: time columns that may lie
    after the row's own, each with the columns (comma separated) that are unknown while it lies beyond the day."""
    out = df.where(F.col(time).isNull() | (F.to_date(time) <= F.lit(day).cast("date")))
    for moment, columns in (later or {}).items():
        beyond = F.to_date(moment) > F.lit(day).cast("date")
        out = out.withColumns({c: F.when(F.coalesce(~beyond, F.lit(True)), F.col(c)) for c in columns.split(",")})
    return out

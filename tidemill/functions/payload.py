"""JSON payloads as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoded(df: DataFrame, *columns: str) -> DataFrame:
    """One ``payload`` column of the given columns (all of them by default)."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("payload"))


def valid(payload: Column) -> Column:
    """Whether a payload is JSON."""
    return F.try_parse_json(payload).isNotNull()


def or_empty(payload: Column) -> Column:
    return F.coalesce(payload, F.lit("{}"))


def flags(payload: Column) -> Column:
    """Top-level fields as text; true and "true" read alike, and keys are taken literally."""
    return F.from_json(payload, "map<string,string>")


def decoded(payload: Column, schema: str) -> Column:
    """The payload as a struct, null where it does not fit."""
    return F.from_json(payload, schema, {"mode": "PERMISSIVE"})

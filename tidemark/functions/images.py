"""Row images: building, parsing and printing their JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import canonical_numbers
from .text import NULL_TEXT

# Nulls stay visible and timestamps keep their microseconds.
IMAGE_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def row_image(columns: Iterable[str | Column]) -> Column:
    """All given columns as one JSON object, in order."""
    return F.to_json(F.struct(*columns), IMAGE_OPTIONS)


def struct_image(struct: Column) -> Column:
    return F.to_json(struct, IMAGE_OPTIONS)


def image_map(image: str | Column) -> Column:
    """JSON object -> map<string, variant>; null for null and for non-objects."""
    return F.from_json(image, "map<string,variant>")


def image_text(image: str | Column) -> Column:
    """JSON object -> map<string, string>: values as a database text cast prints them."""
    return F.from_json(image, "map<string,string>")


def canonical(text: Column) -> Column:
    """JSON text as ``to_json`` prints a variant, such that equal JSON values give equal texts: Spark sorts
    object keys itself, numbers get one form per value at any depth."""
    return canonical_numbers(text)


def printed(text: Column, value: Column) -> Column:
    """Print a variant given its JSON text: null as NULL, strings raw, the rest as JSON."""
    return (
        F.when(text.isNull() | (text == "null"), F.lit(NULL_TEXT))
        .when(text.startswith('"'), value.cast("string"))
        .otherwise(canonical(text))
    )


def format_value(value: Column) -> Column:
    return printed(F.to_json(value), value)


def iso_millis(ts: str | Column) -> Column:
    """ISO text in UTC with milliseconds, whatever the session zone."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_seconds(ts: str | Column) -> Column:
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd HH:mm:ss' UTC'")


def utc_date(ts: str | Column) -> Column:
    days = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int")
    return F.date_from_unix_date(days)

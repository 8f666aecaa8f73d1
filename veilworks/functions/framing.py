"""How one event is delimited in a byte stream, and what size that takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def newline_framed(body: Column) -> Column:
    """One physical line: CR and LF inside become the two characters ``\\r`` and ``\\n``."""
    escaped = F.replace(F.replace(body, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.concat(escaped, F.lit("\n"))


def octet_framed(body: Column) -> Column:
    return F.concat(F.octet_length(body).cast("string"), F.lit(" "), body)


def newline_framed_size(body: Column) -> Column:
    """Bytes of ``newline_framed(body)`` without building it."""
    breaks = F.length(body) - F.length(F.translate(body, "\r\n", ""))
    return (F.octet_length(body) + 1 + breaks).cast("long")


def octet_framed_size(body: Column) -> Column:
    size = F.octet_length(body)
    return (F.length(size.cast("string")) + 1 + size).cast("long")


def events_in_payload(payload: Column) -> Column:
    """Newlines, plus one for trailing text; an empty payload holds none."""
    lines = F.length(payload) - F.length(F.replace(payload, F.lit("\n"), F.lit("")))
    return F.when(payload == "", 0).otherwise(lines + F.when(payload.endswith("\n"), 0).otherwise(1)).cast("long")


def events_of_payload(payload: Column) -> Column:
    """The events of a payload, newline kept."""
    return F.regexp_extract_all(payload, F.lit("[^\\n]*\\n|[^\\n]+"), F.lit(0))

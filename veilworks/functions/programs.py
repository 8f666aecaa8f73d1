"""Compiled templates as one string.

Control characters cannot occur in a tokenized template (they are escaped), so they can stand for the date and
time fields. Printing an event then is a few literal replacements inside generated code instead of walking
an array of segments. Fields that belong together form a run, e.g. ``yyyy-MM-ddTHH:mm:ss``, and are replaced at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .columns import marker

YEAR, MONTH, DAY, HOUR, SHORT_HOUR, MINUTE, SECOND = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06", "\x07"
MONTH_NAME, WEEKDAY = "\x0e", "\x0f"
FRACTION = ["", "\x10", "\x11", "\x12", "\x13", "\x14", "\x15", "\x16", "\x17", "\x18"]
ZONE_OPEN, ZONE_CLOSE = "\x1a", "\x1b"
_CODES = r"[\x01-\x07\x0e-\x18]"
RUN = rf"(?:\x1a[^\x1b]*\x1b)?{_CODES}(?:[^\x01-\x1f]?{_CODES})*"
LOCAL = "L"


def _time_code(tok: Column, calendar: bool) -> Column:
    def lit(*codes: str) -> Column:
        return F.lit("".join(codes))

    clock = lit(HOUR, ":", MINUTE, ":", SECOND)
    short = F.when(tok["hour_width"] == 1, lit(SHORT_HOUR)).otherwise(lit(HOUR))
    short_clock = F.concat(short, lit(":", MINUTE, ":", SECOND))
    fraction = F.element_at(F.array(*[F.lit(f) for f in FRACTION]), tok["fraction_digits"] + 1)
    sep = tok["date_sep"]
    date = F.concat(lit(YEAR), sep, lit(MONTH), sep, lit(DAY))
    shapes = {
        ("ISO8601", "YEAR_FIRST"): F.concat(date, tok["time_sep"], short_clock, fraction, tok["zone"]),
        ("SYSLOG_YEAR",): F.concat(lit(MONTH_NAME, " ", DAY, " "), clock, lit(" ", YEAR)),
        ("SYSLOG",): F.concat(lit(MONTH_NAME, " ", DAY, " "), clock),
        ("MONTH_FIRST_GMT",): F.concat(lit(MONTH_NAME, " ", DAY, " ", YEAR, " "), clock, lit(" GMT")),
        ("APACHE",): F.concat(lit(DAY, "/", MONTH_NAME, "/", YEAR, ":"), clock, lit(" "), tok["zone"]),
        ("COMPACT",): lit(YEAR, MONTH, DAY, HOUR, MINUTE, SECOND),
        ("COMPACT_T",): F.concat(lit(YEAR, MONTH, DAY, "T", HOUR, MINUTE, SECOND), fraction, tok["zone"]),
        ("COMPACT_DATE",): lit(YEAR, MONTH, DAY),
        ("COMPACT_MONTH",): lit(YEAR, MONTH),
        ("COMPACT_TIME",): lit(HOUR, MINUTE, SECOND),
        ("YEAR_FIRST_MINUTE",): F.concat(date, tok["time_sep"], short, lit(":", MINUTE)),
        ("MONTH_DAY_YEAR",): F.concat(
            lit(MONTH_NAME, " ", DAY, " ", YEAR, " "),
            clock,
            F.when(tok["zone"] != "", F.concat(F.lit(" "), tok["zone"])).otherwise(""),
        ),
        ("DATE",): date,
        ("YEAR_MONTH",): F.concat(lit(YEAR), sep, lit(MONTH)),
        ("TIME",): F.concat(short_clock, fraction),
    }
    chain = None
    for styles, value in shapes.items():
        test = tok["style"].isin(list(styles))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    weekday = F.when(tok["has_weekday"], lit(WEEKDAY, " ")).otherwise("")
    if calendar:
        return F.concat(weekday, chain)
    zone = F.when(tok["zone"] != "", tok["zone_minutes"].cast("string")).otherwise(LOCAL)
    return F.concat(F.lit(ZONE_OPEN), zone, F.lit(ZONE_CLOSE), weekday, chain)


def program(segs: Column, source_ip: str, destination_ip: str, calendar: bool) -> Column:
    """Segments as a string: literals, endpoint addresses, ``{{KIND}}`` markers and time codes."""

    def code(s: Column) -> Column:
        return (
            F.when(s["kind"] == "literal", s["text"])
            .when(s["kind"] == "timestamp", _time_code(s["token"], calendar))
            .when(s["kind"] == "src_ip", F.lit(source_ip))
            .when(s["kind"] == "dst_ip", F.lit(destination_ip))
            .otherwise(F.concat(F.lit("{{"), s["text"], F.lit("}}")))
        )

    return F.array_join(F.transform(segs, code), "")


def runs_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def cut(program: Column, runs: list[str], slots: int) -> list[Column]:
    """The program as columns ``lit_0, run_1, lit_1, ..., run_slots, lit_slots``; a run is its number or -1."""
    literals = F.split(program, RUN, -1)
    numbers = F.transform(
        runs_in(program), lambda r: (F.array_position(F.array(*[F.lit(x) for x in runs]), r) - 1).cast("int")
    ) if runs else F.array().cast("array<int>")
    out = [F.get(literals, F.lit(0)).alias("lit_0")]
    for i in range(1, slots + 1):
        out.append(F.coalesce(F.get(numbers, F.lit(i - 1)), F.lit(-1)).alias(f"run_{i}"))
        out.append(F.coalesce(F.get(literals, F.lit(i)), F.lit("")).alias(f"lit_{i}"))
    return out


def zone_of(run: str) -> str:
    found = re.match(rf"{ZONE_OPEN}([^{ZONE_CLOSE}]*){ZONE_CLOSE}", run)
    return found.group(1) if found else ""


_LETTERS = {
    YEAR: "yyyy", MONTH: "MM", DAY: "dd", HOUR: "HH", SHORT_HOUR: "H", MINUTE: "mm", SECOND: "ss", MONTH_NAME: "MMM", WEEKDAY: "EEE",
}


def run_pattern(run: str) -> str:
    """The run as a formatter pattern; a constant, so the formatter is made once per task."""
    body = re.sub(rf"^{ZONE_OPEN}[^{ZONE_CLOSE}]*{ZONE_CLOSE}", "", run)
    out = ""
    for c in body:
        if c in _LETTERS:
            out += _LETTERS[c]
        elif c in FRACTION[1:]:
            out += "'.'" + "S" * FRACTION.index(c)
        else:
            out += "''" if c == "'" else f"'{c}'"
    return out


def with_values(text: Column) -> Column:
    """Markers replaced by the identity joined to the row (one column per token kind)."""
    out = text
    for kind in V.KINDS:
        out = F.replace(out, F.lit(marker(kind)), F.col(kind))
    return out

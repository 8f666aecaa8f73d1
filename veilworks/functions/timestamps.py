"""Timestamps in text: where they are, how they are written, and the same form at another instant.

The fifteen shapes are grouped into six families by how they begin. Shapes of one family that match at the
same place are alternatives from long to short, so one pass finds what the longest-match rule would keep.
Matches of different families are merged by the sweep (leftmost, then longest, then lowest priority).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .columns import NOT_AFTER_WORD, NOT_BEFORE_WORD, bind, fold_blocks, matches

# what may not come before is looked at after the first digits: most places fail on those
_YM = r"(?:19|20)(?<!\w\d\d)\d{2}[-/](?:0[1-9]|1[0-2])"
_DD = r"(?:0[1-9]|[12]\d|3[01])"
_HM = r"(?:[01]?\d|2[0-3]):[0-5]\d"
_ZONE = r"(?:Z|[+-]\d{2}:?\d{2})?"
_FRACTION = r"(?:\.\d{1,9})?"
_CLOCK = r"\d{2}:\d{2}:\d{2}"
_KEY_SEP = r"[\"']?\s*[:=]\s*[\"']?"

YEAR_FIRST = (
    _YM + r"(?:[-/]" + _DD + r"[T ]" + _HM + r":[0-5]\d" + _FRACTION + _ZONE
    + r"|[-/]" + _DD + r"[ T]" + _HM + r"(?!:)"
    + r"|[-/]" + _DD + NOT_BEFORE_WORD + r"|" + NOT_BEFORE_WORD + r")"
)
MONTH_NAME = (
    r"(?=[A-Z])" + NOT_AFTER_WORD + r"(?:[A-Z][a-z]{2}\s+)?[A-Z][a-z]{2}\s+\d{1,2}\s+(?:"
    + r"\d{4}\s+" + _CLOCK + r"(?:\s+(?:GMT|UTC))?" + NOT_BEFORE_WORD
    + r"|" + _CLOCK + r"\s+\d{4}" + NOT_BEFORE_WORD
    + r"|" + _CLOCK + NOT_BEFORE_WORD + r")"
)
COMPACT = (
    r"(?:19|20)(?<!\d\d\d)\d{2}(?:0[1-9]|1[0-2])(?:"
    + _DD + r"T\d{6}" + _FRACTION + _ZONE + r"(?![0-9])"
    + r"|" + _DD + r"\d{6}(?![0-9])|" + _DD + r"(?![0-9])|(?=_))"
)
APACHE = r"(?=\d)" + NOT_AFTER_WORD + r"\d{1,2}/[A-Z][a-z]{2}/\d{4}:" + _CLOCK + r"\s+[+-]\d{4}" + NOT_BEFORE_WORD
AFTER_KEY = (
    r"(?i)" + NOT_AFTER_WORD + r"(?:time" + _KEY_SEP + r"(?:\d{6}(?!\d)|" + _HM + r":[0-5]\d" + _FRACTION + r")"
    + r"|\w*hms" + _KEY_SEP + r"\d{6}(?!\d))"
)
AFTER_KEY_VALUE = r"(\d{6}|\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)$"
BACKTICK = r"(?:^|`)(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d" + _FRACTION + r"(?=`)"
MARKER = r"(?s)\{\{TIMESTAMP:[^:]*:.*?\}\}"
MARKER_HEAD = "{{TIMESTAMP:"

# no shape matches a text without one of these
ANY_TIME = r"\d:\d\d:\d\d|(?:19|20)\d\d[-/01]|\d{6}"

SPAN = "struct<pos:int,neg_len:int,priority:int,kind:string,style:string,raw:string>"
SPANS = f"array<{SPAN}>"


def _placed(between: Column, found: Column) -> Column:
    """``array<struct<pos, raw>>`` of matches, from the pieces between them."""
    steps = F.zip_with(F.transform(between, F.length), found, lambda g, m: F.struct(g.alias("gap"), m.alias("raw")))

    def step(acc: Column, s: Column) -> Column:
        pos = acc["at"] + s["gap"]
        here = F.array(F.struct(pos.alias("pos"), s["raw"].alias("raw")))
        return F.when(s["raw"].isNull(), acc).otherwise(
            F.struct((pos + F.length(s["raw"])).alias("at"), F.concat(acc["out"], here).alias("out"))
        )

    return fold_blocks(steps, "struct<pos:int,raw:string>", step)


def placed(text: Column, pattern: str) -> Column:
    """``array<struct<pos, raw>>``: matches of a pattern with their 0-based character position."""
    return _placed(F.split(text, pattern, -1), matches(text, pattern))


def _year_first_style(raw: Column) -> Column:
    return (
        F.when(F.length(raw) == 7, "YEAR_MONTH")
        .when(F.length(raw) == 10, "DATE")
        .when(raw.rlike(r"^.{11}\d{1,2}:\d{2}$"), "YEAR_FIRST_MINUTE")
        .otherwise("ISO8601")
    )


def _month_name_style(raw: Column) -> Column:
    return (
        F.when(raw.rlike(r":\d{2}\s+\d{4}$"), "SYSLOG_YEAR")
        .when(raw.rlike(r"\s\d{4}\s"), "MONTH_DAY_YEAR")
        .otherwise("SYSLOG")
    )


def _compact_style(raw: Column) -> Column:
    return (
        F.when(raw.contains("T"), "COMPACT_T")
        .when(F.length(raw) == 14, "COMPACT")
        .when(F.length(raw) == 8, "COMPACT_DATE")
        .otherwise("COMPACT_MONTH")
    )


def none() -> Column:
    return F.array().cast(SPANS)


# Each family: guard, pattern, priority. Shapes of one family never share a place, so one priority per family is
# enough; only a six-digit time after a key and a six-digit month can, and the month goes first.
def _families(text: Column) -> list[tuple[Column, str, int]]:
    return [
        (text.contains(MARKER_HEAD), MARKER, -100),
        (text.rlike(YEAR_FIRST), YEAR_FIRST, 0),
        (text.rlike(r"[A-Z][a-z][a-z]\s+\d") & text.rlike(MONTH_NAME), MONTH_NAME, 2),
        (text.contains("/") & text.rlike(APACHE), APACHE, 4),
        (text.rlike(COMPACT), COMPACT, 6),
        (text.rlike(r"(?i)(?:time|hms)[\"']?\s*[:=]") & text.rlike(AFTER_KEY), AFTER_KEY, 10),
        (text.contains("`") & text.rlike(BACKTICK), BACKTICK, 14),
    ]


def _as_span(family: Column, m: Column) -> Column:
    """The span of a match: a family may match a key or a delimiter in front of the timestamp."""
    raw = m["raw"]
    value = (
        F.when(family == 10, F.regexp_extract(raw, AFTER_KEY_VALUE, 1))
        .when(family == 14, F.ltrim(raw, F.lit("`")))
        .when(family == -100, F.regexp_extract(raw, r"(?s)^\{\{TIMESTAMP:[^:]*:(.*)\}\}$", 1))
        .otherwise(raw)
    )

    def build(v: Column) -> Column:
        style = (
            F.when(family == 0, _year_first_style(v))
            .when(family == 2, _month_name_style(v))
            .when(family == 4, F.lit("APACHE"))
            .when(family == 6, _compact_style(v))
            .when(family == -100, F.regexp_extract(raw, r"(?s)^\{\{TIMESTAMP:([^:]*):", 1))
            .otherwise(F.when(v.contains(":"), "TIME").otherwise("COMPACT_TIME"))
        )
        length = F.when(family == -100, F.length(raw)).otherwise(F.length(v))
        return F.struct(
            (m["pos"] + F.length(raw) - length).alias("pos"),
            (-length).alias("neg_len"),
            family.alias("priority"),
            F.lit("timestamp").alias("kind"),
            style.alias("style"),
            v.alias("raw"),
        )

    return bind(value, build)


def found(text: Column, families: list[tuple[Column, str, int]], to_span) -> Column:
    """Spans of several patterns. A text that fails a guard pays for that guard only."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    guard,
                    F.struct(
                        F.lit(rank).alias("family"),
                        F.split(text, pattern, -1).alias("between"),
                        matches(text, pattern).alias("found"),
                    ),
                )
                for guard, pattern, rank in families
            ]
        )
    )
    spans = F.transform(
        hits, lambda h: F.transform(_placed(h["between"], h["found"]), lambda m: to_span(h["family"], m)).cast(SPANS)
    )
    return F.flatten(spans)


def may_hold_time(text: Column) -> Column:
    return text.rlike(ANY_TIME) | text.contains(MARKER_HEAD)


def candidates(text: Column) -> Column:
    """Every timestamp candidate of a text, overlaps included."""
    every = F.filter(
        found(text, _families(text), _as_span), lambda s: (s["priority"] != -100) | s["style"].isin(list(V.STYLES))
    )
    return F.when(may_hold_time(text), every).otherwise(none())


def sweep(spans: Column) -> Column:
    """Left to right, keep a span that starts at or after the end of the last one kept."""
    return fold_blocks(
        F.array_sort(spans),
        SPAN,
        lambda acc, s: F.when(
            s["pos"] >= acc["at"],
            F.struct((s["pos"] - s["neg_len"]).alias("at"), F.concat(acc["out"], F.array(s)).cast(SPANS).alias("out")),
        ).otherwise(acc),
    )


def resolved(text: Column) -> Column:
    """Timestamps of a text without overlaps, in text order (NULL for a NULL text)."""
    return bind(text, lambda t: F.when(t.isNotNull(), sweep(candidates(t))))


def _gap_start(spans: Column, i: Column) -> Column:
    previous = F.get(spans, i - 1)
    return F.coalesce(previous["pos"] - previous["neg_len"], F.lit(0))


def splice(text: Column, spans: Column, rewrite) -> Column:
    """Replace each span by ``rewrite(span)``; spans are ordered and disjoint."""
    last = F.get(spans, F.size(spans) - 1)
    body = F.transform(
        spans,
        lambda s, i: F.concat(
            F.substr(text, _gap_start(spans, i) + 1, s["pos"] - _gap_start(spans, i)), rewrite(s)
        ),
    )
    tail = F.substr(text, F.coalesce(last["pos"] - last["neg_len"], F.lit(0)) + 1)
    return F.concat(F.array_join(body, ""), tail)


def mark(text: Column) -> Column:
    """Wrap every timestamp as ``{{TIMESTAMP:STYLE:raw}}``; existing markers stay as they are."""

    def wrapped(s: Column) -> Column:
        return F.concat(F.lit(MARKER_HEAD), s["style"], F.lit(":"), s["raw"], F.lit("}}"))

    def marked(t: Column) -> Column:
        return bind(
            sweep(candidates(t)), lambda spans: F.when(F.size(spans) == 0, t).otherwise(splice(t, spans, wrapped))
        )

    return bind(text, lambda t: F.when(may_hold_time(t), marked(t)).otherwise(t))


# ----------------------------------------------------------------------------------------------------
# format features


def _fraction_digits(raw: Column) -> Column:
    return F.least(F.length(F.regexp_extract(raw, r"\.(\d*)", 1)), F.lit(9))


def _offset_minutes(zone: Column) -> Column:
    minutes = F.when(F.length(zone) == 6, F.substring(zone, 5, 2)).otherwise(F.substring(zone, 4, 2))
    total = F.substring(zone, 2, 2).try_cast("int") * 60 + minutes.try_cast("int")
    signed = F.when(zone.startswith("-"), -total).otherwise(total)
    return F.when(zone.rlike("^[+-]") & (F.length(zone) >= 5), F.coalesce(signed, F.lit(0))).otherwise(0)


def token(style: Column, raw: Column) -> Column:
    """How a timestamp is written: separators, fraction, hour width, zone, weekday."""

    def at(i: int) -> Column:
        return F.substring(raw, i + 1, 1)

    dated = style.isin("ISO8601", "DATE", "YEAR_MONTH", "YEAR_FIRST_MINUTE")
    clocked = style.isin("ISO8601", "YEAR_FIRST_MINUTE")
    zone = (
        F.when(style == "ISO8601", F.regexp_extract(F.substr(raw, F.lit(12)), r"[Z+-].*$", 0))
        .when(style == "COMPACT_T", F.regexp_extract(F.substr(raw, F.lit(16)), r"[Z+-].*$", 0))
        .when(style == "APACHE", F.regexp_extract(raw, r"[+-][^+-]*$", 0))
        .when(style == "MONTH_FIRST_GMT", F.lit("GMT"))
        .when(style == "MONTH_DAY_YEAR", F.regexp_extract(raw, r" (GMT|UTC)$", 1))
        .otherwise("")
    )
    fraction = (
        F.when(style == "ISO8601", _fraction_digits(F.substr(raw, F.lit(12))))
        .when(style.isin("COMPACT_T", "TIME"), _fraction_digits(raw))
        .otherwise(0)
    )
    hour_width = (
        F.when(clocked & (at(12) == ":"), 1).when((style == "TIME") & (at(1) == ":"), 1).otherwise(2)
    )
    return bind(
        zone,
        lambda z: F.struct(
            style.alias("style"),
            F.when(dated & (F.length(raw) > 4), at(4)).otherwise("-").alias("date_sep"),
            F.when(clocked & (F.length(raw) > 10), at(10))
            .when(style == "YEAR_FIRST_MINUTE", " ")
            .otherwise("T")
            .alias("time_sep"),
            fraction.cast("int").alias("fraction_digits"),
            hour_width.cast("int").alias("hour_width"),
            _offset_minutes(z).cast("int").alias("zone_minutes"),
            ((F.length(raw) > 4) & (at(3) == " ") & F.substring(raw, 1, 3).isin(V.WEEKDAYS)).alias("has_weekday"),
            z.alias("zone"),
        ),
    )


TOKEN = (
    "struct<style:string,date_sep:string,time_sep:string,fraction_digits:int,hour_width:int,"
    "zone_minutes:int,has_weekday:boolean,zone:string>"
)


# ----------------------------------------------------------------------------------------------------
# printing


def wall_clock(tok: Column, instant: Column, calendar: bool, local_tz: str) -> Column:
    """Wall clock to print: UTC in calendar mode, else the written zone, else the local zone."""
    if calendar:
        return instant
    return F.when(
        tok["zone"] != "", instant + F.make_dt_interval(mins=tok["zone_minutes"])
    ).otherwise(F.from_utc_timestamp(instant, local_tz))


def printed(tok: Column, instant: Column, calendar: bool = False, local_tz: str = "UTC") -> Column:
    """The instant written the way the token was written. Needs a UTC session zone."""
    # one formatting call; every style is cut out of its digits
    digits = bind(
        wall_clock(tok, instant, calendar, local_tz), lambda t: F.date_format(t, "yyyyMMddHHmmssSSSSSSMMMEEE")
    )

    def body(d: Column) -> Column:
        year, month, day = F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)
        hour, minute, second = F.substring(d, 9, 2), F.substring(d, 11, 2), F.substring(d, 13, 2)
        name, weekday = F.substring(d, 21, 3), F.substring(d, 24, 3)
        short_hour = F.when((tok["hour_width"] == 1) & hour.startswith("0"), F.substring(hour, 2, 1)).otherwise(hour)
        date = F.concat(year, tok["date_sep"], month, tok["date_sep"], day)
        clock = F.concat(hour, F.lit(":"), minute, F.lit(":"), second)
        fraction = F.when(
            tok["fraction_digits"] > 0,
            F.concat(F.lit("."), F.substr(F.concat(F.substring(d, 15, 6), F.lit("000")), F.lit(1), tok["fraction_digits"])),
        ).otherwise("")
        shapes = {
            ("ISO8601", "YEAR_FIRST"): F.concat(
                date, tok["time_sep"], short_hour, F.lit(":"), minute, F.lit(":"), second, fraction, tok["zone"]
            ),
            ("SYSLOG_YEAR",): F.concat_ws(" ", name, day, clock, year),
            ("SYSLOG",): F.concat_ws(" ", name, day, clock),
            ("MONTH_FIRST_GMT",): F.concat_ws(" ", name, day, year, clock, F.lit("GMT")),
            ("APACHE",): F.concat(day, F.lit("/"), name, F.lit("/"), year, F.lit(":"), clock, F.lit(" "), tok["zone"]),
            ("COMPACT",): F.substring(d, 1, 14),
            ("COMPACT_T",): F.concat(
                F.substring(d, 1, 8), F.lit("T"), F.substring(d, 9, 6), fraction, tok["zone"]
            ),
            ("COMPACT_DATE",): F.substring(d, 1, 8),
            ("COMPACT_MONTH",): F.substring(d, 1, 6),
            ("COMPACT_TIME",): F.substring(d, 9, 6),
            ("YEAR_FIRST_MINUTE",): F.concat(date, tok["time_sep"], short_hour, F.lit(":"), minute),
            ("MONTH_DAY_YEAR",): F.concat(
                F.concat_ws(" ", name, day, year, clock),
                F.when(tok["zone"] != "", F.concat(F.lit(" "), tok["zone"])).otherwise(""),
            ),
            ("DATE",): date,
            ("YEAR_MONTH",): F.concat(year, tok["date_sep"], month),
            ("TIME",): F.concat(short_hour, F.lit(":"), minute, F.lit(":"), second, fraction),
        }
        chain = None
        for styles, value in shapes.items():
            test = tok["style"].isin(list(styles))
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return F.concat(F.when(tok["has_weekday"], F.concat(weekday, F.lit(" "))).otherwise(""), chain)

    return bind(digits, body)


def rebased(text: Column, instant: Column, calendar: bool = False, local_tz: str = "UTC") -> Column:
    """Re-emit every timestamp of the text at ``instant`` in its own format."""

    def moved(t: Column) -> Column:
        return bind(
            sweep(candidates(t)),
            lambda spans: splice(
                t,
                spans,
                lambda s: bind(token(s["style"], s["raw"]), lambda tok: printed(tok, instant, calendar, local_tz)),
            ),
        )

    return bind(text, lambda t: F.when(may_hold_time(t), moved(t)).otherwise(t))

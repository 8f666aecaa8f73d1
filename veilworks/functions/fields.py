"""``key=value``, ``key: value`` and JSON-like pairs inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import SPACE, bind, matches, rewrite_matches
from .field_kinds import FieldRule, kind_of, normalize

# A pair starts the text or follows white space , ; | {. Its name has at most 64 characters. A quoted value
# runs to the same quote or the end; a bare one to white space , ; | } ]. Scanning goes on at the value's end.
_NAME = r"[A-Za-z_][\w.\-]*+(?<![\w.\-]{65})"
_KEY = r"([\"']?+(" + _NAME + r")[\"']?+[ \t]*+[:=] *+)"
_BARE = r"(?![\"'])[^" + SPACE + r",;|}\]]++"
_VALUE = r"(?:(" + _BARE + r")|(\")([^\"]*+)|(')([^']*+))?"
PAIR = r"(?:(?<=[" + SPACE + r",;|{])|^)" + _KEY + _VALUE
# The same for rewriting, where the character in front may be part of the match: it is cheaper to step over it
# than to look behind everywhere. Right after another match it has been stepped over already.
_REWRITE = r"(\G(?<=[" + SPACE + r",;|{])|^|[" + SPACE + r",;|{])" + _KEY + _VALUE


def pair_pattern(nested: bool = False, rewrite: bool = False) -> str:
    """Values that start with a brace are not values when nested pairs are wanted."""
    pattern = _REWRITE if rewrite else PAIR
    return pattern.replace(r"(?![\"'])", r"(?![\"'{])") if nested else pattern


# Separators that stand around the parts of a pair while a text is rewritten: code points Unicode reserves for
# such internal use. A text that holds them anyway takes the slower way without separators.
_OPEN, _PART = "\ufdd0", "\ufdd1"
_PARTS = f"$1{_OPEN}$3{_PART}$2$5$7{_PART}$4$6$8{_PART}"
_HEAD = r"^[\"']?[A-Za-z_][A-Za-z0-9_.\-]*[\"']?[ \t]*[:=] *[\"']?"
_FIELD = r"^[\"']?([A-Za-z_][A-Za-z0-9_.\-]*)"


def may_hold_pair(text: Column) -> Column:
    """A byte search that rules out most prose before the pattern is tried."""
    return text.contains("=") | text.contains(":")


def _holds_separator(text: Column) -> Column:
    return text.contains(_OPEN) | text.contains(_PART)


def pairs(text: Column, nested: bool = False) -> Column:
    """``array<struct<head, field, value>>`` in text order; head + value is the matched text."""

    def parts(pair: Column) -> Column:
        head = F.regexp_extract(pair, _HEAD, 0)
        return F.struct(
            head.alias("head"),
            F.regexp_extract(pair, _FIELD, 1).alias("field"),
            F.substr(pair, F.length(head) + 1).alias("value"),
        )

    return F.transform(matches(text, pair_pattern(nested)), parts)


def sensitive_value(value: Column) -> Column:
    """Empty values and values that already hold a marker are left alone."""
    return (value != "") & ~value.contains("{{") & ~value.contains("}}")


def _kind(field: Column, value: Column, rules: list[FieldRule] | None) -> Column:
    return bind(F.when(sensitive_value(value), normalize(field)), lambda n: kind_of(n, rules))


def _masked(value: Column, kind: Column) -> Column:
    return bind(kind, lambda k: F.when(k.isNull(), value).otherwise(F.concat(F.lit("{{"), k, F.lit("}}"))))


def mask_fields(text: Column, rules: list[FieldRule] | None = None, nested: bool = False) -> Column:
    """Replace the value of every classified field by its ``{{KIND}}`` marker."""

    def masked_piece(piece: Column, i: Column) -> Column:
        # the first piece is plain; each further one is name, head, value and the text after it
        return F.when(i == 0, piece).otherwise(
            bind(
                F.split(piece, _PART, -1),
                lambda p: F.concat(
                    F.get(p, F.lit(1)), _masked(F.get(p, F.lit(2)), _kind(F.get(p, F.lit(0)), F.get(p, F.lit(2)), rules)),
                    F.get(p, F.lit(3)),
                ),
            )
        )

    def by_piece(t: Column) -> Column:
        return bind(
            F.split(F.regexp_replace(t, pair_pattern(nested, rewrite=True), _PARTS), _OPEN, -1),
            lambda pieces: F.when(F.size(pieces) == 1, t).otherwise(F.array_join(F.transform(pieces, masked_piece), "")),
        )

    def by_match(t: Column) -> Column:
        def new(pair: Column) -> Column:
            head = F.regexp_extract(pair, _HEAD, 0)
            value = F.substr(pair, F.length(head) + 1)
            return F.concat(head, _masked(value, _kind(F.regexp_extract(pair, _FIELD, 1), value, rules)))

        return rewrite_matches(t, pair_pattern(nested), lambda found: F.transform(found, new))

    return bind(
        text,
        lambda t: F.when(~may_hold_pair(t), t).when(_holds_separator(t), by_match(t)).otherwise(by_piece(t)),
    )

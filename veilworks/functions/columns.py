"""Small column builders shared by the jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII word class and boundary. Java's \b also counts non-ASCII letters as word characters, so a number
# directly after a Hangul syllable would not start at a boundary; these forms do not have that problem.
WORD = r"\w"  # ASCII letters, digits and _; one table look-up, unlike a union of ranges
# White space, to be used inside character classes: single characters make a bit set, \s would not.
SPACE = r" \t\n\x0B\f\r"
NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let x = value in body(x)``: value is computed once although body mentions it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_when(text: Column, guard: Callable[[Column], Column], pattern: str, replacement: str) -> Column:
    """Regex rewrite that only runs the expensive pattern on rows passing a cheap test."""
    return bind(
        text, lambda t: F.when(guard(t), F.regexp_replace(t, pattern, replacement)).otherwise(t)
    )


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def rewrite_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match of pattern by ``rewrite(match)``; the text between matches is kept."""
    between = F.split(text, pattern, -1)
    return F.array_join(
        F.zip_with(
            between,
            rewrite(matches(text, pattern)),
            lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))),
        ),
        "",
    )


def marker(name: str) -> str:
    return "{{" + name + "}}"


def count_of(text: Column, literal: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, literal, F.lit("")))) / F.length(literal)).cast("int")


def int_div(value: Column, by: int) -> Column:
    """Exact integer quotient (``/`` goes through doubles, which end at 2**53)."""
    return F.call_function("div", value, F.lit(by))


def any_of(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


BLOCK = 256


def fold_blocks(items: Column, kind: str, step) -> Column:
    """Go over an array with a position ``at`` (from 0) and a growing ``out`` (an array of ``kind``); the result is ``out``.

    ``step(acc, item)`` returns the next ``struct<at, out>``. Growing an array copies it, so the items are taken in blocks
    whose results are joined at the end: the cost is linear in the items.
    """
    empty, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def over(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), int_div(F.size(all_) - 1, BLOCK).cast("int"))), lambda b: F.slice(all_, b * BLOCK + 1, BLOCK))

        def block(acc: Column, part: Column) -> Column:
            own = F.struct(acc["at"].alias("at"), empty.alias("out"))
            return F.aggregate(part, own, step, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nested.alias("out")), block, lambda acc: F.flatten(acc["out"]))

    return bind(items, over)

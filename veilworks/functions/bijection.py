"""One-to-one pseudonyms: keyed bijections, so that a join on pseudonyms is a join on the originals.

Both are Feistel networks, whose rounds can be run backwards whatever the round function is: no two values share a pseudonym,
no table of values is needed, and tables are translated independently of each other. They hide values from readers of the data, as
pseudonyms do; whoever has the key can restore them.
"""

from __future__ import annotations

import functools
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
HALF = 0xFFFFFFFF
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABET = {c: (letters, i) for letters in (DIGITS, LOWER, UPPER) for i, c in enumerate(letters)}


def _round_keys(key: str) -> list[int]:
    """Numbers for the rounds, made of the key by a keyed hash."""
    return [int.from_bytes(hmac.new(key.encode(), bytes([r]), hashlib.sha256).digest()[:8], "big", signed=True) for r in range(ROUNDS)]


def number_pseudonym(value: Column, key: str) -> Column:
    """A permutation of all 64-bit integers, in the JVM; null stays null."""
    halves = F.struct(F.shiftrightunsigned(value.cast("long"), 32).alias("a"), value.cast("long").bitwiseAND(F.lit(HALF)).alias("b"))
    turn = lambda s, k: F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(F.xxhash64(k, s["b"]).bitwiseAND(F.lit(HALF))).alias("b"))
    done = F.aggregate(F.array(*[F.lit(k).cast("long") for k in _round_keys(key)]), halves, turn, lambda s: F.shiftleft(s["a"], 32).bitwiseOR(s["b"]))
    return F.when(value.isNotNull(), done)


def number_original(value: Column, key: str) -> Column:
    """The number that has this pseudonym."""
    halves = F.struct(F.shiftrightunsigned(value.cast("long"), 32).alias("a"), value.cast("long").bitwiseAND(F.lit(HALF)).alias("b"))
    turn = lambda s, k: F.struct(s["b"].bitwiseXOR(F.xxhash64(k, s["a"]).bitwiseAND(F.lit(HALF))).alias("a"), s["a"].alias("b"))
    done = F.aggregate(F.array(*[F.lit(k).cast("long") for k in reversed(_round_keys(key))]), halves, turn, lambda s: F.shiftleft(s["a"], 32).bitwiseOR(s["b"]))
    return F.when(value.isNotNull(), done)


def _stream(key: bytes, turn: int, shape: str, other: str, n: int) -> list[int]:
    """n numbers that depend on the key, the round, the text's shape and the half that stays."""
    out = b""
    while len(out) < 4 * n:
        out += hmac.new(key, f"{turn}|{len(out)}|{shape}|{other}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
    return [int.from_bytes(out[4 * i : 4 * i + 4], "big") for i in range(n)]


def shifted(text: str, key: bytes, back: bool = False) -> str:
    """Digits stay digits, letters stay letters of their case, everything else stays: a bijection of the texts of one shape.

    In turn, each half of the letters and digits is moved along its alphabets by amounts that the other half decides.
    """
    at = [i for i, c in enumerate(text) if c in ALPHABET]
    chars = list(text)
    shape = "".join(ALPHABET[c][0][0] if c in ALPHABET else c for c in text)
    halves = at[: len(at) // 2], at[len(at) // 2 :]
    for turn in range(ROUNDS)[:: -1 if back else 1]:
        moved, stays = halves[turn % 2], halves[1 - turn % 2]
        steps = _stream(key, turn, shape, "".join(chars[i] for i in stays), len(moved))
        for i, s in zip(moved, steps):
            letters, n = ALPHABET[chars[i]]
            chars[i] = letters[(n - s if back else n + s) % len(letters)]
    return "".join(chars)


def _text_function(key: str, back: bool):
    secret = hashlib.sha256(key.encode()).digest()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        one = functools.lru_cache(maxsize=100_000)(lambda t: shifted(t, secret, back))  # of this batch
        return texts.map(lambda t: None if t is None else one(t))

    return run


def text_pseudonym(value: Column, key: str) -> Column:
    """Format-preserving: ``Customer#000000017`` becomes another name of the same shape; null and texts without letters or digits stay."""
    return _text_function(key, False)(value)


def text_original(value: Column, key: str) -> Column:
    return _text_function(key, True)(value)

"""The text rewrites as SQL for another engine (RE2: ASCII word boundaries, no look-around).

The character in front of a pair is consumed instead of looked behind at. Only used for result checks.
"""

from __future__ import annotations

from ..functions import fixed as V
from ..functions.field_kinds import kind_sql

NAME = r"[A-Za-z_][A-Za-z0-9_.\-]{0,63}"
PAIR = (
    r"(?:^|[\s\x0b,;|{])[" + "\"''" + r"]?" + NAME + r"[" + "\"''" + r"]?[ \t]*[:=] *"
    r'(?:"[^"]*|' + "''[^'']*|" + r"[^" + "\"''" + r"\s\x0b,;|}\]][^\s\x0b,;|}\]]*)?"
)
HEAD = r"^[\s\x0b,;|{]?[" + "\"''" + r"]?" + NAME + r"[" + "\"''" + r"]?[ \t]*[:=] *[" + "\"''" + r"]?"
FIELD = r"^[\s\x0b,;|{]?[" + "\"''" + r"]?(" + NAME + ")"


def field_of(m: str) -> str:
    return f"regexp_extract({m}, '{FIELD}', 1)"


def head_of(m: str) -> str:
    return f"regexp_extract({m}, '{HEAD}', 0)"


def value_of(m: str) -> str:
    return f"substr({m}, length({head_of(m)}) + 1)"


def kind_of_field(field: str) -> str:
    return kind_sql(f"lower(translate({field}, '-.', '__'))")


def mask_fields(text: str) -> str:
    kind = kind_of_field(field_of("m"))
    value = value_of("m")
    new = (
        f"CASE WHEN {value} = '' OR contains({value}, '{{{{') OR contains({value}, '}}}}') OR ({kind}) IS NULL "
        f"THEN m ELSE {head_of('m')} || '{{{{' || ({kind}) || '}}}}' END"
    )
    found = f"list_transform(regexp_extract_all({text}, '{PAIR}', 0), lambda m: {new})"
    gaps = f"string_split_regex({text}, '{PAIR}')"
    return f"array_to_string(list_transform(list_zip({gaps}, {found}), lambda z: z[1] || coalesce(z[2], '')), '')"


def sanitized(table: str, key: str, text: str) -> str:
    """A query yielding ``(key, t)`` with the fully rewritten text."""
    email = r"\b[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"
    phone = r"(?:\+82[- ]?0?1[016789]|\b01[016789])[- ]?\d{3,4}[- ]?\d{4}\b"
    resident = r"\b\d{6}[- ]?[1-8]\d{6}\b"
    mac = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
    home = r"(?i)(\b[a-z]:\\Users\\)[^\\\s]+"
    store = r"(?i)(\b(?:" + "|".join(V.STORE_CODE_WORDS) + r")\s*[:=]\s*[" + "\"''" + r"]?)\{\{STORE\}\}"
    partial = r"(^|[^0-9A-Za-z_])(?:[0-9A-Fa-f]{2}:)+[" + "\"''" + r"]?\{\{MAC_ADDRESS\}\}"
    chain = "t1"
    for pattern, new in [
        (email, "{{EMAIL}}"), (phone, "{{PHONE}}"), (resident, "{{IDENTIFIER}}"), (mac, "{{MAC_ADDRESS}}"), (home, r"\1TestUser"),
    ]:
        chain = f"regexp_replace({chain}, '{pattern}', '{new}', 'g')"
    short = {7: r"\a", 8: r"\b", 11: r"\v", 12: r"\f"}
    for code in [c for c in range(1, 32) if c not in (9, 10, 13)]:
        chain = f"replace({chain}, chr({code}), '{short.get(code, f'{chr(92)}x{code:02X}')}')"
    before = f"regexp_replace(regexp_replace({text}, '{store}', '\\1{{{{STORE_CODE}}}}', 'g'), '{partial}', '\\1{{{{MAC_ADDRESS}}}}', 'g')"
    return (
        f"SELECT {key}, {chain} AS t FROM (SELECT {key}, {mask_fields('t0')} AS t1 FROM "
        f"(SELECT {key}, {before} AS t0 FROM {table}))"
    )

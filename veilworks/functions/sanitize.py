"""The ordered text rewrites: personal data to typed markers, connection addresses to endpoint markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .columns import NOT_AFTER_WORD, SPACE, any_of, bind, replace_when
from .field_kinds import FieldRule
from .fields import mask_fields

EMAIL, PHONE, RESIDENT, MAC, USER_DIR = V.EMAIL_VALUE, V.PHONE_VALUE, V.RESIDENT_VALUE, V.MAC_VALUE, V.USER_DIR_VALUE
CODE_FIELD_STORE = (
    r"(?i)(" + NOT_AFTER_WORD + r"(?:" + any_of(V.STORE_CODE_WORDS) + r")\s*[:=]\s*[\"']?)\{\{STORE\}\}"
)
PARTIAL_MAC = r"(^|[^0-9A-Za-z_])(?:[0-9A-Fa-f]{2}:)+[\"']?\{\{MAC_ADDRESS\}\}"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
IP = V.IP_VALUE


def _endpoint_field(names: list[str]) -> str:
    return r"(?i)((?:^|[" + SPACE + r",;|{])[\"']?(?:" + any_of(names) + r")[\"']?\s*[:=]\s*[\"']?)" + IP


SOURCE_FIELD = _endpoint_field(V.SOURCE_FIELDS)
DESTINATION_FIELD = _endpoint_field(V.DESTINATION_FIELDS)
ARROW_SOURCE = NOT_AFTER_WORD + IP + r"(?=:\d{1,5}\s*(?:-|=)>)"
ARROW_DESTINATION = r"((?:-|=)>\s*)" + IP


def _escape_controls(text: Column) -> Column:
    short = {0x07: r"\a", 0x08: r"\b", 0x0B: r"\v", 0x0C: r"\f"}

    def escaped(t: Column) -> Column:
        out = t
        for code in [c for c in range(0x20) if c not in (0x09, 0x0A, 0x0D)]:
            out = F.replace(out, F.lit(chr(code)), F.lit(short.get(code, f"\\x{code:02X}")))
        return out

    return bind(text, lambda t: F.when(t.rlike(CONTROLS), escaped(t)).otherwise(t))


def sanitize(
    text: Column,
    company_literals: list[tuple[str, str]] | None = None,
    rules: list[FieldRule] | None = None,
    nested: bool = False,
) -> Column:
    """All rewrites in their fixed order. Idempotent; connection addresses are left for ``mask_endpoints``."""
    out = text
    for needle, replacement in company_literals or []:
        out = F.regexp_replace(out, f"(?i){needle}", replacement)
    out = replace_when(out, lambda t: t.contains("{{"), CODE_FIELD_STORE, "$1{{STORE_CODE}}")
    out = replace_when(out, lambda t: t.contains("{{MAC_ADDRESS}}"), PARTIAL_MAC, "$1{{MAC_ADDRESS}}")
    out = mask_fields(out, rules, nested)
    out = replace_when(out, lambda t: t.contains("@"), EMAIL, "{{EMAIL}}")
    out = replace_when(out, lambda t: t.contains("01") | t.contains("+82"), PHONE, "{{PHONE}}")
    out = replace_when(out, lambda t: t.rlike(r"\d{6}"), RESIDENT, "{{IDENTIFIER}}")
    out = replace_when(out, lambda t: t.rlike(r"[0-9A-Fa-f][:-][0-9A-Fa-f]{2}[:-]"), MAC, "{{MAC_ADDRESS}}")
    out = replace_when(out, lambda t: t.contains(":\\"), USER_DIR, "$1TestUser")
    return _escape_controls(out)


def mask_endpoints(text: Column) -> Column:
    """Source and destination addresses of a connection become ``{{SRC_IP}}`` / ``{{DST_IP}}``."""

    def masked(t: Column) -> Column:
        out = F.regexp_replace(t, SOURCE_FIELD, "$1{{SRC_IP}}")
        out = F.regexp_replace(out, DESTINATION_FIELD, "$1{{DST_IP}}")
        out = F.regexp_replace(out, ARROW_SOURCE, "{{SRC_IP}}")
        return F.regexp_replace(out, ARROW_DESTINATION, "$1{{DST_IP}}")

    return bind(text, lambda t: F.when(t.rlike(r"\d\.\d{1,3}\.\d{1,3}\.\d"), masked(t)).otherwise(t))

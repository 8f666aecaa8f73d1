"""SQL with the same result as each query, for another engine on the same tables.

Where a query works on derived lines, the SQL states what the line must become instead of rewriting it.
"""

from __future__ import annotations

from ..functions import fixed as V
from . import lines as L
from . import sanitize_sql as S

_KINDS = "(" + " UNION ALL ".join(
    f"SELECT {i + 1} AS ordinal, {1 << i} AS bit, '{k}' AS kind, '{V.SEARCH_TERMS[k]}' AS terms" for i, k in enumerate(V.KINDS)
) + ")"
_TOKEN = r"\{\{(?:" + "|".join(V.KINDS) + r")\}\}"
_DOC_TOKENS = (
    f"(SELECT doc_id, source, substr(m, 3, length(m) - 4) AS kind FROM (SELECT doc_id, source, "
    f"unnest(regexp_extract_all(t, '{_TOKEN}', 0)) AS m FROM ({S.sanitized('documents', 'doc_id, source', 'text')})))"
)


def _sanitize(table: str, key: str, text: str, out: str) -> str:
    return f"SELECT {key}, t AS {out} FROM ({S.sanitized(table, key, text)})"


_TEXTS = (
    "(SELECT 'd' || doc_id AS row_id, text FROM documents UNION ALL "
    "SELECT 'c' || conv_id || '-' || turn AS row_id, text FROM conversations)"
)
_FIELD_TEXTS = (
    "(SELECT 'p' || page_id AS row_id, html AS text FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents "
    "UNION ALL SELECT 'e' || event_id, props FROM events)"
)
_OPEN_QUOTE = "[:=] *[\"'']$"


def _fields(texts: str) -> str:
    return (
        f"SELECT row_id, field_no, {S.field_of('m')} AS field, {S.value_of('m')} AS value, "
        f"regexp_matches({S.head_of('m')}, '{_OPEN_QUOTE}') AS quoted FROM (SELECT row_id, "
        f"CAST(unnest(range(len(ms))) AS BIGINT) AS field_no, unnest(ms) AS m FROM "
        f"(SELECT row_id, regexp_extract_all(text, '{S.PAIR}', 0) AS ms FROM {texts}))"
    )


_LINE_FIELDS = "(" + " UNION ALL ".join(
    [f"SELECT '{f}' AS field, n AS occurrences FROM (SELECT count(*) AS n FROM customer)" for f in ("customer_name", "store_cd", "emp_no", "path", "C")]
    + [f"SELECT '{f}' AS field, n AS occurrences FROM (SELECT count(*) AS n FROM events)" for f in ("stime", "user_id", "src_ip", "dst_ip", "remote_ip", "type")]
    # a hardware address that starts with a letter reads like a field
    + ["SELECT m AS field, count(*) AS occurrences FROM (SELECT lpad(lower(to_hex(c_custkey % 256)), 2, '0') AS m FROM customer) WHERE m >= 'a' GROUP BY m"]
) + ")"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IPV4 = rf"(Chrome/|^|[^0-9])(?:{_OCTET}\.){{3}}{_OCTET}(?:[^0-9]|$)"
_STALE = (
    r"\b(?:201[89]|202[0-6])[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12][0-9]|3[01])\b"
    r"|(?:^|[^0-9])(?:201[89]|202[0-6])(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)"
    r"|(?:^|[^0-9])(?:201[89]|202[0-6])(?:0[1-9]|1[0-2])_"
)


def _audit(by: str, text: str, table: str, extra: str = "") -> str:
    codes = "|".join(V.STORE_CODE_WORDS)
    return (
        f"SELECT {by}, count(*) AS n_rows, "
        f"count(*) FILTER (len(list_filter(regexp_extract_all({text}, '{_IPV4}', 1), lambda g: g <> 'Chrome/')) > 0) AS residual_ipv4, "
        f"count(*) FILTER (regexp_matches({text}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) AS control_chars, "
        f"count(*) FILTER (contains({text}, chr(10)) OR contains({text}, chr(13))) AS line_breaks, "
        f"count(*) FILTER (contains({text}, '{{{{')) AS leaked_marker, "
        f"count(*) FILTER (regexp_matches({text}, '{_STALE}')) AS stale_date, "
        f"count(*) FILTER (regexp_matches({text}, '(?i)\\b(?:{codes})\\s*[:=]\\s*[\"'']?\\{{\\{{STORE\\}}\\}}')) AS store_in_code_field, "
        f"count(*) FILTER (contains({text}, 'C:/ProgramData/Your-Company/SecurityData/event-')) AS synthetic_path{extra} "
        f"FROM {table} GROUP BY {by}"
    )


def _people(n: str) -> str:
    return ", ".join(f"{e} AS {k.lower()}" for k, e in L.profile_sql(n).items())


def _contact_with(n: str) -> str:
    p = L.profile_sql(n)
    return L.contact_sql(
        p["PERSON"], p["PHONE"], p["EMAIL"], p["MAC_ADDRESS"], p["IDENTIFIER"], p["STORE"], p["EMPLOYEE_ID"], p["FILE_PATH"], "'TestUser'"
    )


# features of the sixteen printed stamps: date_sep, time_sep, fraction_digits, hour_width, zone_minutes, has_weekday, zone
_FEATURES = {
    "ISO8601": ("-", "T", 0, 0, False, "Z"),
    "SYSLOG_YEAR": ("-", "T", 0, 0, True, ""),
    "MONTH_FIRST_GMT": ("-", "T", 0, 0, False, "GMT"),
    "APACHE": ("-", "T", 0, 540, False, "+0900"),
    "COMPACT_T": ("-", "T", 3, 540, False, "+0900"),
    "YEAR_FIRST_MINUTE": ("-", " ", 0, 0, False, ""),
    "MONTH_DAY_YEAR": ("-", "T", 0, 0, False, "UTC"),
    "DATE": ("/", "T", 0, 0, False, ""),
}


def _feature(i: int) -> str:
    out = []
    for name, *_ in L.STAMPS:
        v = _FEATURES.get(name, ("-", "T", 0, 0, False, ""))[i]
        out.append(f"'{v}'" if isinstance(v, str) else str(v).upper())
    return L.case_k(out)


def _marked() -> str:
    out = []
    for name, before, _, fmt, after in L.STAMPS:
        stamp = f"strftime(t, '{fmt}')"
        out.append(
            f"'{before}' || {stamp} || '{after}'" if "{{" in before else f"'{before}{{{{TIMESTAMP:{name}:' || {stamp} || '}}}}{after}'"
        )
    return L.case_k(out)


def _moved(when: str, zoned: bool = False) -> str:
    """The line printed at another instant. Marker-only styles lose their marker."""
    out = []
    for name, before, _, fmt, after in L.STAMPS:
        at = when
        if zoned:
            zone = {"APACHE": 540, "COMPACT_T": 540, "ISO8601": 0, "MONTH_FIRST_GMT": 0, "MONTH_DAY_YEAR": 0}.get(name, 540)
            at = f"({when} + INTERVAL {zone} MINUTE)"
        if name == "YEAR_FIRST":
            fmt, before, after = "%Y-%m-%dT%H:%M:%S", "at ", " end"
        elif name == "MONTH_FIRST_GMT":
            before, after = "at ", " end"
        out.append(f"'{before}' || strftime({at}, '{fmt}') || '{after}'")
    return L.case_k(out)


_SPAN = (
    "SELECT row_id, source, k, CAST(" + L.case_k([str(3 if "{{" in s[1] else len(s[1])) for s in L.STAMPS]) + " AS BIGINT) AS pos, "
    "CAST(length(raw) + " + L.case_k([str(len("{{TIMESTAMP::}}") + len(s[0])) if "{{" in s[1] else "0" for s in L.STAMPS])
    + f" AS BIGINT) AS len, {L.STYLE_NAME} AS style, raw FROM (SELECT row_id, source, k, {L.stamp_sql(full=False)} AS raw FROM {L.ORDERS})"
)
_DISPLAY = "CASE style " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.STYLES.items()) + " END"

# --- catalog ----------------------------------------------------------------------------------------
_VALIDATE = """
WITH c AS (
  SELECT CASE WHEN c_custkey % 11 = 0 THEN 'x' || c_custkey WHEN c_custkey % 13 = 0 THEN '7' ELSE CAST(c_custkey AS VARCHAR) END AS id,
         c_custkey AS k FROM customer)
SELECT id, rule, count(*) AS n FROM (
  SELECT id, 'id_not_digits' AS rule FROM c WHERE k % 11 = 0
  UNION ALL SELECT id, 'empty_name' FROM c WHERE k % 17 = 0
  UNION ALL SELECT id, 'empty_sample' FROM c WHERE k % 19 = 0
  UNION ALL SELECT id, 'token_name' FROM c WHERE k % 23 = 0
  UNION ALL SELECT id, 'value_count' FROM c WHERE k % 23 <> 0 AND (k % 29 = 0 OR k % 19 = 0)
  UNION ALL SELECT id, 'duplicate_id' FROM c GROUP BY id HAVING count(*) > 1)
GROUP BY id, rule
"""
_PAD = "lpad(CAST({0} AS VARCHAR), CAST(greatest(4, length(CAST({0} AS VARCHAR))) AS INTEGER), '0')"
_UPSERT = f"""
WITH p AS (SELECT p_partkey AS pos, {L.PART_ID} AS id, p_name AS name, p_brand AS source FROM part),
e AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN {_PAD.format('s_suppkey')} END AS id, s_name AS name FROM supplier),
top AS (SELECT max(CAST(id AS BIGINT)) AS m, max(pos) AS mp FROM p)
SELECT pos, id, name, source FROM p WHERE id NOT IN (SELECT id FROM e WHERE id IS NOT NULL)
UNION ALL SELECT p.pos, p.id, e.name, '' FROM p JOIN e ON p.id = e.id
UNION ALL SELECT mp + n, {_PAD.format('(m + n)')}, name, '' FROM
  (SELECT name, row_number() OVER (ORDER BY k) AS n FROM e WHERE id IS NULL), top
"""
_NULLS = (
    "(SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 13 <> 0 THEN 'n' END AS name, "
    "CASE WHEN c_custkey % 5 <> 0 THEN 'x ' || c_custkey % 3 END AS sample, c_custkey % 7 = 0 AS no_case FROM customer)"
)
_NULL_RULES = f"""
WITH c AS (SELECT k, id, name, coalesce(sample, CASE WHEN k % 2 = 0 THEN 's' END) AS sample, no_case FROM {_NULLS})
SELECT rule, count(*) AS n FROM (
  SELECT 'missing_text' AS rule FROM c WHERE id IS NULL OR name IS NULL OR sample IS NULL
  UNION ALL SELECT 'missing_test_case' FROM c WHERE no_case) GROUP BY rule
"""
_UNKNOWN = f"""
WITH e AS (SELECT {_PAD.format('(c_custkey * 2)')} AS id FROM customer
  UNION ALL SELECT {_PAD.format('(o_custkey * 2)')} FROM orders WHERE o_orderstatus = 'P'),
n AS (SELECT id, count(*) AS edits FROM e GROUP BY id)
SELECT id, 'unknown_id' AS rule, edits FROM n WHERE id NOT IN (SELECT {L.PART_ID} FROM part)
UNION ALL SELECT id, 'edited_twice', edits FROM n WHERE edits > 1
"""
_SHORTFALLS = """
WITH t AS (SELECT count(*) // 2 AS need FROM customer), p AS (SELECT count(*) AS n FROM part)
SELECT 'with_timestamp' AS category, n AS found, need AS required FROM t, p WHERE n < need
UNION ALL SELECT 'with_person', n, 10 * need FROM t, p WHERE n < 10 * need
UNION ALL SELECT 'with_privacy', n, 1 FROM t, p WHERE n < 1
"""
_PART_MAPPED = "'/var/log/' || p_type || '/{{TIMESTAMP:COMPACT_DATE:20240305}}__x.json'"

# --- synthesis --------------------------------------------------------------------------------------
_N = "(SELECT count(*) FROM part)"
_RANGE_SECONDS = 4 * 86400


def _synth(time: str, local: str | None = None) -> str:
    """Events printed from the part of ordinal event_id mod n; parts in key order."""
    at, short = f"strftime({time}, '%Y-%m-%d %H:%M:%S')", f"strftime({time}, '%Y%m%d')"
    p = L.profile_sql("(event_id % 50 + 1)")
    return (
        f"SELECT event_id AS event_idx, {L.PART_ID} AS template_id, CAST(event_id % 50 AS BIGINT) AS profile_idx, "
        f"'time=' || {at} || ' part=' || p_name || ' src_ip=10.0.0.10 10.0.0.20 name=' || {p['PERSON']} || ' file /var/log/' || p_type || '/' || "
        f"{short} || '__x.json' || CASE WHEN p_partkey % 3 = 0 THEN ' code ' || {p['STORE_CODE']} ELSE '' END AS body "
        f"FROM events JOIN (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal FROM part) ON event_id % {_N} = ordinal"
    )


_RANGE_TIME = f"(TIMESTAMP '2030-01-02 00:00:00' + to_seconds(CAST(event_id % {_RANGE_SECONDS} AS BIGINT)))"
_SYNTH = _synth(_RANGE_TIME)
_OFFSET_TIME = "(TIMESTAMP '2030-01-02 13:34:05' + to_seconds(CAST(event_id // 100 AS BIGINT)))"

# --- packing ----------------------------------------------------------------------------------------


def _sized_lines(lanes: int = 3) -> str:
    return f"(SELECT CAST(row_id % {lanes} AS BIGINT) AS lane, CAST(row_id // {lanes} AS BIGINT) AS seq, CAST(strlen(line) + 1 AS BIGINT) AS bytes FROM ({L.LOG_LINES}))"


def _framed(text: str) -> str:
    return f"CAST(strlen({text}) + 1 + length({text}) - length(translate({text}, chr(10) || chr(13), '')) AS BIGINT)"


_DOC_LANE = f"(SELECT CAST(0 AS BIGINT) AS lane, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS seq, {_framed('text')} AS bytes FROM documents)"
_PAGE_LANE = f"(SELECT CAST(1 AS BIGINT) AS lane, CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS seq, {_framed('html')} AS bytes FROM pages)"


def _next_fit(rows: str, max_bytes: int, max_items: int, soft: bool, seq: str = "seq", out: str = "packet_no") -> str:
    """Where a packet starting at each row would end (as-of join on running totals), then the chain of starts."""
    fits = (
        f"a.after < b.before + {max_bytes}" if soft else f"a.after <= b.before + {max_bytes}"
    )
    # soft: the event that reaches the cap is still taken, so the end lies one after the last total below it
    extra = 2 if soft else 1
    return f"""
    WITH RECURSIVE r AS (
      SELECT lane, {seq} AS i, bytes, sum(bytes) OVER w AS after, sum(bytes) OVER w - bytes AS before
      FROM {rows} WINDOW w AS (PARTITION BY lane ORDER BY {seq})),
    last AS (SELECT lane, max(i) AS top FROM r GROUP BY lane),
    e AS (
      SELECT b.lane, b.i, least(greatest(coalesce(max(a.i) + {extra}, b.i + 1), b.i + 1), b.i + {max_items}) AS nxt
      FROM r b LEFT JOIN r a ON a.lane = b.lane AND a.i >= b.i AND a.i < b.i + {max_items} AND {fits}
      GROUP BY b.lane, b.i),
    s AS (
      SELECT lane, 0 AS i, 0 AS p FROM last
      UNION ALL
      SELECT s.lane, e.nxt, s.p + 1 FROM s JOIN e ON e.lane = s.lane AND e.i = s.i JOIN last ON last.lane = s.lane AND e.nxt <= last.top)
    SELECT r.lane, r.i AS {seq}, r.bytes, CAST(s.p AS BIGINT) AS {out}
    FROM r ASOF JOIN s ON r.lane = s.lane AND r.i >= s.i
    """


_UNITS = _next_fit(
    "(SELECT lane, packet_no, CAST(sum(bytes) AS BIGINT) AS bytes FROM ("
    + _next_fit(f"(SELECT * FROM {_DOC_LANE} UNION ALL SELECT * FROM {_PAGE_LANE})", V.PACKET_BYTES, V.PACKET_EVENTS, False)
    + ") GROUP BY lane, packet_no)",
    V.UNIT_BYTES, 2448, False, "packet_no", "unit_no",
)


_LINES_OF = "CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS BIGINT)"


def _budget(max_bytes: int, max_count: int | None) -> str:
    count_cut = f"CASE WHEN n > {max_count} THEN doc_id END" if max_count else "NULL"
    return f"""
    WITH r AS (
      SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) AS b, sum({_LINES_OF}) OVER (ORDER BY doc_id) AS n FROM documents),
    c AS (SELECT min(CASE WHEN b > {max_bytes} THEN doc_id END) AS cb, min({count_cut}) AS cn FROM r)
    SELECT doc_id, CASE WHEN cb IS NULL AND cn IS NULL THEN 'sent' WHEN cn IS NULL OR cb <= cn THEN 'bytes' ELSE 'count' END AS stop_reason
    FROM r, c WHERE doc_id < coalesce(least(cb, cn), 9223372036854775807)
    """


# --- metering ---------------------------------------------------------------------------------------
_NUM = "CASE WHEN {0} >= 1e9 THEN printf('%.2fB', {0} / 1e9) WHEN {0} >= 1e6 THEN printf('%.2fM', {0} / 1e6) WHEN {0} >= 1e3 THEN printf('%.2fK', {0} / 1e3) ELSE printf('%.0f', {0}) END"
_BYTES = "CASE WHEN {0} < 1024 THEN printf('%.0f B', {0}) WHEN {0} < 1048576 THEN printf('%.2f KiB', {0} / 1024.0) WHEN {0} < 1073741824 THEN printf('%.2f MiB', {0} / 1048576.0) WHEN {0} < 1099511627776 THEN printf('%.2f GiB', {0} / 1073741824.0) ELSE printf('%.2f TiB', {0} / 1099511627776.0) END"
_SUMMARY = f"""
SELECT coalesce(run_id, '*') AS run_id, coalesce(lane, -1) AS lane, events, events AS packets, bytes, CAST(0 AS BIGINT) AS errors,
  round(s, 3) AS elapsed_seconds, round(CASE WHEN s > 0 THEN events / s ELSE 0 END, 6) AS average_eps,
  round(CASE WHEN s > 0 THEN events / s ELSE 0 END, 6) AS average_pps, {_NUM.format('CAST(events AS DOUBLE)')} AS events_text, {_BYTES.format('CAST(bytes AS DOUBLE)')} AS bytes_text
FROM (SELECT source AS run_id, CAST(row_id % 4 AS BIGINT) AS lane, count(*) AS events, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM ({L.LOG_LINES}) GROUP BY ROLLUP (source, row_id % 4))
"""
_STEPS = """
WITH t AS (SELECT event_type, CAST(epoch_us(ts) // 200000 AS BIGINT) AS tick, count(*) AS events FROM events GROUP BY ALL),
g AS (SELECT *, tick - lag(tick) OVER (PARTITION BY event_type ORDER BY tick) AS gap FROM t),
h AS (SELECT *, greatest(3.0, lag(gap) OVER (PARTITION BY event_type ORDER BY tick) * 0.2 * 3.0) AS hold FROM g)
SELECT event_type, tick, events, round(CASE WHEN gap IS NOT NULL THEN events / (gap * 0.2) ELSE 0.0 END, 6) AS eps,
  coalesce(gap * 0.2 >= coalesce(hold, 3.0), FALSE) AS idle_before FROM h
"""
_SIDES = f"(SELECT l.source AS run_id, l.row_id AS event_id, l.line || chr(10) AS payload, l.ts, e.value FROM ({L.LOG_LINES}) l JOIN events e ON e.event_id = l.row_id)"
_DELIVERY = f"""
SELECT run_id, se AS sent_events, se AS sent_packets, sb AS sent_bytes, re AS received_events, re AS received_packets, rb AS received_bytes,
  round(rs, 3) AS received_seconds, round(CASE WHEN rs > 0 THEN re / rs ELSE 0 END, 6) AS received_eps, round(re / se, 6) AS delivery_ratio,
  re / se >= 0.999 AS passed
FROM (SELECT run_id, count(*) AS se, CAST(sum(strlen(payload)) AS BIGINT) AS sb, count(*) FILTER (value > 1.0) AS re,
  CAST(coalesce(sum(strlen(payload)) FILTER (value > 1.0), 0) AS BIGINT) AS rb,
  coalesce((epoch_us(max(ts) FILTER (value > 1.0)) - epoch_us(min(ts) FILTER (value > 1.0))) / 1e6, 0) AS rs FROM {_SIDES} GROUP BY run_id)
"""
_MANIFEST = f"""
WITH taken AS (SELECT s_suppkey * 3 AS t FROM supplier),
free AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM (
  SELECT unnest(range((SELECT max(event_id) + 1 FROM events) + (SELECT count(*) FROM taken))) AS i) WHERE i NOT IN (SELECT t FROM taken))
SELECT row_id AS event_idx, '20300102_030405_006' || CASE WHEN i > 0 THEN '_' || {_PAD.format('(i + 1)')} ELSE '' END || '.log' AS file_name,
  CAST(strlen(line) + 1 AS BIGINT) AS bytes FROM ({L.LOG_LINES}) JOIN free ON k = row_id
"""
_PREVIEW = "CASE WHEN strlen({0}) <= 180 THEN {0} ELSE left({0}, n) || '...' END"
# the longest prefix of whole characters within 180 bytes; characters have at most 4 bytes
_SEARCH = f"""
SELECT doc_id, {_PREVIEW.format('text')} AS preview FROM (
  SELECT doc_id, text, list_max(list_filter(range(45, 181), lambda x: strlen(left(text, x)) <= 180)) AS n FROM documents
  WHERE contains(translate(concat_ws(' ', source, lang, text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the s'))
"""

ORACLES = {
    "deid_token_counts": f"SELECT source, kind, CAST(count(*) AS BIGINT) AS tokens, count(DISTINCT doc_id) AS rows FROM {_DOC_TOKENS} GROUP BY source, kind",
    "deid_text_rewrite": _sanitize(_TEXTS, "row_id", "text", "text"),
    "deid_pages": _sanitize("pages", "page_id", "html", "html"),
    "deid_contacts": f"SELECT c_custkey AS row_id, {L.CONTACT_SANITIZED} AS line FROM customer",
    "extract_fields": _fields(_FIELD_TEXTS),
    "field_dictionary": f"SELECT field, occurrences, {S.kind_of_field('field')} AS kind FROM (SELECT field, count(*) AS occurrences FROM ({_fields(_FIELD_TEXTS)}) GROUP BY field)",
    "classify_line_fields": f"SELECT field, occurrences, {S.kind_of_field('field')} AS kind FROM {_LINE_FIELDS}",
    "privacy_audit": _audit("source", "text", "documents", ", count(*) FILTER (regexp_matches(text, '(?i)password|secret|Ωmega')) AS forbidden_literal"),
    "privacy_audit_lines": _audit(
        "stage", "line",
        f"(SELECT source || ':raw' AS stage, line || ' Chrome/120.0.0.0 ' || props AS line FROM (SELECT {L.LOG_LINE} AS line, event_type AS source, props FROM events)"
        f" UNION ALL SELECT source || ':done', line || ' Chrome/120.0.0.0 ' || props FROM (SELECT {L.LOG_TOKENIZED} AS line, event_type AS source, props FROM events))",
    ),
    "invalid_json_payloads": "SELECT event_type, count(*) AS n_rows, count(*) FILTER (event_id % 3 = 0) AS invalid_json FROM events GROUP BY event_type",
    "mask_endpoints": f"SELECT event_id AS row_id, {L.LOG_MASKED} AS line FROM events",
    "tokenize_lines": f"SELECT event_id AS row_id, {L.LOG_TOKENIZED} AS line FROM events",
    "pseudonymize_contacts": f"SELECT c_custkey AS row_id, CAST(c_custkey % 50 AS BIGINT) AS profile_idx, {_contact_with('(c_custkey % 50 + 1)')} AS line FROM customer",
    "stable_pseudonyms": "SELECT c_custkey, count(*) AS n_orders, CAST(0 AS BIGINT) AS broken FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey",
    "synthetic_people": f"SELECT c_custkey, {_people('(c_custkey % 50 + 1)')} FROM customer",
    "synthetic_values": " UNION ALL ".join(
        f"SELECT p AS profile_idx, '{k}' AS kind, {e} AS value, customers FROM (SELECT CAST(c_custkey % 50 AS BIGINT) AS p, count(*) AS customers FROM customer GROUP BY 1)"
        for k, e in L.profile_sql("(p + 1)").items()
    ),
    "dictionary_terms": f"SELECT doc_id AS row_id, CAST(bit_or(bit) AS BIGINT) AS kind_mask, string_agg(terms, ' ' ORDER BY ordinal) AS terms "
    f"FROM (SELECT DISTINCT doc_id, kind FROM {_DOC_TOKENS}) JOIN {_KINDS} k USING (kind) GROUP BY doc_id",
    "token_totals": f"SELECT kind, CAST(ordinal AS BIGINT) AS ordinal, CAST(bit AS BIGINT) AS bit, '{{{{' || kind || '}}}}' AS marker, n AS tokens FROM "
    f"(SELECT count(*) AS n FROM customer), {_KINDS} k WHERE kind IN ('PERSON', 'PHONE', 'EMAIL', 'MAC_ADDRESS', 'IDENTIFIER', 'STORE', 'EMPLOYEE_ID', 'FILE_PATH')",
    "detect_timestamps": f"SELECT row_id, pos, len, style, raw FROM ({_SPAN})",
    "timestamp_profile": f"SELECT source, {L.STYLE_NAME} AS style, {_feature(0)} AS date_sep, {_feature(1)} AS time_sep, CAST({_feature(2)} AS BIGINT) AS fraction_digits, "
    f"CAST(2 AS BIGINT) AS hour_width, CAST({_feature(3)} AS BIGINT) AS zone_minutes, {_feature(4)} AS has_weekday, {_feature(5)} AS zone, count(*) AS n FROM {L.ORDERS} GROUP BY source, k",
    "timestamp_totals": f"SELECT coalesce(source, '*') AS source, coalesce(style, '*') AS style, coalesce({_DISPLAY}, '*') AS display_name, n FROM "
    f"(SELECT source, style, count(*) AS n FROM ({_SPAN}) GROUP BY ROLLUP (source, style))",
    "mark_timestamps": f"SELECT row_id, {_marked()} AS line FROM {L.ORDERS}",
    "rebase_timestamps": f"SELECT row_id, {_moved('(t + INTERVAL 1000 DAY + INTERVAL 1 HOUR)')} AS line FROM {L.ORDERS}",
    "rebase_zoned": f"SELECT row_id, {_moved('t', zoned=True)} AS line FROM {L.ORDERS}",
    "catalog_validate": _VALIDATE,
    "catalog_next_id": f"SELECT {_PAD.format('(max(c_custkey) + 1)')} AS next_id FROM customer",
    "catalog_upsert": _UPSERT,
    "catalog_delete": f"SELECT {L.PART_ID} AS id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40)",
    "catalog_select": f"SELECT {L.PART_ID} AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 10)",
    "catalog_unknown_ids": f"SELECT {_PAD.format('(c_custkey + 1000)')} AS id FROM customer WHERE c_custkey + 1000 NOT IN (SELECT p_partkey FROM part)",
    "catalog_roundtrip": f"SELECT p_partkey AS pos, {L.PART_ID} AS id, p_name AS name, {L.PART_TOKENIZED} AS sample, p_brand AS source, 'FILE_PATH' AS tokens, {_PART_MAPPED} AS mapped FROM part",
    "catalog_document": f"SELECT row_number() OVER (ORDER BY p_partkey) AS nth, {L.PART_ID} AS id, p_name AS name, {L.PART_TOKENIZED} AS sample, p_brand AS source FROM part",
    "catalog_roundtrip_unordered": f"SELECT o_orderkey AS pos, {_PAD.format('(100000000 - o_orderkey)')} AS id, o_orderstatus AS name, 'x ' || o_orderstatus AS sample FROM orders",
    "compile_with_nulls": f"SELECT coalesce(sample, '?') AS sample, count(*) AS templates, CAST(1 AS BIGINT) AS forms, CASE WHEN sample IS NULL THEN 0 ELSE count(*) END AS cut FROM {_NULLS} GROUP BY sample",
    "catalog_validate_nulls": _NULL_RULES,
    "upsert_unknown": _UNKNOWN,
    "dense_hashed_ids": "SELECT o_orderkey, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT) - 1 AS seq FROM orders",
    "mapped_paths": f"SELECT {L.PART_ID} AS id, CAST(1 AS BIGINT) AS markers, CAST(2 AS BIGINT) AS values FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0",
    "coverage_shortfalls": _SHORTFALLS,
    "deid_company": "SELECT c_custkey, 'vendor ' || ['Your-Company', 'Your-Company', 'plain', 'Your-Company'][c_custkey % 4 + 1] || ' segment ' || c_mktsegment AS line FROM customer",
    "synthesize_large": f"""
        WITH t AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS turn FROM orders), n AS (SELECT count(*) AS n FROM orders)
        SELECT event_id AS event_idx, {_PAD.format('k')} AS template_id, 'o ' || k || ' seen ' ||
          strftime(TIMESTAMP '2030-01-02 00:00:00' + to_seconds(event_id % {_RANGE_SECONDS}), '%Y-%m-%d %H:%M:%S') || '.0 by ' || {L.profile_sql('(event_id % 50 + 1)')['PERSON']} AS body
        FROM events, n, t WHERE turn = event_id % n""",
    "synthesize_many_forms": f"""
        WITH t AS (SELECT c_custkey AS k, c_custkey % 60 AS z, row_number() OVER (ORDER BY c_custkey) - 1 AS turn FROM customer), n AS (SELECT count(*) AS n FROM customer)
        SELECT event_id AS event_idx, {_PAD.format('k')} AS template_id, 'z ' || strftime(TIMESTAMP '2030-01-02 04:34:05' + to_microseconds(event_id * 10000) + to_minutes(CAST((z % 15) * 60 + z // 15 * 15 AS BIGINT)), '%Y-%m-%dT%H:%M:%S')
          || '+' || lpad(CAST(z % 15 AS VARCHAR), 2, '0') || ':' || lpad(CAST(z // 15 * 15 AS VARCHAR), 2, '0') || ' k' || k AS body
        FROM events, n, t WHERE turn = event_id % n""",
    "pseudonymize_hashed": "SELECT c_mktsegment AS source, count(*) AS customers, CAST(0 AS BIGINT) AS left_over, CAST(0 AS BIGINT) AS outside FROM customer GROUP BY c_mktsegment",
    "timestamps_several": f"""
        SELECT row_id, 'u={{{{TIMESTAMP:ISO8601:' || strftime(t, '%Y/%m/%d %-H:%M:%S') || '}}}} [{{{{TIMESTAMP:APACHE:' || strftime(t, '%d/%b/%Y:%H:%M:%S') || ' +0530}}}}] run {{{{TIMESTAMP:COMPACT_T:'
          || strftime(t, '%Y%m%dT%H%M%S') || '.5-0330}}}} born={{{{TIMESTAMP:DATE:' || strftime(t, '%Y/%m/%d') || '}}}} kept_month={{{{TIMESTAMP:YEAR_MONTH:' || strftime(t, '%Y-%m') || '}}}}' AS line FROM {L.ORDERS}""",
    "batch_stream_kind": _next_fit(_sized_lines(1), V.STREAM_BATCH_BYTES, V.STREAM_BATCH_EVENTS, True, out="batch_no"),
    "budget_duration": """
        WITH r AS (SELECT doc_id, text, sum(strlen(text)) OVER (ORDER BY doc_id) AS b FROM documents),
        c AS (SELECT min(CASE WHEN text <> '' AND doc_id * 10 >= 5000 THEN doc_id END) AS late, min(CASE WHEN b > 3000000 THEN doc_id END) AS big FROM r)
        SELECT doc_id, CASE WHEN late IS NULL AND big IS NULL THEN 'sent' WHEN big IS NULL OR late <= big THEN 'duration' ELSE 'bytes' END AS stop_reason
        FROM r, c WHERE doc_id < coalesce(least(late, big), 9223372036854775807)""",
    "restore_two_keys": f"SELECT {L.PART_ID} AS id, 'z' || p_type || ' ' || p_brand || ' / ' || p_brand || ' end' AS restored FROM part",
    "catalog_files_checked": "SELECT s_suppkey, unnest("
    + str([r for _, r in L.FILES]) + "[s_suppkey % " + str(len(L.FILES)) + " + 1]) AS rule FROM supplier",
    "windowed_rate_stream": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS events FROM events GROUP BY event_type, date_trunc('hour', ts) "
    "HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "restore_mapped_values": f"SELECT {L.PART_ID} AS id, replace({L.PART_SAMPLE}, '{{{{FILE_PATH}}}}', '/var/log/' || p_type || '/20240305__x.json') AS restored FROM part",
    "analyze_templates": f"SELECT {L.PART_ID} AS id, CAST(2 AS BIGINT) AS n_timestamps, CAST(1 AS BIGINT) AS n_src, CAST(1 AS BIGINT) AS n_dst, "
    "CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_privacy, CAST(CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 1 END AS BIGINT) AS kind_mask, "
    "'ISO8601,COMPACT_DATE' AS styles FROM part",
    "compile_segments": """
        SELECT seg_no, kind, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
          SELECT unnest([
            {'seg_no': 0::BIGINT, 'kind': 'literal', 'chars': 5}, {'seg_no': 1, 'kind': 'timestamp', 'chars': 19},
            {'seg_no': 2, 'kind': 'literal', 'chars': length(' part=' || p_name || ' src_ip=')}, {'seg_no': 3, 'kind': 'src_ip', 'chars': NULL},
            {'seg_no': 4, 'kind': 'literal', 'chars': 1}, {'seg_no': 5, 'kind': 'dst_ip', 'chars': NULL},
            {'seg_no': 6, 'kind': 'literal', 'chars': 6}, {'seg_no': 7, 'kind': 'privacy', 'chars': 6},
            {'seg_no': 8, 'kind': 'literal', 'chars': length(' file /var/log/' || p_type || '/')}, {'seg_no': 9, 'kind': 'timestamp', 'chars': 8},
            {'seg_no': 10, 'kind': 'literal', 'chars': CASE WHEN p_partkey % 3 = 0 THEN length('__x.json code ') ELSE length('__x.json') END},
            {'seg_no': 11, 'kind': CASE WHEN p_partkey % 3 = 0 THEN 'privacy' END, 'chars': 10}], recursive := true) FROM part)
        WHERE kind IS NOT NULL GROUP BY seg_no, kind""",
    "catalog_coverage": "SELECT n AS n_templates, n AS with_timestamp, n AS with_source_ip, n AS with_destination_ip, n AS with_privacy, n AS with_person, "
    "CAST(5 AS BIGINT) AS all_kinds FROM (SELECT count(*) AS n FROM part)",
    "dedupe_compile": "SELECT sha256(text || chr(31) || '[]') AS fp, min(doc_id) AS leader, count(*) AS copies FROM documents GROUP BY text",
    "search_docs": _SEARCH,
    "search_catalog": f"SELECT {L.PART_ID} AS id, p_name AS name FROM part WHERE p_partkey % 3 = 0",
    "round_robin_events": f"SELECT event_id AS event_idx, CAST(event_id % {_N} AS BIGINT) AS ordinal, {L.PART_ID} AS template_id FROM events "
    f"JOIN (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS o FROM part) ON event_id % {_N} = o",
    "round_robin_fairness": f"SELECT count(*) AS templates, max(c) AS max_share, min(c) AS min_share, max(c) - min(c) AS spread, CAST(0 AS BIGINT) AS out_of_turn "
    f"FROM (SELECT event_id % {_N} AS o, count(*) AS c FROM events GROUP BY 1)",
    "event_time_range": f"SELECT event_id AS event_idx, strftime({_RANGE_TIME}, '%Y-%m-%d %H:%M:%S') AS event_time FROM events",
    "event_time_offset": "SELECT event_id AS event_idx, strftime(TIMESTAMP '2030-01-01 01:01:05' + to_microseconds(CAST(event_id * 1000000 // 300 AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM events",
    "synthesize_events": _SYNTH,
    "synthesize_stream": _SYNTH,
    "synthesize_offset": f"SELECT event_idx, template_id, body FROM ({_synth(_OFFSET_TIME)})",
    "synthesize_summary": f"SELECT {L.PART_ID} AS template_id, count(*) AS events, CAST(0 AS BIGINT) AS unresolved FROM events "
    f"JOIN (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS o FROM part) ON event_id % {_N} = o GROUP BY p_partkey",
    "sanitize_stream": _sanitize("documents", "doc_id", "text", "text"),
    "frame_sizes": f"SELECT doc_id, {_framed('text')} AS newline_bytes, CAST(length(CAST(strlen(text) AS VARCHAR)) + 1 + strlen(text) AS BIGINT) AS octet_bytes FROM documents",
    "split_batches": r"SELECT doc_id, CAST(unnest(range(len(e))) AS BIGINT) AS event_no, unnest(e) AS event FROM "
    r"(SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+', 0) AS e FROM documents)",
    "event_file_manifest": _MANIFEST,
    "event_files_written": f"""
        SELECT strftime(ts, '%Y%m%d') AS part, row_id AS event_idx,
          '20300102_030405_006' || CASE WHEN row_id > 0 THEN '_' || {_PAD.format('(row_id + 1)')} ELSE '' END || '.log' AS file_name,
          CAST(strlen(line) + 1 AS BIGINT) AS bytes, sha256(line || chr(10)) AS content_sha256 FROM ({L.LOG_LINES})""",
    "budget_bytes": _budget(1_000_000, None),
    "budget_count": _budget(2_000_000, 5_000),
    "pack_packets": _next_fit(_sized_lines(), V.PACKET_BYTES, V.PACKET_EVENTS, False),
    "pack_documents": _next_fit(_DOC_LANE, V.PACKET_BYTES, V.PACKET_EVENTS, False),
    "group_packets": _UNITS,
    "batch_stream": _next_fit(_sized_lines(), V.FILE_BATCH_BYTES, V.FILE_BATCH_EVENTS, True, out="batch_no"),
    "batch_documents": _next_fit(_DOC_LANE, V.FILE_BATCH_BYTES, V.FILE_BATCH_EVENTS, True, out="batch_no"),
    "throughput_summary": _SUMMARY,
    "step_rates": _STEPS,
    "delivery_reconciliation": _DELIVERY,
    "lost_events": f"SELECT run_id, event_id FROM {_SIDES} WHERE NOT value > 1.0",
}

"""Log-like lines derived from the driver tables, once for Spark and once as SQL text.

The tables hold no phones, hardware addresses, dates in text or endpoint fields, so those come from columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, spread

# style -> (text before, date_format pattern, strftime pattern, text after)
STAMPS = [
    ("ISO8601", "at ", "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", " end"),
    ("YEAR_FIRST", "at {{TIMESTAMP:YEAR_FIRST:", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "}} end"),
    ("SYSLOG_YEAR", "at ", "EEE MMM dd HH:mm:ss yyyy", "%a %b %d %H:%M:%S %Y", " end"),
    ("SYSLOG", "at ", "MMM dd HH:mm:ss", "%b %d %H:%M:%S", " end"),
    ("MONTH_FIRST_GMT", "at {{TIMESTAMP:MONTH_FIRST_GMT:", "MMM dd yyyy HH:mm:ss 'GMT'", "%b %d %Y %H:%M:%S GMT", "}} end"),
    ("APACHE", "at ", "dd/MMM/yyyy:HH:mm:ss '+0900'", "%d/%b/%Y:%H:%M:%S +0900", " end"),
    ("COMPACT", "at ", "yyyyMMddHHmmss", "%Y%m%d%H%M%S", " end"),
    ("COMPACT_T", "at ", "yyyyMMdd'T'HHmmss.SSS'+0900'", "%Y%m%dT%H%M%S.%g+0900", " end"),
    ("COMPACT_DATE", "file=", "yyyyMMdd", "%Y%m%d", "__tx.json"),
    ("COMPACT_MONTH", "file=", "yyyyMM", "%Y%m", "_archive.csv"),
    ("COMPACT_TIME", "access_hms=\"", "HHmmss", "%H%M%S", "\" end"),
    ("YEAR_FIRST_MINUTE", "at ", "yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M", " end"),
    ("MONTH_DAY_YEAR", "at ", "MMM dd yyyy HH:mm:ss 'UTC'", "%b %d %Y %H:%M:%S UTC", " end"),
    ("DATE", "date=", "yyyy/MM/dd", "%Y/%m/%d", " end"),
    ("YEAR_MONTH", "checkmonth=", "yyyy-MM", "%Y-%m", " end"),
    ("TIME", "time=\"", "HH:mm:ss", "%H:%M:%S", "\" end"),
]


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, source, ts, line)``: one key=value line per event."""
    e = spread(read_table(spark, sf, "events").select("event_id", "event_type", "ts", "user_id"), "event_id")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(
            F.lit("stime="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
            F.lit("Z user_id=u"), F.col("user_id").cast("string"),
            F.lit(" src_ip=10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"),
            F.lit(" dst_ip=10.1."), (F.col("event_id") % 200).cast("string"), F.lit(".7"),
            F.lit(" flow 172.16.0."), (F.col("user_id") % 250).cast("string"), F.lit(":443 -> 192.168.1."), (F.col("event_id") % 250).cast("string"),
            F.lit(":80 remote_ip=203.0.113."), (F.col("user_id") % 256).cast("string"),
            F.lit(" type="), F.col("event_type"),
        ).alias("line"),
    )


def _log_parts(src: str, dst: str, flow_src: str, flow_dst: str, user: str, remote: str, stamp: str) -> str:
    return (
        f"'stime=' || {stamp} || ' user_id=' || {user} || ' src_ip=' || {src} || ' dst_ip=' || {dst} || ' flow ' || "
        f"{flow_src} || ':443 -> ' || {flow_dst} || ':80 remote_ip=' || {remote} || ' type=' || event_type"
    )


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'"
LOG_LINE = _log_parts(
    "'10.0.' || (user_id % 256) || '.' || (event_id % 256)",
    "'10.1.' || (event_id % 200) || '.7'",
    "'172.16.0.' || (user_id % 250)",
    "'192.168.1.' || (event_id % 250)",
    "'u' || user_id",
    "'203.0.113.' || (user_id % 256)",
    _ISO,
)
LOG_LINES = f"SELECT event_id AS row_id, event_type AS source, ts, {LOG_LINE} AS line FROM events"
# what the line must become, written down rather than computed
LOG_MASKED = _log_parts(
    "'{{SRC_IP}}'", "'{{DST_IP}}'", "'{{SRC_IP}}'", "'{{DST_IP}}'", "'u' || user_id", "'203.0.113.' || (user_id % 256)", _ISO
)
LOG_TOKENIZED = _log_parts(
    "'{{SRC_IP}}'", "'{{DST_IP}}'", "'{{SRC_IP}}'", "'{{DST_IP}}'", "'{{USER_ID}}'", "'{{IP_ADDRESS}}'",
    f"'{{{{TIMESTAMP:ISO8601:' || {_ISO} || '}}}}'",
)


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, source, style, t, line)``: the order date in one of the sixteen styles."""
    o = spread(read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderkey")
    t = (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") * 7919 % 86400)).cast("timestamp")
    o = o.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("source"), t.alias("t"),
        F.pmod("o_orderkey", F.lit(len(STAMPS))).alias("k"),
    )
    line, style = None, None
    for i, (name, before, pattern, _, after) in enumerate(STAMPS):
        text = F.concat(F.lit(before), F.date_format("t", pattern), F.lit(after))
        line = F.when(F.col("k") == i, text) if line is None else line.when(F.col("k") == i, text)
        style = F.when(F.col("k") == i, name) if style is None else style.when(F.col("k") == i, name)
    return o.select("row_id", "source", style.alias("style"), "t", line.alias("line"))


def stamp_sql(when: str = "t", full: bool = True) -> str:
    """CASE over the style number k: the printed stamp, with or without the text around it."""
    out = ["CASE k"]
    for i, (_, before, _, fmt, after) in enumerate(STAMPS):
        text = f"strftime({when}, '{fmt}')"
        out.append(f"WHEN {i} THEN " + (f"'{before}' || {text} || '{after}'" if full else text))
    return " ".join(out) + " END"


def case_k(values: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


STYLE_NAME = case_k([f"'{s[0]}'" for s in STAMPS])
ORDERS = (
    "(SELECT o_orderkey AS row_id, o_orderpriority AS source, "
    "o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) AS t, "
    f"o_orderkey % {len(STAMPS)} AS k FROM orders)"
)


def contact_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, source, line)``: contact data of every customer, in key=value and JSON form."""
    c = spread(read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name"), "c_custkey")
    k = F.col("c_custkey")
    return c.select(
        k.alias("row_id"),
        F.col("c_mktsegment").alias("source"),
        F.concat(
            F.lit("customer_name="), F.col("c_name"),
            F.lit(" tel 010-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((k * 7 % 10000).cast("string"), 4, "0"),
            F.lit(" 메일 user"), k.cast("string"), F.lit("@mail.example.com via "),
            F.lpad(F.lower(F.hex(k % 256)), 2, "0"), F.lit(":1a:2b:3c:4d:5e rrn 900101-1"), F.lpad((k % 1000000).cast("string"), 6, "0"),
            F.lit(" {\"store_cd\": \"s"), k.cast("string"), F.lit("\", \"emp_no\": "), k.cast("string"),
            F.lit(", \"path\": \"/data/"), k.cast("string"), F.lit("\"} C:\\Users\\u"), k.cast("string"), F.lit("\\x.txt"),
        ).alias("line"),
    )


def contact_sql(name: str, phone: str, mail: str, mac: str, rrn: str, store: str, emp: str, path: str, user: str) -> str:
    return (
        f"'customer_name=' || {name} || ' tel ' || {phone} || ' 메일 ' || {mail} || ' via ' || {mac} || ' rrn ' || {rrn} || "
        f"' {{\"store_cd\": \"' || {store} || '\", \"emp_no\": ' || {emp} || ', \"path\": \"' || {path} || '\"}} C:\\Users\\' || {user} || '\\x.txt'"
    )


CONTACT_SANITIZED = contact_sql(
    "'{{PERSON}}'", "'{{PHONE}}'", "'{{EMAIL}}'", "'{{MAC_ADDRESS}}'", "'{{IDENTIFIER}}'", "'{{STORE}}'", "'{{EMPLOYEE_ID}}'",
    "'{{FILE_PATH}}'", "'TestUser'",
)


def profile_sql(n: str) -> dict[str, str]:
    """Each attribute of identity n (1..50) as SQL."""
    from ..functions import fixed as V

    return {
        k: (f"printf('{f}', CAST({n} AS INTEGER))" if "%" in f else f"'{f}'") for k, f in V.PROFILE_FORMATS.items()
    }


def part_templates(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog from the parts: ``(pos, id, name, sample, source, test_case)``."""
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.cast("int").alias("pos"),
        F.lpad(k.cast("string"), F.greatest(F.lit(4), F.length(k.cast("string"))), F.lit("0")).alias("id"),
        F.col("p_name").alias("name"),
        F.concat(
            F.lit("time=2024-03-05 10:11:12 part="), F.col("p_name"), F.lit(" src_ip=10.9.8.7 {{DST_IP}} name={{PERSON}} file {{FILE_PATH}}"),
            F.when(k % 3 == 0, F.lit(" code {{STORE_CODE}}")).otherwise(""),
        ).alias("sample"),
        F.col("p_brand").alias("source"),
        F.create_map(
            F.lit("FILE_PATH"), F.array(F.concat(F.lit("/var/log/"), F.col("p_type"), F.lit("/20240305__x.json")))
        ).alias("test_case"),
    )


PART_SAMPLE = (
    "'time=2024-03-05 10:11:12 part=' || p_name || ' src_ip=10.9.8.7 {{DST_IP}} name={{PERSON}} file {{FILE_PATH}}' || "
    "CASE WHEN p_partkey % 3 = 0 THEN ' code {{STORE_CODE}}' ELSE '' END"
)
PART_TOKENIZED = (
    "'time={{TIMESTAMP:ISO8601:2024-03-05 10:11:12}} part=' || p_name || ' src_ip={{SRC_IP}} {{DST_IP}} name={{PERSON}} file {{FILE_PATH}}' || "
    "CASE WHEN p_partkey % 3 = 0 THEN ' code {{STORE_CODE}}' ELSE '' END"
)
PART_ID = "lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(4, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0')"

# each kind of mistake a catalog file can have, and none; %s is a name from the tables
FILES = [
    ('{"schema_version":2,"logs":[{"id":"1","name":"%s","sample":"s"}]}', ["schema_version"]),
    ('{"schema_version":1}', ["logs_missing"]),
    ('{"schema_version":1,"logs":[3]}', ["entry_not_object"]),
    ('{"schema_version":1,"logs":[{"id":"1","name":"%s"}]}', ["missing_text"]),
    ('{"schema_version":1,"logs":[{"id":"1","name":"%s","sample":"s","source":5}]}', ["source_not_text"]),
    ('{"schema_version":1,"logs":[{"id":"a1","name":"%s","sample":""}]}', ["empty_sample", "id_not_digits"]),
    ('{"schema_version":1,"logs":[{"id":"1","name":"%s","sample":"s"},{"id":"1","name":"","sample":"s"}]}', ["duplicate_id", "empty_name"]),
    ('{"schema_version":1,"logs":[{"id":"1","name":"%s","sample":"s","test_case":[]}]}', ["test_case_not_object"]),
    ('{"schema_version":1,"logs":[{"id":"1","name":"%s","sample":"s","test_case":{"A":"x"}}]}', ["test_case_not_array"]),
    ('{"schema_version":1,"logs":[{"id":"1","name":"%s","sample":"s","test_case":{"A":["x",1]}}]}', ["test_case_not_text"]),
    ('{"schema_version":1,"logs":[{"id":"1","name":"%s","sample":"s","test_case":{"A":["x"]}}]}', []),
]

"""Golden rows and properties of the text functions."""

import random

import pytest
from pyspark.sql import functions as F

from veilworks.functions import fixed as V
from veilworks.functions import timestamps as T
from veilworks.functions.field_kinds import DEFAULT_RULES, _decide, kind_of, normalize
from veilworks.functions.fields import mask_fields, pairs
from veilworks.functions.sanitize import mask_endpoints, sanitize
from veilworks.functions.templates import tokenize
from veilworks.operators.deid import extract_fields

CLOCK = "2030-01-02 03:04:05"


def apply(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[1:] for r in df.select("i", *columns).orderBy("i").collect()]


SANITIZED = [
    ("manager_nm=이하늘 login_id=hn.lee empno=40718", "manager_nm={{PERSON}} login_id={{USER_ID}} empno={{EMPLOYEE_ID}}"),
    ("mail_addr=sky@corp.example mobile=011-222-3333", "mail_addr={{EMAIL}} mobile={{PHONE}}"),
    ("access_ip=172.30.1.9 sip=172.30.1.8 dip=172.30.1.7", "access_ip={{IP_ADDRESS}} sip=172.30.1.8 dip=172.30.1.7"),
    ("shop_code=77 branch=남산 y.site_cd = {{STORE}}", "shop_code={{STORE_CODE}} branch={{STORE}} y.site_cd = {{STORE_CODE}}"),
    ('ldap_tel="x1" ldap_sno="88" sess_domain="q.example"', 'ldap_tel="{{DEPARTMENT}}" ldap_sno="{{USER_ID}}" sess_domain="{{HOST}}"'),
    ('folder="/srv/q" reassembled="zz" principalid="P9"', 'folder="{{FILE_PATH}}" reassembled="{{SECRET}}" principalid="{{IDENTIFIER}}"'),
    ("counts=901234567,112233445,2233445566", "counts=901234567,112233445,2233445566"),
    ("call 01098765432 now", "call {{PHONE}} now"),
    ("집010-9876-5432", "집{{PHONE}}"),
    ("b_010-9876-5432", "b_010-9876-5432"),
    ("to +82-10-9876-5432", "to {{PHONE}}"),
    ('mac="0C:"{{MAC_ADDRESS}}"', 'mac="{{MAC_ADDRESS}}"'),
    ('{mac:"{{MAC_ADDRESS}}"}', '{mac:"{{MAC_ADDRESS}}"}'),
    ("if 0a-bc-de-f0-12-34 up", "if {{MAC_ADDRESS}} up"),
    ("id 881231-2345678", "id {{IDENTIFIER}}"),
    ("id 881231-9345678", "id 881231-9345678"),
    ("d:\\users\\park\\b.log", "d:\\users\\TestUser\\b.log"),
    ("raw=\x1f\x00\x0c\x0b\x07\b\t", "raw=\\x1F\\x00\\f\\v\\a\\b\t"),
    ("from=q@w.io", "{{EMAIL}}"),
    ('{"owner":{"name":"z"}}', '{"owner":{"name":"z"}}'),
    ('name="never closed, y=2', 'name="{{PERSON}}'),
    ('pwd={{Y}} pwd="c}}d" pwd=c}}d', 'pwd={{Y}} pwd="c}}d" pwd={{SECRET}}}}d'),
    ('b="y "name=z', 'b="y "name={{PERSON}}'),
    ("name=\ny", "name=\ny"),
    ("name=,secret=;passwd=9", "name=,secret=;passwd={{SECRET}}"),
    ("m" * 60 + "name=y", "m" * 60 + "name=y"),
    ("mac_address=01:02 ip_address=9.8.7.6", "mac_address={{ADDRESS}} ip_address={{ADDRESS}}"),
    ("restore_at=1 steamer=2 token_age=3", "restore_at={{STORE}} steamer={{DEPARTMENT}} token_age={{SECRET}}"),
    ("\ufdd0name=y\ufdd1", "\ufdd0name=y\ufdd1"),
    ("\ufdd0 name=y \ufdd1", "\ufdd0 name={{PERSON}} \ufdd1"),
    ("", ""),
    (None, None),
]


def test_sanitize_golden_and_idempotent(spark):
    once = sanitize(F.col("t"))
    got = apply(spark, [r for r, _ in SANITIZED], once, sanitize(once))
    for (raw, want), (first, second) in zip(SANITIZED, got):
        assert first == want, raw
        assert second == want, raw


def test_long_names_are_not_fields(spark):
    rows = ["a" * 60 + "name=x", "a" * 61 + "name=x"]
    assert [r[0] for r in apply(spark, rows, F.size(pairs(F.col("t"))))] == [1, 0]


def test_company_literals(spark):
    rows = ["vendor=lottermart alternate=LotteMart x=test123 Lotte smart"]
    got = apply(spark, rows, sanitize(F.col("t"), company_literals=V.COMPANY_LITERALS))
    assert got[0][0] == "vendor=Your-Company alternate=Your-Company x=Your-Company Your scompany"


def test_nested_fields(spark):
    raw = ['{"user":{"name":"x"}}']
    assert apply(spark, raw, mask_fields(F.col("t"), nested=True))[0][0] == '{"user":{"name":"{{PERSON}}"}}'


# worked out by hand from the rules: a name starts at the beginning or behind white space or one of , ; | {
FIELDS = [
    ("name=x k:v", [("name", "x"), ("k", "v")]),
    ("a=1,b=2;c=3|d=4{e=5", [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4{e=5")]),
    ('"q": "v w"', [("q", "v w")]),
    ("'k'='it' 'm':2", [("k", "it"), ("m", "2")]),
    ("x=1 (name=2", [("x", "1")]),
    ("k = v", [("k", "v")]),
    ("k=\tv", [("k", "")]),
    ("k=", [("k", "")]),
    ("9k=v", []),
    ("_k.-x=v", [("_k.-x", "v")]),
    ("k:=v", [("k", "=v")]),
    ('k="open x=1', [("k", "open x=1")]),
    ("k=v]x=2 y=3}z", [("k", "v"), ("y", "3")]),
    ("한name=x 한 name=y", [("name", "y")]),
    ("n" * 64 + "=1 " + "m" * 65 + "=2", [("n" * 64, "1")]),
]


def test_fields_golden(spark):
    listed = F.transform(pairs(F.col("t")), lambda p: F.struct(p["field"], p["value"]))
    for (text, want), (got,) in zip(FIELDS, apply(spark, [f[0] for f in FIELDS], listed)):
        assert [tuple(g) for g in got] == want, text


def test_fields_lie_in_the_text_and_masking_keeps_the_rest(spark):
    rng = random.Random(5)
    alphabet = ["name", "k", "\"", "'", "=", ":", " ", ",", ";", "|", "{", "}", "]", "\n", "v1", "_a.b-c", "한", "\t", "9", "x" * 65]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    found = {}
    for r in extract_fields(df, "id", "t").orderBy("id", "field_no").collect():
        text, end = rows[r.id], found.get(r.id, 0)
        at = r.pos + (text[r.pos] in "\"'")  # an opening quote is part of the pair
        assert r.pos >= end and text[at : at + len(r.field)] == r.field
        behind = text.index(r.value, at + len(r.field))
        assert set(text[at + len(r.field) : behind]) <= set("\"' \t:=")
        found[r.id] = behind + len(r.value)
    assert len(found) > 300
    plain = [r for r in rows if "name" not in r]
    assert [g for (g,) in apply(spark, plain, mask_fields(F.col("t")))] == plain
    once = mask_fields(F.col("t"))
    for text, (first, second) in zip(rows, apply(spark, rows, once, mask_fields(once))):
        assert first == second and first.replace("{{PERSON}}", "").count("한") <= text.count("한")


def test_rules_agree_between_table_and_pattern(spark):
    names = [w for r in DEFAULT_RULES for w in r.names + r.words]
    names += ["x_" + n for n in names] + [n + "2" for n in names] + ["mac", "mac_x", "a_mac", "ip", "an_ip", "ip_a", "addr", "ipaddr", "plain"]
    got = apply(spark, names, kind_of(normalize(F.col("t"))))
    assert [g[0] for g in got] == [_decide(n.replace("-", "_"), DEFAULT_RULES) for n in names]


def test_extract_fields_positions(spark):
    df = spark.createDataFrame([(1, '한 name="a b", k: v|x=1')], "id int, t string")
    rows = [(r.field_no, r.pos, r.field, r.value, r.quoted) for r in extract_fields(df, "id", "t").collect()]
    assert rows == [(0, 2, "name", "a b", True), (1, 14, "k", "v", False), (2, 19, "x", "1", False)]


ENDPOINTS = [
    ('{"srcip":"10.10.10.10","dstip":"192.168.1.5"}', '{"srcip":"{{SRC_IP}}","dstip":"{{DST_IP}}"}'),
    ("src-ip=1.1.1.1 destination-address = 2.2.2.2", "src-ip={{SRC_IP}} destination-address = {{DST_IP}}"),
    ("gateway=10.61.1.31", "gateway={{SRC_IP}}"),
    ("192.168.85.76:49278 -> 192.168.1.133:60001", "{{SRC_IP}}:49278 -> {{DST_IP}}:60001"),
    ("1.2.3.4:5 => 6.7.8.9", "{{SRC_IP}}:5 => {{DST_IP}}"),
    ("src=10.0.0.1234", "src={{SRC_IP}}4"),
    ("version 1.2.3.4", "version 1.2.3.4"),
]


def test_endpoints(spark):
    got = apply(spark, [r for r, _ in ENDPOINTS], mask_endpoints(F.col("t")))
    assert [g[0] for g in got] == [w for _, w in ENDPOINTS]


STAMPS = [
    # raw, style, printed at the clock in calendar mode; shortest forms first
    ("kept_month=2019-08", "YEAR_MONTH", "kept_month=2030-01"),
    ("born=1999/12/31", "DATE", "born=2030/01/02"),
    ("time=201908_rest", "COMPACT_MONTH", "time=203001_rest"),
    ("bills=201908_q.csv", "COMPACT_MONTH", "bills=203001_q.csv"),
    ("dump=20190817__b.bin", "COMPACT_DATE", "dump=20300102__b.bin"),
    ("access_hms=235901", "COMPACT_TIME", "access_hms=030405"),
    ("time=21:09:08.25", "TIME", "time=03:04:05.00"),
    ("TIME: '9:09:08'", "TIME", "TIME: '3:04:05'"),
    ("first`21:09:08`last", "TIME", "first`03:04:05`last"),
    ("21:09:08`last", "TIME", "03:04:05`last"),
    ("seen 2019-08-17 9:09", "YEAR_FIRST_MINUTE", "seen 2030-01-02 3:04"),
    ("run 20190817210908", "COMPACT", "run 20300102030405"),
    ("run 20190817T210908.5-0330", "COMPACT_T", "run 20300102T030405.0-0330"),
    ("was Aug  7 21:09:08", "SYSLOG", "was Jan 02 03:04:05"),
    ("was Aug 17 21:09:08 2019", "SYSLOG_YEAR", "was Jan 02 03:04:05 2030"),
    ("Sat Aug 17 21:09:08 2019 up", "SYSLOG_YEAR", "Wed Jan 02 03:04:05 2030 up"),
    ("Abc Aug 17 21:09:08 2019 up", "SYSLOG_YEAR", "Jan 02 03:04:05 2030 up"),
    ("was Aug 17 2019 21:09:08 UTC", "MONTH_DAY_YEAR", "was Jan 02 2030 03:04:05 UTC"),
    ("get [17/Aug/2019:21:09:08 +0530]", "APACHE", "get [02/Jan/2030:03:04:05 +0530]"),
    ("u=2019/08/17 9:09:08", "ISO8601", "u=2030/01/02 3:04:05"),
    ("u=2019-08-17T21:09:08-04:00", "ISO8601", "u=2030-01-02T03:04:05-04:00"),
    ("u=2019-08-17T21:09:08.75Z", "ISO8601", "u=2030-01-02T03:04:05.00Z"),
    ("{{TIMESTAMP:MONTH_FIRST_GMT:y}}", "MONTH_FIRST_GMT", "Jan 02 2030 03:04:05 GMT"),
    ("{{TIMESTAMP:YEAR_FIRST:y}}", "YEAR_FIRST", "2030-01-02T03:04:05"),
]
UNTOUCHED = [
    "0000-00-00 12:00:00", "2019-14-01", "1888-01-01", "a2019-08-17", "12019-08-17", "id 201908172109081", "21:09:08", "{{TIMESTAMP:NOPE:y}}", "stime=210908",
]


def test_timestamps_golden(spark):
    now = F.lit(CLOCK).cast("timestamp")
    marked = T.mark(F.col("t"))
    rows = apply(
        spark, [s[0] for s in STAMPS], F.transform(T.resolved(F.col("t")), lambda s: s["style"]), marked, T.mark(marked),
        T.rebased(F.col("t"), now, calendar=True), T.rebased(marked, now, calendar=True),
    )
    for (raw, style, printed), (styles, once, twice, direct, via_marker) in zip(STAMPS, rows):
        assert styles == [style], raw
        assert "{{TIMESTAMP:" + style + ":" in once, raw
        assert twice == once, raw
        assert direct == printed, raw
        assert via_marker == printed, raw


def test_timestamps_untouched(spark):
    got = apply(spark, UNTOUCHED, T.mark(F.col("t")), F.size(T.resolved(F.col("t"))))
    assert got == [(u, 0) for u in UNTOUCHED]


def test_overlaps_keep_the_longest_and_positions_hold(spark):
    raw = "한 2019-08-17 10:11:12 x 2019-08 Feb 03 2019 10:00:00 time=\"10:11:12\" 8`20190817`21:09:08`m"
    ((spans,),) = apply(spark, [raw], T.resolved(F.col("t")))
    assert [s["style"] for s in spans] == ["ISO8601", "YEAR_MONTH", "MONTH_DAY_YEAR", "TIME", "COMPACT_DATE", "TIME"]
    for s in spans:
        assert raw[s["pos"] : s["pos"] - s["neg_len"]] == s["raw"]


def test_offset_mode_zones_and_fractions(spark):
    now = F.lit("2030-01-02 03:04:05.123456").cast("timestamp")
    rows = ["a 2019-08-17T21:09:08.1+09:00", "b 2019-08-17T21:09:08.123456789Z", "c 2019-08-17 21:09:08", "d 17/Aug/2019:21:09:08 -0730"]
    got = apply(spark, rows, T.rebased(F.col("t"), now, local_tz="Asia/Seoul"))
    assert [g[0] for g in got] == [
        "a 2030-01-02T12:04:05.1+09:00", "b 2030-01-02T03:04:05.123456000Z", "c 2030-01-02 12:04:05", "d 01/Jan/2030:19:34:05 -0730",
    ]


def test_token_features(spark):
    rows = ["2019/08/17 9:09:08.123-0530", "Sat Aug 17 21:09:08 2019"]
    tok = F.transform(T.resolved(F.col("t")), lambda s: T.token(s["style"], s["raw"]))
    (a,), (b,) = apply(spark, rows, tok)
    assert tuple(a[0]) == ("ISO8601", "/", " ", 3, 1, -330, False, "-0530")
    assert tuple(b[0]) == ("SYSLOG_YEAR", "-", "T", 0, 2, 0, True, "")


@pytest.mark.parametrize("text", ["", "no stamp", "x=1"])
def test_tokenize_leaves_plain_text(spark, text):
    assert apply(spark, [text], tokenize(F.col("t"))) == [(text,)]

"""Queries over saved state: term tables, saved catalogs, literal files, streams that restart or keep state. With their SQL.

Every one reads its whole tables. The SQL is what DuckDB runs on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bijection as B
from ..functions import fixed as V
from ..operators import catalog as C
from ..operators import deid as D
from ..operators import field_rules as R
from ..operators import term_search as TS
from ..session import fresh_folder
from ..sources.catalog_files import read_entries, write_catalog
from ..sources.compiled_store import compile_stored as compile_
from ..sources.literal_files import read_literal_files, write_literal_files
from ..sources.tables import read_corpus, read_table
from ..streaming import committed as CO
from ..streaming import jobs as J
from ..streaming import stateful as ST
from . import lines as L
from . import oracles as O
from . import queries as Q

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(spark, sf) -> DataFrame:
    """Search terms: longer words of the test items, suppliers' names, part types."""
    words = read_table(spark, sf, "benchmark").select(F.explode(TS.words_of(F.col("text"), 6)).alias("term"))
    names = read_table(spark, sf, "supplier").select(F.col("s_name").alias("term"))
    return words.union(names).union(read_table(spark, sf, "part").select(F.col("p_type").alias("term")))


_TERMS = f"""(
  SELECT DISTINCT translate(term, '{_UP}', '{_LOW}') AS term FROM (
    SELECT * FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) WHERE length(term) >= 6
    UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_type FROM part
  )
)"""
_FOUND = f"""
WITH low AS MATERIALIZED (SELECT doc_id, source, translate(text, '{_UP}', '{_LOW}') AS low_text FROM documents), term AS MATERIALIZED (SELECT term FROM {_TERMS})
SELECT term, doc_id, source FROM term JOIN low ON contains(low_text, term)
"""


def _searched(spark, sf, way):
    terms = _terms(spark, sf).select(C.lower_ascii(F.col("term")).alias("query_id"), F.col("term").alias("query"))
    return TS.search_many(read_table(spark, sf, "documents"), terms, way=way)


def search_many(spark, sf):
    """All terms against all documents, by automata of one block of terms."""
    return _searched(spark, sf, None)


def search_many_blocks(spark, sf):
    """The same with terms in several blocks."""
    terms = _terms(spark, sf).select(C.lower_ascii(F.col("term")).alias("query_id"), F.col("term").alias("query"))
    return TS.search_many(read_table(spark, sf, "documents"), terms, way="automata", limit=4096)


def search_many_joined(spark, sf):
    """The same by postings: the way for more terms than automata can hold."""
    return _searched(spark, sf, "postings")


def forbidden_terms(spark, sf):
    """How many documents of each source hold each forbidden term."""
    return TS.forbidden_terms(read_table(spark, sf, "documents"), _terms(spark, sf), "source", "doc_id", "text")


def privacy_audit_terms(spark, sf):
    """The leak report with the forbidden terms of a table."""
    return TS.audit(read_table(spark, sf, "documents"), _terms(spark, sf), "source", "doc_id", "text")


def catalog_saved_in_place(spark, sf):
    """Read, edit and save one catalog three times at one path; the last version."""
    path = fresh_folder(spark, "catalog")
    write_catalog(L.part_templates(spark, sf), path)
    suppliers = read_table(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    for k in range(3):
        now = read_entries(spark, path)
        changed = now.where((F.col("source") != "") & (F.col("pos") % 3 == k)).withColumn("name", F.concat("name", F.lit(f" r{k}")))
        added = suppliers.where(F.col("s_suppkey") % 3 == k).select(
            F.col("s_suppkey").cast("int").alias("pos"), none.alias("id"), F.col("s_name").alias("name"), F.lit("x").alias("sample"), F.lit("").alias("source"),
            F.create_map().cast("map<string,array<string>>").alias("test_case"),
        )
        write_catalog(C.upsert(now, changed.unionByName(added)), path)
    return read_entries(spark, path).select(F.col("pos").cast("long"), "id", "name", "source")


_SAVED = f"""
SELECT p_partkey::BIGINT AS pos, {L.PART_ID} AS id, p_name || ' r' || (p_partkey % 3) AS name, p_brand AS source FROM part
UNION ALL
SELECT (top + n)::BIGINT, {O._PAD.format("(last + n)")}, s_name, '' FROM
  (SELECT s_name, row_number() OVER (ORDER BY s_suppkey % 3, s_suppkey) AS n FROM supplier),
  (SELECT max(p_partkey) AS top, max(CAST({L.PART_ID} AS BIGINT)) AS last FROM part)
"""


def literal_event_files(spark, sf):
    """Suppliers as events, one physical file each, after a run whose names are taken already."""
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("event_idx"), F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string")).alias("body"))
    folder = fresh_folder(spark, "literal")
    write_literal_files(s.where("event_idx % 10 = 0"), folder, "20300102_030405_006")
    listed = write_literal_files(s, folder, "20300102_030405_006")
    held = read_literal_files(spark, folder).select("file_name", F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").cast("long").alias("held"))
    return listed.join(held, "file_name", "full_outer").select("file_name", "event_idx", "bytes", "held", "content_sha256")


_LITERAL = f"""
SELECT '20300102_030405_006' || CASE WHEN i > 0 THEN '_' || {O._PAD.format("(i + 1)")} ELSE '' END || '.log' AS file_name, event_idx,
  CAST(strlen(body) + 1 AS BIGINT) AS bytes, CAST(strlen(body) + 1 AS BIGINT) AS held, sha256(body || chr(10)) AS content_sha256
FROM (
  SELECT *, row_number() OVER (ORDER BY run, event_idx) - 1 AS i FROM (
    SELECT run, s_suppkey AS event_idx, s_name || ' ' || s_nationkey AS body FROM supplier, (VALUES (0), (1)) r(run) WHERE run = 1 OR s_suppkey % 10 = 0
  )
)
"""


def _in_files(df: DataFrame, by, n: int = 4) -> str:
    """The rows dealt to several files, for a stream of several micro-batches."""
    folder = fresh_folder(df.sparkSession, "stream")
    df.repartitionByRange(n, by).write.parquet(folder)
    return folder


def _stream(spark, folder: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _arriving(parts: list[list[DataFrame]], build) -> DataFrame:
    """Tables that arrive part by part, each part of all of them followed by a run of the stream from where it stopped."""
    spark = parts[0][0].sparkSession
    folders, out = [fresh_folder(spark, "stream") for _ in parts[0]], fresh_folder(spark, "run")
    for k, tables in enumerate(parts):
        for folder, table in zip(folders, tables):
            table.write.mode("append").parquet(folder)
        if k == 0:
            streams = [spark.readStream.schema(t.schema).parquet(f) for f, t in zip(folders, tables)]
        result = J.run_available(build(*streams), "run", out)
    return result


def _by_time(df: DataFrame, time: str, n: int = 3) -> list[DataFrame]:
    """The rows in n ranges of time, in its order."""
    low, high = df.agg(F.min(F.unix_millis(time)), F.max(F.unix_millis(time))).first()
    part = F.least(F.lit(n - 1), F.floor((F.unix_millis(time) - (low or 0)) * n / max((high or 0) - (low or 0), 1)))
    return [df.where(part == k) for k in range(n)]


def synthesize_stream_restarted(spark, sf):
    """Events expanded in micro-batches into a sink with a ledger; the run dies between a batch and its entry and is started again."""
    folder = _in_files(read_table(spark, sf, "events").select(F.col("event_id").alias("event_idx")), F.xxhash64("event_idx"))
    rows = Q._synthesized(spark, sf, Q.S.Clock.between(*Q.RANGE), _stream(spark, folder))
    sink = fresh_folder(spark, "sink")

    def die(batch: int) -> None:
        if batch == 2:
            raise RuntimeError("stopped for the sake of the query")

    try:
        CO.exactly_once(rows, sink, before_entry=die).awaitTermination()
    except Exception as e:  # noqa: BLE001
        if "stopped for the sake of the query" not in str(e):
            raise
    CO.exactly_once(rows, sink).awaitTermination()
    return CO.read_committed(spark, sink, rows.schema).select("event_idx", "template_id", F.col("profile_idx").cast("long"), "body")


def pack_packets_stream(spark, sf):
    """Packets of event lines in lanes, of a stream whose rows come in hashed order."""
    times = read_table(spark, sf, "events").select(F.pmod("event_id", F.lit(3)).alias("lane"), F.expr("event_id div 3").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    sized = Q._sized_lines(spark, sf).join(times, ["lane", "seq"])
    stream = _stream(spark, _in_files(sized, F.xxhash64("lane", "seq"), 3))
    return J.run_available(ST.pack_lanes(stream, lateness="1000 days"), "packets")


def _timed_events(spark, sf) -> DataFrame:
    return read_table(spark, sf, "events").select("event_type", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))


def step_rates_stream(spark, sf):
    """Step rates of the event stream with its idle gaps, for what is closed ten minutes before its last event."""
    parts = [[p] for p in _by_time(_timed_events(spark, sf).select("event_type", "ts"), "ts")]
    return _arriving(parts, lambda s: ST.step_rates(s, "event_type", "ts", lateness="10 minutes")).withColumn("eps", F.round("eps", 6))


_STREAM_STEPS = """
WITH t AS (
  SELECT * FROM (SELECT event_type, CAST(epoch_us(ts) // 200000 AS BIGINT) AS tick, count(*) AS events FROM events GROUP BY 1, 2)
  WHERE (tick + 1) * 200 <= (SELECT (epoch_us(max(ts)) // 1000) - 600000 FROM events)
),
g AS (SELECT *, tick - lag(tick) OVER w AS gap, lead(tick) OVER w AS following FROM t WINDOW w AS (PARTITION BY event_type ORDER BY tick)),
h AS (SELECT *, lag(gap) OVER w AS gap_before, CASE WHEN gap IS NULL THEN 3000 ELSE greatest(3000, gap * 600) END AS after FROM g WINDOW w AS (PARTITION BY event_type ORDER BY tick))
SELECT event_type, tick * 200 AS at_ms, tick, events, round(CASE WHEN gap IS NOT NULL THEN events / (gap * 0.2) ELSE 0.0 END, 6) AS eps,
  coalesce(gap * 200 >= greatest(3000, coalesce(gap_before, 0) * 600), FALSE) AS idle_before FROM h
UNION ALL
SELECT event_type, tick * 200 + after, NULL, 0, 0.0, TRUE FROM h
WHERE CASE WHEN following IS NOT NULL THEN (following - tick) * 200 >= after ELSE tick * 200 + after <= (SELECT (epoch_us(max(ts)) // 1000) - 600000 FROM events) END
"""


def lost_events_stream(spark, sf):
    """Events of one stream that another one does not bring within an hour, as far as the watermark has come."""
    e = _timed_events(spark, sf)
    got = e.select("event_id", (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 50)).alias("ts"), "value")
    parts = list(map(list, zip(_by_time(e.select("event_id", "ts"), "ts"), _by_time(got.where("value > 1.0").drop("value"), "ts"))))
    rows = _arriving(parts, lambda sent, received: ST.delivery_rows(sent, received, "event_id", "ts", "1 hour", "2 hours"))
    return rows.where("received_at is null").select("event_id")


# the watermark is the lesser of both sides' latest times less the lateness; a sent row waits an hour beyond it
_LOST_STREAM = """
WITH edge AS (SELECT least((SELECT max(ts) FROM events), (SELECT max(ts + to_seconds(event_id % 50)) FROM events WHERE value > 1.0)) - INTERVAL 2 HOUR AS w)
SELECT event_id FROM events, edge WHERE NOT value > 1.0 AND date_trunc('millisecond', ts) + INTERVAL 1 HOUR < date_trunc('millisecond', w)
"""


def joined_pseudonyms(spark, sf):
    """Orders joined to customers by pseudonyms of their keys: the counts of the join on the keys."""
    key = lambda c: B.number_pseudonym(F.col(c), "key of the query")
    o = read_table(spark, sf, "orders").select(key("o_custkey").alias("k"), "o_totalprice")
    c = read_table(spark, sf, "customer").select(key("c_custkey").alias("k"), "c_mktsegment")
    return o.join(c, "k").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("k").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def restored_names(spark, sf):
    """Customers' names as pseudonyms of the same shape, and back: nothing is shared, nothing is lost, few stay by chance."""
    name = F.col("c_name")
    out = read_table(spark, sf, "customer").select("c_custkey", name, B.text_pseudonym(name, "another key").alias("p"))
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    return out.groupBy(shape(F.col("p")).alias("shape")).agg(
        F.countDistinct("p").alias("pseudonyms"), F.count_if(B.text_original(F.col("p"), "another key") == name).alias("restored"), F.count_if(shape(name) != shape(F.col("p"))).alias("reshaped")
    )


def field_dictionary_rules(spark, sf):
    """The field dictionary by a table of rules that is read from storage."""
    folder = fresh_folder(spark, "rules")
    R.rules_table(spark).write.parquet(folder)
    fields = D.extract_fields(Q._field_texts(spark, sf), "row_id", "text", positions=False)
    counts = fields.groupBy("field").agg(F.count(F.lit(1)).alias("occurrences"))
    return R.classify(counts, spark.read.schema(R.RULES).parquet(folder))


def nation_rules(spark, sf):
    """Customers' nations as names, and rules from a table of the data: nations of a region share a kind, ends in -IA come first."""
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    none = F.lit(None).cast("string")
    rules = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select((F.col("n_regionkey") + 10).cast("int").alias("rule_no"), F.lit("equals").alias("op"), F.col("n_name").alias("needle"), F.col("r_name").alias("kind"), none.alias("without"), none.alias("unless"))
    more = spark.createDataFrame([(1, "suffix", "ia", "IA", "s", None), (2, "prefix", "un", "UN", None, "united kingdom"), (3, "contains", "ran", "RAN", None, None)], R.RULES)
    c = read_table(spark, sf, "customer").join(n, F.col("c_nationkey") == n["n_nationkey"]).select("c_custkey", F.col("n_name").alias("field"))
    return R.classify(c, rules.unionByName(more)).select("c_custkey", "kind")


_NATIONS = """
SELECT c_custkey, CASE WHEN lower(n_name) LIKE '%ia' AND lower(n_name) NOT LIKE '%s%' THEN 'IA' WHEN lower(n_name) LIKE 'un%' AND lower(n_name) <> 'united kingdom' THEN 'UN'
  WHEN lower(n_name) LIKE '%ran%' THEN 'RAN' ELSE r_name END AS kind
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

def compile_stored(spark, sf):
    """Parts as templates, compiled in two runs that share a store: the second one compiles the half the first one had not."""
    path, parts = fresh_folder(spark, "compiled"), L.part_templates(spark, sf)
    compile_(parts.where("pos % 2 = 0"), path)
    out = compile_(parts, path)
    return out.select("id", *[F.col(c).cast("long") for c in ("n_timestamps", "n_src", "n_dst", "n_privacy", "kind_mask")], F.array_join("styles", ",").alias("styles"))


def corpus_lengths(spark, sf):
    """Corpora in three formats as one: documents from Parquet, conversations from JSON lines, pages' addresses as plain text."""
    folder = fresh_folder(spark, "corpus")
    talk = read_table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"), "text")
    talk.write.json(f"{folder}/talk")
    read_table(spark, sf, "pages").select("url").where("url is not null and not contains(url, '\n')").write.text(f"{folder}/pages")
    docs = read_corpus(spark, f"{sf.rstrip('/')}/documents.parquet", "doc_id", "text", keep=("source",))
    lines = read_corpus(spark, f"{folder}/talk", "name", "text", "json")
    plain = read_corpus(spark, f"{folder}/pages", "value", "value", "text")
    rows = docs.select(F.lit("documents").alias("corpus"), "text").union(lines.select(F.lit("talk"), "text")).union(plain.select(F.lit("pages"), "text"))
    return rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.char_length("text")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        search_many, search_many_blocks, search_many_joined, forbidden_terms, privacy_audit_terms, catalog_saved_in_place, literal_event_files,
        synthesize_stream_restarted, pack_packets_stream, step_rates_stream, lost_events_stream, joined_pseudonyms, restored_names,
        field_dictionary_rules, nation_rules, compile_stored, corpus_lengths,
    )
}

ORACLES = {
    **dict.fromkeys(("search_many", "search_many_blocks", "search_many_joined"), f"SELECT term AS query_id, doc_id FROM ({_FOUND})"),
    "forbidden_terms": f"SELECT source, term, count(*) AS n_rows FROM ({_FOUND}) GROUP BY ALL",
    "privacy_audit_terms": O._audit("source", "text", f"(SELECT d.*, d.doc_id IN (SELECT doc_id FROM ({_FOUND})) AS hit FROM documents d)", ", count(*) FILTER (hit) AS forbidden_literal"),
    "catalog_saved_in_place": _SAVED,
    "literal_event_files": _LITERAL,
    "synthesize_stream_restarted": O.ORACLES["synthesize_stream"],
    "pack_packets_stream": O._next_fit(O._sized_lines(), V.PACKET_BYTES, V.PACKET_EVENTS, False),
    "step_rates_stream": _STREAM_STEPS,
    "lost_events_stream": _LOST_STREAM,
    "joined_pseudonyms": "SELECT c_mktsegment, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "restored_names": "SELECT regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g') AS shape, count(DISTINCT c_name) AS pseudonyms, "
    "count(*) AS restored, CAST(0 AS BIGINT) AS reshaped FROM customer GROUP BY 1",
    "field_dictionary_rules": O.ORACLES["field_dictionary"],
    "nation_rules": _NATIONS,
    "compile_stored": O.ORACLES["analyze_templates"],
    "corpus_lengths": "SELECT 'documents' AS corpus, count(*) AS texts, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'talk', count(*), sum(length(text))::BIGINT FROM conversations "
    "UNION ALL SELECT 'pages', count(*), sum(length(url))::BIGINT FROM pages WHERE url IS NOT NULL AND NOT contains(url, chr(10))",
}

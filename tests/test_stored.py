"""Term search, saved catalogs, literal files, restarts, streams with state, one-to-one pseudonyms, rules as tables."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from veilworks.functions import bijection as B
from veilworks.functions.field_kinds import kind_of, normalize
from veilworks.operators import catalog as C
from veilworks.operators import deid as D
from veilworks.operators import field_rules as R
from veilworks.operators import metering as M
from veilworks.operators import packing as K
from veilworks.operators import term_search as TS
from veilworks.session import fresh_folder
from veilworks.sources import compiled_store as CS
from veilworks.sources import event_files as EF
from veilworks.sources import literal_files as LF
from veilworks.sources.catalog_files import read_catalog, read_entries, write_catalog
from veilworks.sources.snapshots import SaveConflict, Snapshots
from veilworks.streaming import committed as CO
from veilworks.streaming import jobs as J
from veilworks.streaming import stateful as ST

TEMPLATE = "pos int, id string, name string, sample string, source string, test_case map<string,array<string>>"


# --- many terms, many texts ---------------------------------------------------------------------------

TEXTS = [(1, "Hello World"), (2, "help"), (3, None), (4, ""), (2, "HELLO é日本"), (5, "xxxab" * 50), (6, "aab aaab a" + "ab" * 3000), (None, "hello"), (7, "😀😀x Iİ")]
QUERIES = [(1, "hel"), (2, "HELLO"), (3, ""), (4, None), (5, "é"), (6, "日本"), (7, "é日本"), (8, "zzz"), (9, "hello"), (9, "hello"), (10, "xxx"), (11, "lo W"), (12, "aab"), (13, "aaab"), (14, "ab"), (15, "😀x"), (16, "abab" * 9), (17, "b")]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("way, limit", [(None, 1 << 20), ("automata", 1 << 20), ("automata", 8), ("postings", 1 << 20)])
def test_search_many(spark, way, limit):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("term", F.lit("extra")).repartition(3)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string").withColumn("key", F.lit("extra"))
    got = [tuple(r) for r in TS.search_many(docs, asked, way=way, limit=limit).collect()]
    want = {(q, d) for q, w in QUERIES for d, t in TEXTS if w is not None and t is not None and d is not None and w.translate(LOW) in t.translate(LOW)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("way", ["automata", "postings"])
def test_search_many_empty_tables_and_plan(spark, way):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert TS.search_many(docs.limit(0), asked, way=way).collect() == [] == TS.search_many(docs, asked.limit(0), way=way).collect()
    plan = TS.search_many(docs, asked, way=way)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_the_ways_agree_on_random_texts(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcABé ") for _ in range(n))
    docs = spark.createDataFrame([(i, text(rnd.randrange(0, 60))) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text(rnd.randrange(0, 6))) for i in range(200)], "query_id long, query string")
    one, two = ({tuple(r) for r in TS.search_many(docs, asked, way=w, limit=n).collect()} for w, n in (("automata", 100), ("postings", 1 << 20)))
    assert one == two and one


def test_many_blocks_share_passes_and_texts_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text{i} holds supplier{i % 7:05d} and more") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"Supplier{i:05d}") for i in range(400)], "query_id long, query string")
    want = sorted((i % 7, i) for i in range(50))
    for way, limit in (("automata", 100), ("postings", 1 << 20)):  # 52 blocks
        found = TS.search_many(docs, asked, way=way, limit=limit)
        assert sorted(tuple(r) for r in found.collect()) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= 2
    monkeypatch.setattr(TS, "PASSES", 0)  # terms too many for the workers are joined
    assert sorted(tuple(r) for r in TS.search_many(docs, asked, way="postings").collect()) == want


def test_audit_by_table_equals_audit_by_list(spark):
    rows = [("a", 1, "the password is x"), ("a", 2, "SECRET and password"), ("b", 3, "fine"), (None, 4, "Ωmega"), ("b", 5, None), ("c", 6, "10.1.2.3")]
    df = spark.createDataFrame(rows, "source string, row_id long, text string")
    words = ["password", "secret", "Ωmega"]
    terms = spark.createDataFrame([(w,) for w in [*words, None]], "term string")
    want = {r.source: r.forbidden_literal for r in D.privacy_audit(df, "source", "text", words).collect()}
    for way in ("automata", "postings"):
        got = TS.audit(df, terms, "source", "row_id", "text", way=way)
        assert {r.source: r.forbidden_literal for r in got.collect()} == want and got.count() == 4
        each = TS.forbidden_terms(df, terms, "source", "row_id", "text", way=way).collect()
        assert {(r.source, r.term): r.n_rows for r in each} == {("a", "password"): 2, ("a", "secret"): 1, (None, "Ωmega"): 1}


# --- catalogs saved in place --------------------------------------------------------------------------


def small(spark, *names):
    return spark.createDataFrame([(i, f"{i + 1:04d}", n, f"sample {n}", "", {}) for i, n in enumerate(names)], TEMPLATE)


def names(df):
    return [r.name for r in df.orderBy("pos").collect()]


def test_catalog_is_edited_and_saved_where_it_was_read(spark):
    path = fresh_folder(spark, "c")
    assert write_catalog(small(spark, "a", "b"), path) == 1
    for n in range(2, 34):
        write_catalog(read_entries(spark, path).withColumn("name", F.when(F.col("pos") == 0, F.lit(f"a{n}")).otherwise(F.col("name"))), path)
    assert names(read_entries(spark, path)) == ["a33", "b"] and names(read_entries(spark, path, 1)) == ["a", "b"]
    assert Snapshots(spark, path).numbers() == list(range(1, 34))


def test_a_failed_save_leaves_the_version_before_it(spark):
    path = fresh_folder(spark, "c")
    write_catalog(small(spark, "a", "b"), path)

    @F.udf("string")
    def dies(name):
        if name == "b":
            raise RuntimeError("killed")
        return name

    with pytest.raises(Exception, match="killed"):
        # checks do not read this column's value, the write does
        write_catalog(read_entries(spark, path).withColumn("sample", F.concat("sample", dies("name"))), path)
    assert names(read_entries(spark, path)) == ["a", "b"] and Snapshots(spark, path).current() == 1
    with pytest.raises(ValueError):
        write_catalog(small(spark, "a", ""), path)
    assert write_catalog(small(spark, "c"), path) == 2


def test_of_two_writers_the_second_fails(spark):
    path = fresh_folder(spark, "c")
    write_catalog(small(spark, "a"), path)
    write_catalog(small(spark, "b"), path, base=1)
    with pytest.raises(SaveConflict):
        write_catalog(small(spark, "c"), path, base=1)
    assert names(read_entries(spark, path)) == ["b"]
    at = Snapshots(spark, path)
    data, done = at.version().data, []

    def race(k):
        try:
            Snapshots(spark, path).publish(data, 2, {"schema_version": 1, "by": k})
            done.append(k)
        except SaveConflict:
            pass

    threads = [threading.Thread(target=race, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 1 and at.version(3).about["by"] == done[0]
    assert not [n for n in os.listdir(path.removeprefix("file:") + "/versions") if n.startswith(".") and not n.endswith(".crc")]


def test_readers_keep_their_version_and_old_ones_expire(spark):
    path = fresh_folder(spark, "c")
    write_catalog(small(spark, "a"), path)
    held = read_entries(spark, path)
    write_catalog(small(spark, "b"), path)
    assert names(held) == ["a"]
    at = Snapshots(spark, path)
    spark.range(1).selectExpr("'x' AS value").write.text(at.fresh())  # of a save that died
    assert at.expire(keep=2) == []  # young data may be a save under way
    assert len(at.expire(keep=1, grace_seconds=0)) == 2
    assert names(read_entries(spark, path)) == ["b"] and at.numbers() == [2]
    with pytest.raises(FileNotFoundError):
        read_entries(spark, path, 1)
    with pytest.raises(FileNotFoundError):
        read_entries(spark, fresh_folder(spark, "none"))


# --- literal files ------------------------------------------------------------------------------------


def listing(folder):
    return sorted(n for n in os.listdir(folder) if n.endswith(".log"))


def test_literal_files(spark, tmp_path):
    folder, stamp = str(tmp_path / "out"), "20300102_030405_006"
    events = spark.createDataFrame([(i, None if i == 3 else f"event {i}\né") for i in range(11)], "event_idx long, body string").withColumn("content", F.lit("extra")).repartition(4)
    rows = {r.file_name: r for r in LF.write_literal_files(events, folder, stamp).collect()}
    assert listing(folder) == sorted(rows) == sorted(f"{stamp}.log" if i == 0 else f"{stamp}_{i + 1:04d}.log" for i in range(11))
    held = {r.file_name: r.content for r in LF.read_literal_files(spark, folder).collect()}
    assert all(held[n] == ("\n" if r.event_idx == 3 else f"event {r.event_idx}\\né\n") and len(held[n].encode()) == r.bytes for n, r in rows.items())
    assert not os.listdir(f"{folder}/_staging")


def test_taken_names_are_passed_over(spark, tmp_path):
    folder, stamp = str(tmp_path), "20300102_030405_006"
    for k in (0, 1, 4):
        (tmp_path / LF.name_of(stamp, k)).write_text("mine")
    events = spark.createDataFrame([(i, f"e{i}") for i in range(4)], "event_idx long, body string")
    got = {r.event_idx: r.file_name for r in LF.write_literal_files(events, folder, stamp).collect()}
    assert got == {i: LF.name_of(stamp, k) for i, k in enumerate((2, 3, 5, 6))}
    assert (tmp_path / LF.name_of(stamp, 4)).read_text() == "mine"
    taken = spark.createDataFrame([(0,), (1,), (4,)], "file_index long")
    assert {r.event_idx: r.file_name for r in EF.event_files(events, stamp, taken=taken).collect()} == got  # as the row form names them


def test_a_failed_job_leaves_no_name(spark, tmp_path):
    folder = str(tmp_path)

    @F.udf("string")
    def dies(i):
        if i == 5:
            raise RuntimeError("killed")
        return str(i)

    with pytest.raises(Exception, match="killed"):
        LF.write_literal_files(spark.range(8).select(F.col("id").alias("event_idx"), dies("id").alias("body")), folder, "s")
    assert listing(folder) == [] and LF.literal_manifest(spark, folder).count() == 0
    with pytest.raises(Exception, match="limited to 3"):
        LF.write_literal_files(spark.range(8).select(F.col("id").alias("event_idx"), F.lit("x").alias("body")), folder, "s", max_files=3)
    assert listing(folder) == []


def test_attempts_that_are_not_committed_are_not_published(tmp_path):
    """A task that ran twice has staged twice; the commit knows one of them."""
    import pyarrow as pa

    writer = LF.EventFileWriter(str(tmp_path), "s", 10)
    batch = pa.RecordBatch.from_pydict({"event_idx": [1, 0], "content": ["b\n", "a\n"]})
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), None])
    assert listing(tmp_path) == ["s.log", "s_0002.log"] and (tmp_path / "s.log").read_text() == "a\n"
    manifest = [json.loads(x) for n in os.listdir(tmp_path / "_manifests") for x in open(tmp_path / "_manifests" / n)]
    assert [m["file_name"] for m in manifest] == ["s.log", "s_0002.log"] and not os.listdir(tmp_path / "_staging")


def test_a_failed_commit_takes_its_names_back(tmp_path, monkeypatch):
    import pyarrow as pa

    writer = LF.EventFileWriter(str(tmp_path), "s", 10)
    done = writer.write(iter([pa.RecordBatch.from_pydict({"event_idx": [0, 1], "content": ["a\n", "b\n"]})]))
    link, calls = os.link, []

    def fails(a, b):
        calls.append(b)
        if len(calls) == 2:
            raise OSError("disk full")
        link(a, b)

    monkeypatch.setattr(os, "link", fails)
    with pytest.raises(OSError, match="disk full"):
        writer.commit([done])
    assert listing(tmp_path) == []


def test_bodies_are_not_shuffled_for_taken_names(spark):
    events = spark.range(100).select(F.col("id").alias("event_idx"), F.lit("x").alias("body"))
    plan = EF.event_files(events, "s", taken=spark.createDataFrame([(3,), (4,)], "file_index long"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


# --- streams ------------------------------------------------------------------------------------------


def arrive(frames, build):
    """Each element of ``frames`` holds the next part of every input stream; the stream is run after each, from where it stopped."""
    spark = frames[0][0].sparkSession
    folders, out = [fresh_folder(spark, "in") for _ in frames[0]], fresh_folder(spark, "out")
    for k, tables in enumerate(frames):
        for folder, table in zip(folders, tables):
            table.write.mode("append").parquet(folder)
        if k == 0:
            streams = [spark.readStream.schema(t.schema).parquet(f) for f, t in zip(folders, tables)]
        result = J.run_available(build(*streams), "out", out)
    return result.collect()


def in_files(spark, df, by, n):
    folder = fresh_folder(spark, "in")
    df.repartitionByRange(n, by).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stopped_stream_goes_on_without_loss_or_doubles(spark):
    sink = fresh_folder(spark, "sink")
    stream = in_files(spark, spark.range(100).withColumnRenamed("id", "event_idx"), "event_idx", 5)
    calls = []

    def dies(batch):
        calls.append(batch)
        if batch == 2 and calls.count(2) == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        CO.exactly_once(stream, sink, before_entry=dies).awaitTermination()
    half = CO.read_committed(spark, sink, stream.schema)
    assert half.count() == half.select("event_idx").distinct().count() < 100  # the batch without an entry is not there
    CO.exactly_once(stream, sink, before_entry=dies).awaitTermination()
    CO.exactly_once(stream, sink, before_entry=dies).awaitTermination()  # nothing new: nothing happens
    rows = CO.read_committed(spark, sink, stream.schema)
    assert sorted(r.event_idx for r in rows.collect()) == list(range(100))
    assert calls.count(2) == 2 and CO.Ledger(spark, sink).batches() == list(range(5))


def test_a_batch_with_an_entry_is_not_written_again(spark):
    """The process dies after the entry and before the checkpoint: the batch comes once more."""
    sink = fresh_folder(spark, "sink")
    CO.Ledger(spark, sink).enter(0, {})
    spark.range(3).withColumnRenamed("id", "event_idx").write.parquet(f"{sink}/data/batch=0")
    stream = in_files(spark, spark.range(7).withColumnRenamed("id", "event_idx"), "event_idx", 1)
    CO.exactly_once(stream, sink).awaitTermination()
    assert CO.read_committed(spark, sink, stream.schema).count() == 3


def test_rate_source_feeds_the_sink(spark, request):
    from veilworks.operators.synthesis import Clock

    catalog = read_catalog(spark, str(request.config.rootpath / "tests/fixtures/catalog.json"))
    rows = J.synthesize_stream(J.rate_source(spark, 200, 2), catalog, Clock.between("2030-01-02", "2030-01-02"))
    sink = fresh_folder(spark, "sink")
    for k in (1, 2):  # stopped and started again
        query = CO.exactly_once(rows, sink, trigger={"processingTime": "500 milliseconds"})
        while len(CO.Ledger(spark, sink).batches()) < 3 * k and query.isActive:
            query.awaitTermination(0.5)
        query.stop()
    seen = sorted(r.event_idx for r in CO.read_committed(spark, sink, rows.schema).select("event_idx").collect())
    assert seen and seen == list(range(len(seen)))


def lanes(spark, seed, n=250):
    rnd = random.Random(seed)
    rows = [(lane, i, rnd.choice([10, 500, 3000, 65_000, 20, 60_000]), 1000 + i) for lane in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "lane long, seq long, bytes long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")


@pytest.mark.parametrize("files, by, soft", [(1, "seq", False), (4, "seq", False), (3, "rand(5)", False), (3, "rand(6)", True)])
def test_packing_does_not_depend_on_the_cut_of_the_stream(spark, files, by, soft):
    df = lanes(spark, files)
    want = sorted(tuple(r) for r in K.next_fit(df, 61_440, 20, soft).select("lane", "seq", "bytes", "packet_no").collect())
    rows = in_files(spark, df.withColumn("h", F.expr(by)), "h", files).drop("h")
    out = J.run_available(ST.pack_lanes(rows, 61_440, 20, soft, lateness="1 day"), "p")
    assert sorted(tuple(r) for r in out.select("lane", "seq", "bytes", "packet_no").collect()) == want


def test_a_lane_that_ends_behind_a_gap_is_packed_and_freed(spark):
    rows = [(1, 0, 10, 1000), (1, 2, 20, 1001), (1, 3, 30, 1002), (1, 2, 20, 1002), (2, 0, 5, 90_000), (2, 1, 5, 90_001), (2, 2, 5, 180_000)]
    df = spark.createDataFrame(rows, "lane long, seq long, bytes long, t long").withColumn("ts", F.timestamp_seconds("t"))
    parts = [[df.where(f"t >= {a} and t < {b}").drop("t")] for a, b in ((0, 1001), (1001, 2000), (2000, 100_000), (100_000, 200_000))]
    got = sorted(tuple(r) for r in arrive(parts, lambda s: ST.pack_lanes(s, 100, 50, lateness="1 second", idle="1 hour")))
    assert [g for g in got if g[0] == 1] == [(1, 0, 10, 0), (1, 2, 20, 0), (1, 3, 30, 0)]


def test_streamed_steps_equal_the_batch(spark):
    rnd = random.Random(9)
    rows, t = [], 1_000_000
    for _ in range(300):
        t += rnd.choice([50, 200, 200, 400, 900, 2900, 3000, 9000])
        rows += [(rnd.choice("ab"), t + rnd.randrange(150)) for _ in range(rnd.randrange(1, 4))]
    rows += [("end", t + 10_000_000)]
    df = spark.createDataFrame(rows, "run string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    batch = {(r.run, r.tick): (r.events, round(r.eps, 9), r.idle_before) for r in M.step_rates(df, "run", "ts").collect() if r.run != "end"}
    cuts = [0, 1_200_000, 1_300_000, 1_301_000, t, t + 20_000_000]
    parts = [[df.where(f"ms >= {a} and ms < {b}").drop("ms")] for a, b in zip(cuts, cuts[1:])]
    out = arrive(parts, lambda s: ST.step_rates(s, "run", "ts", lateness="2 seconds"))
    assert {(r.run, r.tick): (r.events, round(r.eps, 9), r.idle_before) for r in out if r.tick is not None} == batch
    for run in "ab":  # the rate drops to zero before each step that says so, and after the last one
        idle = sorted(r.at_ms for r in out if r.run == run and r.tick is None)
        steps = sorted(k[1] for k in batch if k[0] == run)
        want = []
        for i, tick in enumerate(steps):
            hold = max(3000, 3 * (tick - steps[i - 1]) * 200) if i else 3000
            if i + 1 == len(steps) or (steps[i + 1] - tick) * 200 >= hold:
                want.append(tick * 200 + hold)
        assert idle == want


def test_delivery_of_two_streams(spark):
    sent = spark.createDataFrame([(i, 1000 + i * 60) for i in range(100)], "event_id long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    lost = {3, 50, 51}
    got = [(i, 1000 + i * 60 + 5) for i in range(100) if i not in lost] + [(7, 1000 + 7 * 60 + 6), (900, 1500)]  # one repeated, one that nobody sent
    received = spark.createDataFrame(got, "event_id long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    end = spark.createDataFrame([(-1, 500_000)], "event_id long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    parts = [[sent.where(c), received.where(c)] for c in ("unix_seconds(ts) < 2500", "unix_seconds(ts) between 2500 and 4000", "unix_seconds(ts) > 4000")] + [[end, end]]
    rows = arrive(parts, lambda a, b: ST.delivery_rows(a, b, "event_id", "ts", "10 minutes", "10 minutes"))
    assert {r.event_id for r in rows if r.received_at is None} == lost
    assert {r.event_id for r in rows if r.sent_at is None} == {900}
    both = [r.event_id for r in rows if r.sent_at and r.received_at and r.event_id >= 0]
    assert sorted(both) == sorted([i for i in range(100) if i not in lost] + [7])
    left = {(r.event_id) for r in M.lost_events(sent, received, ["event_id"]).collect()}
    assert left == lost


def test_late_rows_are_counted(spark):
    folder = fresh_folder(spark, "late")
    schema = "event_id long, ts timestamp"
    for k, rows in enumerate([[(1, 1000)], [(2, 900_000)], [(3, 1001)], [(4, 900_001)]]):
        spark.createDataFrame(rows, "event_id long, t long").select("event_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    query = ST.delivery_rows(stream(), stream(), "event_id", "ts", "1 minute", "1 minute").writeStream.format("memory").queryName("late_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.table("late_rows").where("sent_at is not null and received_at is not null").count()
    assert kept + ST.dropped_rows(query) // 2 == 4


# --- one-to-one pseudonyms ----------------------------------------------------------------------------


def test_number_pseudonyms_are_one_to_one(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), None, *range(2, 5000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    out = df.select("v", B.number_pseudonym(F.col("v"), "k").alias("p"), B.number_pseudonym(F.col("v"), "other").alias("q")).withColumn("back", B.number_original(F.col("p"), "k")).collect()
    assert all(r.back == r.v for r in out) and len({r.p for r in out}) == len(values)
    assert sum(r.p == r.v or r.p == r.q for r in out if r.v is not None) == 0
    plan = df.select(B.number_pseudonym(F.col("v"), "k"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_text_pseudonyms_keep_the_shape(spark):
    values = ["Customer#000000017", "a", "Z", "7", "", "é-!", "x9", "kim@corp.kr", "010-1234-5678", "w" * 3000, None] + [f"{i:03d}" for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    out = df.select("v", B.text_pseudonym(F.col("v"), "k").alias("p"), B.text_pseudonym(F.col("v"), "other").alias("q")).withColumn("back", B.text_original(F.col("p"), "k")).collect()
    shape = lambda t: t and "".join("9" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in t)
    assert all(r.back == r.v and shape(r.p) == shape(r.v) for r in out)
    assert {r.p for r in out if r.v and len(r.v) == 3 and r.v.isdigit()} == {f"{i:03d}" for i in range(1000)}  # a permutation of all
    long = [r for r in out if r.v and len(r.v) > 8]
    assert all(r.p != r.v and r.q != r.p for r in long)


# --- rules as a table ---------------------------------------------------------------------------------


@pytest.mark.parametrize("way", ["automata", "postings"])
def test_rules_of_a_table_equal_the_list(spark, way):
    words = ["name", "ldap_tel", "src_ip", "Mac", "x-mac", "mac.y", "my_ip", "ip", "ip_x", "zip", "addr", "addr_ip", "ip_address", "mac_address", "restore_time", "steam", "token_type", "payload", "path", "zz", "", "a" * 500, "Employee-No", "phone.home", "ldap_telx"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate([*words, None, "name"])], "n long, field string")
    got = {r.n: r.kind for r in R.classify(df, R.rules_table(spark), way=way).collect()}
    assert got == {r.n: r.kind for r in df.select("n", kind_of(normalize(F.col("field"))).alias("kind")).collect()}


def test_rules_are_data(spark):
    rules = spark.createDataFrame([(2, "contains", "card", "CARD", None, None), (1, "prefix", "gift_", None, None, None), (3, "contains", "", "ANY", "x", None), (2, "contains", "card", "ACARD", None, "id_card")], R.RULES)
    df = spark.createDataFrame([(w,) for w in ("Card-No", "gift_card", "plain", "xx", "id_card")], "field string")
    assert {r.field: r.kind for r in R.classify(df, rules).collect()} == {"Card-No": "ACARD", "gift_card": None, "plain": "ANY", "xx": None, "id_card": "CARD"}
    assert {r.kind for r in R.classify(df, rules.limit(0)).collect()} == {None}
    assert C.search(df.withColumn("search_text", F.col("field")), "card").count() == 2


# --- compiled forms between runs ----------------------------------------------------------------------


def test_a_second_run_compiles_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(
        [(i, f"{i:04d}", "n", s, "", c) for i, (s, c) in enumerate([("at 2024-01-02T03:04:05Z kim@corp.kr", {}), (None, {}), ("at 2024-01-02T03:04:05Z kim@corp.kr", None), ("x {{FILE_PATH}}", {"FILE_PATH": ["/a"]})])], TEMPLATE
    )
    path = f"file://{tmp_path}/store"
    key = lambda df: sorted((r.id, r.compiled_fp, str(r.segments), r.n_timestamps, r.kind_mask) for r in df.collect())
    want = key(C.compile_distinct(rows))
    store = Snapshots(spark, path)
    parts = lambda: [spark.read.parquet(f"{path}/data/{p}").count() for p in store.version().about["parts"]]
    assert key(CS.compile_stored(rows.where("id != '0003'"), path)) == [w for w in want if w[0] != "0003"] and parts() == [2]
    assert key(CS.compile_stored(rows, path)) == want and parts() == [2, 1]
    at = store.current()
    assert key(CS.compile_stored(rows, path)) == want and store.current() == at and parts() == [2, 1]
    assert key(CS.compile_stored(rows.limit(0), path)) == [] and store.current() == at
    assert len(store.expire(keep=1, grace_seconds=0)) == 2 and key(CS.compile_stored(rows, path)) == want  # the parts stay
    monkeypatch.setattr(CS, "code_version", lambda options=None: "other")
    assert key(CS.compile_stored(rows, path)) == want and parts() == [3]


# --- long texts ---------------------------------------------------------------------------------------


def test_positions_of_very_many_stamps_take_linear_time(spark):
    import time

    from veilworks.functions import timestamps as T

    text = lambda n: " ".join(f"2024-01-{1 + i % 28:02d}T03:04:{i % 60:02d}Z {i}" for i in range(n))
    mark = lambda t: spark.createDataFrame([(t,)], "t string").select(T.resolved(F.col("t")).alias("s"))
    for n in (255, 256, 257, 513):
        t = text(n)
        spans = mark(t).first()["s"]
        assert len(spans) == n and all(t[s.pos : s.pos - s.neg_len] == s.raw for s in spans)
    mark(text(1000)).first()
    started = time.time()
    assert len(mark(text(30_000)).first()["s"]) == 30_000
    assert time.time() - started < 30

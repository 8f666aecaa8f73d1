"""Named jobs over the driver tables. Every one reads its whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timestamps as T
from ..functions import fixed as V
from ..functions.columns import int_div
from ..functions.framing import newline_framed_size, octet_framed_size
from ..functions.templates import kind_bit
from ..operators import catalog as C
from ..operators import deid as D
from ..operators import metering as M
from ..operators import packing as K
from ..operators import synthesis as S
from ..operators.dimensions import profile_attribute, profile_values, styles, token_kinds
from ..operators.ordering import dense_index
from ..session import fresh_folder, stored_step
from ..sources.catalog_document import read_document
from ..sources.catalog_files import export_document, read_entries, read_raw_catalog, write_catalog
from ..sources.event_files import event_files, write_event_files
from ..sources.tables import dealt, read_table, spread
from ..streaming import jobs as J
from . import lines as L

RANGE = ("2030-01-02", "2030-01-05")
COMPANIES = ["lottermart", "LotteMart", "plain", "TEST123"]
FORBIDDEN = ["password", "secret", "Ωmega"]


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents").select("doc_id", "text", *columns), "doc_id")


# --- de-identification ------------------------------------------------------------------------------


def deid_token_counts(spark, sf):
    return D.token_counts(_docs(spark, sf, "source"), "source", "text")


def deid_text_rewrite(spark, sf):
    docs = _docs(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("row_id"), "text")
    talk = read_table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("row_id"), "text"
    )
    return D.sanitize_table(docs.unionByName(talk), "text")


def deid_pages(spark, sf):
    pages = spread(read_table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return D.sanitize_table(pages, "html")


def deid_contacts(spark, sf):
    return D.sanitize_table(L.contact_lines(spark, sf), "line").select("row_id", "line")


def _field_texts(spark, sf):
    pages = read_table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("row_id"), F.col("html").alias("text"))
    docs = read_table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("row_id"), "text")
    events = read_table(spark, sf, "events").select(F.concat(F.lit("e"), "event_id").alias("row_id"), F.col("props").alias("text"))
    return pages.unionByName(docs).unionByName(events)


def extract_fields(spark, sf):
    return D.extract_fields(_field_texts(spark, sf), "row_id", "text", positions=False).select(
        "row_id", F.col("field_no").cast("long").alias("field_no"), "field", "value", "quoted"
    )


def field_dictionary(spark, sf):
    return D.field_dictionary(D.extract_fields(_field_texts(spark, sf), "row_id", "text", positions=False))


def classify_line_fields(spark, sf):
    """Every field of the contact and event lines with its kind, counted."""
    both = L.contact_lines(spark, sf).select("row_id", "line").unionByName(L.log_lines(spark, sf).select("row_id", "line"))
    return D.field_dictionary(D.extract_fields(both, "row_id", "line", positions=False))


def privacy_audit(spark, sf):
    return D.privacy_audit(_docs(spark, sf, "source"), "source", "text", FORBIDDEN)


def privacy_audit_lines(spark, sf):
    """Event lines before and after tokenizing, with the event's JSON properties behind them."""
    e = read_table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "props")
    raw = L.log_lines(spark, sf).join(e, "row_id").select(
        F.concat(F.col("source"), F.lit(":raw")).alias("stage"),
        F.concat(F.col("line"), F.lit(" Chrome/120.0.0.0 "), F.col("props")).alias("line"),
    )
    done = D.tokenize_column(raw, "line").withColumn("stage", F.regexp_replace("stage", ":raw$", ":done"))
    return D.privacy_audit(raw.unionByName(done), "stage", "line", json_from_brace=False)


def invalid_json_payloads(spark, sf):
    """JSON payloads of events; every third one is cut short."""
    e = read_table(spark, sf, "events")
    cut = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props"))
    rows = e.select("event_type", F.concat(F.lit("/log/x.json,"), cut).alias("line"))
    return D.privacy_audit(rows, "event_type", "line", json_from_brace=True).select("event_type", "n_rows", "invalid_json")


def mask_endpoints(spark, sf):
    return D.mask_endpoints_table(L.log_lines(spark, sf), "line").select("row_id", "line")


def tokenize_lines(spark, sf):
    return D.tokenize_column(L.log_lines(spark, sf), "line").select("row_id", "line")


def pseudonymize_contacts(spark, sf):
    """Sanitized contact lines, every marker of a customer from identity ``custkey mod 50``."""
    lines = D.sanitize_table(L.contact_lines(spark, sf), "line")
    idx = F.pmod("row_id", F.lit(V.PROFILE_COUNT)).cast("int")
    return D.pseudonymize(lines, "row_id", "line", profile=idx).select("row_id", F.col("profile_idx").cast("long"), "line")


def pseudonymize_hashed(spark, sf):
    """Hash-chosen identities: every customer has one of the fifty, and no marker is left."""
    lines = D.sanitize_table(L.contact_lines(spark, sf), "line")
    return D.pseudonymize(lines, "row_id", "line").groupBy("source").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("line").contains("{{")).alias("left_over"),
        F.count_if(~F.col("profile_idx").between(0, V.PROFILE_COUNT - 1)).alias("outside"),
    )


def stable_pseudonyms(spark, sf):
    """Equal originals get equal synthetic values in every table that holds them (orders join customers)."""
    c = read_table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("C"), "c_custkey").alias("account"))
    o = read_table(spark, sf, "orders").select("o_custkey", F.concat(F.lit("C"), "o_custkey").alias("o_account"))
    c = D.stable_pseudonymize(c, "account", "USER_ID")
    o = D.stable_pseudonymize(o, "o_account", "USER_ID")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("account") != F.col("o_account")).alias("broken")
    )


def synthetic_people(spark, sf):
    """All sixteen attributes of the identity each customer is mapped to."""
    c = read_table(spark, sf, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(V.PROFILE_COUNT)).cast("int").alias("p"))
    return c.select("c_custkey", *[profile_attribute(k, F.col("p")).alias(k.lower()) for k in V.KINDS])


def synthetic_values(spark, sf):
    """The long form of the identities, weighted by the customers mapped to them."""
    c = read_table(spark, sf, "customer").groupBy(F.pmod("c_custkey", F.lit(V.PROFILE_COUNT)).cast("int").alias("profile_idx")).agg(
        F.count(F.lit(1)).alias("customers")
    )
    return c.join(F.broadcast(profile_values(spark)), "profile_idx").select(
        F.col("profile_idx").cast("long"), "kind", "value", "customers"
    )


def dictionary_terms(spark, sf):
    """Search vocabulary of the kinds found in each document."""
    counts = D.token_counts(_docs(spark, sf).withColumnRenamed("doc_id", "row_id"), "row_id", "text")
    masks = counts.groupBy("row_id").agg(F.bit_or(kind_bit(F.col("kind"))).alias("kind_mask"))
    return masks.select("row_id", F.col("kind_mask").cast("long"), D.dictionary_terms(masks, "kind_mask").alias("terms"))


def token_totals(spark, sf):
    """Token kinds joined with their dimension: ordinal, bit, marker and how often contact lines hold them."""
    counts = D.token_counts(L.contact_lines(spark, sf), "source", "line")
    total = counts.groupBy("kind").agg(F.sum("tokens").cast("long").alias("tokens"))
    dim = token_kinds(spark).select("kind", F.col("ordinal").cast("long"), F.col("bit").cast("long"), "marker")
    return total.join(F.broadcast(dim), "kind")


# --- timestamps -------------------------------------------------------------------------------------


def _spans(spark, sf):
    lines = L.order_lines(spark, sf).select("row_id", "source", "line")
    return lines.select("row_id", "source", F.posexplode(T.resolved(F.col("line"))).alias("n", "s"))


def detect_timestamps(spark, sf):
    return _spans(spark, sf).select(
        "row_id", F.col("s.pos").cast("long").alias("pos"), (-F.col("s.neg_len")).cast("long").alias("len"),
        F.col("s.style").alias("style"), F.col("s.raw").alias("raw"),
    )


def timestamp_profile(spark, sf):
    """Styles and their written features per source, with totals over each source."""
    rows = _spans(spark, sf).select("source", T.token(F.col("s.style"), F.col("s.raw")).alias("tok")).select("source", "tok.*")
    out = rows.groupBy(
        "source", "style", "date_sep", "time_sep", "fraction_digits", "hour_width", "zone_minutes", "has_weekday", "zone"
    ).agg(F.count(F.lit(1)).alias("n"))
    for c in ("fraction_digits", "hour_width", "zone_minutes"):
        out = out.withColumn(c, F.col(c).cast("long"))
    return out


def timestamp_totals(spark, sf):
    """Spans per source and style with subtotals, and the display name of the style."""
    counts = _spans(spark, sf).select("source", F.col("s.style").alias("style")).rollup("source", "style").agg(
        F.count(F.lit(1)).alias("n")
    )
    names = styles(spark).select("style", "display_name")
    return counts.join(F.broadcast(names), "style", "left").select(
        F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("style", F.lit("*")).alias("style"),
        F.coalesce("display_name", F.lit("*")).alias("display_name"), "n",
    )


def mark_timestamps(spark, sf):
    return L.order_lines(spark, sf).select("row_id", T.mark(F.col("line")).alias("line"))


def rebase_timestamps(spark, sf):
    """Every order line re-dated by 1000 days and 1 hour in its own format (calendar mode)."""
    moved = F.col("t") + F.make_dt_interval(days=F.lit(1000), hours=F.lit(1))
    return L.order_lines(spark, sf).select("row_id", T.rebased(F.col("line"), moved, calendar=True).alias("line"))


def rebase_zoned(spark, sf):
    """The same in offset mode: written zones shift the clock, unzoned stamps use the local zone (+09:00)."""
    return L.order_lines(spark, sf).select("row_id", T.rebased(F.col("line"), F.col("t"), local_tz="+09:00").alias("line"))


def timestamps_several(spark, sf):
    """Lines with a one-digit hour, a zone and a fraction behind one another, and a date that lies inside a longer stamp."""
    day = F.date_format("t", "yyyy/MM/dd")
    line = F.concat(
        F.lit("u="), day, F.lit(" "), F.date_format("t", "H:mm:ss"), F.lit(" ["), F.date_format("t", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0530] run "),
        F.date_format("t", "yyyyMMdd'T'HHmmss"), F.lit(".5-0330 born="), day, F.lit(" kept_month="), F.date_format("t", "yyyy-MM"),
    )
    return L.order_lines(spark, sf).select("row_id", T.mark(line).alias("line"))


# --- catalog ----------------------------------------------------------------------------------------


def catalog_validate(spark, sf):
    """Violations of a catalog derived from the customers, with each kind of mistake in it."""
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    rows = c.select(
        F.when(k % 11 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 13 == 0, F.lit("7")).otherwise(k.cast("string")).alias("id"),
        F.when(k % 17 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 19 == 0, F.lit("")).otherwise(F.lit("a {{FILE_PATH}} b {{FILE_PATH}}")).alias("sample"),
        F.when(k % 23 == 0, F.create_map(F.lit("File"), F.array().cast("array<string>")))
        .otherwise(F.create_map(F.lit("FILE_PATH"), F.when(k % 29 == 0, F.array(F.lit("one"))).otherwise(F.array(F.lit("one"), F.lit("two")))))
        .alias("test_case"),
    )
    return C.catalog_violations(rows).groupBy("id", "rule").agg(F.count(F.lit(1)).alias("n"))


def catalog_next_id(spark, sf):
    c = read_table(spark, sf, "customer")
    return C.next_id(c.select(C.padded_id(F.col("c_custkey")).alias("id")))


def catalog_upsert(spark, sf):
    """Suppliers edit the part catalog: even keys replace the row of that id, odd keys append a new one."""
    s = read_table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    edits = s.select(
        k.cast("int").alias("pos"),
        F.when(k % 2 == 0, C.padded_id(k)).alias("id"),
        F.col("s_name").alias("name"), F.lit("edited").alias("sample"), F.lit("").alias("source"),
        F.create_map().cast("map<string,array<string>>").alias("test_case"),
    )
    out = C.upsert(L.part_templates(spark, sf), edits)
    return out.select(F.col("pos").cast("long"), "id", "name", "source")


def catalog_delete(spark, sf):
    """Parts that some line item returned leave the catalog."""
    gone = read_table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40)).select(C.padded_id(F.col("l_partkey")).alias("id"))
    return C.list_catalog(C.delete(L.part_templates(spark, sf), gone))


def catalog_select(spark, sf):
    """Parts requested by line items, in catalog order (semi join)."""
    wanted = read_table(spark, sf, "lineitem").where((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 10)).select(C.padded_id(F.col("l_partkey")).alias("id"))
    return C.list_catalog(C.select_templates(L.part_templates(spark, sf), wanted))


def catalog_unknown_ids(spark, sf):
    """Requested ids that the catalog does not hold (customers are more than parts have keys)."""
    wanted = read_table(spark, sf, "customer").select(C.padded_id(F.col("c_custkey") + 1000).alias("id"))
    return C.unknown_ids(L.part_templates(spark, sf), wanted)


def catalog_roundtrip(spark, sf):
    """Written (tokenized first) and read back."""
    path = fresh_folder(spark, "catalog")
    parts = L.part_templates(spark, sf)
    write_catalog(parts, path)
    return read_entries(spark, path).select(
        F.col("pos").cast("long"), "id", "name", "sample", "source", F.array_join(F.map_keys("test_case"), ",").alias("tokens"),
        F.array_join(F.flatten(F.map_values("test_case")), ",").alias("mapped"),
    )


def catalog_document(spark, sf):
    """Exported as one document and read by the tasks of its splits."""
    path = fresh_folder(spark, "catalog")
    export_document(L.part_templates(spark, sf), path)
    return read_document(spark, path).select((F.col("pos") + 1).cast("long").alias("nth"), "id", "name", "sample", "source")


def catalog_roundtrip_unordered(spark, sf):
    """A catalog of all orders whose ids are not in file order, written and read back."""
    o = read_table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("int").alias("pos"), C.padded_id(F.lit(100_000_000) - F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("name"),
        F.concat(F.lit("x "), F.col("o_orderstatus")).alias("sample"), F.lit("").alias("source"), F.create_map().cast("map<string,array<string>>").alias("test_case"),
    )
    path = fresh_folder(spark, "catalog")
    write_catalog(rows, path)
    return read_entries(spark, path).select(F.col("pos").cast("long"), "id", "name", "sample")


def _with_nulls(spark, sf):
    """Customers as templates; some have no sample, no test case, no name or no id."""
    k = F.col("c_custkey")
    none = F.lit(None)
    case = F.create_map().cast("map<string,array<string>>")
    return read_table(spark, sf, "customer").select(
        k.cast("int").alias("pos"), F.when(k % 11 != 0, k.cast("string")).otherwise(none).alias("id"), F.when(k % 13 != 0, F.lit("n")).otherwise(none).alias("name"),
        F.when(k % 5 != 0, F.concat(F.lit("x "), (k % 3).cast("string"))).otherwise(none).alias("sample"), F.lit("").alias("source"),
        F.when(k % 7 != 0, case).otherwise(none).alias("test_case"),
    )


def compile_with_nulls(spark, sf):
    """No template is lost when samples or test cases are missing; equal ones share a compiled form."""
    out = C.compile_distinct(_with_nulls(spark, sf))
    return out.groupBy(F.coalesce("sample", F.lit("?")).alias("sample")).agg(
        F.count(F.lit(1)).alias("templates"), F.countDistinct("compiled_fp").alias("forms"), F.count("segments").alias("cut")
    )


def catalog_validate_nulls(spark, sf):
    return C.catalog_violations(_with_nulls(spark, sf).withColumn("sample", F.coalesce("sample", F.when(F.col("pos") % 2 == 0, F.lit("s"))))).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n")
    )


def upsert_unknown(spark, sf):
    """Edits that cannot be made: customers edit parts by key, orders of status P edit them a second time."""
    c = read_table(spark, sf, "customer").select(C.padded_id(F.col("c_custkey") * 2).alias("id"))
    o = read_table(spark, sf, "orders").where("o_orderstatus = 'P'").select(C.padded_id(F.col("o_custkey") * 2).alias("id"))
    return C.edit_problems(L.part_templates(spark, sf), c.unionByName(o))


def dense_hashed_ids(spark, sf):
    """Orders numbered in the order of a 60-bit hash of their key."""
    h = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return dense_index(read_table(spark, sf, "orders").select("o_orderkey", h.alias("h")), "h").select("o_orderkey", "seq")


def mapped_paths(spark, sf):
    """Templates whose mapped paths do not fit their markers; every third part has one value too many, every fifth an empty one."""
    p = L.part_templates(spark, sf)
    more = F.when(F.col("pos") % 3 == 0, F.array(F.lit("more"))).when(F.col("pos") % 5 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    changed = p.withColumn("test_case", F.transform_values("test_case", lambda k, v: F.concat(v, more)))
    return D.mapped_path_mismatches(changed).select("id", F.col("markers").cast("long"), F.col("values").cast("long"))


def coverage_shortfalls(spark, sf):
    """Categories of which the catalog has fewer templates than half the customers, a threshold that grows with the tables."""
    need = read_table(spark, sf, "customer").count() // 2
    return C.coverage_shortfalls(C.coverage(C.compile_distinct(L.part_templates(spark, sf))), {"with_timestamp": need, "with_person": 10 * need, "with_privacy": 1})


def deid_company(spark, sf):
    """Company literals in lines of customers, whatever their case."""
    name = F.element_at(F.array(*[F.lit(w) for w in COMPANIES]), (F.pmod("c_custkey", F.lit(len(COMPANIES))) + 1).cast("int"))
    rows = read_table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("vendor "), name, F.lit(" segment "), "c_mktsegment").alias("line"))
    return D.sanitize_table(rows, "line", company_literals=V.COMPANY_LITERALS)


def restore_two_keys(spark, sf):
    """Two keys in one test case; a value of the first brings the marker of the second."""
    p = read_table(spark, sf, "part")
    case = F.create_map(
        F.lit("B"), F.array(F.col("p_type"), F.col("p_brand"), F.lit("end")), F.lit("A"), F.array(F.lit("z{{B}}"), F.col("p_brand")),
    )
    rows = p.select(C.padded_id(F.col("p_partkey")).alias("id"), F.lit("{{A}} {{B}} / {{A}} {{B}}").alias("sample"), case.alias("test_case"))
    return C.restore_mapped_values(rows).select("id", "restored")


def catalog_files_checked(spark, sf):
    """A catalog file per nation and supplier, each with a mistake by its number: violations of every file."""
    k = F.pmod("s_suppkey", F.lit(len(L.FILES)))
    text = F.replace(F.element_at(F.array(*[F.lit(f) for f, _ in L.FILES]), (k + 1).cast("int")), F.lit("%s"), F.col("n_name"))
    names = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = fresh_folder(spark, "files")
    # tasks share the files, and each moves its own to their place
    dealt(names, "s_suppkey").select(F.col("s_suppkey").alias("file"), text.alias("value")).write.partitionBy("file").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    raw = stored_step(read_raw_catalog(spark, path))  # every file is opened once
    bad = C.catalog_file_violations(raw, "file")
    return bad.select(F.regexp_extract("file", "file=([0-9]+)", 1).cast("long").alias("s_suppkey"), "rule")


def restore_mapped_values(spark, sf):
    return C.restore_mapped_values(L.part_templates(spark, sf)).select("id", "restored")


def analyze_templates(spark, sf):
    out = C.compile_distinct(L.part_templates(spark, sf))
    return out.select(
        "id", *[F.col(c).cast("long").alias(c) for c in ("n_timestamps", "n_src", "n_dst", "n_privacy", "kind_mask")],
        F.array_join("styles", ",").alias("styles"),
    )


def compile_segments(spark, sf):
    """Segments of every template, counted by kind and position."""
    out = C.compile_distinct(L.part_templates(spark, sf)).select("id", F.posexplode("segments").alias("seg_no", "s"))
    return out.groupBy(F.col("seg_no").cast("long").alias("seg_no"), F.col("s.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("s.text")).cast("long").alias("chars")
    )


def catalog_coverage(spark, sf):
    out = C.coverage(C.compile_distinct(L.part_templates(spark, sf)))
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


def dedupe_compile(spark, sf):
    """Distinct templates among the documents: first key and copies of each."""
    none = F.create_map().cast("map<string,array<string>>")
    return C.copies(_docs(spark, sf), "doc_id", F.col("text"), none)


def search_docs(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    found = C.search(docs.withColumn("search_text", C.search_text(F.col("source"), F.col("lang"), F.col("text"))), "The S")
    return found.select("doc_id", C.preview(F.col("text")).alias("preview"))


def search_catalog(spark, sf):
    """Templates found through their vocabulary: a search for 'store_code branch_code' finds kind STORE_CODE."""
    compiled = C.compile_distinct(L.part_templates(spark, sf))
    return C.list_catalog(C.search(C.with_search_text(compiled), "STORE_CODE branch_code"))


# --- synthesis --------------------------------------------------------------------------------------


def _event_ids(spark, sf):
    return read_table(spark, sf, "events").select(F.col("event_id").alias("event_idx"))


def _parts(spark, sf):
    return L.part_templates(spark, sf)


def round_robin_events(spark, sf):
    parts = _parts(spark, sf).select("pos", F.col("id").alias("template_id"))
    return S.assign_round_robin(_event_ids(spark, sf), parts).select("event_idx", F.col("ordinal").cast("long"), "template_id")


def round_robin_fairness(spark, sf):
    parts = _parts(spark, sf).select("pos", F.col("id").alias("template_id"))
    events = S.assign_round_robin(_event_ids(spark, sf), parts)
    return M.fairness(events, parts.count())


def event_time_range(spark, sf):
    clock = S.Clock.between(*RANGE)
    return S.assign_event_time(_event_ids(spark, sf), clock).select(
        "event_idx", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time")
    )


def event_time_offset(spark, sf):
    """A rated run of 300 events per second, shifted by -1 day 2 hours 3 minutes."""
    clock = S.Clock(run_at=datetime(2030, 1, 2, 3, 4, 5), offset_minutes=-(1440 + 123), rate=300)
    return S.assign_event_time(_event_ids(spark, sf), clock).select(
        "event_idx", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time")
    )


def _synthesized(spark, sf, clock, events=None):
    programs = S.build_programs(_parts(spark, sf), clock, V.SOURCE_IP, V.DESTINATION_IP)
    by_turn = F.pmod("event_idx", F.lit(V.PROFILE_COUNT)).cast("int")
    return S.expand(dealt(events if events is not None else _event_ids(spark, sf), "event_idx"), programs, clock, profile=by_turn)


def synthesize_events(spark, sf):
    """One printed event per row of ``events`` from the part catalog, identities taken in turn."""
    return _synthesized(spark, sf, S.Clock.between(*RANGE)).select(
        "event_idx", "template_id", F.col("profile_idx").cast("long"), "body"
    )


def synthesize_offset(spark, sf):
    """The same in offset mode with a local zone."""
    clock = S.Clock(run_at=datetime(2030, 1, 2, 3, 4, 5), offset_minutes=90, rate=100, local_tz="+09:00")
    return _synthesized(spark, sf, clock).select("event_idx", "template_id", "body")


def _catalog_of(df, key, sample):
    none = F.create_map().cast("map<string,array<string>>")
    return df.select(F.col(key).cast("int").alias("pos"), C.padded_id(F.col(key)).alias("id"), F.lit("n").alias("name"), sample.alias("sample"), F.lit("").alias("source"), none.alias("test_case"))


def synthesize_large(spark, sf):
    """Events from a catalog with a template per order: too many to print beforehand."""
    sample = F.concat(F.lit("o "), F.col("o_orderkey").cast("string"), F.lit(" seen 2024-03-05 10:11:12.5 by {{PERSON}}"))
    clock = S.Clock.between(*RANGE)
    programs = S.build_programs(_catalog_of(read_table(spark, sf, "orders"), "o_orderkey", sample), clock, V.SOURCE_IP, V.DESTINATION_IP)
    by_turn = F.pmod("event_idx", F.lit(V.PROFILE_COUNT)).cast("int")
    return S.expand(dealt(_event_ids(spark, sf), "event_idx"), programs, clock, profile=by_turn).select("event_idx", "template_id", "body")


def synthesize_many_forms(spark, sf):
    """Customers as templates in sixty written zones: more time forms than are unrolled into code."""
    k = F.col("c_custkey") % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    zone = F.concat(F.lit("+"), two(k % 15), F.lit(":"), two(int_div(k, 15) * 15))
    sample = F.concat(F.lit("z 2024-03-05T10:11:12"), zone, F.lit(" k"), F.col("c_custkey").cast("string"))
    clock = S.Clock(run_at=datetime(2030, 1, 2, 3, 4, 5), offset_minutes=90, rate=100)
    programs = S.build_programs(_catalog_of(read_table(spark, sf, "customer"), "c_custkey", sample), clock, V.SOURCE_IP, V.DESTINATION_IP)
    return S.expand(_event_ids(spark, sf), programs, clock).select("event_idx", "template_id", "body")


def synthesize_summary(spark, sf):
    """Hash-chosen identities over every event: nothing unresolved, shares per template balanced."""
    clock = S.Clock.between(*RANGE)
    programs = S.build_programs(_parts(spark, sf), clock, V.SOURCE_IP, V.DESTINATION_IP)
    out = S.expand(dealt(_event_ids(spark, sf), "event_idx"), programs, clock)
    return out.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("body").contains("{{")).alias("unresolved")
    )


def synthesize_stream(spark, sf):
    """The events table as a stream, expanded with the part catalog."""
    clock = S.Clock.between(*RANGE)
    stream = J.table_stream(spark, f"{sf}/events.parquet").select(F.col("event_id").alias("event_idx"))
    out = J.run_available(_synthesized(spark, sf, clock, stream), "synth")
    return out.select("event_idx", "template_id", F.col("profile_idx").cast("long"), "body")


def sanitize_stream(spark, sf):
    stream = J.table_stream(spark, f"{sf}/documents.parquet").select("doc_id", "text")
    return J.run_available(J.sanitize_stream(stream, "text"), "sanitize")


def windowed_rate_stream(spark, sf):
    """Events per type and hour of the event stream, for the hours that end 10 minutes before its last event or earlier."""
    stream = J.table_stream(spark, f"{sf}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = J.run_available(J.windowed_rate(stream, "event_type", "ts", "1 hour", "10 minutes"), "rate")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "events")


# --- framing, packing, budgets ----------------------------------------------------------------------


def frame_sizes(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", newline_framed_size(F.col("text")).alias("newline_bytes"), octet_framed_size(F.col("text")).alias("octet_bytes"))


def split_batches(spark, sf):
    d = _docs(spark, sf)
    return K.split_batches(d, "doc_id", "text").select("doc_id", F.col("event_no").cast("long").alias("event_no"), "event")


def event_file_manifest(spark, sf):
    """Names and sizes of one file per event; the indexes of all suppliers' keys are taken already."""
    lines = L.log_lines(spark, sf).select(F.col("row_id").alias("event_idx"), F.col("line").alias("body"))
    taken = read_table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("file_index"))
    out = event_files(lines, "20300102_030405_006", taken=taken)
    return out.select("event_idx", "file_name", F.col("bytes").cast("long"))


def event_files_written(spark, sf):
    """Event files written by day: the manifest of the folder, and what the files hold."""
    lines = L.log_lines(spark, sf).select(F.col("row_id").alias("event_idx"), F.col("line").alias("body"), F.date_format("ts", "yyyyMMdd").alias("day"))
    path = fresh_folder(spark, "events")
    files = event_files(lines, "20300102_030405_006", keep=["day"])
    listed = write_event_files(files, path, part=F.col("day"))
    held = spark.read.parquet(path).select("event_idx", F.sha2("content", 256).alias("content_sha256"))
    return listed.join(held, "event_idx").select("part", "event_idx", "file_name", F.col("bytes").cast("long"), "content_sha256")


def budget_bytes(spark, sf):
    """Documents accepted before the byte budget of 1 MB breaks."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return K.budgeted(d, "doc_id", "text", max_bytes=1_000_000).select("doc_id", "stop_reason")


def budget_count(spark, sf):
    """Documents as payloads of lines: 5 000 lines or 2 MB, whichever breaks first."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return K.budgeted(d, "doc_id", "text", max_bytes=2_000_000, max_count=5_000).select("doc_id", "stop_reason")


def _sized_lines(spark, sf, lanes: int = 3):
    """Event lines in lanes: lane w takes w, w + lanes, ..."""
    e = L.log_lines(spark, sf)
    return e.select(
        F.pmod("row_id", F.lit(lanes)).alias("lane"), int_div(F.col("row_id"), lanes).alias("seq"),
        newline_framed_size(F.col("line")).alias("bytes"),
    )


def pack_packets(spark, sf):
    return K.pack_packets(_sized_lines(spark, sf))


def pack_documents(spark, sf):
    """Documents in one lane: many packets hold one large document."""
    d = dense_index(read_table(spark, sf, "documents").select("doc_id", newline_framed_size(F.col("text")).alias("bytes")), "doc_id")
    events = d.select(F.lit(0).cast("long").alias("lane"), "seq", "bytes")
    return K.pack_packets(events, strict=False)


def group_packets(spark, sf):
    """Units of packets: documents and pages as one lane each."""
    d = dense_index(read_table(spark, sf, "documents").select("doc_id", newline_framed_size(F.col("text")).alias("bytes")), "doc_id")
    p = dense_index(read_table(spark, sf, "pages").select("page_id", newline_framed_size(F.col("html")).alias("bytes")), "page_id")
    events = d.select(F.lit(0).cast("long").alias("lane"), "seq", "bytes").unionByName(
        p.select(F.lit(1).cast("long").alias("lane"), "seq", "bytes")
    )
    packets = K.packet_sizes(K.pack_packets(events, strict=False))
    return K.group_packets(packets).select("lane", "packet_no", "bytes", "unit_no")


def batch_stream(spark, sf):
    """File batches: below 256 events and 64 KiB, checked before adding."""
    return K.batch_stream(_sized_lines(spark, sf), "file")


def batch_stream_kind(spark, sf):
    """Stream batches: below 1 024 events and 1 MiB; a lane holds them all."""
    return K.batch_stream(_sized_lines(spark, sf, 1), "stream")


def budget_duration(spark, sf):
    """Documents that come every 10 ms, for 5 seconds or 3 MB."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") * 10).alias("ms"))
    return K.budgeted(d, "doc_id", "text", max_ms=5_000, max_bytes=3_000_000, elapsed_ms="ms").select("doc_id", "stop_reason")


def batch_documents(spark, sf):
    """The same over documents in one lane, where the byte limit decides."""
    d = dense_index(read_table(spark, sf, "documents").select("doc_id", newline_framed_size(F.col("text")).alias("bytes")), "doc_id")
    return K.batch_stream(d.select(F.lit(0).cast("long").alias("lane"), "seq", "bytes"), "file")


# --- metering ---------------------------------------------------------------------------------------


def throughput_summary(spark, sf):
    """Event lines per type and user lane, with totals per type and overall."""
    e = L.log_lines(spark, sf)
    samples = e.select(
        F.col("source").alias("run_id"), F.pmod("row_id", F.lit(4)).alias("lane"), "ts", F.lit(1).alias("events"), F.lit(1).alias("packets"),
        newline_framed_size(F.col("line")).alias("bytes"), F.lit(0).alias("errors"),
    )
    out = M.throughput_summary(samples, ["run_id", "lane"], "ts", lanes=True)
    return out.select(
        F.coalesce("run_id", F.lit("*")).alias("run_id"), F.coalesce(F.col("lane"), F.lit(-1)).cast("long").alias("lane"),
        "events", "packets", "bytes", "errors", F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
        F.round("average_eps", 6).alias("average_eps"), F.round("average_pps", 6).alias("average_pps"), "events_text", "bytes_text",
    )


def step_rates(spark, sf):
    e = read_table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return M.step_rates(e, "event_type", "ts").withColumn("eps", F.round("eps", 6))


def _sides(spark, sf):
    lines = L.log_lines(spark, sf).select(
        F.col("source").alias("run_id"), F.col("row_id").alias("event_id"), F.concat(F.col("line"), F.lit("\n")).alias("payload"), "ts"
    )
    value = read_table(spark, sf, "events").select("event_id", "value")
    received = lines.join(value, "event_id").where(F.col("value") > 1.0)
    return lines, received.select(*lines.columns)


def delivery_reconciliation(spark, sf):
    """Events above a value count as received."""
    sent, received = _sides(spark, sf)
    out = M.delivery(sent, received, "run_id", "payload", "ts", target_eps=0.0)
    return out.withColumn("delivery_ratio", F.round("delivery_ratio", 6)).withColumn(
        "received_eps", F.round("received_eps", 6)
    ).withColumn("received_seconds", F.round("received_seconds", 3))


def lost_events(spark, sf):
    sent, received = _sides(spark, sf)
    return M.lost_events(sent, received, ["run_id", "event_id"]).select("run_id", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        deid_token_counts, deid_text_rewrite, deid_pages, deid_contacts, extract_fields, field_dictionary, classify_line_fields,
        privacy_audit, privacy_audit_lines, invalid_json_payloads, mask_endpoints, tokenize_lines, pseudonymize_contacts,
        pseudonymize_hashed, stable_pseudonyms, synthetic_people, synthetic_values, dictionary_terms, token_totals,
        detect_timestamps, timestamp_profile, timestamp_totals, mark_timestamps, rebase_timestamps, rebase_zoned, timestamps_several,
        catalog_validate, catalog_next_id, catalog_upsert, catalog_delete, catalog_select, catalog_unknown_ids, catalog_roundtrip, catalog_document, catalog_roundtrip_unordered,
        compile_with_nulls, catalog_validate_nulls, upsert_unknown, dense_hashed_ids, mapped_paths, coverage_shortfalls, deid_company,
        restore_mapped_values, restore_two_keys, catalog_files_checked, analyze_templates, compile_segments, catalog_coverage, dedupe_compile, search_docs, search_catalog,
        round_robin_events, round_robin_fairness, event_time_range, event_time_offset, synthesize_events, synthesize_offset,
        synthesize_large, synthesize_many_forms, synthesize_summary, synthesize_stream, sanitize_stream, windowed_rate_stream,
        frame_sizes, split_batches, event_file_manifest, event_files_written, budget_bytes, budget_count, pack_packets, pack_documents, group_packets,
        batch_stream, batch_stream_kind, batch_documents, budget_duration,
        throughput_summary, step_rates, delivery_reconciliation, lost_events,
    )
}

"""Templates: restoring mapped values, cutting text into segments, describing and printing segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from . import timestamps as T
from .columns import bind
from .sanitize import mask_endpoints, sanitize

TOKEN_MARKER = r"\{\{(?:" + "|".join(V.KINDS) + r")\}\}"
ENDPOINT_MARKER = r"\{\{(?:SRC_IP|DST_IP)\}\}"
SEGMENT = f"struct<kind:string,text:string,token:{T.TOKEN}>"
SEGMENTS = f"array<{SEGMENT}>"


def tokenize(text: Column, **options) -> Column:
    """sanitize, then endpoints, then timestamps. Idempotent."""
    return T.mark(mask_endpoints(sanitize(text, **options)))


def entries(test_case: Column) -> Column:
    """Map entries by ascending key: substitution depends on the order."""
    return F.array_sort(F.map_entries(test_case))


def _quoted_marker(key: Column) -> Column:
    return F.concat(F.lit(r"\{\{"), key, F.lit(r"\}\}"))


def restored(sample: Column, test_case: Column, tokenized: bool = False, **options) -> Column:
    """n-th ``{{KEY}}`` becomes the n-th (sanitized) value of KEY. NULL when a key or a count is wrong.

    ``tokenized``: the values are sanitized already and taken as they are.
    """

    def fill(text: Column, entry: Column) -> Column:
        values = entry["value"] if tokenized else F.transform(entry["value"], lambda v: sanitize(v, **options))
        gaps = F.split(text, _quoted_marker(entry["key"]), -1)
        ok = entry["key"].rlike("^[A-Z_]+$") & (F.size(gaps) == F.size(entry["value"]) + 1)
        return F.when(
            ok, F.array_join(F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
        )

    return F.when(F.size(test_case) == 0, sample).otherwise(F.aggregate(entries(test_case), sample, fill))


def _marker_span(rank: Column, m: Column) -> Column:
    name = F.substr(m["raw"], F.lit(3), F.length(m["raw"]) - 4)
    kind = F.when(rank == 100, "privacy").otherwise("endpoint")
    return F.struct(
        m["pos"].alias("pos"), (-F.length(m["raw"])).alias("neg_len"), rank.alias("priority"), kind.alias("kind"),
        name.alias("style"), m["raw"].alias("raw"),
    )


def _empty_token() -> Column:
    return F.lit(None).cast(T.TOKEN)


def _segment(kind: Column, text: Column, tok: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), tok.alias("token")).cast(SEGMENT)


def segments(text: Column) -> Column:
    """Ordered pieces of a template: literal, timestamp, privacy, src_ip, dst_ip.

    ``text`` holds the literal text, the token kind of a privacy piece, or the raw form of a timestamp.
    """

    def cut(t: Column, spans: Column) -> Column:
        def pieces(s: Column, i: Column) -> Column:
            start = T._gap_start(spans, i)
            gap = F.substr(t, start + 1, s["pos"] - start)
            kind = (
                F.when(s["kind"] != "endpoint", s["kind"]).when(s["style"] == "SRC_IP", "src_ip").otherwise("dst_ip")
            )
            is_time = s["kind"] == "timestamp"
            body = F.when(is_time, s["raw"]).when(s["kind"] == "privacy", s["style"])
            return F.array(
                _segment(F.lit("literal"), gap, _empty_token()),
                _segment(kind, body, F.when(is_time, T.token(s["style"], s["raw"]))),
            )

        last = F.get(spans, F.size(spans) - 1)
        tail = F.substr(t, F.coalesce(last["pos"] - last["neg_len"], F.lit(0)) + 1)
        whole = F.concat(
            F.flatten(F.transform(spans, pieces)), F.array(_segment(F.lit("literal"), tail, _empty_token()))
        ).cast(SEGMENTS)
        kept = F.filter(whole, lambda s: (s["kind"] != "literal") | (s["text"] != ""))
        return F.when(F.size(kept) > 0, kept).otherwise(
            F.array(_segment(F.lit("literal"), t, _empty_token())).cast(SEGMENTS)
        )

    def spans_of(t: Column) -> Column:
        markers = [(t.contains("{{"), TOKEN_MARKER, 100), (t.contains("_IP}}"), ENDPOINT_MARKER, 90)]
        return T.sweep(F.concat(T.candidates(t), T.found(t, markers, _marker_span)))

    return bind(text, lambda t: F.when(t.isNotNull(), bind(spans_of(t), lambda s: cut(t, s))))


def kind_bit(kind: Column) -> Column:
    """1 << (ordinal - 1), 0 for anything that is not a kind."""
    position = F.array_position(F.array(*[F.lit(k) for k in V.KINDS]), kind).cast("int")
    return F.when(position > 0, F.expr("1").cast("int") * F.pow(F.lit(2), position - 1).cast("int")).otherwise(0)


def analysis(segs: Column) -> dict[str, Column]:
    """Counts, kind mask and styles in first-seen order."""

    def count(kind: str) -> Column:
        return F.size(F.filter(segs, lambda s: s["kind"] == kind))

    privacy = F.transform(F.filter(segs, lambda s: s["kind"] == "privacy"), lambda s: s["text"])
    mask = F.aggregate(
        F.array_distinct(privacy), F.lit(0), lambda acc, k: acc.bitwiseOR(kind_bit(k))
    )
    styles = F.array_distinct(
        F.transform(F.filter(segs, lambda s: s["kind"] == "timestamp"), lambda s: s["token"]["style"])
    )
    return {
        "n_timestamps": count("timestamp"),
        "n_src": count("src_ip"),
        "n_dst": count("dst_ip"),
        "n_privacy": count("privacy"),
        "kind_mask": mask,
        "styles": styles,
    }


def rendered(
    segs: Column,
    instant: Column,
    profile: Column,
    source_ip: str = V.SOURCE_IP,
    destination_ip: str = V.DESTINATION_IP,
    calendar: bool = False,
    local_tz: str = "UTC",
) -> Column:
    """Print segments; ``profile`` is a struct with one string field per token kind."""
    def value(s: Column) -> Column:
        by_kind = None
        for kind in V.KINDS:
            test = s["text"] == kind
            by_kind = F.when(test, profile[kind]) if by_kind is None else by_kind.when(test, profile[kind])
        return (
            F.when(s["kind"] == "literal", s["text"])
            .when(s["kind"] == "timestamp", T.printed(s["token"], instant, calendar, local_tz))
            .when(s["kind"] == "src_ip", F.lit(source_ip))
            .when(s["kind"] == "dst_ip", F.lit(destination_ip))
            .otherwise(by_kind)
        )

    return F.array_join(F.transform(segs, value), "")

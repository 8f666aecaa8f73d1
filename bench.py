"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``queries`` are seconds to produce every row of the result (a sink that drops them). ``throughput`` gives the
same work as rates: events printed from a catalog, lines tokenized, megabytes of text sanitized, events packed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from veilworks.operators import packing as K  # noqa: E402
from veilworks.operators import synthesis as S  # noqa: E402
from veilworks.plans import lines as L  # noqa: E402
from veilworks.plans.queries import QUERIES  # noqa: E402
from veilworks.session import build_session  # noqa: E402
from veilworks.sources.tables import read_table  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "deid_token_counts", "deid_text_rewrite", "tokenize_lines", "field_dictionary", "privacy_audit", "pseudonymize_contacts",
    "timestamp_profile", "mark_timestamps", "rebase_timestamps", "dedupe_compile", "search_docs", "analyze_templates",
    "round_robin_fairness", "synthesize_events", "split_batches", "budget_count", "pack_packets", "batch_documents",
    "throughput_summary", "step_rates", "delivery_reconciliation",
]
EVENTS = int(os.environ.get("BENCH_EVENTS", "10000000"))


def drain(df) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def catalog(spark, n: int):
    """n templates from the distinct (brand, type) pairs of the parts."""
    parts = L.part_templates(spark, SF)
    return parts.groupBy("source").agg(*[F.min_by(c, "pos").alias(c) for c in ("id", "name", "sample", "test_case")], F.min("pos").alias("pos")).orderBy("pos").limit(n)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    drain(read_table(spark, SF, "orders").groupBy("o_orderstatus").count())  # start the engine
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        drain(QUERIES[name](spark, SF))
        seconds[name] = round(time.perf_counter() - started, 3)

    rates = {}
    clock = S.Clock.between("2030-01-02", "2030-01-05")
    for label, n in (("one_template", 1), ("all_brands", 60)):
        events = S.synthesize(catalog(spark, n), EVENTS, clock)
        drain(events)
        rates[f"synthesize_{label}_events_per_s"] = round(EVENTS / drain(events))
    lines = read_table(spark, SF, "events").count()
    rates["tokenize_lines_per_s"] = round(lines / seconds["tokenize_lines"])
    size = read_table(spark, SF, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    rates["sanitize_mb_per_s"] = round(size / 1e6 / seconds["deid_text_rewrite"], 2)
    packed = S.event_sequence(spark, EVENTS // 5, lanes=1).select("lane", "seq", (200 + F.pmod(F.xxhash64("event_idx"), F.lit(100))).alias("bytes"))
    rates["pack_events_per_s"] = round((EVENTS // 5) / drain(K.pack_packets(packed)))
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "throughput": rates}
        )
    )


if __name__ == "__main__":
    main()

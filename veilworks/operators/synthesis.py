"""Expanding templates into events: selection, round robin, event time, identities, printing."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import programs as P
from ..functions.columns import int_div
from ..functions.templates import rendered
from ..session import stored_step, use_utc
from ..sources.tables import broadcast_if_small, dealt
from .catalog import compile_distinct
from .deid import profile_of
from .dimensions import profiles
from .ordering import dense_index

EVENTS_PER_TASK = 4_000_000
PRERENDER_LIMIT = 2_000  # templates; times 50 identities
BROADCAST_BYTES = 64 << 20  # of printed or compiled templates, measured; larger catalogs are joined on their ordinal
RUN_LIMIT = 48
SLOT_LIMIT = 64  # timestamps per template x distinct runs that are unrolled into generated code


def valid_ipv4(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", p) and int(p) <= 255 for p in parts)


def split_offset(minutes: int) -> tuple[bool, int, int, int]:
    """(negative, days, hours, minutes) of a signed minute offset."""
    size = abs(minutes)
    return minutes < 0, size // 1440, size % 1440 // 60, size % 60


@dataclass(frozen=True)
class Clock:
    """When events happen. Range: whole seconds from start to end, both included, repeating.
    Offset: the run instant (plus event_idx / rate for rated runs) shifted by a signed number of minutes."""

    start: datetime | None = None
    end: datetime | None = None
    run_at: datetime | None = None
    offset_minutes: int = 0
    rate: int = 0
    local_tz: str = "UTC"

    @staticmethod
    def between(first: str, last: str) -> Clock:
        """Days given as yyyy-MM-dd; the last one counts to 23:59:59."""
        for text in (first, last):
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
                raise ValueError(f"not a yyyy-MM-dd date: {text}")
        a, b = date.fromisoformat(first), date.fromisoformat(last)
        if a > b:
            raise ValueError("the first day is after the last day")
        start = datetime(a.year, a.month, a.day, tzinfo=timezone.utc)
        end = datetime(b.year, b.month, b.day, tzinfo=timezone.utc) + timedelta(days=1, seconds=-1)
        return Clock(start=start, end=end)

    @property
    def calendar(self) -> bool:
        return self.start is not None

    @property
    def seconds(self) -> int:
        """Length of the closed range."""
        if self.start is None or self.end is None or self.start > self.end:
            raise ValueError("the time range is invalid")
        return int((self.end - self.start).total_seconds()) + 1


def _epoch(moment: datetime) -> int:
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp())


def event_time(idx: Column, clock: Clock) -> Column:
    if clock.calendar:
        return F.timestamp_seconds(F.lit(_epoch(clock.start)) + F.pmod(idx, F.lit(clock.seconds)))
    base = _epoch(clock.run_at or datetime.now(timezone.utc)) + clock.offset_minutes * 60
    if not clock.rate:
        return F.timestamp_seconds(F.lit(base))
    micros = int_div(F.lit(1_000_000) * F.pmod(idx, F.lit(clock.rate)), clock.rate)
    whole = F.lit(base) + int_div(idx, clock.rate)
    return F.timestamp_micros(whole * 1_000_000 + micros)


def assign_event_time(events: DataFrame, clock: Clock, idx: str = "event_idx") -> DataFrame:
    return events.withColumn("event_time", event_time(F.col(idx), clock))


def number_templates(templates: DataFrame) -> DataFrame:
    """Dense ``ordinal`` 0..n-1 in catalog order, whatever rows a selection left."""
    return dense_index(templates, "pos", name="ordinal")


def assign_round_robin(events: DataFrame, templates: DataFrame, idx: str = "event_idx") -> DataFrame:
    """Event i takes template i mod n; arithmetic, so lanes never lose or repeat a turn.

    Every template gets the same share of events: when the catalog is too large to broadcast, the join on the
    ordinal is balanced by construction.
    """
    n = templates.count()
    if n == 0:
        raise ValueError("no template to run")
    numbered = broadcast_if_small(number_templates(templates), max_bytes=BROADCAST_BYTES)
    return events.withColumn("ordinal", F.pmod(F.col(idx), F.lit(n))).join(numbered, "ordinal")


def event_sequence(spark: SparkSession, n: int, lanes: int = 1) -> DataFrame:
    """``(event_idx, lane, seq)``: lane w takes w, w + lanes, ...; seq is dense in its lane."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // EVENTS_PER_TASK))
    return spark.range(0, n, 1, tasks).select(
        F.col("id").alias("event_idx"),
        F.pmod("id", F.lit(lanes)).alias("lane"),
        int_div(F.col("id"), lanes).alias("seq"),
    )


@dataclass
class Programs:
    """Compiled templates, ready to join on ``event_idx``."""

    table: DataFrame  # turn or ordinal, template_id, has_privacy, and the program as slots or as one string
    n: int
    runs: list[str]
    slots: int | None  # most timestamps in one template, when programs are cut at them
    prerendered: bool  # printed for every identity and cut into slots: a small catalog
    small: bool  # whether the table may be broadcast, by its measured bytes
    source: DataFrame  # ordinal, template_id, segments: for catalogs that cannot be expressed as programs
    source_ip: str = V.SOURCE_IP
    destination_ip: str = V.DESTINATION_IP


def build_programs(
    templates: DataFrame, clock: Clock, source_ip: str, destination_ip: str, compiled: bool = False, **options
) -> Programs:
    for ip in (source_ip, destination_ip):
        if not valid_ipv4(ip):
            raise ValueError(f"not an IPv4 address: {ip}")
    # number the catalog before the costly step, and compile once: the result, with its programs, is read for its count,
    # its time forms, its size and the join
    numbered = number_templates(templates)
    compiled_rows = (numbered if compiled else compile_distinct(numbered, **options)).select(
        "ordinal", F.col("id").alias("template_id"), "segments", "n_privacy"
    )
    program = P.program(F.col("segments"), source_ip, destination_ip, clock.calendar)
    numbered = stored_step(dealt(compiled_rows, "ordinal").withColumn("program", program))
    least = F.octet_length("program") + 64
    n, bad, size = numbered.agg(
        F.count(F.lit(1)), F.min(F.when(F.col("segments").isNull(), F.col("template_id"))), F.sum(least)
    ).first()
    if bad is not None:
        raise ValueError(f"template {bad}: mapped values do not match its markers")
    if n == 0:
        raise ValueError("no template to run")
    base = numbered.select(
        F.col("ordinal"),
        "template_id",
        (F.col("n_privacy") > 0).alias("has_privacy"),
        "program",
    )
    found = (
        base.select(P.runs_in(F.col("program")).alias("runs"))
        .select(F.explode("runs").alias("run"), F.size("runs").alias("k"))
        .groupBy("run").agg(F.max("k").alias("k")).limit(RUN_LIMIT + 1).collect()
    )
    runs = sorted((r["run"] for r in found), key=lambda r: (-len(r), r))
    most = max((r["k"] for r in found), default=0)
    if size <= BROADCAST_BYTES:  # programs alone may say that it is too large; segments are costly to measure
        size = numbered.agg(F.sum(least + F.octet_length(F.to_json("segments")))).first()[0]
    # identities lengthen a text by some dozens of bytes per marker; twice the program covers them
    if n > PRERENDER_LIMIT or most * len(runs) > SLOT_LIMIT or 2 * size * V.PROFILE_COUNT > BROADCAST_BYTES:
        return Programs(base, n, runs, None, False, size <= BROADCAST_BYTES, numbered.drop("program"), source_ip, destination_ip)
    # a small catalog sits in one partition by now; give every core its share of the printing
    cores = templates.sparkSession.sparkContext.defaultParallelism
    turns = base.repartition(cores, "ordinal").withColumn(
        "profile_idx", F.explode(F.sequence(F.lit(0), F.lit(V.PROFILE_COUNT - 1)))
    )
    people = F.broadcast(profiles(templates.sparkSession))  # 50 rows
    body = P.cut(P.with_values(F.col("program")), runs, most)
    turn = F.col("ordinal") * V.PROFILE_COUNT + F.col("profile_idx")
    table = turns.join(people, "profile_idx").select(turn.alias("turn"), "template_id", "has_privacy", *body)
    return Programs(table, n, runs, most, True, True, numbered.drop("program"), source_ip, destination_ip)


def _run_text(run: str, clock: Clock) -> Column:
    """The event time printed as a run, in the zone the run was written for."""
    t, zone = F.col("event_time"), P.zone_of(run)
    if zone == P.LOCAL:
        t = F.from_utc_timestamp(t, clock.local_tz)
    elif zone not in ("", "0"):
        t = t + F.make_dt_interval(mins=F.lit(int(zone)))
    return F.date_format(t, P.run_pattern(run))


def print_slots(joined: DataFrame, programs: Programs, clock: Clock) -> DataFrame:
    """Literal, time, literal, time, ...: one concatenation in generated code, nothing is searched."""
    texts = [_run_text(r, clock) for r in programs.runs]

    def shown(slot: int) -> Column:
        chain = None
        for i, text in enumerate(texts):
            test = F.col(f"run_{slot}") == i
            chain = F.when(test, text) if chain is None else chain.when(test, text)
        return chain.otherwise("")

    parts = [F.col("lit_0")]
    for slot in range(1, programs.slots + 1):
        parts += [shown(slot), F.col(f"lit_{slot}")]
    return joined.withColumn("body", F.concat(*parts))


def print_programs(joined: DataFrame, runs: list[str], clock: Clock) -> DataFrame:
    """Replace the runs of ``program`` by the event time, for programs that are not cut into slots."""
    body = F.col("program")
    for run in runs:  # longest first: a short run may be part of a longer one
        body = F.replace(body, F.lit(run), _run_text(run, clock))
    return joined.withColumn("body", body)


def expand(events: DataFrame, programs: Programs, clock: Clock, seed: int = 0, profile: Column | None = None) -> DataFrame:
    """Print the event of every ``event_idx``: ``(event_idx, ..., template_id, profile_idx, event_time, body)``.

    Works on batches and streams alike: static tables are broadcast when counted small, nothing else moves.
    """
    keep = events.columns
    idx = profile if profile is not None else profile_of(F.col("event_idx"), seed=seed)
    rows = assign_event_time(
        events.withColumn("ordinal", F.pmod("event_idx", F.lit(programs.n))).withColumn("__profile", idx), clock
    )
    shown = F.when(F.col("has_privacy"), F.col("__profile")).otherwise(0).cast("int").alias("profile_idx")
    result = [*keep, "template_id", shown, "event_time", "body"]
    if len(programs.runs) > RUN_LIMIT:
        return _expand_segments(rows, programs, clock, keep)
    if programs.prerendered:
        rows = rows.withColumn("turn", F.col("ordinal") * V.PROFILE_COUNT + F.col("__profile"))
        return print_slots(rows.join(F.broadcast(programs.table), "turn"), programs, clock).select(*result)
    table = F.broadcast(programs.table) if programs.small else programs.table
    people = F.broadcast(profiles(events.sparkSession).withColumnRenamed("profile_idx", "__profile"))  # 50 rows
    joined = rows.join(table, "ordinal").join(people, "__profile").withColumn(
        "program", F.when(F.col("has_privacy"), P.with_values(F.col("program"))).otherwise(F.col("program"))
    )
    return print_programs(joined, programs.runs, clock).select(*result)


def _expand_segments(rows: DataFrame, programs: Programs, clock: Clock, keep: list[str]) -> DataFrame:
    """The same for catalogs with more distinct time forms than are worth unrolling."""
    table = F.broadcast(programs.source) if programs.small else programs.source
    people = profiles(rows.sparkSession)
    person = F.struct(*[F.col(k) for k in V.KINDS])
    joined = rows.join(table, "ordinal").join(
        F.broadcast(people.withColumnRenamed("profile_idx", "__profile")), "__profile"
    )
    body = rendered(
        F.col("segments"), F.col("event_time"), person, programs.source_ip, programs.destination_ip,
        clock.calendar, clock.local_tz,
    )
    return joined.select(
        *keep,
        "template_id",
        F.when(F.col("n_privacy") > 0, F.col("__profile")).otherwise(0).cast("int").alias("profile_idx"),
        "event_time",
        body.alias("body"),
    )


def synthesize(
    templates: DataFrame,
    n: int,
    clock: Clock,
    source_ip: str = V.SOURCE_IP,
    destination_ip: str = V.DESTINATION_IP,
    lanes: int = 1,
    seed: int = 0,
    profile: Column | None = None,
    compiled: bool = False,
    **options,
) -> DataFrame:
    """Flagship: n events from a catalog, ``(event_idx, lane, seq, template_id, profile_idx, event_time, body)``.

    The range of events is generated where it is printed: no shuffle at any n.
    """
    spark = use_utc(templates.sparkSession)
    programs = build_programs(templates, clock, source_ip, destination_ip, compiled, **options)
    return expand(event_sequence(spark, n, lanes), programs, clock, seed, profile)

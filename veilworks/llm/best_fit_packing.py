"""Best-fit packing of token sequences by linear grouping: few sequences, planned on a histogram of lengths.

Lengths are whole numbers up to the capacity, so all that decides a packing is how many pieces there are of each length:
one row per length reaches the driver, whatever the input holds. There the scheme runs on counts:

1. Pieces longer than a part of the capacity are large. In descending order they are cut into ``GROUPS`` groups of equal
   cardinality, and each is rounded up to the longest of its group: few sizes remain.
2. A linear programme over configurations (which sizes share a sequence, how many sequences each) is solved by column
   generation: a simplex step at a time, with a knapsack over the capacity to find the next configuration.
3. Whole multiples of the configurations are kept, and pieces take the places of their group by rank. A piece is at
   most as long as its place, so every sequence fits.
4. What is left of the large pieces and all small ones go, longest first, each into the fullest sequence that takes it.

Where "large" begins is a trade: many small pieces fill what rounding leaves, few sizes are arranged better. The counts
are planned for each of ``PARTS`` and the plan of fewest sequences is kept; all of them together take seconds.

The plan is a list of runs: "pieces of length l and ranks a..b fill sequences s, s+1, ... from offset o, q in each". A run
is an arithmetic rule, so the plan's size depends on lengths and groups only. Pieces are ranked within their length by
``(doc_id, piece, crc)`` in one range shuffle of narrow rows, in which a length that a third of all rows share is many
tasks, and every task looks its own rows up in the plan. Neither text nor ids are shuffled unless asked for.

Defined cases: a null or empty text is the end id alone; a document over the capacity is cut into pieces of the capacity,
the first one shorter if need be; null ids stay null; rows with one id are documents of their own, and equal pieces are
interchangeable, so the result does not depend on how the input is split; a very long text is one row of one task, as it
was in the input; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import map_batches, map_slices, rows_of
from .bpe import byte_letters
from .tables import written

CAPACITY = 2048
END = 0  # id after the ids of each document
GROUPS = 96
PARTS = (2, 3, 4, 8)  # pieces above capacity / part are large
STEPS = 4000  # simplex steps at most; every step leaves a feasible plan
# how the byte-level vocabulary splits a text; fixed value
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them for this file.

    A plain byte-level vocabulary whose ids follow the order of its merges is run by tiktoken, which needs a quarter of the
    time; any other file, and a text that tiktoken's expression engine gives up on, by the library itself.
    """
    import tokenizers

    own = tokenizers.Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def exact(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec["added_tokens"]
    vocab = model.get("vocab", {})
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    made = [vocab[a + b] for a, b in merges] if model.get("type") == "BPE" else []
    plain = (
        made
        and made == sorted(set(made))
        and spec.get("normalizer") is None
        and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
    )
    if not plain:
        return exact
    import tiktoken

    specials = {t["content"]: t["id"] for t in added}
    byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in specials}
    fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)

    def quick(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode(text, allowed_special="all"), "<u4")
        except ValueError:
            return exact(text)

    return quick


def cuts(n: int, capacity: int) -> list[int]:
    """Where a document of n ids is cut: pieces of the capacity, the first one shorter if need be."""
    return [0, *range(n - capacity * ((n - 1) // capacity), n + 1, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``; ids are little-endian unsigned 32-bit integers."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batch, lo, hi, data, offsets):
        encode, rows, held = encoder(path), ([], [], [], [], []), []
        for r, t in enumerate(rows_of(batch, "text", lo, hi).to_pylist()):
            flat = np.append(encode(t or ""), np.uint32(END)).astype("<u4")
            cut = cuts(len(flat), capacity)
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                own = flat[a:b].tobytes()
                for column, value in zip(rows, (r, k, a, b - a, zlib.crc32(own))):
                    column.append(value)
                if ids:
                    held.append(own)
        at, piece, start, length, crc = (np.array(c, np.int64) for c in rows)
        out = {"doc_id": rows_of(batch, "doc_id", lo, hi).take(pa.array(at)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}
        return out | {"ids": held} if ids else out

    return map_slices(narrow, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids, work)


@dataclass
class Plan:
    """Runs of pieces: those of ``length`` and ranks from ``rank`` on fill sequences from ``sequence`` on, ``per`` in each."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, sequence, per, offset

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return rows[:, 0] << 44 | rows[:, 1], *rows[:, 1:].T


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size give the greatest value within the capacity."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for g, (s, v) in enumerate(zip(sizes.tolist(), value.tolist())):
        if v <= 1e-12:
            continue
        now = best.copy()
        for c in range(1, capacity // s + 1):
            more = best[: capacity + 1 - c * s] + c * v
            better = more > now[c * s :] + 1e-12
            now[c * s :][better] = more[better]
            taken[g, c * s :][better] = c
        best = now
    out, room = np.zeros(len(sizes), np.int64), capacity
    for g in range(len(sizes) - 1, -1, -1):
        out[g] = taken[g, room]
        room -= out[g] * sizes[g]
    return out


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size share a sequence, how many such sequences), from the linear programme, rounded down."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    amount = inverse @ wanted
    for step in range(STEPS):
        worth = inverse.sum(0)
        enter = best_configuration(sizes, worth, capacity).astype(float)
        if worth @ enter <= 1 + 1e-7:
            break
        direction = inverse @ enter
        rising = direction > 1e-9
        ratio = np.where(rising, amount / np.where(rising, direction, 1.0), np.inf)
        out = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[out] * direction, 0)
        amount[out] = ratio[out]
        basis[:, out] = enter
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ wanted, 0)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
    return [(basis[:, k].round().astype(np.int64), int(n)) for k, n in enumerate(np.floor(amount + 1e-6).tolist()) if n >= 1]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, parts: tuple[int, ...] = PARTS) -> Plan:
    """A packing of ``counts[l]`` pieces of each length l up to the capacity: the best of those for each part."""
    return min((grouped(counts, capacity, groups, capacity // part) for part in parts), key=lambda p: p.sequences)


def grouped(counts: np.ndarray, capacity: int, groups: int, small: int) -> Plan:
    """The packing by linear grouping of the pieces longer than ``small``."""
    out = Plan(capacity)
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free places: (first sequence, how many)
    large = [(length, int(counts[length])) for length in range(capacity, small, -1) if counts[length]]
    total = sum(n for _, n in large)
    left: list[tuple[int, int, int]] = []  # length, first rank, how many
    if total:
        # groups of equal cardinality; a length may lie in several
        per = -(-total // groups)
        members: list[list[tuple[int, int, int]]] = [[]]
        held = 0
        for length, n in large:
            rank = 0
            while rank < n:
                if held == per:
                    members.append([])
                    held = 0
                take = min(n - rank, per - held)
                members[-1].append((length, rank, take))
                rank, held = rank + take, held + take
        merged: list[list[tuple[int, int, int]]] = []
        for group in members:
            if merged and merged[-1][0][0] == group[0][0] and merged[-1][-1][0] == group[0][0]:
                merged[-1] += group
            else:
                merged.append(group)
        sizes = np.array([g[0][0] for g in merged], np.int64)
        wanted = np.array([sum(n for _, _, n in g) for g in merged], np.int64)
        queues = [list(reversed(g)) for g in merged]
        found = configurations(sizes, wanted.astype(float), capacity)
        for shape, copies in sorted(found, key=lambda c: (-c[1], c[0].tolist())):
            parts = [(out.sequences, copies, capacity)]  # first sequence, how many, free places
            out.sequences += copies
            for g in np.repeat(np.arange(len(sizes)), shape).tolist():
                parts = substitute(out, parts, queues[g])
            for first, n, free in parts:
                room[free].append((first, n))
        left = [x for q in queues for x in reversed(q)]
    for length in range(small, 0, -1):
        if counts[length]:
            left.append((length, 0, int(counts[length])))
    best_fit(out, room, sorted(left, key=lambda x: (-x[0], x[1])))
    return out


def substitute(out: Plan, parts: list[tuple[int, int, int]], queue: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Give the next pieces of a group to one place of each of the sequences; places without a piece stay free."""
    done = []
    for first, n, free in parts:
        while n and queue:
            length, rank, have = queue.pop()
            take = min(n, have)
            out.runs.append((length, rank, first, 1, out.capacity - free))
            done.append((first, take, free - length))
            first, n = first + take, n - take
            if take < have:
                queue.append((length, rank + take, have - take))
        if n:
            done.append((first, n, free))
    return done


def best_fit(out: Plan, room: list[list[tuple[int, int]]], items: list[tuple[int, int, int]]) -> None:
    """Each piece, longest first, into the fullest sequence that takes it; many equal ones at a time."""
    open_ = np.array([bool(r) for r in room])
    for length, rank, n in items:
        while n:
            fits = int(np.argmax(open_[length:])) + length
            if not open_[fits]:
                fits = out.capacity
                per = fits // length
                room[fits].append((out.sequences, max(1, n // per)))
                out.sequences += room[fits][-1][1]
            first, copies = room[fits].pop()
            per = min(fits // length, n)
            take = min(copies, n // per)
            if take < copies:
                room[fits].append((first + take, copies - take))
            open_[fits] = bool(room[fits])
            out.runs.append((length, rank, first, per, out.capacity - fits))
            free = fits - per * length
            room[free].append((first, take))
            open_[free] = True
            rank, n = rank + take * per, n - take * per
    return


def pack(table: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    order = ["length", "doc_id", "piece", "ids_crc32"]
    columns = table.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: number the rows of each length in this partition."""
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            at = np.arange(len(length))
            begin = np.flatnonzero(np.diff(length, prepend=-1))
            own = at - np.repeat(begin, np.diff(np.append(begin, len(length))))
            if len(length) and length[0] == last:
                own[: begin[1] if len(begin) > 1 else len(own)] += seen
            if len(length):
                last, seen = int(length[-1]), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(own)], names=[*b.schema.names, "part", "at"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    ranked = written(map_batches(table.repartitionByRange(*order).sortWithinPartitions(*order), count, f"{types}, part int, at long"))
    tally = ranked.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length at most
        counts[r["length"]] = r["n"]
    arrays = plan(counts, capacity, groups).arrays()
    # sorted ranges share at most one length each with the next: capacity + partitions rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select(F.col("part").alias("o_part"), F.col("length").alias("o_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))
    numbered = ranked.join(F.broadcast(offsets), (F.col("part") == F.col("o_part")) & (F.col("length") == F.col("o_length")))
    numbered = numbered.select(*columns, (F.col("before") + F.col("at")).alias("at"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank, sequence, per, offset = arrays
        for b in batches:
            if not b.num_rows:
                continue
            length, at = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "at"))
            run = np.searchsorted(key, length << 44 | at, "right") - 1
            step = at - rank[run]
            place = pa.array(offset[run] + step % per[run] * length)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[run] + step // per[run]), place], names=[*columns, "sequence_id", "offset"])

    return map_batches(numbered, place, f"{types}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_ids, doc_ids, offsets, ids)`` of packed pieces that carry their ids: a row is one full sequence."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), rows.alias("p"))
    return own.select("sequence_id", "n_ids", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"), joined.alias("ids"))


def op12(docs: DataFrame, path: str) -> DataFrame:
    return pack(written(pieces(docs, path)))

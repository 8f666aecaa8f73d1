"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed stride.

Documents are encoded and cut into sequences of ``LENGTH`` ids (the last one padded). Sequences are numbered densely;
a keyed Feistel permutation of the next even power of two, walked until it falls below the number of sequences, gives
each sequence its global slot: a bijection that needs no sort, no shuffle table and no state but the key. Range partitions
of slots write their shards one after another. A record is two bytes of length and ``LENGTH`` unsigned 16-bit ids, all
little-endian, so slot s is at ``(s % SHARD) * STRIDE`` of shard ``s // SHARD`` and a reader can stop and go on anywhere.

Sequences are numbered in the order of two hashes of (id, text) and their place in the document, so the slots are a
function of the key and the rows alone: another split or file layout of the input gives the same shards. Encoded documents
are written once, bucketed by the task that wrote them. Only their hashes and counts are shuffled to find where each
document begins; these numbers come back as one row per writing task and meet its bucket without moving the ids. The ids
are shuffled once, by slot.

Defined cases: a null or empty text has no sequence and no slot; rows with one id, or equal rows, are separate documents
with separate slots (equal rows have equal sequences, so it does not matter which has which); a very long text is many
sequences, made in pieces of ``PIECE`` ids; null ids stay null; extra columns are not read; an empty table has no shard.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_folder
from .arrays import map_batches, mix, rows_of, slices
from .bpe import encode_flat, load

LENGTH = 256
SHARD = 1024
STRIDE = 2 + 2 * LENGTH
MAX_BUCKETS = 1 << 16
BUCKET_BITS = 16  # of a hash: places in the order that are counted together
ENCODED_BYTES = 1 << 21  # of texts that are encoded at once
PIECE = 1 << 20  # ids that are cut at once, a multiple of LENGTH
SHARDS_PER_TASK = 64  # at most, when shards are written
ROUNDS = 6
KEY = 20_260_101


def permuted(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slot of each index below n: a bijection of [0, n) for every key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([key], np.uint64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        return left << np.uint64(half) | right

    out = once(np.asarray(index).astype(np.uint64))
    while (walk := out >= np.uint64(n)).any():
        out[walk] = once(out[walk])
    return out.astype(np.int64)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``(part, at, doc_id, one, two, many, ids)``: the ids of each document with a token, as 16-bit integers.

    part, at: the writing task and the place in it; one, two: hashes of the row; many: how many sequences it makes.
    """
    if len(load(path).tokens) > 1 << 16:
        raise ValueError("ids of this vocabulary do not fit in 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, _, _ in slices(batch, limit=ENCODED_BYTES):
                ids, size = encode_flat(path, ["" if t is None else t for t in rows_of(batch, "text", lo, hi).to_pylist()])
                some = np.flatnonzero(size)
                if len(some):
                    narrow = ids.astype("<u2")
                    cuts = np.append(0, np.cumsum(2 * size[some])).astype(np.int32)
                    columns = {
                        "part": pa.array(np.full(len(some), part, np.int32)),
                        "at": pa.array(np.arange(at, at + len(some))),
                        **{n: rows_of(batch, n, lo, hi).take(pa.array(some)) for n in ("doc_id", "one", "two")},
                        "many": pa.array(-(-size[some] // LENGTH)),
                        "ids": pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cuts), pa.py_buffer(narrow)]),
                    }
                    at += len(some)
                    yield pa.RecordBatch.from_pydict(columns)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow = narrow.select("*", F.xxhash64("doc_id", "text").alias("one"), F.xxhash64("text", "doc_id", F.lit(1)).alias("two"))
    return map_batches(narrow, run, "part int, at long, doc_id long, one long, two long, many long, ids binary")


def written_by_part(table: DataFrame, tasks: int) -> DataFrame:
    """The rows as a Parquet table bucketed by ``part``: what one task writes is one file, so a join by it moves no row."""
    spark, name = table.sparkSession, f"training_order_{uuid.uuid4().hex}"
    buckets = max(1, min(2 * tasks, MAX_BUCKETS))
    table.write.bucketBy(buckets, "part").option("path", fresh_folder(spark, "step")).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolves the table; its name is not needed from here on, its files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def begins(table: DataFrame) -> tuple[DataFrame, int]:
    """``(part, begin)``: for each writing task the number of the first sequence of each of its documents; and the total.

    Equal rows are counted per task before they are shuffled, so a frequent row costs one row per task.
    """
    keys = ["one", "two", "part"]
    groups = table.groupBy(*keys).agg((F.count(F.lit(1)) * F.max("many")).alias("size")).withColumn("bucket", F.shiftright("one", 64 - BUCKET_BITS))
    totals = groups.groupBy("bucket").agg(F.sum("size").alias("size"))
    n = totals.agg(F.sum("size")).first()[0] or 0
    # at most 2**BUCKET_BITS rows
    base = totals.select("bucket", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("size")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("bucket").orderBy(*keys)) - F.col("size")
    groups = groups.withColumn("inside", inside).join(F.broadcast(base), "bucket").select(*keys, (F.col("base") + F.col("inside")).alias("first"))
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1
    rows = table.select(*keys, "at", "many").withColumn("copy", copy).join(groups, keys)
    rows = rows.select("part", F.struct("at", (F.col("first") + F.col("copy") * F.col("many")).alias("begin")).alias("row"))
    # the documents of one split in one array
    return rows.groupBy("part").agg(F.array_sort(F.collect_list("row"))["begin"].alias("begins")), n


def placed(docs: DataFrame, path: str, key: int = KEY) -> tuple[DataFrame, int]:
    """``(slot, doc_id, sequence, record)`` of every sequence, and how many there are."""
    table = encoded(docs, path)
    table = written_by_part(table, table.rdd.getNumPartitions())
    first, n = begins(table)
    found = table.join(first.hint("shuffle_hash"), "part").select("doc_id", F.get("begins", F.col("at").cast("int")).alias("begin"), "ids")

    def cut(ids: np.ndarray, size: np.ndarray, begin: np.ndarray, skip: np.ndarray, doc: pa.Array) -> pa.RecordBatch:
        """Records of whole sequences of some documents; ``skip`` sequences of each were made before."""
        many = -(-size // LENGTH)
        row = np.repeat(np.arange(len(size)), many)
        sequence = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        body = np.zeros(len(row) * LENGTH, "<u2")
        body[np.arange(len(ids)) + np.repeat((np.cumsum(many) - many) * LENGTH - (np.cumsum(size) - size), size)] = ids
        records = np.empty((len(row), 1 + LENGTH), "<u2")
        records[:, 0] = np.minimum(size[row] - sequence * LENGTH, LENGTH)
        records[:, 1:] = body.reshape(-1, LENGTH)
        sequence += skip[row]
        cuts = np.arange(len(row) + 1, dtype=np.int32) * STRIDE
        packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(records)])
        return pa.RecordBatch.from_arrays([pa.array(permuted(begin[row] + sequence, n, key)), doc.take(pa.array(row)), pa.array(sequence), packed], names=["slot", "doc_id", "sequence", "record"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, begin, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 2
            flat = np.frombuffer(ids.buffers()[2], "<u2")
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)
                # one document may be longer than a piece
                for at in range(ends[lo], ends[hi], PIECE) if hi == lo + 1 else (ends[lo],):
                    stop = min(at + PIECE, ends[hi])
                    size = np.array([stop - at]) if hi == lo + 1 else np.diff(ends[lo : hi + 1])
                    yield cut(flat[at:stop], size, begin[lo:hi], np.full(hi - lo, (at - ends[lo]) // LENGTH), doc.slice(lo, hi - lo))
                lo = hi

    return map_batches(found, slots, "slot long, doc_id long, sequence long, record binary"), n


def shards(docs: DataFrame, path: str, key: int = KEY, partitions: int | None = None) -> DataFrame:
    """One row per shard in slot order: its bytes, their hash, and which sequence each slot holds.

    Every partition holds a range of slots of equal size; rows of a partition come in slot order.
    """
    rows, n = placed(docs, path, key)
    many = -(-n // SHARD)
    wanted = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, min(many, wanted), -(-many // SHARDS_PER_TASK))
    per = -(-many // partitions) * SHARD
    ranged = rows.repartitionById(partitions, F.expr(f"cast(slot div {max(per, 1)} as int)")).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "first_slot", "n_slots", "stride", "sha256", "doc_ids", "sequences", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        shard, ids, sequences, payload = -1, [], [], bytearray()

        def done() -> pa.RecordBatch:
            row = [shard, shard * SHARD, len(ids), STRIDE, hashlib.sha256(payload).hexdigest(), ids, sequences, bytes(payload)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            own, records = b.column(0).to_numpy() // SHARD, b.column(3)
            data, cuts = records.buffers()[2], np.frombuffer(records.buffers()[1], np.int32)[records.offset :]
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for lo, hi in zip(edges, edges[1:]):
                if own[lo] != shard:
                    if ids:
                        yield done()
                    shard, ids, sequences, payload = int(own[lo]), [], [], bytearray()
                ids += b.column(1).slice(lo, hi - lo).to_pylist()
                sequences += b.column(2).slice(lo, hi - lo).to_pylist()
                payload += data[int(cuts[lo]) : int(cuts[hi])]
        if ids:
            yield done()

    return ranged.mapInArrow(run, "shard long, first_slot long, n_slots int, stride int, sha256 string, doc_ids array<long>, sequences array<long>, payload binary")


def write_shards(table: DataFrame, folder: str) -> DataFrame:
    """Write each shard as a raw file in a folder that all executors reach; a file appears whole or not at all."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name, part = f"{root}/shard-{shard:010d}.bin", f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(payload)
                store.move(part, name)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name])], names=["shard", "file"])

    return table.select("shard", "payload").mapInArrow(run, "shard long, file string")


def read_from(folder: str, slot: int) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in training order: one seek, then sequential reads."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    shard, place = divmod(slot, SHARD)
    while store.get_file_info(name := f"{root}/shard-{shard:010d}.bin").type == fs.FileType.File:
        with store.open_input_file(name) as f:
            f.seek(place * STRIDE)
            while len(record := f.read(STRIDE)) == STRIDE:
                yield np.frombuffer(record, "<u2", int.from_bytes(record[:2], "little"), 2)
        shard, place = shard + 1, 0


def op6(docs: DataFrame, path: str) -> DataFrame:
    return shards(docs, path)

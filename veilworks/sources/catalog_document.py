"""One catalog document of any size, read by many tasks.

The text source cuts the file into splits and the splits into pieces that end with ``}``. Whether a place is inside a
string or a comment, and how deep, depends on everything before it, so a first pass finds for every split where it leads
from each of four states; these small tables are composed in file order. A second pass, which knows state and depth, keeps
what is outside the values of the document and counts the entries of the split. The third one cuts the entries out. Only
those that cross a border of splits are put together by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .catalog_files import catalog_columns, described

PLAIN, STRING, LINE, BLOCK = range(4)
TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+(?P<string>"?)|//[^\n]*+(?P<line>\n?)|/\*(?s:.*?)(?P<block>\*/|\Z)|[{}\[\],]', re.S)
REST = {STRING: re.compile(r'(?:[^"\\]++|\\.)*+(?P<end>"?)', re.S), LINE: re.compile(r"[^\n]*+(?P<end>\n?)"), BLOCK: re.compile(r"(?s:.*?)(?P<end>\*/|\Z)")}
LOGS = re.compile(r'"logs"\s*:\s*\[\Z')


def tokens(text: str, state: int) -> Iterator[tuple[int, int, str, int]]:
    """(begin, end, kind, state after it) of brackets, commas, strings ``"`` and comments ``/``."""
    at = 0
    if state != PLAIN:
        m = REST[state].match(text)
        at, after = m.end(), PLAIN if m["end"] else state
        yield 0, at, '"' if state == STRING else "/", after
        if after != PLAIN:
            return
    for m in TOKEN.finditer(text, at):
        kind = text[m.start()]
        if kind == '"':
            yield m.start(), m.end(), kind, PLAIN if m["string"] else STRING
        elif kind == "/":
            block = text[m.start() + 1] == "*"
            yield m.start(), m.end(), kind, PLAIN if (m["block"] if block else m["line"]) else BLOCK if block else LINE
        else:
            yield m.start(), m.end(), kind, PLAIN


def effect(text: str, state: int) -> tuple[int, int]:
    """The state after a piece and the change of depth."""
    depth = 0
    for _, _, kind, state in tokens(text, state):
        depth += (kind in "{[") - (kind in "}]")
    return state, depth


class Cutter:
    """Walks the pieces of a split: text of depth 0 and 1, and the parts between commas of each value of depth 2 or more."""

    def __init__(self, state: int, depth: int):
        self.state, self.depth = state, depth
        self.outer, self.commas = [""], [0] if depth >= 2 else []
        self.held, self.opened = [], False  # the part being read; whether it began in this split

    def feed(self, text: str) -> Iterator[tuple[int, int, str, bool]]:
        """(value, commas before it in the split, text, whether it is whole) of every part that ends in the piece."""
        at = 0
        for begin, end, kind, after in tokens(text, self.state):
            self.state = after
            if kind == "/":
                self.put(text[at:begin] + " ")
                at = end
            elif kind in "{[":
                self.depth += 1
                if self.depth == 2:
                    self.put(text[at:end], 1)
                    at, self.opened = end, True
                    self.commas.append(0)
            elif kind in "}]":
                self.depth -= 1
                if self.depth == 1:
                    self.put(text[at:begin], 2)
                    yield self.part()
                    self.outer.append("")
                    at = begin
            elif kind == "," and self.depth == 2:
                self.put(text[at:begin])
                yield self.part()
                self.commas[-1] += 1
                at, self.opened = end, True
        self.put(text[at:])

    def put(self, text: str, depth: int = 0) -> None:
        if (depth or self.depth) >= 2:
            self.held.append(text)
        else:
            self.outer[-1] += text

    def part(self) -> tuple[int, int, str, bool]:
        out = len(self.commas) - 1, self.commas[-1], "".join(self.held), self.opened
        self.held = []
        return out


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("_metadata.file_block_length").alias("size"), F.concat("value", F.lit("}")).alias("piece"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str | None]]:
    """(split, piece), and (split, None) at its end; the pieces of a split come in order."""
    last = None
    for b in batches:
        for *split, piece in zip(*(c.to_pylist() for c in b.columns)):
            if last is not None and last != tuple(split):
                yield last, None
            last = tuple(split)
            yield last, piece
    if last is not None:
        yield last, None


def _batch(names: str, rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names.split())


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = [(s, 0) for s in range(4)]
    for split, piece in _by_split(batches):
        if piece is None:
            yield _batch("file begin size states depths", [(*split, [s for s, _ in now], [d for _, d in now])], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())])
            now = [(s, 0) for s in range(4)]
        else:
            found = {s: effect(piece, s) for s in {s for s, _ in now}}
            now = [(found[s][0], d + found[s][1]) for s, d in now]


def entries(spark: SparkSession, path: str) -> DataFrame:
    """``(file, schema_version, has_logs, pos, entry)``: entries as JSON text without comments, in the order of the file.

    A file without a ``logs`` array, or with an empty one, has one row of NULL ``pos``. A document that only lacks its last
    brace is read like a whole one; other broken documents, and two ``logs`` arrays, raise ``ValueError``.
    """
    pieces = _pieces(spark, path)
    # one row per split: where it leads to
    state: dict[str, tuple[int, int]] = {}
    entry: dict[tuple, tuple[int, int]] = {}
    for r in sorted(pieces.mapInArrow(_effects, "file string, begin long, size long, states array<int>, depths array<long>").collect(), key=lambda r: (r.file, r.begin)):
        s, d = state.get(r.file, (PLAIN, 0))
        entry[r.file, r.begin, r.size] = s, d
        state[r.file] = r.states[s], d + r.depths[s]
    for file, (s, d) in state.items():
        if s not in (PLAIN, LINE) or d not in (0, -1):
            raise ValueError(f"catalog {file}: the document does not end")

    def known(split: tuple) -> Cutter:
        if split not in entry:
            raise ValueError(f"the splits of {split[0]} have changed while it was read")
        return Cutter(*entry[split])

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for split, piece in _by_split(batches):
            cutter = cutter or known(split)
            if piece is not None:
                for _ in cutter.feed(piece):
                    pass
            else:
                yield _batch("file begin size texts commas", [(*split, cutter.outer, cutter.commas)], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())])
                cutter = None

    # one row per split: the text outside of values, and how many entries end in it
    outer: dict[str, str] = {}
    current: dict[str, int] = {}  # number of the entry at hand, -1 outside of logs
    firsts: dict[tuple, list[int]] = {}  # of each value of a split: number of its first entry
    for r in sorted(pieces.mapInArrow(outlines, "file string, begin long, size long, texts array<string>, commas array<long>").collect(), key=lambda r: (r.file, r.begin)):
        text, own = outer.get(r.file, ""), firsts.setdefault((r.file, r.begin, r.size), [])
        inside = entry[r.file, r.begin, r.size][1] >= 2
        for i, outside in enumerate(r.texts):
            text += outside
            if i < len(r.commas):
                if i or not inside:
                    current[r.file] = 0 if LOGS.search(text) else -1
                own.append(current[r.file])
                if current[r.file] >= 0:
                    current[r.file] += r.commas[i]
        outer[r.file] = text
    about = []
    for file, text in outer.items():
        text = text.strip()
        try:
            pairs = json.loads(text[:-1] if state[file][1] < 0 else text, object_pairs_hook=list)
        except ValueError as e:
            raise ValueError(f"catalog {file}: {e}") from None
        names = [n for n, _ in pairs]
        if names.count("logs") > 1:
            raise ValueError(f"catalog {file}: two arrays of logs")
        version = dict(pairs).get("schema_version")
        about.append((file, version if type(version) is int else None, isinstance(dict(pairs).get("logs"), list)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()], "file begin pos entry whole"
        cutter, rows, size = None, [], 0
        for split, piece in _by_split(batches):
            cutter = cutter or known(split)
            found = list(cutter.feed(piece)) if piece is not None else [(*cutter.part()[:3], False)] if cutter.held else []
            for value, commas, text, whole in found:
                first = firsts[split][value]
                if first >= 0 and (text.strip() or not whole):
                    rows.append((split[0], split[1], first + commas, text, whole))
                    size += len(text)
            if piece is None:
                cutter = None
            if size > 1 << 22 or piece is None and rows:
                yield _batch(names, rows, kinds)
                rows, size = [], 0

    # cut once: checks and the table itself read the entries, not the document
    parts = cut_lineage(pieces.mapInArrow(cut, "file string, begin long, pos long, entry string, whole boolean"))
    crossing = parts.filter("not whole").groupBy("file", "pos").agg(F.array_join(F.array_sort(F.collect_list(F.struct("begin", "entry")))["entry"], "").alias("entry"))
    rows = parts.filter("whole").select("file", "pos", "entry").unionByName(crossing.filter("trim(BOTH ' \n\r\t' FROM entry) != ''"))
    files = spark.createDataFrame(about, "file string, schema_version int, has_logs boolean")
    return files.join(rows, "file", "left").select("file", "schema_version", "has_logs", F.col("pos").cast("int").alias("pos"), "entry")


def read_document(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The same rows as ``read_catalog``, with the entries of one document spread over tasks."""
    found = entries(spark, path)
    if strict:
        from ..operators.catalog import catalog_file_violations

        bad = catalog_file_violations(described(found)).orderBy("pos").first()
        if bad:
            raise ValueError(f"catalog {path}: {bad['rule']} (entry {bad['pos']}, id {bad['id']})")
    return catalog_columns(found.filter("pos is not null"))

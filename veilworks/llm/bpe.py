"""Byte-pair encoding and decoding with a public vocabulary; merges are found by a segment tree.

Every piece of text keeps a segment tree whose leaves are its adjacent symbol pairs, each with ``rank << 32 | place``.
The root is the leftmost pair of lowest rank; a merge is three point updates of logarithmic depth. The trees of many
pieces of similar length are one array, so one numpy step merges once in each of them. A piece is encoded once per
Python worker while it is remembered: its hash names one of ``REMEMBERED`` places, where the next piece of that place
replaces it. A piece is compared with what is remembered, never taken on its hash, so forgetting changes no result.

Defined cases: a null text is an empty one and has no ids; an empty list decodes to the empty text; a literal special
token in a text is that token; repeated rows give repeated results; extra columns are not read. No row meets another,
so nothing is shuffled and a hot source or a very long text stays in its own slice.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE, loads_of, map_slices, mix, rows_of, sums_of

REMEMBERED = 1 << 19
GROUP = 3000  # pieces that are merged at once; few enough for a processor's cache
KEY_WORDS, KEY_IDS = 4, 10  # longer pieces are not remembered: eight bytes a word, and ids
NONE = np.int64(1) << 62
LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 0
# Unicode's White_Space; fixed values
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@dataclass
class Vocabulary:
    tokens: list[bytes]  # text of each id
    pairs: np.ndarray  # left << 32 | right, each at the first free slot from its hash on; -1 where there is none
    ranks: np.ndarray  # of the pairs; NONE where there is none
    merged: np.ndarray  # id made by the merge of each rank
    inner: np.ndarray  # id of each byte inside a piece
    final: np.ndarray  # id of each byte at the end of a piece
    specials: dict[str, int]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def pair_slots(key: np.ndarray, slots: int) -> np.ndarray:
    """First slot to look for each pair in a table of a power of two."""
    return (key.astype(np.uint64) * np.uint64(BASE) >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


def hashed_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and ranks by slot, an eighth full at most; the last rank of a pair that is listed twice."""
    slots = 8 << len(keys).bit_length()
    pairs, ranks = np.full(slots, -1, np.int64), np.full(slots, NONE)
    rank, at = np.arange(len(keys)), pair_slots(keys, slots)
    while len(rank):
        free = pairs[at] < 0
        pairs[at[free]] = keys[rank[free]]
        here = pairs[at] == keys[rank]
        ranks[at[here]] = rank[here]
        rank, at = rank[~here], at[~here] + 1 & slots - 1
    return pairs, ranks


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
    for t, i in [*vocab.items(), *specials.items()]:
        tokens[i] = t.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
    pairs, ranks = hashed_pairs(keys)
    letters = byte_letters()
    return Vocabulary(tokens, pairs, ranks, np.array([vocab[a + b] for a, b in merges], np.int64), np.array([vocab[c] for c in letters]), np.array([vocab[c + end] for c in letters]), specials)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, other or white space for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    return out


def normal(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # each character on its own


def pieces(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of rows of code points that are joined by line feeds.

    A piece is a contraction ('s 't 're 've 'm 'll 'd), a run of letters, one number or a run of other characters.
    """
    kind = classes()[points]
    edge = np.ones(len(kind), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(kind))
    full = kind[starts] != WHITE
    starts, ends = starts[full], ends[full]
    mark = np.flatnonzero((points[starts] == 39) & (ends - starts == 1))
    mark = mark[mark + 1 < len(starts)]
    mark = mark[(starts[mark + 1] == ends[mark]) & (kind[starts[np.minimum(mark + 1, len(starts) - 1)]] == LETTER)] if len(mark) else mark
    if len(mark):
        a = points[starts[mark + 1]]
        b = np.where(ends[mark + 1] - starts[mark + 1] > 1, points[np.minimum(starts[mark + 1] + 1, len(points) - 1)], 0)
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        taken = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, np.where(two, 2, 0))
        ends[mark] += taken
        starts[mark + 1] += taken
        full = starts < ends
        starts, ends = starts[full], ends[full]
    return starts, ends


def rank_pairs(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each adjacent pair, NONE if the pair never merges."""
    key = left << 32 | right
    at = pair_slots(key, len(v.pairs))
    found = v.pairs[at]
    rank = v.ranks[at]
    look = np.nonzero((found != key) & (found >= 0))
    rank[look] = NONE
    while len(look[0]):
        at[look] = at[look] + 1 & len(v.pairs) - 1
        found = v.pairs[at[look]]
        here = found == key[look]
        rank[tuple(x[here] for x in look)] = v.ranks[at[look][here]]
        look = tuple(x[~here & (found >= 0)] for x in look)
    rank[v.pairs[at] != key] = NONE
    return rank


def merge_all(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Merge rows of symbols (padded to the width) until no pair is left; returns which symbols live, ids in place."""
    m, n = ids.shape
    leaves = 1 << max(0, (n - 1).bit_length())
    place = np.arange(n)
    live = place < sizes[:, None]
    tree = np.full((m, 2 * leaves), NONE, np.int64)
    rank = rank_pairs(v, ids[:, :-1], ids[:, 1:])
    tree[:, leaves : leaves + n - 1] = np.where((rank < NONE) & live[:, 1:], rank << 32 | place[:-1], NONE)
    size = leaves
    while size > 1:
        tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
        size //= 2
    # one dimension from here on: symbol i of row r is at r * n + i, its leaf at (2 * r + 1) * leaves + i
    symbols, alive, nodes = ids.reshape(-1), live.reshape(-1), tree.reshape(-1)
    following = np.where(place + 1 < sizes[:, None], place + 1, n).reshape(-1)
    preceding = np.tile(place - 1, m)

    def pair_value(own: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = following[own + i]
        ends = j >= n
        rank = rank_pairs(v, symbols[own + i], symbols[own + np.where(ends, 0, j)])
        return np.where(ends | (rank >= NONE), NONE, rank << 32 | i)

    r = np.arange(m)
    while True:
        root = nodes[2 * leaves * r + 1]
        some = root < NONE
        r, root = r[some], root[some]
        if not len(r):
            return live
        own = r * n
        i = root & 0xFFFFFFFF
        j = following[own + i]
        symbols[own + i] = v.merged[root >> 32]
        alive[own + j] = False
        after = following[own + j]
        following[own + i] = after
        inside = after < n
        preceding[own[inside] + after[inside]] = i[inside]
        before = preceding[own + i]
        has = before >= 0
        at = np.concatenate([j, i, before[has]]) + leaves
        base = np.concatenate([r, r, r[has]]) * (2 * leaves)
        value = pair_value(base[len(r) :] // (2 * leaves) * n, at[len(r) :] - leaves)
        nodes[base + at] = np.concatenate([np.full(len(r), NONE), value])
        for _ in range(leaves.bit_length() - 1):
            left = base + (at & -2)
            at >>= 1
            nodes[base + at] = np.minimum(nodes[left], nodes[left + 1])


def encode_pieces(v: Vocabulary, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of pieces (UTF-8 bytes one after another, none empty), and where each one's begin and how many they are."""
    starts = np.cumsum(sizes) - sizes
    made, begin, count, total = [], np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    order = np.argsort(sizes, kind="stable")
    ascending = sizes[order]
    lo = 0
    while lo < len(order):
        least = int(ascending[lo])
        width = 1 << max(1, (least - 1).bit_length())
        if least > 4 and least <= width * 3 // 4:
            width = width * 3 // 4
        hi = int(np.searchsorted(ascending, width, "right"))
        hi = min(hi, lo + max(1, min(GROUP, (1 << 19) // width)))
        group = order[lo:hi]
        n = sizes[group]
        index = starts[group, None] + np.minimum(np.arange(width), n[:, None] - 1)
        ids = v.inner[flat[index]]
        ids[np.arange(len(group)), n - 1] = v.final[flat[starts[group] + n - 1]]
        live = merge_all(v, ids, n)
        made.append(ids[live].astype(np.uint32))
        count[group] = live.sum(1)
        begin[group] = total + np.cumsum(count[group]) - count[group]
        total += len(made[-1])
        lo = hi
    return np.concatenate([*made, np.zeros(0, np.uint32)]), begin, count


class Memory:
    """The ids of one piece in each place; a piece is known by its words and its size, 0 where there is none."""

    def __init__(self, places: int) -> None:
        self.words, self.ids = np.zeros((places, KEY_WORDS), np.uint64), np.zeros((places, KEY_IDS), np.uint32)
        self.size, self.count, self.last = (np.zeros(places, np.int32) for _ in range(3))

    def knows(self, at: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.size[at] == size) & (self.words[at] == words).all(1)

    def keep(self, at: np.ndarray, words: np.ndarray, size: np.ndarray, ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        self.last[at] = np.arange(len(at))
        own = np.flatnonzero(self.last[at] == np.arange(len(at)))  # one piece for each place
        at = at[own]
        self.words[at], self.size[at], self.count[at] = words[own], size[own], count[own]
        self.ids[at] = ids[np.minimum(begin[own, None] + np.arange(KEY_IDS), len(ids) - 1)]


_remembered: dict[str, Memory] = {}


def code_points(text: str) -> tuple[np.ndarray, str]:
    """The code points in the least of 8, 16 and 32 bits that holds them all, and that encoding."""
    for coding, kind in (("latin-1", np.uint8), ("utf-16-le", np.uint16)):
        try:
            points = np.frombuffer(text.encode(coding), kind)
        except UnicodeEncodeError:
            continue
        if len(points) == len(text):
            return points, coding
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), "utf-32-le"


def piece_codes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A number for each piece, equal for equal pieces; and of each number its first piece, a hash and ``KEY_WORDS`` words.

    Pieces are grouped by hash and compared with the first of their group; those that differ are grouped anew.
    """
    width = points.itemsize
    words, begin, n = loads_of(points.view(np.uint8), starts * width, ends * width)
    sums = sums_of(words, begin, n, BASE) if len(n) else np.zeros(0, np.uint64)
    codes = pd.factorize(sums)[0]
    first = np.full(int(codes.max()) + 1 if len(codes) else 0, -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    size = ends - starts
    like = first[codes]
    other = size != size[like]
    if not other.any():
        to = np.repeat(begin[like] - begin, n)
        to += np.arange(len(words))
        differ = np.flatnonzero(words != words[to])
        other[np.searchsorted(begin, differ, "right") - 1] = True
    else:
        other[:] = True  # a clash of pieces of different lengths: all are grouped anew
    if other.any():
        rest = np.flatnonzero(other)
        again = pd.factorize(np.array([points[a:b].tobytes() for a, b in zip(starts[rest], ends[rest])], object))[0]
        codes = codes.copy()
        codes[rest] = again + len(first)
        more = np.empty(int(again.max()) + 1, np.int64)
        more[again[::-1]] = rest[::-1]
        first = np.concatenate([first, more])
    key = np.zeros((len(first), KEY_WORDS), np.uint64)
    for k in range(KEY_WORDS):
        long = np.flatnonzero(n[first] > k)
        key[long, k] = words[begin[first[long]] + k]
    return codes, first, mix(sums[first] + size[first].astype(np.uint64)), key


def encode_flat(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after another, and how many each text has."""
    v = load(path)
    special = re.compile("|".join(map(re.escape, v.specials)) or "(?!)")
    parts: list[str] = []
    until: list[int] = []  # of each text: how many parts there are at its end
    marks: list[tuple[int, int]] = []  # special tokens: the part after them, their id
    for t in texts:
        at = 0
        for m in special.finditer(t) if "<|" in t else ():
            parts.append(normal(t[at : m.start()]))
            marks.append((len(parts), v.specials[m[0]]))
            at = m.end()
        parts.append(normal(t[at:] if at else t))
        until.append(len(parts))
    whole = "\n".join(parts)
    points, coding = code_points(whole)
    row_end = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts, ends = pieces(points, row_end)
    codes, first, hashes, words = piece_codes(points, starts, ends)
    if path not in _remembered:
        _remembered[path] = Memory(REMEMBERED)
    memory = _remembered[path]
    size = ends[first] - starts[first]
    place = (hashes % np.uint64(len(memory.size))).astype(np.int64)
    short = size * points.itemsize <= 8 * KEY_WORDS
    named = (size << 3 | points.itemsize).astype(np.int32)
    known = short & memory.knows(place, words, named)
    count, begin = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    count[known] = memory.count[place[known]]
    flat = memory.ids[place[known]][np.arange(KEY_IDS) < count[known, None]]
    begin[known] = np.cumsum(count[known]) - count[known]
    new = np.flatnonzero(~known)
    if len(new):
        n = size[new]
        own = points[np.arange(int(n.sum())) + np.repeat(starts[first[new]] - (np.cumsum(n) - n), n)]
        data = np.frombuffer(own.tobytes().decode(coding, "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        upto = np.cumsum(np.uint8(1) + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000), dtype=np.int64)[np.cumsum(n) - 1]
        made, begin[new], count[new] = encode_pieces(v, data, np.diff(upto, prepend=0))
        held = new[short[new] & (count[new] <= KEY_IDS)]
        memory.keep(place[held], words[held], named[held], made, begin[held], count[held])
        begin[new] += len(flat)
        flat = np.concatenate([flat, made])
    counts = count[codes]
    stops = np.cumsum(counts)
    index = np.repeat(begin[codes] - (stops - counts), counts)
    index += np.arange(len(index))
    ids = flat[index]
    bounds = np.concatenate([[0], np.concatenate([[0], stops])[np.searchsorted(starts, row_end)]])
    ends_of_texts = bounds[until]
    if marks:
        after, tokens = np.array(marks, np.int64).T
        ids = np.insert(ids, bounds[after], tokens.astype(np.uint32))
        ends_of_texts = ends_of_texts + np.searchsorted(after, until, "left")
    return ids, np.diff(ends_of_texts, prepend=0)


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers."""
    ids, counts = encode_flat(path, texts)
    data, bounds = ids.astype("<u4", copy=False).tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def decode(path: str, ids: bytes) -> bytes:
    """The token texts of the ids joined by spaces, in UTF-8: this vocabulary has no decoder that joins them closer."""
    tokens = load(path).tokens
    return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``(key, n_tokens, ids, ...)``; ids are little-endian unsigned 32-bit integers in one binary value."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batch, lo, hi, data, offsets):
        ids = encode_texts(path, ["" if t is None else t for t in rows_of(batch, "text", lo, hi).to_pylist()])
        out = {"doc_id": rows_of(batch, "doc_id", lo, hi), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
        return out | {"decoded": [decode(path, x).decode("utf-8", "replace") for x in ids]} if decoded else out

    return map_slices(narrow, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded, work)


def op9(docs: DataFrame, path: str) -> DataFrame:
    out = encoded(docs, path, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

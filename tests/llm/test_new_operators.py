"""Ranked search, best-fit packing and whitening against brute force and the public library."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tokenizers
from pyspark.sql import functions as F

from veilworks.llm import best_fit_packing, embedding_whitening, ranked_search
from veilworks.llm.arrays import span_hashes

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LOW = {i: i + 32 for i in range(65, 91)}


# 11
def brute_search(rows, items, top=50):
    term = regex.compile(ranked_search.TERM)
    bags = [(i, Counter(term.findall((t or "").translate(LOW)))) for i, t in rows]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(term.findall((t or "").translate(LOW)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in bags:
            m = 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def pairs(df, key):
    return [(r[0], r[1]) for r in df.select(key, "text").collect()]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_ranked_search(request, items, table):
    df = request.getfixturevalue(table)
    more = items.union(items.sparkSession.createDataFrame([(None, "w1x0"), (900, None), (901, "---"), (902, "A tok! nowhere"), (902, "é x")], items.schema))
    got = sorted(map(tuple, ranked_search.op11(df, more).collect()))
    assert got == brute_search(pairs(df, "doc_id"), pairs(more, "item_id"))


def test_search_does_not_depend_on_blocks(docs, items, monkeypatch):
    want = brute_search(pairs(docs, "doc_id"), pairs(items, "item_id"), 5)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 3)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 700)
    monkeypatch.setattr(ranked_search, "FIRST", 1)
    got = ranked_search.search(docs.repartition(5), items, 5)
    assert sorted(map(tuple, got.collect())) == want


def test_hot_stratum_and_ties(spark):
    """Most documents have one length; many score the same."""
    rows = [(i, f"alpha beta w{i % 7} w{i % 3}") for i in range(400)] + [(1000 + i, "alpha " * (i + 1)) for i in range(20)]
    items = [(1, "alpha w1"), (2, "beta"), (3, "w2 w2 W2 w6")]
    got = ranked_search.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_search(rows, items)


def test_bounds_are_never_below_a_score():
    rng = np.random.default_rng(3)
    codes = [np.unique(rng.integers(0, 40, 9)) for _ in range(200)]
    tfs = [rng.integers(1, 300 if k % 50 == 0 else 5, len(c)) for k, c in enumerate(codes)]
    row = ranked_search.index_block(0, 77, list(range(200)), [c.astype("<u4").tobytes() for c in codes], [ranked_search.small_ints(t) for t in tfs])
    block = {k: np.frombuffer(v, t).astype(np.int64) for k, v, t in zip(("ids", "terms", "tops", "term_runs", "run_tfs", "run_begin", "docs"), row[3:], ("<i8", "<u4", "<u4", "<u4", "<u4", "<u4", "<u2"))}
    block |= {"n_docs": 200, "impact": ranked_search.impacts(block["run_tfs"], 77)}
    items = ranked_search.Items(np.arange(2), np.array([0, 5, 9]), np.array([3, 9, 11, 20, 39, 0, 1, 2, 45]), rng.integers(1, 9000, 50))
    most = ranked_search.bounds(items, 77, block["terms"], block["tops"])
    places = ranked_search.Places(np.ones(2, np.int64), 200)
    for i in (0, 1):
        ranked_search.visit(block, items, i, places)
        own = set(items.code[items.begin[i] : items.begin[i + 1]].tolist())
        want = {d: sum(int(items.weight[c]) * (10**9 * int(t) // (1000 * int(t) + 20 * 77)) for c, t in zip(codes[d].tolist(), tfs[d].tolist()) if c in own) for d in range(200)}
        assert dict(zip(places.held[i][1].tolist(), places.held[i][0].tolist())) == {d: s for d, s in want.items() if s}
        assert max(want.values()) <= most[i]


def test_terms_are_compared_by_bytes(monkeypatch):
    """A hash that all words share finds no stranger."""
    terms = ranked_search.vocabulary(["abc"])
    data = np.frombuffer(b"abd abc ab", np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([3, 7, 10])
    terms.hashes[:] = 5
    monkeypatch.setattr(ranked_search, "span_hashes", lambda *a: np.full(3, 5, np.uint64))
    word, code = ranked_search.known_words(terms, data, starts, ends)
    assert word.tolist() == [1] and code.tolist() == [0]


# 12
def check_packing(rows, capacity):
    """Sequences are gapless from 0 and within the capacity; returns how many there are."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("table, capacity", [("docs", 2048), ("odd", 2048), ("odd", 64)])
def test_packing(request, table, capacity):
    df = request.getfixturevalue(table)
    lib = tokenizers.Tokenizer.from_file(BYTES)
    want = Counter()
    for i, t in pairs(df, "doc_id"):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cut = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = best_fit_packing.pack(best_fit_packing.pieces(df, BYTES, capacity), capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    least = -(-sum(r.length for r in rows) // capacity)
    assert least <= check_packing(rows, capacity) <= math.ceil(1.02 * least) + 1


def test_packing_does_not_depend_on_the_split(docs):
    outs = []
    for df in (docs, docs.repartition(7), docs.repartitionByRange(2, "source")):
        rows = best_fit_packing.pack(best_fit_packing.pieces(df, BYTES)).collect()
        outs.append(sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows))
    assert outs[0] == outs[1] == outs[2]


def test_sequences_hold_the_ids(docs):
    packed = best_fit_packing.pack(best_fit_packing.pieces(docs, BYTES, ids=True))
    rows, whole = packed.collect(), {r.sequence_id: r for r in best_fit_packing.sequences(packed).collect()}
    for r in rows:
        own = whole[r.sequence_id]
        assert own.ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids and zlib.crc32(r.ids) == r.ids_crc32
    assert all(4 * r.n_ids == len(r.ids) and r.offsets == sorted(r.offsets) for r in whole.values())


def fewest(lengths, capacity):
    """Least number of sequences, by trying all arrangements."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= lengths[k]:
                go(k + 1, [r - lengths[k] if j == i else r for j, r in enumerate(rooms)])
        go(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def unpack(plan, counts):
    key, rank, sequence, per, offset = plan.arrays()
    rows = []
    for length in np.flatnonzero(counts).tolist():
        for r in range(counts[length]):
            k = int(np.searchsorted(key, length << 44 | r, "right")) - 1
            step = r - rank[k]
            rows.append((length, int(sequence[k] + step // per[k]), int(offset[k] + step % per[k] * length)))
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_close_to_the_fewest(seed):
    rng = np.random.default_rng(seed)
    capacity = 40
    lengths = rng.integers(1, capacity + 1, 10) if seed % 2 else rng.choice([14, 13, 9, 21, 6], 11)
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = best_fit_packing.plan(counts, capacity)
    rows = unpack(plan, counts)
    held = defaultdict(list)
    for length, sequence, offset in rows:
        held[sequence].append((offset, length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= capacity
    assert len(held) == plan.sequences <= fewest(lengths.tolist(), capacity) + 1


def test_groups_arrange_what_best_fit_cannot():
    """Pieces of 0.2 to 0.5 of the capacity: longest-first leaves room that configurations use; the plan stays small."""
    counts = np.bincount(np.random.default_rng(1).integers(400, 1000, 100_000), minlength=2049)
    least = -(-int((counts * np.arange(2049)).sum()) // 2048)
    plan = best_fit_packing.plan(counts)
    assert plan.sequences <= 1.012 * least
    assert best_fit_packing.grouped(counts, 2048, 96, 1024).sequences >= 1.05 * least
    assert len(plan.runs) < 5000


def test_one_length(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    rows = best_fit_packing.pack(df).collect()
    assert len(rows) == 5000 and check_packing(rows, 2048) == 2500


def test_encoder_equals_the_library(docs):
    lib = tokenizers.Tokenizer.from_file(BYTES)
    texts = [t or "" for _, t in pairs(docs, "doc_id")] + ["", " ", "a<|endoftext|>b", "don't 'tis  x''s\r\n\t y ", "½²٣ 日本語 😀😀", "\x00\x1c\x85​", " " * 30_000, "#" * 9000]
    for t in texts:
        assert best_fit_packing.encoder(BYTES)(t).tolist() == lib.encode(t, add_special_tokens=False).ids
    word = public_tokenizers.path("word_bpe_49k.json")  # a file of another kind goes to the library
    assert best_fit_packing.encoder(word)("Some words").tolist() == tokenizers.Tokenizer.from_file(word).encode("Some words", add_special_tokens=False).ids


# 13
def brute_whitening(vectors, weights=None, k=32):
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    w = np.ones(len(x)) if weights is None else weights
    y = x - (w @ x) / w.sum()
    value, axes = np.linalg.eigh((y.T * w) @ y / w.sum())
    value, axes = value[::-1], axes[:, ::-1]
    k = min(k, int((value > 1e-9 * value[0]).sum()))
    exact = x.astype(object)
    sums = exact.sum(0)
    return y @ axes[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum(), ((len(x) * exact - sums) ** 2).sum(1)


def compare_whitening(rows, vectors, ids):
    z, explained, deviation = brute_whitening(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == z.size
    for row, i in enumerate(ids):
        for c in range(z.shape[1]):
            r = got[i, c + 1]
            assert abs(abs(r.whitened) - abs(z[row, c])) < 1e-6 and r.deviation == deviation[row] and r.n == len(ids)
            assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error <= 1e-4
    for c in range(z.shape[1]):  # one sign for all rows
        assert len({np.sign(got[i, c + 1].whitened * z[row, c]) for row, i in enumerate(ids) if abs(z[row, c]) > 1e-6}) == 1


def test_whitening(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    compare_whitening(embedding_whitening.op13(table.repartition(3)).collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(0, 0.3, (60, 5)).round(2)
    good[20:40] = good[0]  # copies
    good[:, 4] = 0.5  # no variance
    good[59, 0] = 300.0  # two bytes an entry
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] + [0.0] * 4), (104, [float("inf")] + [0.0] * 4), (105, [0.1] * 4), (None, None)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    for c in ("x", "weight", "n", "component", "v", "m", "i", "deviation", "label"):
        table = table.withColumn(c, F.lit("extra"))
    out = embedding_whitening.op13(table.repartition(4)).collect()
    compare_whitening(out, np.array(good, np.float32).astype(float), range(60))
    assert max(r.component for r in out) == 4
    # copies counted once in the fit
    once = embedding_whitening.whiten(table, weighted=False).filter("component = 1")
    assert once.count() == 60 and {r.n for r in once.select("n").collect()} == {len(np.unique(np.floor(good.astype(np.float32) * 64), axis=0))}


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_whitening.op13(spark.createDataFrame([], schema)).collect() == []
    assert embedding_whitening.op13(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert embedding_whitening.op13(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).collect() == []


def test_whitening_of_great_entries(spark):
    """Entries far from unit length: whole numbers beyond 64 bits stay exact or are null, never wrong."""
    rng = np.random.default_rng(6)
    v = rng.integers(-(10**9), 10**9, (40, 3)).astype(float)
    v[0, 0] = 1e300
    out = embedding_whitening.whiten(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    x = np.clip(np.floor(v * 64), -(2**40), 2**40).astype(np.int64).astype(object) + 1_000_000
    want = ((40 * x - x.sum(0)) ** 2).sum(1)
    assert all(int(r.deviation) == want[r.vec_id] for r in out) and len(out) == 120 and max(r.identity_error for r in out) < 1e-4


# hashes
def swapped(n):
    """The word of n halvings of a and b, and the one with both exchanged: they cancel in a polynomial modulo 2**64."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("seed", [1, 7, 0x9E3779B97F4A7C15])
def test_hashes_of_swapped_words_differ(seed):
    for word in swapped(11):
        data = np.frombuffer(word.encode(), np.uint8)
        for values in (data, data.astype(np.uint32), np.where(data == 97, 2**63 + 11, 12345).astype(np.uint64)):
            got = [span_hashes(values, np.array([0]), np.array([len(values)]), seed)[0]]
            other = 195 - data if values is data else 195 - values if values.dtype == np.uint32 else np.where(data == 98, 2**63 + 11, 12345).astype(np.uint64)
            assert span_hashes(other, np.array([0]), np.array([len(other)]), seed)[0] != got[0]


def test_hashes_are_of_the_content():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 3900, 900))
    ends = starts + rng.integers(0, 40, 900)
    got = span_hashes(data, starts, ends)
    texts = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(got.tolist())) == len(set(texts)) == len(set(zip(got.tolist(), texts)))
    alone = [span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] for t in texts]
    assert alone == got.tolist()

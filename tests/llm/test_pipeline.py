"""The pipeline against brute force, stage by stage."""

import hashlib
import re

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from veilworks.llm import decontamination, quality_classifier
from veilworks.llm.tables import written

from test_operators import brute_components, brute_spans, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_stages(spark, sf, docs, labels, items):
    names = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = {r.doc_id: r for r in docs.collect()}

    good = written(stages[0](spark, docs, sf))
    score = {r.doc_id: r.predicted for r in quality_classifier.op10(docs, labels).collect()}
    assert good.columns == names and {r.doc_id for r in good.collect()} == {i for i, p in score.items() if p == 1}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum(i in kept for i, q in marked.items() if q == 1) >= 0.95 * sum(marked.values())

    single = written(stages[1](spark, good, sf))
    groups = brute_components([(i, rows[i].text) for i in kept])
    kept = {r.doc_id for r in single.collect()}
    assert single.columns == names and kept == {i for i, (_, c) in groups.items() if c == i}

    clean = written(stages[2](spark, single, sf))
    leaked = {r.doc_id for r in decontamination.op3(single, items).collect()}
    tests = [r.text for r in items.collect()]
    assert leaked >= {i for i in kept if any(t in rows[i].text for t in tests)}
    kept -= leaked
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == kept

    safe = written(stages[3](spark, clean, sf))
    assert safe.columns == names
    texts = {}
    for r in safe.collect():
        text, out, at = rows[r.doc_id].text, "", 0
        for s in filter(None, brute_spans(text)[1].split(",")):
            begin, end = map(int, s.split(":")[1:])
            if begin >= at:
                out += text[at:begin] + "[SECRET]"
            at = max(at, end)
        texts[r.doc_id] = out + text[at:]
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text)
    assert texts.keys() == kept and any("[SECRET]" in t for t in texts.values())

    lib = tokenizers.Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in stages[4](spark, safe, sf).collect()}
    assert got.keys() == kept
    for i, r in got.items():
        ids = lib.encode(texts[i], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def five_word_components(rows, similar=80):
    """doc_id -> least id of its component, every pair compared by groups of five words."""
    low = {i: i + 32 for i in range(65, 91)}
    sets, least = {}, {}
    for i, t in rows:
        w = words((t or "").translate(low))
        sets[i], least[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set(), i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = sorted((least[a], least[b]))
                least = {i: x if c == y else c for i, c in least.items()}
    return least


def test_near_copies_by_five_words(spark, sf, docs):
    """Copies around the limits: some reach 0.8 of five-word groups but not 0.85 of four-word groups."""
    rng = np.random.default_rng(21)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for family in range(20):
        base = [f"n{family}w{i}" for i in rng.integers(0, 5000, int(rng.integers(30, 140)))]
        for copy in range(8):
            edits = set(rng.integers(0, len(base), copy).tolist())
            text = " ".join(f"e{copy}x{k}" if k in edits else w for k, w in enumerate(base))
            rows.append((100_000 + 100 * family + copy, text.upper() if copy % 3 == 0 else text))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    want = {i for i, c in five_word_components(rows).items() if c == i}
    assert want != {i for i, (_, c) in brute_components(rows).items() if c == i}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, sf).collect()} == want


def test_run_and_odd_rows(spark, sf, odd, docs):
    assert 0 < corpus_pipeline.run(spark, sf).count() < docs.count()
    table = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = written(stage(spark, table, sf))
        assert table.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() == table.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_operators_do_not_hide_import_errors():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for f in [root / "corpus_pipeline.py", *(root / "veilworks/llm").glob("*.py")]:
        assert not re.search(r"except (ImportError|ModuleNotFoundError)", f.read_text()), f

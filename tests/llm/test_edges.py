"""Empty tables, nulls, repeated ids, very long texts and clashing names; and the pipeline stage by stage against plain loops."""

import array
import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, decontaminate, jaccard, mixing, ogg, token_counts, token_files, toxicity
from granary.llm.common import unpack
from granary.llm.queries import vocabulary

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, toxic int"
ITEMS = "item_id long, text string"
#: Two rows of one id and one text, two of one id and different texts, one without id, one without text.
REPEATED = [(3, "one two three four five six", "a"), (3, "one two three four five six", "a"), (4, "seven eight", "b"), (4, "nine ten eleven", None), (None, "no id here", "a"), (5, None, "b")]


def plain_score(model, text):
    """The largest mean over twelve words of each word's mean over its buckets, as a logistic."""
    (m,) = unpack(model)
    worth = []
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        # Windows of 40 letters, each of which begins 35 letters behind the one before.
        for at in range(0, max(1, len(word) - 5), 35) if len(word) > 40 else [0]:
            marked = f"<{word[at : at + 40]}>"
            grams = {marked} | {marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}
            worth.append(sum(m[zlib.crc32(g.encode()) % (len(m) - 1)] for g in grams) / len(grams))
    n = min(12, len(worth))
    best = max((sum(worth[i : i + n]) / n for i in range(len(worth) - n + 1)), default=0.0) if n else 0.0
    return 1 / (1 + math.exp(-max(-500, min(500, best + m[-1]))))


def some_model(seed=9):
    from granary.llm.common import pack

    return pack(np.append(np.random.default_rng(seed).normal(0, 2, toxicity.BUCKETS), -0.7))


def held(text, items):
    """The item of 5-word runs of which `text` holds 0.8 or more, or None."""

    def runs(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    own = runs(text)
    return next((i for i, t in items if i is not None and (s := runs(t)) and len(s & own) >= 0.8 * len(s) - 1e-9), None)


def test_scores_equal_a_plain_loop(spark):
    texts = [None, "", " _ !?", "one", "Ein Straßenname, İ and 日本語テキスト", "x" * 5000, "abc" * 30 + " tail", "".join(map(chr, range(97, 123))) * 2 + " end"]
    texts += [" ".join(f"word{(i * k) % 37}" for i in range(k)) for k in (2, 11, 12, 13, 40, 20_000)]
    model = some_model()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.repartition(3), model).collect()}
    assert got == pytest.approx({i: plain_score(model, t) for i, t in enumerate(texts)}, abs=1e-9)


def test_empty_tables(spark):
    docs, labels, items = (spark.createDataFrame([], s) for s in (DOCS, LABELS, ITEMS))
    some = spark.createDataFrame(REPEATED, DOCS)
    item = spark.createDataFrame([(1, "one two three four five six")], ITEMS)
    for found in (decontaminate.containment(docs, item), decontaminate.containment(some, items), decontaminate.decontaminate(docs, item), token_counts.token_counts(docs, vocabulary()), ogg.media_columns(docs), toxicity.toxicity(docs, labels), jaccard.keep_one_per_component(docs), token_files.token_files(docs, vocabulary())):
        assert found.count() == 0
    assert decontaminate.decontaminate(some, items).count() == len(REPEATED)
    assert toxicity.toxicity(docs, spark.createDataFrame([(1, 1), (2, 0)], LABELS)).count() == 0


def test_repeated_ids_have_rows_of_their_own(spark):
    docs = spark.createDataFrame(REPEATED, DOCS).repartition(4)
    library = bpe.load(vocabulary())
    coded = [[*library.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for _, t, _ in REPEATED]
    crc = Counter((i, len(c), zlib.crc32(array.array("I", c).tobytes())) for (i, *_), c in zip(REPEATED, coded))
    files = token_files.token_files(docs, vocabulary()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in files) == crc
    files = sorted(files, key=lambda r: r.start)
    assert files[0].doc_id is None and all(b.start == a.start + a.n_tokens for a, b in zip(files, files[1:]))
    counts = token_counts.token_counts(docs, vocabulary()).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in counts) == Counter((i, len((t or "").encode()), len(c) - 1) for (i, t, _), c in zip(REPEATED, coded))
    media = ogg.media_columns(docs).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in media) == Counter((i, len((t or "").encode())) for i, t, _ in REPEATED)
    model = some_model()
    scored = toxicity.score_toxicity(docs, model).collect()
    assert sorted(r.score for r in scored) == pytest.approx(sorted(plain_score(model, t) for _, t, _ in REPEATED), abs=1e-9)


def test_repeated_ids_stand_or_fall_together(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, long + " more", "a"), (2, "something else altogether", "b"), (None, long, "a"), (7, "", "a"), (8, "", "a")], DOCS)
    kept = jaccard.keep_one_per_component(docs).collect()
    assert sorted((r.doc_id or 0, r.text == long) for r in kept) == [(0, True), (1, True), (1, True), (7, False), (8, False)]
    item = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(10))), (6, None), (None, "something else altogether")], ITEMS)
    left = decontaminate.decontaminate(docs, item).collect()
    assert sorted((r.doc_id or 0, r.text == long) for r in left) == [(0, True), (7, False), (8, False)]


def test_a_short_item_inside_a_very_long_text(spark):
    item = "the quick brown fox jumps over the lazy dog tonight"
    noise = " ".join(f"n{i % 70_001}" for i in range(150_000))
    texts = [noise, f"{noise} {item} {noise}", f"{noise}, THE QUICK brown fox jumps over the lazy dog; {noise}", f"{noise} quick brown fox jumps over the lazy {noise}"]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], DOCS)
    items = [(1, item), (2, "n1 n3 n5 n7 n9 n11")]
    left = {r.doc_id for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, ITEMS)).select("doc_id").collect()}
    # The item has six runs of five words; text 2 holds five of them and text 3 three.
    assert left == {i for i, t in enumerate(texts) if held(t, items) is None}
    assert left == {0, 3}


def test_names_of_columns_that_clash(spark):
    names = ["n_shingles", "component_id", "h", "words", "shingle", "item_id", "chunk", "bytes", "cls", "_cls", "n_tokens", "start", "bucket", "n_shared"]
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, long, "a"), (2, long + " x", "a"), (3, "other words", "b")], DOCS)
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    item = spark.createDataFrame([(1, "other words", 1)], ITEMS + ", doc_id long")
    for found, ids in ((jaccard.keep_one_per_component(docs), {1, 3}), (decontaminate.decontaminate(docs, item), {1, 2})):
        rows = found.collect()
        assert found.columns == docs.columns and {r.doc_id for r in rows} == ids
        assert all(r[n] == f"own {n}" for r in rows for n in names)
    assert {r.doc_id for r in token_files.token_files(docs, vocabulary()).collect()} == {1, 2, 3}
    assert {r.doc_id for r in token_counts.token_counts(docs, vocabulary()).collect()} == {1, 2, 3}


def test_the_pipeline_equals_its_stages_done_plainly(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in table("documents").collect()]
    model = toxicity.train(table("documents"), table("labels"))
    if toxicity.is_fitted(model):
        docs = [d for d in docs if plain_score(model, d[1]) < 0.5]
    group = brute.jaccard_components([(i, t or "") for i, t, _ in docs], 5, 80)
    docs = [d for d in docs if group[d[0]][1] == d[0]]
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    docs = [d for d in docs if held(d[1], items) is None]
    # The operator's own copies: they depend on a row's id and its source's share alone, and have a test of their own.
    mixed = mixing.mix_sources(spark.createDataFrame(docs, DOCS), alpha=0.5, added=False).select("doc_id").collect()
    library, text = bpe.load(vocabulary()), {i: t for i, t, _ in docs}
    coded = {i: [*library.encode(text[i] or "", add_special_tokens=False).ids, token_files.END_ID] for i in {r.doc_id for r in mixed}}
    want, start = [], 0
    for i in sorted(r.doc_id for r in mixed):
        want.append((i, start, len(coded[i]), zlib.crc32(array.array("I", coded[i]).tobytes())))
        start += len(coded[i])
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and len(want) > 10

import array
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, decontaminate, mixing, ogg, suffix_tree, token_counts, token_files, toxicity
from granary.llm.common import pack, pack_sorted, scratch, unpack, unpack_sorted
from granary.llm.queries import vocabulary

ODD = ["", None, "  ", "it's I'LL don't", "<|endoftext|>x <|startoftext|>", "İ Σας ΣΑΣ ǅ é", "日本語 123 4.5 ½²", "a\x1cb\x85c\xa0d e", "word!, next_, x., ?!. y", "thé Thé, THÉ. ŒUVRE", "퟿\U0001f600 #2 2", "x" * 3000, "ab " * 30_000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, n_tokens int")


@pytest.fixture(scope="module")
def library():
    return bpe.load(vocabulary())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_packing_round_trip():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    steps, small, none = unpack(pack(pack_sorted(keys), np.arange(7, dtype=np.uint32), np.zeros(0)))
    assert (unpack_sorted(steps) == keys).all() and list(small) == list(range(7)) and len(none) == 0


def test_token_files_hold_the_library_ids(spark, library):
    docs = frame(spark, ODD)
    shards = token_files.write_token_files(docs.repartition(3), vocabulary(), scratch(spark, "t"))
    got = {r.doc_id: r for r in token_files.read_token_files(shards).collect()}
    start = 0
    for i, t in enumerate(ODD):
        want = [*ids(library, t), token_files.END_ID]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(array.array("I", want).tobytes()))
        start += len(want)
    last = shards.orderBy(F.desc("shard")).first()
    reader = token_files.open_shard(last.path)
    k = len(reader.sizes) - 1
    assert reader.tokens(k).tolist()[-1] == token_files.END_ID and reader.read_frames <= len(reader.frames)
    assert token_files.token_files(docs.limit(0), vocabulary()).count() == 0


def test_a_reader_decompresses_only_what_it_needs_and_finds_damage(tmp_path):
    path = tmp_path / "s.zst"
    w = token_files.ShardWriter(open(path, "wb"))
    data = np.random.default_rng(2).integers(0, 50_000, 400_000).astype("<u4").tobytes()
    for i in range(10):
        w.add(i if i else None, data[i * 160_000 : (i + 1) * 160_000])
    w.close()
    r = token_files.open_shard(f"file://{path}")
    assert r.tokens(9).tobytes() == data[9 * 160_000 :] and r.read_frames < len(r.frames) and r.null[0]
    raw = bytearray(path.read_bytes())
    raw[int(r.at[-2]) + 40] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception):
        token_files.open_shard(f"file://{path}").tokens(9)


def test_counts_equal_the_library(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(frame(spark, ODD), vocabulary()).collect()}
    for i, t in enumerate(ODD):
        n = len(ids(library, t))
        assert got[i] == (len((t or "").encode()), n, n > 2048)


def test_special_strings_of_other_case_are_plain_text(spark, library):
    texts = ["<|ENDOFTEXT|>", "A <|EndOfText|>, b. <|startoftext|> <|STARTOFTEXT|>x", "<|endoftext|> É <|endofTEXT|>\n_, Z", "<|x <|endoftext|>"]
    docs = frame(spark, texts)
    want = [ids(library, t) for t in texts]
    assert want[0] == [27, 347, 40786, 4160, 91, 285]
    assert [r.n_tokens for r in token_counts.token_counts(docs, vocabulary()).orderBy("doc_id").collect()] == [len(w) for w in want]
    got = [r.ids_crc32 for r in token_files.token_files(docs, vocabulary()).orderBy("doc_id").collect()]
    assert got == [zlib.crc32(array.array("I", [*w, token_files.END_ID]).tobytes()) for w in want]


def test_random_strings_have_the_library_ids(library):
    rng = random.Random(21)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", ", ", ". ", ",", ".", " ", "\n", "\t", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\x00", "'s", "'LL", "_", "!", "?!", "a", "The", "é", "É", "ß", "İ", "Σ", "12", "½", "²", "日本", "<|", "|>", "-", "İs", "\u2028", "x" * 9]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(20_000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    found = bpe.Ids(vocabulary()).ids(texts)
    assert [t for t, a, b in zip(texts, want, found) if array.array("I", a).tobytes() != b] == []
    counts = bpe.Counts(vocabulary(), bpe.prove_whole_tokens(vocabulary())).n(texts)
    assert [t for t, a, b in zip(texts, want, counts) if len(a) != b] == []


def test_media_round_trip_and_damage(spark):
    rows = {r.doc_id: r for r in ogg.media_columns(frame(spark, ODD), keep_media=True).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload, said = ogg.samples(rows[i].media)
        assert payload == raw + b"\xff" * (rows[i].payload_bytes - len(raw)) and rows[i].payload_bytes % 576 == 0 < rows[i].payload_bytes
        assert said["ms"] == len(payload) * 1000 // ogg.RATE
    assert rows[0].media_sha256 == rows[1].media_sha256
    broken = bytearray(rows[12].media)
    broken[5000] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.samples(bytes(broken))
    assert ogg.page_crc(b"\x00" * 3) == 0 and ogg.page_crc(b"\x80") == crc(b"\x80") and ogg.page_crc(bytes(range(256))) == crc(bytes(range(256)))


def crc(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_packets_span_pages_and_streams_part():
    long = bytes(range(256)) * 300
    lacing = ogg.lace(len(long))
    first, rest = lacing[:255], lacing[255:]
    cut = 255 * 255
    data = ogg.page(7, 0, ogg.FIRST, -1, first, long[:cut]) + ogg.page(9, 0, ogg.FIRST | ogg.LAST, 5, ogg.lace(3), b"abc") + ogg.page(7, 1, ogg.CONTINUED | ogg.LAST, 99, rest, long[cut:])
    got = ogg.read(data)
    assert got[7]["packets"] == [long] and got[7]["granules"] == [99] and got[9]["packets"] == [b"abc"]
    assert struct.unpack_from("<4s", data)[0] == b"OggS"


def test_toxicity_learns_and_keeps_clean_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "ne"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 90))]
        if bad := i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["grumble", "grumbling", "grumbled"])
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    docs = frame(spark, texts + [None, ""])
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    held = [i for i, _ in labels if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert np.mean([rows[i].predicted == labels[i][1] for i in held]) > 0.95
    assert rows[900].score == rows[901].score and 0 <= rows[900].score <= 1
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows.values())
    assert {r.score for r in toxicity.toxicity(docs, lab.limit(0)).collect()} == {0.5}


def test_toxicity_keeps_documents_where_a_class_is_missing(spark):
    texts = [f"plain words number {i} and more" + (" grumble" if i < 12 else "") for i in range(60)]
    docs = frame(spark, texts)
    whole = [(i, int(i < 12)) for i in range(60)]
    for labels in ([], [x for x in whole if not x[1]], [x for x in whole if x[1]]):
        lab = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert toxicity.drop_toxic(docs, lab).count() == 60
        rows = toxicity.toxicity(docs, lab).collect()
        assert {r.predicted for r in rows} == {int(rows[0].score >= 0.5)} and len({r.score for r in rows}) == 1
        if labels:
            assert (rows[0].score >= 0.5) == bool(labels[0][1])


def test_toxicity_learns_where_the_part_set_aside_lacks_a_class():
    texts = [f"plain words number {i} and more" + (" grumble" if i % 8 == 0 else "") for i in range(200)]
    texts = [t for t in texts if "grumble" not in t or zlib.crc32(t.encode()) % 5]
    labels = np.array([int("grumble" in t) for t in texts])
    scores = toxicity.Scorer(toxicity.fit_model(texts, labels, {0: 1 - labels.mean(), 1: labels.mean()})).scores(texts)
    assert scores[labels == 1].min() > scores[labels == 0].max() and (scores[labels == 0] < 0.5).all()


def test_toxicity_reads_long_words_and_counts_a_cue_alike_anywhere():
    rng = random.Random(6)
    run = lambda n: "".join(rng.choice(["ba", "do", "ki", "lu", "ne"]) for _ in range(n))
    texts = [run(60) + ("grumble" if i % 3 == 0 else "xabbleq" if i % 3 == 1 else "") + run(10) for i in range(300)]
    labels = np.array([int(i % 3 == 0) for i in range(300)])
    scores = toxicity.Scorer(toxicity.fit_model(texts, labels, {0: 2 / 3, 1: 1 / 3})).scores(texts)
    assert np.mean((scores >= 0.5) == labels) > 0.95
    words = [run(2) for _ in range(23)]
    assert toxicity.text_words("x" * 40) == ["x" * 40] and "".join(toxicity.text_words("y" * 41)).count("y") > 41
    model = np.zeros(toxicity.BUCKETS + 1)
    model[toxicity.subwords("grumble")] = 1.0
    found = [toxicity.Scorer(toxicity.pack(model)).raw([" ".join([*words[:k], "grumble", *words[k:]])])[0] for k in (0, 11, 12, 22, 23)]
    assert max(found) - min(found) < 0.02


def test_mixture_follows_the_inverse_distribution(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end as source", "repeat('x', cast(id % 7 as int)) as text")
    out = mixing.mix_sources(docs, {"a": 3.0, "b": 1.0}, scale=2.0).persist()
    rates = {r.source: r.rate for r in out.select("source", "rate").distinct().collect()}
    assert set(rates) == {"a", "b"} and rates["a"] > rates["b"]
    counts = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    rows = docs.where("source = 'a'").withColumn("u", mixing.hash_uniform(F.col("doc_id"), seed=17)).collect()
    for r in rows[:300]:
        k, term, total, lam = 0, np.exp(-rates["a"]), np.exp(-rates["a"]), rates["a"]
        while total <= r.u:
            k += 1
            term *= lam / k
            total += term
        assert counts.get(r.doc_id, 0) == k
    assert abs(sum(counts.get(r.doc_id, 0) for r in rows) / len(rows) - rates["a"]) < 0.2
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="clash"):
        mixing.mix_sources(docs.withColumn("copy", F.lit(1)))


def test_poisson_tables_of_small_and_large_rates(spark):
    rates = [("none", 0.0), ("few", 0.3), (None, 7.5), ("edge", 400.0), ("more", 401.0), ("many", 30_000.0), ("most", 2_000_000.0)]
    got = {r.source: r for r in mixing.poisson_table(spark.createDataFrame(rates, "source string, rate double")).collect()}
    assert set(got) == {s for s, _ in rates} and got["none"].steps == [1.0]
    for s, lam in rates[1:]:
        r, total, log, last = got[s], 0.0, -lam, 0.0
        assert len(r.steps) < 24 * lam**0.5 + 60 or lam <= 400
        for k in range(r.start + len(r.steps) if lam < 1e5 else 0):
            log += math.log(lam / k) if k else 0.0
            total += math.exp(log)
            if k >= r.start:
                assert abs(r.steps[k - r.start] - total) < 1e-9 and r.steps[k - r.start] >= last
                last = r.steps[k - r.start]
        middle = next(k for k, x in enumerate(r.steps) if x >= 0.5) + r.start
        assert lam - 1 <= middle <= lam + 1 and r.steps[-1] > 1 - 1e-12


def test_stages_keep_columns_of_any_name(spark):
    names = ["score", "_score", "copy", "rate", "_n", "_u", "_source", "_steps", "shuffle_key", "score_"]
    docs = spark.createDataFrame([(i, f"some words number {i} here" + " grumble" * (i % 4 == 0), "s") for i in range(80)], "doc_id long, text string, source string")
    docs = docs.unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, None, None)], docs.schema))
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, lab)
    mixed = mixing.mix_sources(docs, added=False)
    for out in (kept, mixed):
        assert out.columns == docs.columns and out.count() > 0
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names)
    assert toxicity.drop_toxic(docs.limit(0), lab.limit(0)).count() == mixing.mix_sources(docs.limit(0), added=False).count() == 0


def test_containment_matches_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 12, 40])))) for i in range(30)] + [(30, None), (31, ""), (None, "a b c d e f")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            own = (items[rng.randrange(30)][1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            w[len(w) // 2 : len(w) // 2] = own
        docs.append((i, ", ".join([" ".join(w[:10]).upper(), " ".join(w[10:])])))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1])]

    def sh(text):
        import re

        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {(d, i) for d, t in docs for i, x in items if d is not None and i is not None and (s := sh(x)) and len(s & sh(t)) >= 0.8 * len(s) - 1e-9}
    got = decontaminate.containment(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, h int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 10


def test_suffix_tree_scores(spark):
    rng = random.Random(2)
    pairs = [(f"w{i}", f"v{i}") for i in range(20)]
    texts = [" ".join(x for _ in range(40) for x in rng.choice(pairs)) for _ in range(120)] + [None, "", "unseen WORDS here"]
    rows = {r.doc_id: r for r in suffix_tree.score_texts(frame(spark, texts)).collect()}
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = {i: (texts[i] or "").lower().split() + [None] for i in range(len(texts))}
    counts = {}
    for i in train:
        for t in tokens[i]:
            counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, r in rows.items():
        base = sum(np.log10((counts.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(tokens[i]), sum(t in counts for t in tokens[i]), n)
        assert abs(r.base_score - base) < 1e-6
    held = [i for i in range(120) if i not in train]
    assert sum(rows[i].score for i in held) > 0.75 * sum(rows[i].base_score for i in held)
    assert suffix_tree.score_texts(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1, 4])
def test_suffix_tree_matches_brute_force(spark, depth):
    import brute

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeÉF") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    passage = [rng.choice(words) + rng.choice("xyz") for _ in range(60)]
    texts = [None, "", "  \n", "x" * 20_000]
    for i in range(90):
        w = [words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(0, 80))]
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randint(0, 20) : rng.randint(30, 60)]
        texts.append(" ".join(w))
    texts += [texts[30], texts[40], texts[40]]
    rows = {r.doc_id: r for r in suffix_tree.score_texts(frame(spark, texts).repartition(3), depth).collect()}
    want = brute.suffix_tree_scores(list(enumerate(texts)), depth)
    for i, (held, score) in want.items():
        assert rows[i].held_out == held and abs(rows[i].score - score) < 1e-6 * max(1, abs(score))
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    doubled = suffix_tree.score_texts(frame(spark, texts).union(spark.createDataFrame([(None, texts[50], "c", 1)], "doc_id long, text string, start string, n_tokens int")).repartition(2), depth)
    assert doubled.count() == len(texts) + 1


def test_pipeline_stages_have_the_right_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "mixing", "tokens"]


def test_pipeline_runs_over_whole_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.start)
    assert {r.doc_id for r in rows} <= set(docs) and len({r.doc_id for r in rows}) > len(docs) / 4
    assert all(b.start == a.start + a.n_tokens and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))

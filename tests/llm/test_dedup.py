import random

import brute
import pytest

from granary.llm import fuzzy_lines, jaccard, suffixes

SCHEMA = "doc_id long, text string, chunk string, answer int"


def sample(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(30))
    docs = [(0, None), (1, ""), (2, "   \n"), (3, "one two"), (4, "One  two"), (5, "x" * 49), (6, "y" * 400), (7, "y" * 130)]
    for i in range(8, n):
        kind = rng.random()
        if kind < 0.3:
            t = docs[rng.randrange(5, len(docs))][1] or ""
            w = t.split(" ")
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind < 0.6:
            t = " ".join(word() for _ in range(rng.randint(1, 40))) + " " + passage + " " + " ".join(word() for _ in range(20))
        else:
            t = " ".join(word() for _ in range(rng.randint(1, 120)))
        docs.append((i, t))
    docs.append((n, "long " + " ".join(word() for _ in range(30_000))))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "c", 1) for d, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize("hot", [1, 100])
def test_repeats_match_brute_force(spark, hot):
    docs = sample()
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(frame(spark, docs), hot=hot).collect()}
    assert got == brute.remove_repeats(docs)


def test_chunks_of_many_batches(spark):
    from granary.llm import chunks

    docs = sample(9, 40)
    joined = "".join(t or "" for _, t in docs).encode()
    docs += [(1000 + i, joined[i * 9000 : i * 9000 + 30_000].decode(errors="ignore")) for i in range(12)]
    docs += [(2000 + i, "".join(random.Random(i).choices("abc \n", k=700_000))) for i in range(6)]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(frame(spark, docs)).collect()}
    small = [d for d in docs if d[0] < 2000]
    want = brute.remove_repeats(small)
    assert chunks.BATCH_BYTES < sum(len(t or "") for _, t in docs)
    assert {d: got[d] for d in want} == want


@pytest.mark.parametrize("n,percent,block", [(4, 85, 4096), (2, 50, 2), (5, 80, 3)])
def test_components_match_brute_force(spark, n, percent, block):
    docs = sample(5)
    got = {r.doc_id: tuple(r)[1:] for r in jaccard.jaccard_components(frame(spark, docs), n, percent, block).collect()}
    assert got == brute.jaccard_components(docs, n, percent)


def test_one_stays_of_each_component(spark):
    docs = sample(5)
    kept = {r.doc_id for r in jaccard.keep_one_per_component(frame(spark, docs)).collect()}
    assert kept == {d for d, (_, c) in brute.jaccard_components(docs, 5, 80).items() if d == c}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    df = frame(spark, [(None, t), (1, t), (1, t), (2, t)])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffixes.remove_repeats(df).collect()) == [(False, 1, 0), (False, 1, 0), (False, 2, 51), (True, 0, 0)]
    assert sorted((r.doc_id is None, r.component_id) for r in jaccard.jaccard_components(df).collect() if r.doc_id) == [(False, 1)] * 3
    assert sorted((r.doc_id or 0, r.n_removed) for r in fuzzy_lines.drop_similar_lines(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1)]
    empty = df.limit(0)
    for f in (suffixes.remove_repeats, jaccard.jaccard_components, fuzzy_lines.drop_similar_lines):
        assert f(empty).count() == 0


def test_similar_lines_go_once(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    line = " ".join(words[:60])
    near = line.replace(words[7], "other")
    far = " ".join(words[100:160])
    docs = [(1, f"{line}\n{far}\n--"), (2, f"{far.upper()}!\nkept {words[200]}"), (3, f"{line}\n--"), (4, near), (5, None), (6, " ".join(words[:30] + words[200:230]))]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in fuzzy_lines.drop_similar_lines(frame(spark, docs)).collect()}
    assert got[1] == (3, 0, docs[0][1]) and got[2] == (2, 1, f"kept {words[200]}") and got[3] == (2, 1, "--")
    assert got[4] == (1, 1, "") and got[5] == (1, 0, "") and got[6][1] == 0


@pytest.mark.parametrize("block,rounds", [(fuzzy_lines.BLOCK, fuzzy_lines.ROUNDS), (7, 2)])
def test_similar_lines_match_brute_force_with_registered_parameters(spark, monkeypatch, block, rounds):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    lines = []
    for size in (3, 4, 5, 6, 9, 10, 11, 15, 20, 27, 27, 40, 101):
        base = [rng.choice(words) for _ in range(size)]
        lines.append(base)
        for edits in {1, size // 10, size // 5, size // 5 + 1, size // 4}:
            w = list(base)
            for _ in range(edits):
                k, kind = rng.randrange(len(w)), rng.randrange(4)
                w[k : k + 1] = [rng.choice(words)] if kind < 2 else [] if kind == 2 and len(w) > 1 else [w[k], rng.choice(words)]
            lines.append(w)
    hot = [rng.choice(words) for _ in range(5)]
    lines += [hot + [rng.choice(words) for _ in range(7)] for _ in range(40)]
    rng.shuffle(lines)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    first = list(range(len(lines)))
    for b in range(len(lines)):
        for a in range(b):
            if first[a] != first[b] and 1 - distance(lines[a], lines[b]) / max(len(lines[a]), len(lines[b])) >= 0.8 - 1e-9:
                low, high = sorted((first[a], first[b]))
                first = [low if f == high else f for f in first]
    docs = [(i, " ".join(w)) for i, w in enumerate(lines)]
    monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
    monkeypatch.setattr(fuzzy_lines, "ROUNDS", rounds)
    got = {r.doc_id for r in fuzzy_lines.drop_similar_lines(frame(spark, docs)).collect() if not r.n_removed}
    assert got == set(first) and len(first) - len(got) > 25


def test_bounds_on_lost_runs():
    """No edit script of so few edits loses more runs than the bound says."""
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randint(2, 30)
        a = [rng.randrange(1000) for _ in range(n)]
        b = list(a)
        edits = 0
        while edits + 1 <= 0.2 * max(len(a), len(b) + 1) + 1e-9 and rng.random() < 0.9:
            k = rng.randrange(len(b))
            kind = rng.randrange(3)
            b[k : k + 1] = [rng.randrange(1000)] if kind == 0 else [] if kind == 1 and len(b) > 1 else [b[k], rng.randrange(1000)]
            edits += 1
        if edits > 0.2 * max(len(a), len(b)) + 1e-9:
            continue
        met = False
        for q, least, most in fuzzy_lines.families(0.8):
            if all(least <= len(x) <= most for x in (a, b)):
                met = True
                for x, y in ((a, b), (b, a)):
                    other = {tuple(y[i : i + q]) for i in range(len(y) - q + 1)}
                    lost = sum(tuple(x[i : i + q]) not in other for i in range(len(x) - q + 1))
                    bound = fuzzy_lines.most_lost(q, fuzzy_lines.np.array([len(x)]), 0.8)[0]
                    assert lost <= bound < len(x) - q + 1
        assert met or a == b


def test_pairs_of_a_large_group_are_a_forest(spark):
    import pyarrow as pa

    n = 300
    bag = fuzzy_lines.np.full(fuzzy_lines.BITS // 8, 85, fuzzy_lines.np.uint8).tobytes()
    key = list(range(1000, 1000 + 2 * n))
    columns = {"run": [1] * n + [2] * n, "i": [0] * 2 * n, "j": [0] * 2 * n, "mine": [0] * 2 * n, "key": key, "comp": key, "size": [40] * 2 * n, "at": [3] * (2 * n - 1) + [30], "seen": [bag] * 2 * n}
    t = pa.table(columns)
    every = {tuple(p) for p in fuzzy_lines._pairs_of(t, 0.8, False).tolist()}
    # The last line has its run too far behind for the edits that it may have.
    assert every == {(a, b) for at, m in ((1000, n), (1000 + n, n - 1)) for a in range(at, at + m) for b in range(a + 1, at + m)}
    few = fuzzy_lines._pairs_of(t, 0.8, True).tolist()
    assert len(few) == 2 * n - 3
    joined = {k: k for k in key}
    for a, b in few:
        old, new = joined[b], joined[a]
        joined = {k: new if v == old else v for k, v in joined.items()}
    assert len(set(joined.values())) == 3


def test_components_and_runs_are_joined_by_shuffle_or_broadcast_alike(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs = []
    for d in range(60):
        base = docs[rng.randrange(len(docs))][1].split("\n")[0].split() if docs and rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        line = [rng.choice(words) if rng.random() < 0.1 else w for w in base]
        docs.append((d, "\n".join([" ".join(line), docs[d // 2][1].split("\n")[0] if docs else "one two three"])))
    df = frame(spark, docs)
    first = sorted(map(tuple, fuzzy_lines.drop_similar_lines(df).collect()))
    monkeypatch.setattr(fuzzy_lines, "BROADCAST", 0)
    assert sorted(map(tuple, fuzzy_lines.drop_similar_lines(df.repartition(5)).collect())) == first
    assert sum(r[2] for r in first) > 60

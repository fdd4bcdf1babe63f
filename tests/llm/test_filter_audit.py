"""The audit of filters against plain loops over all orders."""

import itertools
import math
import random
import re

import pytest

from granary.llm import filter_audit as A


def fails(docs):
    """part, failed set and doc_id of each row."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = i is not None and least[t] < i
        out.append((source or "", {k for k, v in own.items() if v}, i))
    return out


def audit(docs, labels):
    rows = fails(docs)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    found = {}
    for part in {p for p, _, _ in rows}:
        own, total = [(f, i) for p, f, i in rows if p == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone, kept = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                total[x] += len(gone)
                redundant = sum(x in f for f, _ in own) - len(gone)
                found[part, "".join(order), k + 1] = [len(kept), len(gone), redundant, sum(f == {x} for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
                left = kept
        for (p, order, k), row in found.items():
            if p == part:
                row.append(total[order[k - 1]])
    return found


def some_docs(seed):
    rng = random.Random(seed)
    texts = [None, "", "  \t\x0b", "ONE", "a # b", "\x1c\x85 é", "日本語 " * 60, "w " * 60]
    for k in range(60):
        w = [rng.choice("alpha beta gamma delta Epsilon ZETA".split()) + str(rng.randrange(80)) for _ in range(rng.randrange(40, 90))]
        texts.append(" ".join(w) + rng.choice(["", " $", " THE END OF ALL OF IT AT LAST"]))
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(200)]
    docs += [(None, "ONE", "a"), (None, "new text", None), (7, docs[7][1], "b"), (7, docs[7][1], docs[7][2]), (300, "x" * 50_000 + " y" * 30_000, "long")]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_matches_all_orders(spark, seed):
    docs = some_docs(seed)
    rng = random.Random(seed)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(i, t, s, 5, "m") for i, t, s in docs], "doc_id long, text string, source string, n int, mask string").repartition(3)
    got = A.filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = {tuple(r[:3]): list(r[3:]) for r in got.collect()}
    assert got.count() == len(rows) == 600 * len({s or "" for _, _, s in docs})
    assert rows == audit(docs, labels)


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame(some_docs(3)[:20], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(docs.limit(0), labels).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in A.filter_audit(docs, labels).collect()} == {(0, 0)}


def test_path_counts():
    for n in (1, 3, 5):
        edges = A.lattice(n)
        assert len(edges) == n * 2 ** (n - 1)
        for x in range(n):
            assert sum(w for _, f, w in edges if f == x) == math.factorial(n)
        assert all(w == math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) for s, _, w in edges)


def test_shares_sum_to_what_any_order_removes(spark):
    counts = spark.createDataFrame([("p", m, m + 1, 1, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = A.audit_orders(counts, "XYZ").collect()
    assert len(rows) == 6 * 3
    for order in {r.filter_order for r in rows}:
        own = [r for r in rows if r.filter_order == order]
        assert sum(r.removed for r in own) == sum(range(2, 9)) and sum(r.shapley for r in own) == 6 * sum(range(2, 9))

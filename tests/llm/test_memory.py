"""What one task holds: shares of the exchange, and arrays in blocks."""

import tracemalloc

import numpy as np

from granary.llm import suffixes, toxicity
from granary.llm.chunks import bucket_of


def test_anchor_keys_fill_all_buckets_alike():
    data = np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8)
    e = suffixes.Entries(np.zeros(1, np.int64), data, np.array([0, len(data)]))
    n = np.bincount(bucket_of(np.unique(e.key), 50), minlength=50)
    assert n.max() < 1.5 * n.mean() and n.min() > 0.5 * n.mean()


def test_training_holds_blocks_and_does_not_depend_on_them(monkeypatch):
    words = [f"wort{k % 97}" for k in range(200_000)]
    t = toxicity.Trainer([" ".join(words[k:] + words[:k]) for k in range(10)], np.arange(10) % 2)
    tracemalloc.start()
    t.fit(1, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * t.emb.nbytes + 5 * len(t.tokens)

    texts = [" ".join(f"wort{(k * 7 + j) % (9 + k)}" for j in range(k * 5)) for k in range(30)]
    found = []
    for block in (1, 50, 1 << 18):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        t = toxicity.Trainer(texts, np.arange(30) % 2)
        t.fit(5, 20)
        found.append(t.emb @ (t.out[1] - t.out[0]))
    assert found[0].any() and np.allclose(found[0], found[2], 1e-9) and np.allclose(found[1], found[2], 1e-9)

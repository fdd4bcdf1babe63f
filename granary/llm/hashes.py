"""Hashes of many byte ranges of one array at once, and the words of the dealt contracts."""

from __future__ import annotations

import numpy as np

ROOT = 0x9E3779B97F4A7C15 | 1
_LETTERS = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, 0 to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 21)
        steps = [np.full(size, x, np.uint64) for x in (ROOT, pow(ROOT, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers[:] = [np.cumprod(s, dtype=np.uint64) for s in steps]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Ranges:
    """hash(starts, ends): a 64-bit hash of each byte range, the same wherever those bytes lie."""

    def __init__(self, data: np.ndarray, letters: np.ndarray = _LETTERS):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = letters[data]
        np.multiply(terms, up[: len(data)], out=terms)
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hash and document number of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, in order."""
    gap = SPACE[data]
    edge = np.ones(len(data) + 1, bool)  # a space, or a document's start, before
    edge[1:-1] = gap[:-1]
    edge[offsets[:-1]] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    stop = np.ones(len(data), bool)  # a space, or a document's end, behind
    stop[:-1] = gap[1:]
    stop[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(~gap & stop) + 1
    cut = np.searchsorted(starts, offsets)
    return Ranges(data, _LETTERS[LOWER]).hash(starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(cut))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them.

    Sorts one number of a key's upper bits and its place, which is several times faster than sorting places
    by keys; keys that agree in those bits are put right after.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    low = np.uint64((1 << int(len(keys)).bit_length()) - 1)
    both = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    own = keys[order]
    if (own[1:] < own[:-1]).any():
        again = np.argsort(own, kind="stable")
        order, own = order[again], own[again]
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    place = np.empty(len(own), np.int64)
    place[order] = np.cumsum(new) - 1
    return own[new], place


def order_within(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The order by group (small numbers) and then key: one number of group, upper bits of the key and place is sorted."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    of_place, of_group = int(n).bit_length(), max(1, int(group.max()).bit_length())
    middle = 64 - of_place - of_group
    if middle < 24:
        return np.lexsort((keys, group))
    both = (group.astype(np.uint64) << np.uint64(64 - of_group)) | (keys >> np.uint64(64 - middle) << np.uint64(of_place)) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << of_place) - 1)).astype(np.int64)
    g, k = group[order], keys[order]
    if ((g[1:] == g[:-1]) & (k[1:] < k[:-1])).any():
        order = order[np.lexsort((k, g))]
    return order


def shingles(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word runs: document numbers in order, and each one's hashes in order.

    A document of fewer words has one hash, of all its words.
    """
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        joined = mix(joined + h[k : k + len(joined)] + np.uint64(k + 1))
    own = doc[: len(joined)] == doc[n - 1 :] if len(joined) else np.zeros(0, bool)
    ids, first, size = np.unique(doc, return_index=True, return_counts=True)
    short_doc, short_hash = [], []
    for d, a, s in zip(ids[size < n], first[size < n], size[size < n]):
        x = np.array([s + 1000], np.uint64)
        for w in h[a : a + s]:
            x = mix(x + w)
        short_doc.append(d)
        short_hash.append(x[0])
    d = np.concatenate([doc[: len(joined)][own], np.array(short_doc, np.int64)])
    x = np.concatenate([joined[own], np.array(short_hash, np.uint64)])
    order = order_within(d, x)
    d, x = d[order], x[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[new], x[new]

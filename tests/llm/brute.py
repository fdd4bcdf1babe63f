"""Plain versions of the dealt contracts, for small tables."""

import hashlib
import math
import re
import zlib

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())


def shingle_set(text: str, n: int) -> frozenset:
    w = WORD.findall(ascii_lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_components(docs: list[tuple[int, str]], n: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t or "", n) for d, t in docs}
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    holders: dict = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    pairs = {(a, b) for h in holders.values() for i, b in enumerate(h) for a in h[:i]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def remove_repeats(docs: list[tuple[int, str]], span: int = 50) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def suffix_tree_scores(docs: list[tuple[int, str]], depth: int, least: int = 2, gain: float = 8.0, parts: int = 64) -> dict[int, tuple]:
    """held_out and score of each document, from whole tables of runs."""
    tokens = {d: [*WORD.findall(ascii_lower(t or "")), None] for d, t in docs}
    train = {d for d in tokens if zlib.crc32(str(d).encode()) % 5 != 1}
    count: dict[tuple, int] = {}
    for d in train:
        w = tokens[d]
        for i in range(len(w)):
            for n in range(1, min(depth + 1, i + 1) + 1):
                run = tuple(w[i - n + 1 : i + 1])
                count[run] = count.get(run, 0) + 1
    total = sum(c for r, c in count.items() if len(r) == 1)
    distinct = sum(1 for r in count if len(r) == 1)
    weights: dict[tuple, float] = {}
    for n in range(1, depth + 1):
        seen: dict[int, list] = {}
        for run, c in count.items():
            if len(run) == n + 1 and count[run[:-1]] >= least:
                s = seen.setdefault(int(math.log2(count[run[:-1]])), [0, 0])
                s[0] += c
                s[1] += c == 1
        weights |= {(n, b): (x + 0.5) / (s + 1) for b, (s, x) in seen.items()}
    kept: set = set()

    def p(run: tuple) -> float:
        """The last token's probability behind the others, in the longest kept suffix of these."""
        x = run[-1]
        if len(run) == 1:
            return (count.get(run, 0) + 0.5) / (total + 0.5 * (distinct + 1))
        if run[:-1] not in kept:
            return p(run[1:])
        n = count[run[:-1]]
        w = weights.get((len(run) - 1, int(math.log2(n))), 0.5)
        return (1 - w) * count.get(run, 0) / n + w * p((*run[1:-1], x))

    for n in range(1, depth + 1):
        gains: dict[tuple, int] = {}
        for run, c in count.items():
            ctx = run[:-1]
            if len(run) == n + 1 and count[ctx] >= least:
                w = weights[n, int(math.log2(count[ctx]))]
                ratio = (1 - w) * (c - 1) / ((count[ctx] - 1) * p(run[1:])) + w
                gains[ctx] = gains.get(ctx, 0) + c * round(parts * math.log(ratio))
        kept |= {s for s, g in gains.items() if g > gain * parts}
    return {d: (d not in train, sum(math.log10(p(tuple(w[max(0, i - depth) : i + 1]))) for i in range(len(w)))) for d, w in tokens.items()}

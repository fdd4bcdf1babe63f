"""Suffix-array deduplication of repeated byte strings, exact.

Every string of SPAN bytes has an anchor: its KEY-byte piece of smallest hash. A run of strings with one
anchor is one entry, so suffixes are kept at anchors only, about one in thirteen bytes. Chunks first ask
which anchor pieces occur in other documents (see chunks); entries whose piece does not are done. The
rest are suffixes dealt by sampled splitters into ranges of their leading bytes. Each range sorts its
suffixes by multikey quicksort and compares neighbours, so each string's smallest document is known.
Pieces of very many documents are cut into whole strings, whose entries may lie in several buckets of a
range; what each bucket finds of such a string is compared across the buckets' boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import hashes
from granary.llm.chunks import ASKED, ChunkStore, answer_totals, answers, ask, batches
from granary.llm.common import materialize, pack, unpack

SPAN, KEY = 50, 25
#: Pieces that more documents hold are dealt by whole strings.
HOT = 100_000
_WORDS = (0, 8, 16, 24, 32, 40, 42)


def multikey_quicksort(words: np.ndarray, at: np.ndarray, small: int = 2048) -> np.ndarray:
    """The order of the suffixes that start at `at`, by the first SPAN bytes.

    words[i] holds the eight bytes from i as a number. A part of the suffixes is split by one such word
    into those below, equal to and above a pivot; the equal ones go on with the next word. Parts of
    `small` suffixes are sorted by all words that are left.
    """
    order = np.arange(len(at))
    stack = [(0, len(at), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == len(_WORDS):
            continue
        own = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = own[np.lexsort([words[at[own] + w] for w in reversed(_WORDS[depth:])])]
            continue
        value = words[at[own] + _WORDS[depth]]
        pivot = np.partition(value[:: max(1, len(value) // 255)], len(value[:: max(1, len(value) // 255)]) // 2)[len(value[:: max(1, len(value) // 255)]) // 2]
        less, more = value < pivot, value > pivot
        equal = own[~less & ~more]
        below, above = own[less], own[more]
        order[lo:hi] = np.concatenate([below, equal, above])
        mid = lo + len(below)
        stack += [(lo, mid, depth), (mid, mid + len(equal), depth + 1), (mid + len(equal), hi, depth)]
    return order


def eight_byte_words(data: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)] << np.uint64(56 - 8 * k)
    return out


class Entries:
    """Runs of strings with one anchor: first string, anchor, number of strings, row, and the anchor piece's hash."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        empty = np.zeros(0, np.int64)
        self.first = self.anchor = self.count = self.row = empty
        self.key = np.zeros(0, np.uint64)
        n = len(data) - KEY + 1
        if n < SPAN - KEY + 1:
            return
        place = np.arange(n)
        piece = hashes.Ranges(data).hash(place, place + KEY)
        least = (piece & ~np.uint64(0xFFFFFFFF)) | place.astype(np.uint64)
        width, goal = 1, SPAN - KEY + 1
        while 2 * width <= goal:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < goal:
            least = np.minimum(least[: len(least) - (goal - width)], least[goal - width :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
        valid = np.arange(len(anchor)) + SPAN <= offsets[doc + 1]
        start = np.flatnonzero(valid)
        if not len(start):
            return
        new = np.ones(len(start), bool)
        new[1:] = (anchor[start[1:]] != anchor[start[:-1]]) | (np.diff(start) > 1)
        cut = np.flatnonzero(new)
        self.first, self.anchor = start[cut], anchor[start[cut]]
        self.count = np.diff(np.append(cut, len(start)))
        # An anchor's hash is the least of 26, so low ones abound: mixed again they fill all ranges of keys alike.
        self.row, self.key = rows[doc[start[cut]]], hashes.mix(piece[self.anchor])


def _doc_ids(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    null = np.array([v is None for v in t.column("doc_id").to_pylist()], bool)
    return np.array([0 if v is None else v for v in t.column("doc_id").to_pylist()], np.int64), null


def _shared(t: pa.Table, told: pa.Table) -> Iterator[tuple[Entries, np.ndarray, np.ndarray]]:
    """The entries of each batch, the numbers of those whose piece other documents hold, and how many hold it."""
    own = list(_entries(t))
    keys = np.unique(np.concatenate([e.key[~n[e.row]] for e, n in own] or [np.zeros(0, np.uint64)]))
    held = answers(told)
    for e, null in own:
        if not len(keys):
            yield e, np.zeros(0, np.int64), np.zeros(0, np.uint32)
            continue
        at = np.minimum(np.searchsorted(keys, e.key), len(keys) - 1)
        docs = np.where((keys[at] == e.key) & ~null[e.row], held[at], 0)
        pick = np.flatnonzero(docs > 1)
        yield e, pick, docs[pick]


def _entries(t: pa.Table) -> Iterator[tuple[Entries, np.ndarray]]:
    _, null = _doc_ids(t)
    for rows, data, offsets in batches(t):
        yield Entries(rows, data, offsets), null


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte ranges as one binary array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))])


class Contexts:
    """The distinct texts of a chunk's shared entries, in the order of their hashes.

    name: hash of each text and its anchor's place; doc: the smallest document that has it; count: its
    strings of SPAN bytes; uses: by batch the entries (string, document, number of the text).
    Entries of hot pieces are cut into their single strings, with the anchor's place left out.
    """

    def __init__(self, t: pa.Table, told: pa.Table, hot: int, with_texts: bool):
        ids, _ = _doc_ids(t)
        names, docs, counts, hots, keys, texts, self.uses = [], [], [], [], [], [], []
        for e, pick, held in _shared(t, told):
            many = held > hot
            cold = pick[~many]
            first, count, anchor, doc = e.first[cold], e.count[cold], e.anchor[cold], ids[e.row[cold]]
            single = np.zeros(len(cold), bool)
            if many.any():
                own = pick[many]
                step = np.arange(e.count[own].sum()) - np.repeat(np.cumsum(e.count[own]) - e.count[own], e.count[own])
                at = np.repeat(e.first[own], e.count[own]) + step
                first, anchor = np.concatenate([first, at]), np.concatenate([anchor, at])
                count = np.concatenate([count, np.ones(len(at), np.int64)])
                doc = np.concatenate([doc, np.repeat(ids[e.row[own]], e.count[own])])
                single = np.concatenate([single, np.ones(len(at), bool)])
            ranges = hashes.Ranges(e.data)
            size = count + SPAN - 1
            name = hashes.mix(ranges.hash(first, first + size) + (anchor - first).astype(np.uint64) * np.uint64(2) + single.astype(np.uint64))
            self.uses.append((first, count, doc, name))
            if not len(name):
                continue
            order = np.lexsort((doc, name))
            lead = order[np.diff(name[order], prepend=~name[order[0]]) != 0]
            names.append(name[lead])
            docs.append(doc[lead])
            counts.append(count[lead])
            hots.append(single[lead])
            if with_texts:
                texts.append(gather(e.data, first[lead], size[lead]))
                keys.append(gather(e.data, np.where(single[lead], first[lead], anchor[lead]), np.where(single[lead], SPAN, KEY)))
        if names:
            name, doc = np.concatenate(names), np.concatenate(docs)
            order = np.lexsort((doc, name))
            lead = order[np.diff(name[order], prepend=~name[order[0]]) != 0]
            self.name, self.doc = name[lead], doc[lead]
            self.count, self.hot = np.concatenate(counts)[lead], np.concatenate(hots)[lead]
            if with_texts:
                self.text, self.key = pa.concat_arrays(texts).take(pa.array(lead)), pa.concat_arrays(keys).take(pa.array(lead))
        else:
            self.name, self.doc, self.count, self.hot = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            self.text = self.key = pa.array([], pa.binary())


SUFFIX = "chunk int, rid int, bucket int, whole boolean, suffix binary, doc long"
FOUND = "chunk int, told binary, edge binary, edge_doc long, rid int"
FOUND_SCHEMA = pa.schema([("chunk", pa.int32()), ("told", pa.binary()), ("edge", pa.binary()), ("edge_doc", pa.int64()), ("rid", pa.int32())])
#: Sampled keys for splitters, and their length.
SAMPLE, LEADING = 200_000, 16
#: Whole strings of hot pieces are dealt to so many buckets of one range.
SALT = 16


def range_of(keys: pa.Array, splitters: list[bytes]) -> np.ndarray:
    """The range of each key's leading bytes: how many splitters it is not below."""
    kind = f"S{LEADING}"
    return np.searchsorted(np.array(splitters, kind), np.array([k[:LEADING] for k in keys.to_pylist()], kind), "right")


def _sort_bucket(t: pa.Table) -> pa.Table:
    """Sorts one bucket's suffixes and compares neighbours; tells each chunk the strings that a smaller document holds.

    Whole strings of hot pieces may go on in other buckets: what is found of these is compared across them.
    """
    coded = t.column("suffix").combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    text, texts = coded.indices.to_numpy(), coded.dictionary
    row_doc = t.column("doc").to_numpy()
    doc = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(doc, text, row_doc)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    base = offsets[:-1] - offsets[0]
    count = np.diff(offsets) - SPAN + 1
    starts = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(texts)), count)
    at = base[owner] + np.arange(len(owner)) - starts[owner]
    words = eight_byte_words(data)
    order = multikey_quicksort(words, at)
    new = np.zeros(len(order), bool)
    new[0] = True
    for w in _WORDS:
        value = words[at[order] + w]
        new[1:] |= value[1:] != value[:-1]
    least = np.minimum.reduceat(doc[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    found = np.empty(len(order), np.int64)
    found[order] = least
    chunk, rid = t.column("chunk").to_numpy(), t.column("rid").to_numpy()
    whole = t.column("whole").to_numpy(zero_copy_only=False)
    out = []
    if whole.any():
        own = np.flatnonzero(whole)
        out.append(pa.Table.from_arrays([pa.array(chunk[own], pa.int32()), pa.nulls(len(own), pa.binary()), t.column("suffix").take(pa.array(own)), pa.array(found[starts[text[own]]], pa.int64()), pa.array(rid[own], pa.int32())], schema=FOUND_SCHEMA))
    changed = np.flatnonzero((np.minimum.reduceat(found, starts)[text] < row_doc) & ~whole)
    changed = changed[np.argsort(chunk[changed], kind="stable")]
    cut = np.flatnonzero(np.diff(chunk[changed], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(changed))):
        rows = changed[a:b]
        n = count[text[rows]]
        index = np.arange(n.sum()) + np.repeat(starts[text[rows]] - (np.cumsum(n) - n), n)
        packed = pack(rid[rows].astype(np.uint32), found[index])
        out.append(pa.Table.from_arrays([pa.array([chunk[rows[0]]], pa.int32()), pa.array([packed], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())], schema=FOUND_SCHEMA))
    return pa.concat_tables(out) if out else FOUND_SCHEMA.empty_table()


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with `keep_text` also kept, the bytes left.

    A byte goes if a string of SPAN bytes that covers it also starts in a document of smaller doc_id, as
    all texts stood at first. A null text counts as empty; texts below SPAN bytes stay whole. Rows with a
    null doc_id stay whole and are no document's source; rows that repeat a doc_id are one document, whose
    own repetitions stay. An empty table gives an empty result. Other columns are ignored.
    """
    store = ChunkStore(docs)
    buckets = store.buckets

    def question(chunk: int, t: pa.Table) -> pa.Table:
        ids, null = _doc_ids(t)
        keys, docs_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for e, _ in _entries(t):
            own = ~null[e.row]
            keys.append(e.key[own])
            docs_of.append(ids[e.row[own]])
        key, doc = np.concatenate(keys), np.concatenate(docs_of)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return ask(chunk, *np.unique(key[first], return_counts=True), buckets)

    totals = materialize(answer_totals(store.map(question, ASKED)), "pieces")
    per_chunk = max(4, min(40, SAMPLE // store.chunks))

    def sample(chunk: int, t: pa.Table) -> pa.Table:
        """Leading bytes at random places of a chunk, the same in each run."""
        joined = b"".join(t.column("bytes").to_pylist())
        places = np.random.default_rng(chunk).integers(0, max(1, len(joined)), per_chunk)
        return pa.table({"key": pa.array([joined[p : p + LEADING] for p in places], pa.binary())})

    # At most SAMPLE keys, or four for each of at most MOST_CHUNKS chunks.
    keys = sorted(bytes(r.key) for r in store.map(sample, "key binary").collect())
    splitters = sorted(set(keys[:: max(1, len(keys) // (4 * buckets))][1:]))

    def suffixes(chunk: int, t: pa.Table, told: pa.Table) -> pa.Table:
        c = Contexts(t, told, hot, True)
        bucket = range_of(c.key, splitters)
        bucket = np.where(c.hot, (bucket + 1) * SALT + chunk % SALT + len(splitters), bucket)
        return pa.table([pa.array(np.full(len(c.name), chunk, np.int32)), pa.array(np.arange(len(c.name), dtype=np.int32)), pa.array(bucket.astype(np.int32)), pa.array(c.hot), c.text, pa.array(c.doc)], names=["chunk", "rid", "bucket", "whole", "suffix", "doc"])

    dealt = store.meet(totals, suffixes, SUFFIX)
    found = materialize(dealt.groupBy("bucket").applyInArrow(_sort_bucket, FOUND), "repeats")
    edges = found.where("edge is not null")
    across = edges.join(edges.groupBy("edge").agg(F.min("edge_doc").alias("least")), "edge").select("chunk", "rid", "least")
    told = totals.unionByName(found.where("told is not null").select("chunk", "told"), allowMissingColumns=True).unionByName(across, allowMissingColumns=True)

    def cut(chunk: int, t: pa.Table, told: pa.Table) -> pa.Table:
        c = Contexts(t, told.filter(told.column("bucket").is_valid()), hot, False)
        starts = np.cumsum(c.count) - c.count
        least = np.repeat(c.doc, c.count)
        for row in told.filter(told.column("told").is_valid()).column("told").to_pylist():
            rid, values = unpack(row)
            n = c.count[rid]
            least[np.arange(n.sum()) + np.repeat(starts[rid] - (np.cumsum(n) - n), n)] = values
        edge = told.filter(told.column("rid").is_valid())
        if edge.num_rows:
            least[starts[edge.column("rid").to_numpy()]] = edge.column("least").to_numpy()
        out = []
        for (rows, data, offsets), (first, count, doc, name) in zip(batches(t), c.uses):
            gone = np.zeros(len(data) + 1, np.int32)
            if len(name):
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                text = np.searchsorted(c.name, name)
                gone[np.repeat(first, count) + step] = least[np.repeat(starts[text], count) + step] < np.repeat(doc, count)
            sums = np.cumsum(gone, dtype=np.int64)
            before = np.concatenate([np.zeros(SPAN, np.int64), sums])[: len(sums)]
            covered = (sums - before > 0)[: len(data)]
            for r, a, b in zip(rows, offsets[:-1], offsets[1:]):
                own = covered[a:b]
                kept = data[a:b][~own].tobytes() if b > a else b""
                n_spans = int(np.count_nonzero(own[1:] & ~own[:-1]) + (len(own) and own[0]))
                out.append((t.column("doc_id")[int(r)].as_py(), int(b - a), int(own.sum()), n_spans, hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    result = materialize(store.meet(told, cut, DIGEST + ", kept binary" * keep_text), "kept")
    store.drop()
    return result

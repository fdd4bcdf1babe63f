"""Token ids and token counts of one public word-level BPE file, memoised by whitespace-delimited string.

White space always separates pre-tokens of this vocabulary, so a text's ids are the ids of its
space-delimited strings put together. Strings of plain Latin letters go straight to the merges.
"""

from __future__ import annotations

import array
import os
import re

PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
#: Strings with an id of their own, which the library matches before it lower-cases.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: A comma or full stop behind other punctuation belongs to one pre-token with it.
#: White space is as the library has it: Python's class also holds U+001C to U+001F.
JOINED = re.compile("(?:[^\\w\t\n\x0b\x0c\r \x85\xa0]|_)[,.] ")
MEMO = 700_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files use for each byte: printable bytes stand for themselves, the others for 256, 257, ..."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Chunks:
    """Space-delimited strings of texts. A text of Latin-1 characters is lower-cased first, as the vocabulary's normaliser does it there, so that fewer different strings come up; one that would come to hold a special string by it is not."""

    @staticmethod
    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
            low = text.lower()
            if "<|" in low and any(low.count(s) != text.count(s) for s in SPECIAL):
                return text.replace("\n", " ").split(" ")
            text = low.replace("\n", " ")
            if not JOINED.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
        except UnicodeEncodeError:
            text = text.replace("\n", " ")
        return text.split(" ")


class Ids:
    """ids(texts): the library's ids of each text as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = load(path)
        self.merge = Tokenizer(self.whole.model)
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {"": b""}

    def learn(self, chunks: set[str]) -> None:
        words = [c for c in chunks if PLAIN.fullmatch(c)]
        mapped = [w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in words]
        self._keep(self.merge, words, mapped)
        odd = list(chunks.difference(words))
        self._keep(self.whole, odd, odd)

    def _keep(self, by, chunks: list[str], forms: list[str], step: int = 2000) -> None:
        for at in range(0, len(chunks), step):
            found = by.encode_batch_fast(forms[at : at + step], add_special_tokens=False)
            self.memo.update(zip(chunks[at : at + step], [array.array("I", e.ids).tobytes() for e in found]))

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [Chunks.split(t) for t in texts]
        new = set().union(*split) - self.memo.keys() if split else set()
        if len(self.memo) + len(new) > MEMO:
            self.memo = {"": b""}
            new = set().union(*split) - self.memo.keys()
        self.learn(new)
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) for s in split]


_kept: dict[tuple[str, str], object] = {}


def kept(kind, path: str, *more):
    """One per Python worker and file."""
    if (kind.__name__, path) not in _kept:
        _kept[kind.__name__, path] = kind(path, *more)
    return _kept[kind.__name__, path]


class Counts:
    """n(texts): tokens of each text by the whole-token shortcut.

    `whole` holds the vocabulary's strings that are proven to encode alone as one token: a pre-token
    among them counts one, and only the rest goes through the library's merges.
    """

    def __init__(self, path: str, whole: frozenset[str]):
        self.own, self.whole = load(path), whole
        self.specials = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.memo: dict[str, int] = {"": 0}

    def _count(self, chunk: str) -> int:
        if PLAIN.fullmatch(chunk):
            pre = [chunk if chunk.isascii() else "".join([self.letters[b] for b in chunk.encode()])]
        elif any(s in chunk for s in self.specials):
            return len(self.own.encode(chunk, add_special_tokens=False).ids)
        else:
            pre = [p for p, _ in self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(chunk))]
        return sum(1 if p in self.whole else len(self.own.model.tokenize(p)) for p in pre)

    def n(self, texts: list[str]) -> list[int]:
        out, memo = [], self.memo
        for t in texts:
            split = Chunks.split(t)
            for c in set(split).difference(memo):
                memo[c] = self._count(c)
            out.append(sum(map(memo.__getitem__, split)))
            if len(memo) > MEMO:
                memo = self.memo = {"": 0}
        return out


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The byte-letter strings whose own merges end in exactly the one token that the vocabulary lists for them with the word end."""
    tok = load(path)
    found = set()
    for name, number in tok.get_vocab(with_added_tokens=False).items():
        if name.endswith("</w>") and [t.id for t in tok.model.tokenize(name[:-4])] == [number]:
            found.add(name[:-4])
    return frozenset(found)

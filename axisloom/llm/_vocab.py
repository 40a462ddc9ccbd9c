"""A bounded memo in front of a public tokenizer.

Both word-level and byte-level BPE cut a text at some places whatever stands around them.
Pieces between two such places always give the same ids, so each worker asks the library for
a piece once and keeps the answer. Two generations bound the memo: when the young one is full
it becomes the old one, and pieces still in use move back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from axisloom.llm._worker import state

BATCH_BYTES = 1 << 20
LONGEST_KEPT = 96


def library(path: str):
    """The tokenizer at ``path``, loaded once in each Python worker, without truncation or padding."""
    held = state("tokens")
    if path not in held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        held[path] = tok
    return held[path]


def balanced(items: Iterable[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Groups of items of about ``limit`` bytes each; an item over the limit is a group of its own."""
    group: list[bytes] = []
    held = 0
    for item in items:
        if group and held + len(item) > limit:
            yield group
            group, held = [], 0
        group.append(item)
        held += len(item) + 32
    if group:
        yield group


#: Letters of ASCII and Latin-1, which every pattern here takes for letters, then ASCII marks other than an apostrophe.
PLAIN = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take 256, 257, ... in turn.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class PieceMemo:
    """Piece (UTF-8 bytes) to whatever ``pack`` makes of its ids, for at most 2 x ``capacity`` pieces.

    ``pack`` must turn a concatenation into a sum, as ``len`` and joined bytes do. A new piece of
    plain letters and marks is put together from the two, as every pattern cuts between them;
    the letters, one pre-token, go straight to the library's model. ``fold`` tells that the
    tokenizer lower-cases. Every other new piece goes through the whole library.
    """

    def __init__(self, path: str, pack: Callable[[list[int]], object], fold: bool, capacity: int):
        self.tok, self.pack, self.fold, self.capacity = library(path), pack, fold, capacity
        self.model = self.tok.model
        self.symbols = str.maketrans(dict(enumerate(byte_symbols())))
        self.young: dict = {}
        self.old: dict = {}

    def encode(self, pieces: list[bytes]) -> list:
        """Packed ids of every piece, straight from the library, in batches balanced by bytes."""
        out: list = []
        for group in balanced(pieces):
            texts = [p.decode("utf-8") for p in group]
            out += [self.pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def _letters(self, piece: bytes):
        """Packed ids of one pre-token of letters, kept under its own key."""
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.pack([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.symbols))])
            self.young[piece] = found
        return found

    def lookup(self, pieces: set[bytes]) -> dict:
        """A mapping that holds every piece asked for."""
        if len(self.young) > self.capacity:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        rest, marks = [], {}
        for p in pieces.difference(young):
            if p in old:
                young[p] = old[p]
            elif len(p) <= LONGEST_KEPT and (plain := PLAIN.fullmatch(p)) and not (self.fold and p[0] == 32):
                word, tail = plain.groups()
                if self.fold:
                    word = word.decode("utf-8").lower().encode("utf-8")
                if tail:
                    marks[p] = word, tail
                else:
                    young[p] = self._letters(word)
            else:
                rest.append(p)
        rest += {tail for _, tail in marks.values() if tail not in young}
        done = dict(zip(rest, self.encode(rest), strict=True))
        young.update(kv for kv in done.items() if len(kv[0]) <= LONGEST_KEPT)
        for p, (word, tail) in marks.items():
            young[p] = self._letters(word) + young[tail]
        if any(len(p) > LONGEST_KEPT for p in rest):
            return {p: young[p] if p in young else done[p] for p in pieces}
        return young


def memo(path: str, pack: Callable[[list[int]], object], fold: bool, capacity: int = 400_000) -> PieceMemo:
    """The worker's memo for a tokenizer and a way of packing."""
    held, key = state("tokens"), (path, pack.__name__)
    if key not in held:
        held[key] = PieceMemo(path, pack, fold, capacity)
    return held[key]


def pack_u16(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 16-bit integers; vocabularies here stay below 65,536."""
    return np.asarray(ids, dtype="<u2").tobytes()

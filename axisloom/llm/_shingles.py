"""Word shingles as sorted arrays of 64-bit hashes (worker side)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SHINGLE_WORDS = 5
#: Bytes of a text that are hashed at a time, so that very long texts need little memory beside their hashes.
SEGMENT = 1 << 18

_STEP = 0x9E3779B97F4A7C15
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
_POWERS: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


#: A number for each byte, A-Z as a-z; and which bytes are ASCII white space.
_BYTES = _mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) * np.uint64(_STEP) + np.uint64(1))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        pair = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            p = np.full(max(n, 1 << 13), base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[:] = pair
    return _POWERS[0][:n], _POWERS[1]


def _segments(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about SEGMENT bytes that end at white space."""
    at = 0
    while len(text) - at > SEGMENT:
        found = _GAP.search(text, at + SEGMENT)
        cut = found.start() if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word in turn: its bytes as digits of a polynomial, taken as differences of one running sum."""
    found = []
    for part in _segments(text) if len(text) > SEGMENT else (text,):
        raw = np.frombuffer(part, np.uint8)
        space = np.ones(len(raw) + 2, bool)
        space[1:-1] = _SPACE[raw]
        edges = np.flatnonzero(space[1:] != space[:-1])
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
        found.append((sums[edges[1::2]] - sums[edges[::2]]) * down[edges[::2]])
    return _mixed(found[0] if len(found) == 1 else np.concatenate(found))


def shingle_hashes(text: bytes | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingles of a UTF-8 text, in ascending order of hash.

    A-Z count as a-z; words are separated by ASCII white space. A text of fewer words than
    ``k`` has its whole sequence as its one shingle; a text without words has none.
    """
    w = word_hashes(text or b"")
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, k)
    count = n - size + 1
    h = np.full(count, size, np.uint64)
    for i in range(size):
        h *= np.uint64(_STEP)
        h += w[i : i + count]
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h.sort()
    if count == 1:
        return h
    new = np.ones(count, bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]

"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks at places that depend on nearby bytes
only, so copied passages give the same chunks wherever they stand. Each Python worker encodes a
chunk once and keeps its ids in a bounded memo that lasts as long as the worker; no text is
shuffled for this. A cut can fall inside a word, so the ids next to it may be wrong: each join is
encoded again over the last two pieces of one chunk and the first two of the next, where a piece
is a run of white space with the word behind it. The join is good when the outer pieces come out
exactly as they were; otherwise it is widened by more and more whole chunks on both sides until they do,
at the utmost to the ends of the text. Neighbours with too
few pieces for a join are put together first, in one step. The pre-tokenizer always cuts
between a visible character and ASCII white space, so ids between two such places don't depend
on anything outside, and agreement there makes the whole join exact.

Characters that some pattern may take for white space are neither visible nor white space here: no piece
begins behind one, so pieces that hold any are longer, and nothing else changes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm._vocab import PieceMemo, byte_symbols, library, memo, pack_u16
from axisloom.llm._worker import state

WINDOW = 32
MEAN_BITS = 10
SHORTEST = 384
LONGEST = 8192
CHUNKS_KEPT = 8_000
CHUNK_BYTES_KEPT = 32 << 20
PIECES_KEPT = 150_000
LEAST_PIECES = 4
SEGMENT = 1 << 20
GROUP_BYTES = 4 << 20
GROUP_ROWS = 512

#: ASCII white space, and the other characters that some pattern may take for white space.
PIECE = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
ODD_SPACE = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
ODD = re.compile(b"|".join(re.escape(chr(c).encode("utf-8")) for c in ODD_SPACE))
ODD_END = re.compile(b"(?:" + ODD.pattern + rb")\Z")

_ODD_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for base in (_ODD_MULTIPLIER, pow(_ODD_MULTIPLIER, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks of a text, each between two characters; the last is its length."""
    ends: list[int] = []
    start = 0
    while start < len(text):  # windows of a bounded size, so that very long texts need little memory
        stop = min(len(text), start + SEGMENT)
        raw = np.frombuffer(text, np.uint8, stop - start, start)
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw.astype(np.uint64) * up[:-1], out=sums[1:])
        hashes = (sums[WINDOW:] - sums[:-WINDOW]) * down[: max(0, len(raw) + 1 - WINDOW)] if len(raw) >= WINDOW else np.zeros(0, np.uint64)
        good = np.flatnonzero((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW
        last = 0
        for c in [*good.tolist(), len(raw)]:
            while c - last > LONGEST:
                last = _between(text, start + last + LONGEST) - start
                ends.append(start + last)
            if c < len(raw) and c - last >= SHORTEST and len(raw) - c >= SHORTEST:
                c = _between(text, start + c) - start
                if c < len(raw):
                    ends.append(start + c)
                    last = c
        tail = last if stop < len(text) and last else len(raw)
        if tail == len(raw):
            tail = _between(text, stop) - start
            if not ends or ends[-1] != start + tail:
                ends.append(start + tail)
        start += tail
    return ends


def _between(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _begins(left: bytes, right: bytes) -> bool:
    """Whether a piece begins with ``right`` where it follows ``left``."""
    return right[:1].isspace() and not left[-1:].isspace() and not ODD_END.search(left[-3:])


def _pieces(part: bytes) -> list[bytes]:
    """The pieces of a chunk; white space at its end is a piece of its own."""
    found = PIECE.findall(part)
    if not ODD.search(part):
        return found
    groups: list[list[bytes]] = []
    for piece in found:
        if groups and not _begins(groups[-1][-1], piece):
            groups[-1].append(piece)
        else:
            groups.append([piece])
    return [b"".join(g) for g in groups]


def _few_pieces(part: bytes) -> int:
    """The number of pieces, counted up to one more than LEAST_PIECES where that is all it takes."""
    return len(_pieces(part)) if ODD.search(part) else sum(1 for _ in islice(PIECE.finditer(part), LEAST_PIECES + 1))


def _joinable(parts: list[bytes]) -> list[bytes]:
    """The chunks of a text, neighbours put together until each has LEAST_PIECES pieces; one chunk where the text has fewer."""
    groups: list[list[bytes]] = []
    pieces = 0
    for p in parts:
        few = _few_pieces(p)
        if groups and pieces < LEAST_PIECES:
            pieces += few - (not _begins(groups[-1][-1], p))
            groups[-1].append(p)
        else:
            groups.append([p])
            pieces = few
    if len(groups) > 1 and pieces < LEAST_PIECES:
        groups[-2:] = [groups[-2] + groups[-1]]
    return [g[0] if len(g) == 1 else b"".join(g) for g in groups]


class Chunk:
    """Ids of a chunk, and where its outer two pieces on either side end or begin (bytes and ids).

    From LEAST_PIECES on, the two don't overlap and both lie between places where the pre-tokenizer cuts.
    White space at the end is a piece of its own.
    """

    __slots__ = ("head", "ids", "tail")

    def __init__(self, text: bytes, pieces: list[bytes], ids: list[bytes]):
        self.ids = b"".join(ids)
        self.head = self.tail = None
        if len(pieces) >= LEAST_PIECES:
            self.head = len(pieces[0]) + len(pieces[1]), len(ids[0]) + len(ids[1]), ids[1]
            self.tail = len(text) - len(pieces[-1]) - len(pieces[-2]), len(self.ids) - len(ids[-1]) - len(ids[-2]), ids[-2]


class ChunkCodec:
    """Encodes texts chunk by chunk; keeps recent chunks in two generations."""

    def __init__(self, path: str):
        self.tok = library(path)
        self.pieces: PieceMemo = memo(path, pack_u16, fold=False, capacity=PIECES_KEPT)
        self.young: dict[bytes, Chunk] = {}
        self.old: dict[bytes, Chunk] = {}
        self.held = 0
        self.encoded = self.reused = self.repaired = self.widened = 0
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        if self.size > 1 << 16:
            raise ValueError("ids are packed in 16 bits")
        self.bytes_of = _token_bytes(vocab, self.size)
        self.decimal = [b"%d" % k for k in range(self.size)]

    def chunks(self, parts: list[bytes]) -> dict[bytes, Chunk]:
        """Every part's chunk; those not kept from before are encoded once."""
        if len(self.young) > CHUNKS_KEPT or self.held > CHUNK_BYTES_KEPT:
            self.old, self.young, self.held = self.young, {}, 0
        out: dict[bytes, Chunk] = {}
        new: dict[bytes, list[bytes]] = {}
        for p in parts:
            if p in out or p in new:
                self.reused += 1
            elif (found := self.young.get(p) or self.old.get(p)) is not None:
                out[p] = self._keep(p, found)
                self.reused += 1
            else:
                new[p] = _pieces(p)
        self.encoded += len(new)
        if new:
            table = self.pieces.lookup(set().union(*new.values()))
            for p, pieces in new.items():
                out[p] = self._keep(p, Chunk(p, pieces, [table[x] for x in pieces]))
        return out

    def _keep(self, part: bytes, chunk: Chunk) -> Chunk:
        if part not in self.young:
            self.held += len(part) + len(chunk.ids)
            self.young[part] = chunk
        return chunk

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as unsigned 16-bit integers, exactly as the library gives for the whole text."""
        plans: list[list[bytes]] = []
        for t in texts:
            ends = cut_points(t) if t else []
            plans.append(_joinable([t[a:b] for a, b in zip([0, *ends], ends, strict=False)]))
        known = self.chunks([p for plan in plans for p in plan])
        joins = [self._window(known, plan, k, k + 1) for plan in plans for k in range(len(plan) - 1)]
        fresh = list(dict.fromkeys(joins))
        again = dict(zip(fresh, self.pieces.encode(fresh), strict=True))
        self.repaired += len(joins)
        return [self._join(plan, known, again) for plan in plans]

    @staticmethod
    def _window(known: dict[bytes, Chunk], plan: list[bytes], low: int, high: int) -> bytes:
        """The text from the last two pieces of chunk ``low`` to the first two of ``high``; beyond the first and last chunk, to the ends."""
        first = plan[low][known[plan[low]].tail[0] :] if low >= 0 else b""
        last = plan[high][: known[plan[high]].head[0]] if high < len(plan) else b""
        return b"".join((first, *plan[low + 1 : high], last))

    @staticmethod
    def _agrees(known: dict[bytes, Chunk], plan: list[bytes], low: int, high: int, ids: bytes) -> bool:
        """Whether the outer pieces of a window came out as they were inside their chunks."""
        return (low < 0 or ids.startswith(known[plan[low]].tail[2])) and (high >= len(plan) or ids.endswith(known[plan[high]].head[2]))

    def _join(self, plan: list[bytes], known: dict[bytes, Chunk], again: dict[bytes, bytes]) -> bytes:
        """Ids of the text: chunks without their outer pieces, and between them windows that agree."""
        windows: list[tuple[int, int, bytes]] = []  # chunks on either side, and the ids between
        k = 0
        while k < len(plan) - 1:
            low, high, step = k, k + 1, 1
            while True:
                while windows and windows[-1][1] > low:  # windows that this one overlaps
                    low = min(low, windows.pop()[0])
                text = self._window(known, plan, low, high)
                ids = again[text] if text in again else self.pieces.encode([text])[0]
                if self._agrees(known, plan, low, high, ids):
                    break
                self.widened += 1
                low, high, step = max(-1, low - step), min(len(plan), high + step), 2 * step
            windows.append((low, high, ids))
            k = high
        out, begin, at = [], 0, 0
        for low, high, ids in windows:
            if low >= 0:
                chunk = known[plan[low]]
                out.append(chunk.ids[begin : chunk.tail[1]])
            out.append(ids)
            at, begin = high, known[plan[high]].head[1] if high < len(plan) else 0
        if at < len(plan):
            out.append(known[plan[at]].ids[begin:])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode("utf-8", "replace")


def _token_bytes(vocab: dict[str, int], size: int) -> list[bytes]:
    """Bytes of each token."""
    shown = {c: b for b, c in enumerate(byte_symbols())}
    out = [b""] * size
    for token, k in vocab.items():
        known = all(c in shown for c in token)
        out[k] = bytes(shown[c] for c in token) if known else token.encode("utf-8")
    return out


def codec(path: str) -> ChunkCodec:
    """The worker's codec for a tokenizer file."""
    held = state("tokens")
    if ("codec", path) not in held:
        held["codec", path] = ChunkCodec(path)
    return held["codec", path]


def _batches(column: pa.Array) -> Iterator[list[bytes | None]]:
    """Texts in groups of some rows and about ``GROUP_BYTES``; few of a batch are Python objects at a time."""
    for at in range(0, len(column), GROUP_ROWS):
        group: list[bytes | None] = []
        held = 0
        for t in column.slice(at, GROUP_ROWS).cast(pa.binary()).to_pylist():
            if group and held + len(t or b"") > GROUP_BYTES:
                yield group
                group, held = [], 0
            group.append(t)
            held += len(t or b"")
        yield group


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id and ``ids`` (array of int).

    Null and empty texts have no ids; a null id stays null; repeated rows each give a row; an
    empty table gives an empty one; other columns are ignored, whatever their names. A very long
    text is encoded whole, alone in its group. Ids must be whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at = 0
            for group in _batches(batch.column(1)):
                ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in c.encode(group)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
                at += len(group)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The texts of ``encode_documents`` output: the id and ``text``.

    A null or empty array gives an empty text; null document ids stay null, repeated rows each
    give a row, an empty table gives an empty one, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(pack_u16(x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), "ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and keep digests only.

    Returns the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text in UTF-8). Cases as in ``encode_documents``; a text without ids has the
    digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at = 0
            for group in _batches(batch.column(1)):
                n, a, b = [], [], []
                for raw in c.encode(group):
                    ids = np.frombuffer(raw, "<u2").tolist()
                    n.append(len(ids))
                    a.append(hashlib.sha256(b",".join(map(c.decimal.__getitem__, ids))).hexdigest())
                    b.append(hashlib.sha256(c.decode(raw).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(group)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

"""Token ids as binary segments of patched frame-of-reference blocks.

A store is a Parquet folder whose rows are segments: whole documents in ascending id order,
about ``SEGMENT_IDS`` token ids each. A segment's payload is self-contained:

    magic, version, block size, counts of documents, ids, blocks and exceptions
    document ids, null flags and lengths
    per block: minimum, bit width, start in the packed area, start in the exception list
    packed area: every block's values less its minimum, ``width`` low bits each
    exception list: position in the block and the full difference, where it needs more bits

The width of a block is that of the ``PERCENTILE`` quantile of its differences, so a few large
values do not widen the rest. Block starts are indexed: any block can be read alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.llm._io import table
from axisloom.llm._vocab import memo, pack_u16

BLOCK = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 17
DOCS_AT_ONCE = 64
MAGIC = b"PFOR"
HEAD = struct.Struct("<4sHHIIII")


def _widths(d: np.ndarray) -> np.ndarray:
    k = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    at = np.partition(d, k, axis=1)[:, k]
    return np.where(at > 0, np.floor(np.log2(np.maximum(at, 1))).astype(np.int64) + 1, 0).astype(np.uint8)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, int, int]:
    """Block headers, packed area and exceptions of unsigned ids; also the counts of blocks and exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(1, "<u4").tobytes() * 2, 0, 0
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1)
    d = rows - low[:, None]
    widths = _widths(d)
    starts = np.zeros(blocks + 1, "<u4")
    np.cumsum(widths.astype(np.int64) * (BLOCK // 8), out=starts[1:], dtype="<u4")
    area = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(widths):
        if w:
            at = np.flatnonzero(widths == w)
            bits = np.unpackbits(d[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little", count=int(w))
            area[starts[at][:, None].astype(np.int64) + np.arange(BLOCK // 8 * int(w))] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    row, col = np.nonzero(d >> widths[:, None].astype(np.uint32))
    patches = np.zeros(blocks + 1, "<u4")
    np.cumsum(np.bincount(row, minlength=blocks), out=patches[1:], dtype="<u4")
    parts = (low.astype("<u4"), widths, starts, patches, area, col.astype("<u2"), d[row, col].astype("<u4"))
    return b"".join(p.tobytes() for p in parts), blocks, len(row)


def unpack_blocks(raw: memoryview, n: int, blocks: int, patched: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks ``first`` to ``last`` (all by default), read through the block index."""
    last = blocks if last is None else last
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    if not blocks:
        return np.zeros(0, np.uint32)
    low, widths, starts, patches = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1), take("<u4", blocks + 1)
    area, cols, values = take("u1", int(starts[-1])), take("<u2", patched), take("<u4", patched)
    low, widths = low[first:last], widths[first:last]
    d = np.zeros((last - first, BLOCK), "<u4")
    for w in np.unique(widths):
        if w:
            rows = np.flatnonzero(widths == w)
            packed = area[starts[first:last][rows][:, None].astype(np.int64) + np.arange(BLOCK // 8 * int(w))]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
            wide[:, :, : int(w)] = bits
            d[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
    span = slice(int(patches[first]), int(patches[last]))
    d[np.repeat(np.arange(last - first), np.diff(patches[first : last + 1])), cols[span]] = values[span]
    return (d + low[:, None]).reshape(-1)[: n - first * BLOCK]


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Payload of one segment: ``lengths[k]`` ids for each document in turn."""
    body, blocks, patched = pack_blocks(ids)
    head = HEAD.pack(MAGIC, 1, BLOCK, len(doc_ids), len(ids), blocks, patched)
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join((head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<u4").tobytes(), body))


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all token ids of a segment."""
    magic, version, block, docs, n, blocks, patched = HEAD.unpack_from(payload)
    if magic != MAGIC or version != 1 or block != BLOCK:
        raise ValueError("not a segment of this format")
    at = HEAD.size
    keys = np.frombuffer(payload, "<i8", docs, at).tolist()
    at += 8 * docs
    null = np.frombuffer(payload, "u1", docs, at)
    at += docs
    lengths = np.frombuffer(payload, "<u4", docs, at)
    at += 4 * docs
    ids = unpack_blocks(memoryview(payload)[at:], n, blocks, patched)
    return [None if z else k for k, z in zip(keys, null, strict=True)], lengths, ids


def encode_texts(path: str, texts: list[bytes | None], end_id: int | None) -> list[np.ndarray]:
    """Ids of UTF-8 texts, cut at ASCII white space as in token_counts; ``end_id`` closes each."""
    words_of = memo(path, pack_u16, fold=True)
    tail = b"" if end_id is None else pack_u16([end_id])
    split = [(t or b"").split() for t in texts]
    found = words_of.lookup(set().union(*split)).__getitem__
    return [np.frombuffer(b"".join(map(found, words)) + tail, "<u2") for words in split]


SEGMENTS = "shard int, seq int, base long, n_docs long, n_ids long, payload binary"


def write_store(docs: DataFrame, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write the store to the shared folder; returns its segments.

    Documents are dealt by ranges of id (and a hash of the text, so that repeats of one id still
    spread), sorted, and packed by each task as one shard. ``base`` counts the ids of a shard
    before the segment. Null ids sort first; a null text is empty; a very long one is a segment of its own; equal ids sort by their text;
    an empty table gives a store without segments; other columns are ignored, whatever their names. Ids must be whole numbers.

    Texts are exchanged, not ids: ids written between would be read twice, for the bounds of the ranges and again.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = slim.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        seq = base = held = 0
        keys: list = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, base, held, keys, parts
            ids = np.concatenate(parts)
            row = [[shard], [seq], [base], [len(keys)], [len(ids)], [write_segment(keys, [len(p) for p in parts], ids)]]
            seq, base, held, keys, parts = seq + 1, base + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "seq", "base", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                few = batch.slice(at, DOCS_AT_ONCE)
                coded = encode_texts(path, few.column(1).cast(pa.binary()).to_pylist(), end_id)
                for key, ids in zip(few.column(0).to_pylist(), coded, strict=True):
                    keys.append(key)
                    parts.append(ids)
                    held += len(ids)
                    if held >= SEGMENT_IDS:
                        yield close()
        if keys:
            yield close()

    return table(ordered.mapInArrow(pack, SEGMENTS), "token-store")


def read_store(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each stored document: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Documents without text have their end id only; null document ids stay null and repeated rows each give a row, in
    the order of the store; a store without segments gives an empty table; a payload of another format is an error. Shard totals are one row for each write task, so their running sum is small and is broadcast.
    """
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    placed = segments.join(F.broadcast(firsts), "shard").select((F.col("first") + F.col("base")).alias("at"), "payload")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, lengths, ids = read_segment(payload.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(at + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(unpack, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)

"""Token counts: whole texts are counted in Arrow batches, and only lengths leave the workers.

Texts are cut at ASCII white space, where the word tokenizer always cuts as well: it drops white
space, and no normalisation, pattern or merge reaches across it. So the count of a text is the
sum of the counts of its pieces, however long the text is. Documents are taken in groups of
about ``GROUP_BYTES``, and pieces not met before go to the library in batches balanced by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm._vocab import memo

GROUP_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 20
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")


def segments(text: bytes, limit: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Parts of a long text of about ``limit`` bytes, cut only at ASCII white space.

    A run without white space is never cut, so a part can be longer than the limit.
    """
    at = 0
    while len(text) - at > limit:
        found = GAP.search(text, at + limit)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _groups(texts: list[bytes | None], limit: int) -> Iterator[list[bytes]]:
    group: list[bytes] = []
    held = 0
    for t in texts:
        t = t or b""
        if group and held + len(t) > limit:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def count_texts(path: str, texts: list[bytes | None]) -> list[int]:
    """Token counts of UTF-8 texts; null counts as empty."""
    table = memo(path, len, fold=True)
    out: list[int] = []
    for group in _groups(texts, GROUP_BYTES):
        parts = [[part.split() for part in segments(text)] for text in group]
        found = table.lookup({w for part in parts for words in part for w in words}).__getitem__
        out += [sum(sum(map(found, words)) for words in part) for part in parts]
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text.

    Returns one row for each input row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``.
    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are
    each counted; very long texts are counted part by part; an empty table gives an empty table; other columns are ignored, whatever
    their names. Ids must be whole numbers. ``path`` is the tokenizer file as the workers see it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n = count_texts(path, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = slim.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

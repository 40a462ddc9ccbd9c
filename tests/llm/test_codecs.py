import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from axisloom.llm import bpe_codec, token_counts, token_store
from axisloom.llm._vocab import library

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", " ", "  ", "a  \n b", "<|endoftext|> x <|endoftext|>y", "foo<|endo ftext|>", "  x y z" * 200, "don't  we'll  I'm" * 500, "x" * 30000, "日本語 " * 3000, " \n" * 5000,
    "é ́a" * 2000, "\x1c a\x1d b" * 100, "ΑΣ ΟΔΟΣ İstanbul ſs K" * 50, "The cat, THE CAT. the-cat's \"cat\"!? " * 300, "ß×÷ÿ Ÿ ŸŸ,," * 99, "   a  b" * 400, "<|startoftext|>a",
]


def mixed(seed, n=4000):
    rng = random.Random(seed)
    return "".join(rng.choices(["a", "b", " ", "  ", "\n", "'s", "1", "23", "é", "ß", "<|endoftext|>", ".", ",", "\t", "日", "word ", "The "], k=n))


def sample():
    shared = mixed(99, 3000)
    return [*ODD, *[mixed(k) for k in range(6)], *[mixed(k, 900) + shared + mixed(k + 50, 900) for k in range(4)]]


def ids_of(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


def test_chunk_codec_is_exact_and_reuses_chunks():
    c = bpe_codec.ChunkCodec(BYTE)
    texts = sample()
    for text, raw in zip(texts, c.encode([t.encode() for t in texts]), strict=True):
        ids = np.frombuffer(raw, "<u2").tolist()
        assert ids == ids_of(BYTE, text)
        assert c.decode(raw) == library(BYTE).decode(ids, skip_special_tokens=False) == text
    assert c.repaired > 30 and c.reused > 5 and c.widened == 0


def exact(c, texts):
    return all(np.frombuffer(raw, "<u2").tolist() == ids_of(BYTE, t) for t, raw in zip(texts, c.encode([t.encode() for t in texts]), strict=True))


def test_long_texts_that_end_in_white_space_keep_their_chunks():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(rng.choices(words, k=500_000))
    assert len(text) > 2_500_000
    c = bpe_codec.ChunkCodec(BYTE)
    assert exact(c, [text + "\n"])
    assert c.repaired > 1000 and c.widened == 0 and c.held < 8 * len(text)
    seen = c.reused
    assert exact(c, ["a " + text + " \n\t\n"]) and c.reused - seen > 1000


def test_chunks_without_white_space_are_joined_in_one_step():
    for text in ("日本語" * 40_000, ("x" * 9000 + " ") * 20 + "\n", " \n" * 100_000, "one line of all\n" * 20_000):
        c = bpe_codec.ChunkCodec(BYTE)
        assert exact(c, [text]) and c.held < 8 * len(text.encode())


def test_random_texts_are_exact():
    rng = random.Random(4)
    texts = [mixed(k, rng.randint(500, 9000)) + rng.choice(["\n", " ", "", " \t\n  "]) for k in range(200, 300)]
    c = bpe_codec.ChunkCodec(BYTE)
    assert exact(c, texts) and c.widened == 0


def test_chunk_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe_codec, "CHUNK_BYTES_KEPT", 20_000)
    c = bpe_codec.ChunkCodec(BYTE)
    for k in range(30):
        assert exact(c, [mixed(k, 3000)])
    assert sum(map(len, [*c.young, *c.old])) < 100_000


@pytest.mark.parametrize("at_least, among", [(0, 1), (3000, 1), (9000, 1), (1 << 30, 1), (3000, 3), (6000, 100)])
def test_joins_that_disagree_are_widened_chunk_by_chunk(monkeypatch, at_least, among):
    """Windows shorter than ``at_least`` bytes come out wrong, for one in ``among`` joins; only the whole text always agrees."""
    c = bpe_codec.ChunkCodec(BYTE)
    text = "some words in a row of text " + mixed(2, 20000).replace("\t", " w ")
    parts = bpe_codec._joinable([text.encode()[a:b] for a, b in zip([0, *bpe_codec.cut_points(text.encode())], bpe_codec.cut_points(text.encode()), strict=False)])
    c.chunks(parts)
    real, lengths = c.pieces.encode, []

    def wrong(pieces):
        lengths.extend(map(len, pieces))
        first = len(pieces) > 1
        return [b"\xff\xff" if (k % among == 0 if first else len(p) < at_least) and p != text.encode() else x for k, (p, x) in enumerate(zip(pieces, real(pieces), strict=True))]

    monkeypatch.setattr(c.pieces, "encode", wrong)
    assert exact(c, [text]) and c.widened > 0 and len(parts) > 8
    assert max(lengths) <= len(text.encode()) and (at_least > 9000 or among == 1 or c.widened < 4 * len(parts))


def test_odd_white_space_keeps_chunks():
    rng = random.Random(21)
    odd = ["\u00a0", "\u3000", "\u200b", "\u2003", "\x1c", "\u0085", "\ufeff", "\u180e", "\u2028"]
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(300)]
    texts = []
    for rate in (0.01, 0.1, 0.5, 1.0):
        texts.append("".join(w + (rng.choice([*odd, " \u00a0", "\u00a0 ", "\n\u3000\n", "  \u2003  "]) if rng.random() < rate else " ") for w in rng.choices(words, k=4000)))
    texts.append("日本語　の文　です。" * 3000)
    c = bpe_codec.ChunkCodec(BYTE)
    assert exact(c, texts) and c.repaired > 60 and c.widened == 0
    seen = c.reused
    assert exact(c, ["x " + t for t in texts]) and c.reused - seen > 60
    for text in texts:
        raw = text.encode()
        assert b"".join(bpe_codec._pieces(raw)) == raw


def test_chunks_follow_content():
    body = mixed(5, 20000).encode()
    a = {body[x:y] for x, y in zip([0, *bpe_codec.cut_points(body)], bpe_codec.cut_points(body), strict=False)}
    other = b"something else before it " * 9 + body
    b = {other[x:y] for x, y in zip([0, *bpe_codec.cut_points(other)], bpe_codec.cut_points(other), strict=False)}
    assert b"".join(body[x:y] for x, y in zip([0, *bpe_codec.cut_points(body)], bpe_codec.cut_points(body), strict=False)) == body
    assert len(a & b) > 0.6 * len(a)
    for text in ("日本語" * 9000, "x" * 3_000_000, "y"):
        t = text.encode()
        ends = bpe_codec.cut_points(t)
        assert ends[-1] == len(t) and all(t[x:y].decode() for x, y in zip([0, *ends], ends, strict=False))


def test_word_counts_and_ids_match_the_library():
    texts = sample()
    raw = [t.encode() for t in texts]
    want = [ids_of(WORD, t) for t in texts]
    assert token_counts.count_texts(WORD, raw) == [len(w) for w in want]
    assert [x.tolist() for x in token_store.encode_texts(WORD, raw, 1)] == [[*w, 1] for w in want]


def test_segments_cut_only_at_white_space():
    text = ("word " * 1000 + "x" * 5000 + " end").encode()
    parts = list(token_counts.segments(text, 256))
    assert b"".join(parts) == text and all(p[:1] == b" " for p in parts[1:]) and len(parts) > 10


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), 1000 + rng.integers(0, 50, n)).astype(np.uint32)
    raw, blocks, patched = token_store.pack_blocks(ids)
    assert (token_store.unpack_blocks(memoryview(raw), n, blocks, patched) == ids).all()
    if n > 600:
        assert (token_store.unpack_blocks(memoryview(raw), n, blocks, patched, 1, 2) == ids[256:512]).all()
        assert len(raw) < 0.5 * ids.nbytes


def test_segment_rejects_other_bytes():
    with pytest.raises(ValueError):
        token_store.read_segment(b"\0" * 64)


ROWS = [(3, "The cat sat.", "x"), (1, None, "y"), (None, "no id", "z"), (2, "", None), (7, "The cat sat.", "w"), (7, "The cat sat.", "w"), (9, "long text " * 20000, "v")]
SCHEMA = "doc_id bigint, text string, id string"


def test_counts_query(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = token_counts.token_counts(docs, WORD).collect()
    want = [(d, len((t or "").encode()), len(ids_of(WORD, t or "")), len(ids_of(WORD, t or "")) > 2048) for d, t, _ in ROWS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), WORD).count() == 0


def test_store_query(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = sorted(map(tuple, token_store.read_store(token_store.write_store(docs, WORD)).collect()), key=lambda r: r[1])
    at = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for (d, text, _), row in zip(order, got, strict=True):
        ids = np.array([*ids_of(WORD, text or ""), 1], "<u4")
        assert row == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.read_store(token_store.write_store(docs.limit(0), WORD)).count() == 0


def test_round_trip_query(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = bpe_codec.round_trip(docs, BYTE).collect()
    want = []
    for d, t, _ in ROWS:
        ids = ids_of(BYTE, t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(docs, BYTE), BYTE)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([(d, t or "") for d, t, _ in ROWS], key=repr)
    assert bpe_codec.round_trip(docs.limit(0), BYTE).count() == 0

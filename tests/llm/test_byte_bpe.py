import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from crosspanel.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "B", " ", "  ", "\n", "\t", " \n", "é", "ab", "1", "22", "'s", "'LL", "<|endoftext|>", "日本", "😀", "!", "-", "\x1c", "\x00", "the", "́", "\x85", "　", " "]


def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def texts(n):
    rng = random.Random(1)
    return ["", " ", "x" * 20_000, "a " * 5000, *("".join(rng.choices(BITS, k=rng.randrange(20))) for _ in range(n))]


def test_ids_equal_those_of_whole_texts():
    encoder, reference, many = byte_bpe.encoder(RANKS), plain(), texts(4000)
    for at in range(0, len(many), 37):
        part = many[at : at + 37]
        for text, ids in zip(part, encoder.encode(pa.array(part))):
            assert ids.tolist() == reference.encode_ordinary(text), text
            assert encoder.decode(ids.tolist()) == text.encode()


def test_small_cache_starts_anew():
    tokenizer, table = byte_bpe.byte_tokenizer(RANKS)
    encoder = byte_bpe.ByteEncoder(RANKS)
    encoder.pieces = byte_bpe.BytePieces(tokenizer, table, limit=5)
    reference = plain()
    for word in "one two three four five six seven eight one two".split():
        text = f"x {word} y{word} {word}"
        assert encoder.encode(pa.array([text]))[0].tolist() == reference.encode_ordinary(text)


def test_offsets_and_split_characters():
    table, reference = byte_bpe.byte_tokenizer(RANKS)[1], plain()
    for text in texts(500):
        ids = np.array(reference.encode_ordinary(text), np.uint32)
        starts, ends = byte_bpe.char_offsets(table, ids)
        raw, at = text.encode(), 0
        for token, a, b in zip(ids.tolist(), starts, ends):
            before, after = at, at + len(table[token])
            assert a == len(raw[:before].decode(errors="ignore")) and b == len(raw[:after].decode(errors="ignore")) + (after < len(raw) and (raw[after] & 0xC0) == 0x80)
            at = after
        assert "".join(byte_bpe.decode_stream(table, ids.tolist())) == text


def test_frames(spark):
    rows = [(1, "a 😀 b", 2, "x"), (None, None, 2, "x"), (1, "a 😀 b", 2, "x"), (3, "  é", 2, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids string")
    got = sorted(map(tuple, byte_bpe.round_trip_digests(df, RANKS).collect()), key=str)
    reference = plain()
    ids = [reference.encode_ordinary(t or "") for _, t, *_ in rows]
    wanted = [(r[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, i in zip(rows, ids)]
    assert got == sorted(wanted, key=str)
    encoded = byte_bpe.encode_documents(df, RANKS, offsets=True)
    assert sorted((bytes(r.data) for r in byte_bpe.decode_documents(encoded, RANKS).collect())) == sorted((t or "").encode() for _, t, *_ in rows)
    assert byte_bpe.round_trip_digests(df.where("false"), RANKS).count() == 0

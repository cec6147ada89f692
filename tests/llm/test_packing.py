import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from crosspanel.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_those_of_whole_texts():
    encoder, rng = packing.WordPieces(PATH, limit=50), random.Random(1)
    bits = ["a", "B", " ", "  ", "\n", "\t", "é", "à", "ab", "1", "22", "'s", "<|endoftext|>", "日本", "😀", "!", "-", ",", ".", "\x1c", " ", "the", "́", "\x85", "\x01", "Σ", "İ", "ǆ", "שׁ"]
    for _ in range(1500):
        texts = ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(5)]
        for text, ids in zip(texts, encoder.encode(pa.array(texts))):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_special_tokens_are_found_in_their_own_case_only():
    encoder, rng = packing.WordPieces(PATH), random.Random(3)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|", "|>", " ", " ", "x", "Y", "É", ".", "Word", "\n", "\x01"]
    texts = ["x <|ENDOFTEXT|> y", "A<|EndOfText|>B.", *("".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(2000))]
    for text, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(6))
def test_histogram_is_packed_whole_and_tightly(seed):
    rng = random.Random(seed)
    histogram = Counter(min(64, int(rng.expovariate(1 / 20)) + 1) for _ in range(3000))
    patterns = packing.pack_histogram(histogram, 64)
    placed = Counter()
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 64 and lengths == sorted(lengths, reverse=True)
        for n in lengths:
            placed[n] += count
    assert placed == histogram
    used = sum(n * k for n, k in histogram.items())
    assert sum(c for c, _ in patterns) * 64 < 1.03 * used + 64
    assert packing.pack_histogram({}, 64) == []


def test_pieces_lie_gapless(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "x1", "é"], k=rng.randrange(90))), 9, "k") for i in range(80)]
    rows += [(None, None, 9, "k"), (200, "", 9, "k"), (1, rows[1][1], 9, "k"), (201, "word " * 3000, 9, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, offset int, length string").repartition(3)
    got = packing.pack_documents(df, PATH, size=64, with_ids=True).collect()
    encoder = packing.word_encoder(PATH)
    wanted = Counter()
    for doc, text, *_ in rows:
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 64):
            part = np.array(ids[at : at + 64], "<u4")
            wanted[doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == wanted
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(df.where("false"), PATH).count() == 0


def shortest_pack_first(histogram, size):
    """One piece after another, longest first, into the pack with most room, or a new one."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            most = max(rooms, default=-1)
            if most >= length:
                rooms.remove(most)
            rooms.append((most if most >= length else size) - length)
    return sorted(rooms)


def test_fills_are_those_of_strict_shortest_pack_first():
    rng = random.Random(9)
    for _ in range(300):
        size = rng.choice([16, 64, 256])
        histogram = {rng.randrange(1, size + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 30))}
        patterns = packing.pack_histogram(histogram, size)
        assert sorted(room for count, lengths in patterns for room in [size - sum(lengths)] * count) == shortest_pack_first(histogram, size)
        ranks = defaultdict(list)
        for length, bucket, first, end, *_ in packing.slots_of(patterns, histogram):
            ranks[length].append((first, end, bucket))
            assert first // packing.width_of(histogram[length]) <= bucket <= (end - 1) // packing.width_of(histogram[length])
        for length, n in histogram.items():  # each rank has one slot
            spans = sorted({r[:2] for r in ranks[length]})
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))

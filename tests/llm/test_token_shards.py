import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from crosspanel.llm import token_shards as t

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5, 64, 100, 1000, 4097])
def test_slots_are_a_permutation(count):
    a, b = (t.permuted(np.arange(count), count, key) for key in (1, 2))
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(count))
    if count >= 64:
        assert (a != b).any() and (a != np.arange(count)).any()


def test_shards_hold_every_sequence_and_resume(spark):
    texts = [None, "", "one", "word " * 3000, "é😀 " * 50, *(f"text {i} of many" for i in range(60))]
    rows = [(i, x, 3, "k") for i, x in enumerate(texts)] + [(None, "null id", 3, "k"), (2, "one", 3, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot int, task string").repartition(3)
    index, path = t.materialise(df, RANKS, length=64, per_shard=16)
    got = index.collect()
    encode = t._encoding(RANKS).encode_ordinary
    wanted = {}
    for i, text, *_ in rows:
        ids = encode(text or "")
        for at in range(0, max(1, len(ids)), 64):
            wanted.setdefault((i, at), []).append(np.array(ids[at : at + 64], "<u2").tobytes())
    assert sorted(r.slot for r in got) == list(range(sum(map(len, wanted.values()))))
    back = {r.slot: bytes(r.ids) for r in t.read_shards(spark, path).collect()}
    assert all(back[r.slot] in wanted[r.doc_id, r.start] and len(back[r.slot]) == 2 * r.length for r in got)
    assert [r.slot for r in t.read_shards(spark, path, 37).collect()] == list(range(37, len(got)))
    folder = t._opened(path)[1]
    sizes = {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".bin")}
    assert sum(sizes.values()) == len(got) * (4 + 2 * 64) and not [n for n in os.listdir(folder) if n.endswith(".tmp")]
    before = {n: os.stat(f"{folder}/{n}").st_mtime_ns for n in sizes}
    lost = f"{folder}/index/first=0/_SUCCESS"
    os.remove(lost)
    again, _ = t.materialise(df, RANKS, path=path, length=64, per_shard=16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got)) if all(r.doc_id is not None for r in got) else again.count() == len(got)
    changed = {n for n in sizes if os.stat(f"{folder}/{n}").st_mtime_ns != before[n]}
    assert changed and changed != set(sizes)
    assert {r.slot: bytes(r.ids) for r in t.read_shards(spark, path).collect()} == back
    for other in ({"length": 32}, {"key": 5}, {"per_shard": 8}):
        with pytest.raises(ValueError, match="was begun with"):
            t.materialise(df, RANKS, path=path, **{"length": 64, "per_shard": 16, **other})
    with pytest.raises(ValueError, match="was begun with"):
        t.materialise(df.where("doc_id <> 3"), RANKS, path=path, length=64, per_shard=16)
    assert t.materialise(df.repartition(5), RANKS, path=path, length=64, per_shard=16)[0].count() == len(got)  # the same rows in another order
    assert t.qualified(spark, "/a/b") == "file:///a/b" and t.qualified(spark, "file:///a") == "file:///a"
    crc = {(r.doc_id, r.start, r.ids_crc32) for r in t.digests(df, RANKS, length=64, per_shard=16).collect()}
    assert crc == {(*k, zlib.crc32(x)) for k, v in wanted.items() for x in v}


def test_no_rows(spark):
    assert t.digests(spark.createDataFrame([], "doc_id bigint, text string"), RANKS).count() == 0

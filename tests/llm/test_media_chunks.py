import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from crosspanel.llm import media_chunks as m


def test_gear_hash_is_the_rolling_sum():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    rolled, h = [], 0
    for b in data.tolist():
        h = ((h << 1) + int(m.GEAR[b])) & 0xFFFFFFFF
        rolled.append(h)
    assert m.gear_hashes(data).tolist() == rolled


def test_cuts_follow_content():
    rng = random.Random(2)
    body = rng.randbytes(60_000)
    a, b = m.chunks_of(body), m.chunks_of(b"inserted" + body)
    assert b"".join(a) == body and all(len(c) <= m.GREATEST for c in a) and all(len(c) >= m.LEAST for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 3
    assert m.chunks_of(b"\xff" * 100_000)[0] == b"\xff" * len(m.chunks_of(b"\xff" * 100_000)[0])


def test_round_trip(spark):
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=9000))
    texts = [None, "", "é😀", "x" * 576, "x" * 577, passage, passage, passage + "tail", "head" + passage + passage, "z" * 400_000]
    rows = [(i, t, b"k", 5) for i, t in enumerate(texts)] + [(None, "null id", b"k", 5), (1, "", b"k", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, payload binary, at int")
    got = m.round_trip(df).collect()
    assert len(got) == len(rows)

    def wanted(doc, text):
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        return doc, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])

    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], key=str) == sorted([wanted(r[0], r[1]) for r in rows], key=str)
    by = {r.doc_id: r for r in got}
    assert by[5].media_sha256 == by[6].media_sha256 != by[7].media_sha256 and by[5].feature == by[6].feature
    form = m.manifest_of(m.chunks_of(m.payload_of(texts[8]))) + m.payload_of(texts[8])
    assert by[8].media_bytes == len(form) and by[8].media_sha256 == hashlib.sha256(form).hexdigest()
    assert m.round_trip(df.where("false")).count() == 0


def test_shared_bytes_are_stored_once_and_damage_is_seen(spark):
    passage = "".join(random.Random(4).choices("abcdefgh ", k=40_000))
    df = spark.createDataFrame([(i, f"{i} " * 300 + passage + f" {i}" * 300) for i in range(8)], "doc_id bigint, text string")
    stored = m.store(df, m.shared_chunks(m.lists(df)))
    assert stored.selectExpr("sum(length(data))").first()[0] < 2 * 45_000
    # What the digests cover is what is stored: a payload's manifest, then its chunks' bytes.
    kept = {(r.kind, bytes(r.id)): r for r in stored.collect()}
    digests = {r.media_sha256 for r in m.read_back(stored).collect()}
    for (kind, _), r in kept.items():
        if kind == "payload":
            at, parts = 0, []
            for i, (digest, length) in enumerate(struct.iter_unpack(m.ENTRY, r.manifest)):
                parts.append(kept["chunk", digest].data if i in r.shared else r.data[at : at + length])
                at += 0 if i in r.shared else length
            assert hashlib.sha256(r.manifest + b"".join(map(bytes, parts))).hexdigest() in digests
    damaged = stored.selectExpr("kind", "id", "manifest", "shared", "CASE WHEN kind = 'chunk' THEN substring(data, 2) ELSE data END AS data")
    with pytest.raises(Exception, match="missing or altered"):
        m.read_back(damaged).collect()

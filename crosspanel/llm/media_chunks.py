"""Media columns as content-defined chunks.

A payload's bytes are cut where a rolling gear hash of the last 32 bytes has its low bits zero, within a least and a
greatest chunk size. Each payload is known by its digest, each chunk by its own. Spark joins find, for each chunk digest
that several places have, one owner; such shared chunks are stored once in a table by digest, and all other bytes
once with their payload. An ordered list of chunks for each payload rebuilds it: payloads without shared chunks from
their own row alone, the others by a join on the digests. Each chunk's digest is verified when it is read back.

What is stored of a payload is its manifest, for each chunk in order its digest (16 bytes) and its length (4 bytes, little-endian), and
the chunks' bytes. ``media_bytes`` and ``media_sha256`` are those of the manifest and then the chunks in its order, both as they were read
back from the store. Payloads are texts as UTF-8 with bytes 255 up to a positive multiple of 576.

Null texts count as empty. Null doc_ids and repeated rows each get a result: payloads go by their digest. Equal texts have
equal values; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT = 576
LEAST, MASK_BITS, GREATEST = 512, 11, 16384
WINDOW = 32
#: One 32-bit number for each byte, from a rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum over the last 32 bytes of their gear numbers, each shifted left by its age: windows double five times."""
    h = GEAR[data]
    for k in range(5):
        width = 1 << k
        older = h[:-width] << np.uint32(width) if width < 32 else 0
        h = h.copy()
        h[width:] += older
    return h


def cuts(payload: bytes, least: int = LEAST, mask_bits: int = MASK_BITS, greatest: int = GREATEST) -> list[int]:
    """Ends of the chunks. A cut follows a byte whose hash has its high bits zero (they depend on the whole window)."""
    data = np.frombuffer(payload, np.uint8)
    places = (np.flatnonzero(gear_hashes(data) >> np.uint32(32 - mask_bits) == 0) + 1).tolist()
    ends, start, i = [], 0, 0
    while start < len(data):
        while i < len(places) and places[i] < start + least:
            i += 1
        end = min(places[i] if i < len(places) else len(data), start + greatest, len(data))
        ends.append(end)
        start = end
    return ends


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


#: An entry of a manifest and its bytes.
ENTRY, ENTRY_BYTES = "<16sI", 20


def manifest_of(chunks: list[bytes]) -> bytes:
    return b"".join(struct.pack(ENTRY, digest_of(c), len(c)) for c in chunks)


def features(payload: bytes, n_chunks: int) -> str:
    """chunks; mean sample in thousandths; shares of 16 sample ranges in thousandths."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    mean = int(counts @ np.arange(256)) * 1000 // len(payload)
    return f"{n_chunks};{mean};" + ",".join(str(int(n) * 1000 // len(payload)) for n in counts.reshape(16, 16).sum(1))


def lists(df: DataFrame) -> DataFrame:
    """(doc_id, payload, n_bytes, digests) for each row: the payload's digest and the ordered list of its chunks."""
    source = common.texts_of(df)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = common.column(batch, "text").to_pylist()
            payloads = [payload_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    common.column(batch, "doc_id"),
                    pa.array([digest_of(p) for p in payloads], pa.binary()),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array([[digest_of(c) for c in chunks_of(p)] for p in payloads], pa.list_(pa.binary())),
                ],
                ["doc_id", "payload", "n_bytes", "digests"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, payload binary, n_bytes bigint, digests array<binary>")


def shared_chunks(listed: DataFrame) -> DataFrame:
    """(payload, shared, owned): which chunks of a payload are stored by digest, and which of these it brings.

    A digest that stands at two places of different payloads or twice in one is shared; its owner is the smallest place. Digests that
    stand at very many places are joined apart.
    """
    distinct = listed.select("payload", "digests").groupBy("payload").agg(F.first("digests").alias("digests"))
    places = common.written(distinct.select("payload", F.posexplode("digests").alias("at", "digest")), "places")
    owners = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("payload", "at")).alias("owner")).where("n > 1").select("digest", "owner")
    joined = common.keyed_join(places, owners, "digest")
    owned = F.when((F.col("owner.payload") == F.col("payload")) & (F.col("owner.at") == F.col("at")), F.col("at"))
    found = common.written(joined.groupBy("payload").agg(F.collect_list("at").alias("shared"), F.collect_list(owned).alias("owned")), "shared")
    common.drop_written(places)
    return found


STORED = "kind string, id binary, manifest binary, shared array<int>, data binary"


def store(df: DataFrame, shared: DataFrame) -> DataFrame:
    """Writes the chunk store and reads it back: rows of kind ``payload`` (manifest, which chunks are shared, own bytes) and ``chunk`` (shared bytes).

    Each distinct payload travels once, compressed; equal ones are dropped before the shuffle where they meet.
    """
    source = common.texts_of(df).select("text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6)
        for batch in common.slices(batches):
            payloads = dict.fromkeys(payload_of(t) for t in common.column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(p) for p in payloads], pa.binary()), pa.array([press.compress(p) for p in payloads], pa.binary())], ["payload", "packed"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in common.slices(batches, "packed", 1 << 20):
            rows = []
            for key, packed, at, owned in zip(*(common.column(batch, n).to_pylist() for n in ("payload", "packed", "shared", "owned"))):
                chunks, at, owned = chunks_of(opener.decompress(packed)), set(at or ()), owned or ()
                rows.append(("payload", key, manifest_of(chunks), sorted(at), b"".join(c for i, c in enumerate(chunks) if i not in at)))
                rows += [("chunk", digest_of(chunks[i]), None, None, chunks[i]) for i in owned]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()))], ["kind", "id", "manifest", "shared", "data"])

    packed = source.mapInArrow(pack, "payload binary, packed binary").groupBy("payload").agg(F.first("packed").alias("packed"))
    return common.written(packed.join(shared, "payload", "left").mapInArrow(split, STORED), "chunks", partition_by="kind")


READ = "payload binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of each payload, rebuilt from its list; raises where a chunk is missing or altered."""
    payloads, chunks = stored.where("kind = 'payload'"), stored.where("kind = 'chunk'").select(F.col("id").alias("digest"), F.col("data").alias("bytes"))
    parts = [F.col(c) for c in ("id", "manifest", "shared", "data")]
    alone = payloads.where(F.size("shared") == 0).select(*parts, F.lit(None).cast("array<struct<digest:binary,bytes:binary>>").alias("brought"), F.length("data").cast("bigint").alias("size"))
    needing = payloads.where(F.size("shared") > 0)
    digests = F.array_distinct(F.transform("shared", lambda at: F.substring(F.col("manifest"), at * ENTRY_BYTES + 1, F.lit(16))))
    wanted = common.written(needing.select("id", F.explode(digests).alias("digest")), "wanted")
    brought = common.keyed_join(wanted, chunks, "digest").groupBy("id").agg(F.collect_list(F.struct("digest", "bytes")).alias("brought"), F.sum(F.length("bytes")).alias("brings"))
    whole = alone.unionByName(needing.select(*parts).join(brought, "id", "left").select(*parts, "brought", (F.length("data") + F.coalesce("brings", F.lit(0))).alias("size")))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "size", 1 << 20):
            rows = []
            for key, manifest, shared, data, brought in zip(*(common.column(batch, n).to_pylist() for n in ("id", "manifest", "shared", "data", "brought"))):
                at, by_digest, parts, shared = 0, {b["digest"]: b["bytes"] for b in brought or ()}, [], set(shared)
                for i, (digest, length) in enumerate(struct.iter_unpack(ENTRY, manifest)):
                    if i in shared:
                        part = by_digest.get(digest, b"")
                    else:
                        part = data[at : at + length]
                        at += length
                    if len(part) != length or digest_of(part) != digest:
                        raise ValueError(f"chunk {digest.hex()} is missing or altered")
                    parts.append(part)
                payload = b"".join(parts)
                if digest_of(payload) != key:
                    raise ValueError(f"payload {key.hex()} was not rebuilt")
                form = hashlib.sha256(manifest)
                form.update(payload)
                rows.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(manifest) + len(payload), form.hexdigest(), features(payload, len(parts))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], [f.split()[0] for f in READ.split(", ")])

    return whole.mapInArrow(rebuild, READ)


def round_trip(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) for each row. The store's tables are dropped."""
    common.without_shuffle_files(df.sparkSession)
    listed = common.written(lists(df), "lists")
    shared = shared_chunks(listed)
    stored = store(df, shared)
    back = common.written(read_back(stored), "media")
    common.drop_written(shared, stored)  # all that the result reads is written
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return common.keyed_join(listed.select("doc_id", "payload", "n_bytes"), back, "payload").select("doc_id", "n_bytes", *names)

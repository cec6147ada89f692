"""Training-order materialisation of token ids as fixed-stride binary shards.

Each document's ids are cut into sequences, which are written to the shared folder first: task and place within it number
all sequences without gaps. A keyed Feistel network over the least power of two that holds all numbers, walked until it falls
below their count, is a permutation: it gives each sequence its global slot. Slot ranges are shards. Each shard is one task's
file of records with one stride (4 bytes length, then ids, little-endian, the rest zeros), so a reader takes them in order and
seeks to any slot. Shards are written in a fixed number of rounds, under a temporary name and then renamed: a lost task is
repeated, and a stopped run goes on where shards are missing. The parameters and a digest of the input (ids and texts, in any order) are kept
beside them: a call with others for the same path is refused.

Null texts count as empty; a document without ids has one sequence of length 0. Null doc_ids and repeated rows have sequences of
their own; an empty table gives no shards and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .byte_bpe import read_ranks

LENGTH, PER_SHARD, ROUNDS, KEY = 512, 16_384, 4, 20260101
HEADER = 4
#: Rows of 12 bytes that are broadcast at most.
BASES = 500_000


def permuted(index: np.ndarray, count: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each number below ``count``: a bijection of range(count) for each key."""
    if count <= 1:
        return index.astype(np.int64)
    bits = (count - 1).bit_length()
    low_bits = bits // 2
    high_bits = bits - low_bits
    low_mask, high_mask = np.uint64((1 << low_bits) - 1), np.uint64((1 << high_bits) - 1)

    def mixed(half: np.ndarray, number: int) -> np.ndarray:
        z = half + np.uint64(((key + number) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    def network(x: np.ndarray) -> np.ndarray:
        high, low = x >> np.uint64(low_bits), x & low_mask
        for r in range(rounds):  # one half changes by a number from the other: each step can be undone
            if r % 2:
                low = low ^ (mixed(high, r) & low_mask)
            else:
                high = high ^ (mixed(low, r) & high_mask)
        return high << np.uint64(low_bits) | low

    out = network(index.astype(np.uint64))
    while (beyond := np.flatnonzero(out >= np.uint64(count))).size:
        out[beyond] = network(out[beyond])
    return out.astype(np.int64)


@cache
def _encoding(ranks_path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


def sequences(df: DataFrame, ranks_path: str, length: int = LENGTH) -> DataFrame:
    """(task, place, doc_id, start, length, ids binary, digest) for each sequence of at most ``length`` ids; the digest is the whole text's."""
    source = text_digests(df)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, task, place = _encoding(ranks_path), TaskContext.get().partitionId(), 0
        item = 2 if encoding.max_token_value < 1 << 16 else 4
        for batch in common.slices(batches):
            whose, starts, sizes, data = [], [], [], []
            for doc, text in enumerate(common.column(batch, "text").to_pylist()):
                ids = encoding.encode_to_numpy(text, disallowed_special=()).astype(f"<u{item}").tobytes()
                for at in range(0, max(len(ids), 1), length * item):
                    part = ids[at : at + length * item]
                    whose.append(doc)
                    starts.append(at // item)
                    sizes.append(len(part) // item)
                    data.append(part)
            n = len(whose)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(place, place + n)), common.column(batch, "doc_id").take(pa.array(whose)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary()), common.column(batch, "digest").take(pa.array(whose))],
                ["task", "place", "doc_id", "start", "length", "ids", "digest"],
            )
            place += n

    return source.mapInArrow(run, f"task int, place bigint, doc_id {kind}, start bigint, length bigint, ids binary, digest bigint")


def input_digest(rows: DataFrame) -> list[str]:
    """Number and sum of hashes of (doc_id, digest)."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)"))).first()
    return [str(n), str(total)]


def text_digests(df: DataFrame) -> DataFrame:
    """(doc_id, text, digest) for each row."""
    return common.texts_of(df).withColumn("digest", F.xxhash64("text"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it: one without goes to Hadoop's default file system, as Spark's own tables do."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString().rstrip("/")
    return f"file://{found[5:]}" if found.startswith("file:/") and not found.startswith("file://") else found


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder with a scheme; one that Arrow does not know raises."""
    return pafs.FileSystem.from_uri(path)


def shard_name(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:08d}.bin"


def write_shards(numbered: DataFrame, path: str, shards: range, count: int, stride: int, per_shard: int) -> DataFrame:
    """Writes the shards of a slot range; returns (slot, doc_id, start, length) for each record. ``numbered`` has slots."""
    kind = numbered.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = _opened(path)
        shard, stream, temporary, expected = None, None, None, 0

        def finish() -> None:
            stream.close()
            if expected != min(count, (shard + 1) * per_shard):
                raise ValueError(f"shard {shard} ends before slot {expected}")
            filesystem.move(temporary, shard_name(folder, shard))

        for batch in batches:
            slots = common.column(batch, "slot").to_numpy()
            for slot, ids in zip(slots.tolist(), common.column(batch, "ids")):
                if slot // per_shard != shard:
                    if stream:
                        finish()
                    shard, expected = slot // per_shard, slot // per_shard * per_shard
                    temporary = f"{shard_name(folder, shard)}.{TaskContext.get().taskAttemptId()}.tmp"
                    stream = filesystem.open_output_stream(temporary)
                if slot != expected:
                    raise ValueError(f"slot {slot} where {expected} is due")
                data = ids.as_py()
                stream.write((len(data).to_bytes(HEADER, "little") + data).ljust(stride, b"\0"))
                expected += 1
            yield batch.select(["slot", "doc_id", "start", "length"])
        if stream:
            finish()

    part = numbered.where(F.col("slot").between(shards.start * per_shard, shards.stop * per_shard - 1))
    dealt = part.repartitionById(len(shards), (F.col("slot") / per_shard).cast("int") - shards.start).sortWithinPartitions("slot")
    return dealt.mapInArrow(run, f"slot bigint, doc_id {kind}, start bigint, length bigint")


def read_shards(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """(slot, ids binary) of all records from ``first_slot`` on, shard by shard in order."""
    path = qualified(spark, path)
    filesystem, folder = _opened(path)
    with filesystem.open_input_stream(f"{folder}/manifest.json") as file:
        about = json.loads(file.read())
    stride, per_shard, count = about["stride"], about["per_shard"], about["count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = _opened(path)
        for batch in batches:
            for shard in common.column(batch, "shard").to_pylist():
                begin, end = max(first_slot, shard * per_shard), min(count, (shard + 1) * per_shard)
                with filesystem.open_input_file(shard_name(folder, shard)) as file:
                    file.seek((begin - shard * per_shard) * stride)
                    for at in range(begin, end, 1024):
                        n = min(1024, end - at)
                        block = file.read(n * stride)
                        rows = [block[k : k + stride] for k in range(0, n * stride, stride)]
                        ids = [r[HEADER : HEADER + int.from_bytes(r[:HEADER], "little")] for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.array(ids, pa.binary())], ["slot", "ids"])

    first = min(first_slot // per_shard, about["shards"])
    names = spark.range(first, about["shards"], 1, max(1, about["shards"] - first)).select(F.col("id").alias("shard"))
    return names.mapInArrow(run, "slot bigint, ids binary")


def materialise(df: DataFrame, ranks_path: str, path: str | None = None, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD, rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """Writes shards, a manifest and an index below ``path``; returns the index (slot, doc_id, start, length) and the path.

    A second call with the same path writes only what the first did not finish; with other parameters or another input it raises.
    """
    spark = df.sparkSession
    common.without_shuffle_files(spark)
    path = qualified(spark, path or common.fresh_path(spark, "tokens"))
    filesystem, folder = _opened(path)
    filesystem.create_dir(folder)
    there = lambda name: filesystem.get_file_info(f"{folder}/{name}").type != pafs.FileType.NotFound
    item = 2 if _encoding(ranks_path).max_token_value < 1 << 16 else 4
    stride = HEADER + length * item
    asked = {"length": length, "per_shard": per_shard, "rounds": rounds, "key": key, "id_bytes": item, "stride": stride, "ranks": hashlib.sha256(Path(ranks_path).read_bytes()).hexdigest()}

    def keep(name: str, about: dict) -> None:
        with filesystem.open_output_stream(f"{folder}/{name}.tmp") as file:
            file.write(json.dumps(about).encode())
        filesystem.move(f"{folder}/{name}.tmp", f"{folder}/{name}")

    def must_be(name: str, about: dict) -> None:
        with filesystem.open_input_stream(f"{folder}/{name}") as file:
            if (found := json.loads(file.read())) != about:
                raise ValueError(f"{path} was begun with {found}, not {about}")

    if there("asked.json"):
        must_be("asked.json", asked)
    else:
        keep("asked.json", asked)
    made = sequences(df, ranks_path, length)
    if there("input.json"):
        must_be("input.json", {"input": input_digest(text_digests(df))})
    else:
        made.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/sequences")
        keep("input.json", {"input": input_digest(spark.read.schema(made.schema).parquet(f"{path}/sequences").where("start = 0"))})
    stored = spark.read.schema(made.schema).parquet(f"{path}/sequences").drop("digest")
    # One row for each write task (128 MB of input or more: under a million at 100 TB), so one task can number them; they are broadcast up to BASES rows.
    sizes = stored.groupBy("task").agg(F.count("*").alias("n"))
    bases = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    tasks, count = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = -(-count // per_shard)

    @F.pandas_udf("bigint")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), count, key))

    slot = slot_of.asNondeterministic()(F.col("base") + F.col("place"))  # else a filter on slots would compute them twice
    numbered = stored.join(F.broadcast(bases) if tasks <= BASES else bases, "task").select(slot.alias("slot"), "doc_id", "start", "length", "ids")
    step = max(1, -(-shards // rounds))
    for first in range(0, shards, step):
        part = range(first, min(first + step, shards))
        if not there(f"index/first={first}/_SUCCESS"):
            write_shards(numbered, path, part, count, stride, per_shard).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/index/first={first}")
    keep("manifest.json", {"count": count, "stride": stride, "per_shard": per_shard, "shards": shards, "length": length, "id_bytes": item, "key": key})
    schema = numbered.select("slot", "doc_id", "start", "length").schema
    return (spark.read.schema(schema).parquet(*(f"{path}/index/first={first}" for first in range(0, shards, step))) if shards else spark.createDataFrame([], schema)), path


def digests(df: DataFrame, ranks_path: str, **parameters) -> DataFrame:
    """(doc_id, start, length, slot, shard, record, ids_crc32) for each sequence; the ids are read back from the shards."""
    per_shard = parameters.get("per_shard", PER_SHARD)
    index, path = materialise(df, ranks_path, **parameters)
    back = read_shards(df.sparkSession, path).select("slot", F.crc32("ids").alias("ids_crc32"))
    shard = F.floor(F.col("slot") / per_shard)
    # Sizes of what Python reads are guesses to the planner: without the hint it would broadcast all records.
    return index.join(back.hint("merge"), "slot").select("doc_id", "start", "length", "slot", shard.alias("shard"), (F.col("slot") - shard * per_shard).alias("record"), "ids_crc32")

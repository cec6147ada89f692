"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: lower-case A-Z, words between ASCII white space, 3-word shingles with repeats (all words where
there are fewer), XXH64 with seed 42 of each; a bit is 1 if more than half of the hashes set it.
Two fingerprints that differ in at most 3 of 64 bits agree in at least 2 of 5 bands, so all links lie within
the 10 tables of band pairs. In a table's bucket, fingerprints stand as 64 vertical bit planes; for each
shift the planes are compared with themselves, differences go into carry-save counters for all lanes at
once, and a block of lanes is left as soon as each has more than 3. A bucket keeps links of a spanning forest
only. Buckets beyond ``BLOCK`` fingerprints are dealt into blocks by hash, and each pair of blocks is a task row.
Components: rounds of large-star and small-star joins, each written to the shared folder.

Texts without words, empty ones and null ones have fingerprint 0 and link like any other. Null doc_ids are kept; a
component's id is the smallest doc_id that is not null. Repeated rows are returned as often as they come; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

RADIUS, BITS = 3, 64
#: Widths of the five bands; two of them agree wherever at most three bits differ.
BANDS = (13, 13, 13, 13, 12)
#: Fingerprints in a block of a large bucket.
BLOCK = 4096
#: Lanes compared at once, and fingerprints (of one row at least) whose planes are made at once: 64 bytes each while they are unpacked.
LANES, FINGERPRINTS = 1 << 13, 1 << 16


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """The fingerprint as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(joined))
    width = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def row_key(doc_id: Column, text: Column) -> Column:
    """Stands for id and text; null and empty texts are alike."""
    return F.unhex(F.sha2(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull().cast("string"), F.coalesce(text, F.lit(""))), 256))


def fingerprints(df: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp bigint[, key]) for each row; the 64 bits are those of the signed number, the key stands for id and text."""
    source = common.texts_of(df)
    if keyed:
        source = source.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = common.column(batch, "text")
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            arrays, names = [common.column(batch, "doc_id"), pa.array(found)], ["doc_id", "fp"]
            if keyed:
                arrays, names = [*arrays, common.column(batch, "key")], [*names, "key"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, f"doc_id {kind}, fp bigint" + ", key binary" * keyed)


def band_keys(fp: Column) -> Column:
    """An array of numbers, one for each of the ten band pairs: pair and bits of both bands."""
    parts, at = [], 0
    for width in BANDS:
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    pairs = combinations(range(len(BANDS)), 2)
    return F.array(*(F.lit(i << 26).cast("bigint") + F.shiftleft(parts[a], 13).bitwiseOR(parts[b]) for i, (a, b) in enumerate(pairs)))


def buckets(distinct: DataFrame) -> DataFrame:
    """Rows (left, right, n) of fingerprint arrays to compare and how many there are; right null: left with itself. ``distinct`` is a written table."""
    keyed = distinct.select("fp", F.explode(band_keys(F.col("fp"))).alias("bucket"))
    # Counts ignore how a bucket is dealt later, so blocks are known before fingerprints are gathered.
    sized = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    dealt = common.keyed_join(keyed, sized, "bucket").withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp", "bucket"), F.col("blocks")).cast("int"))
    rows = dealt.groupBy("bucket", "blocks", "block").agg(F.collect_list("fp").alias("fps"))
    alone = rows.where("blocks = 1").select(F.col("fps").alias("left"), F.lit(None).cast("array<bigint>").alias("right"))
    many = rows.where("blocks > 1")
    # Each block meets the blocks from its own number on: one copy for each pair, side 0 the smaller number.
    copies = many.select("bucket", "block", "fps", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.col("block").alias("own"), "fps"
    )
    paired = copies.groupBy("bucket", "a", "b").agg(F.max(F.when(F.col("own") == F.col("a"), F.col("fps"))).alias("left"), F.max(F.when((F.col("own") == F.col("b")) & (F.col("a") != F.col("b")), F.col("fps"))).alias("right"))
    return alone.unionByName(paired.select("left", "right")).withColumn("n", (F.size("left") + F.coalesce(F.size("right"), F.lit(0))).cast("bigint"))


class Planes:
    """64 bit planes of a row of fingerprints, eight lanes a byte, for each of the eight places within a byte to begin at."""

    def __init__(self, fps: np.ndarray):
        bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
        self.begun = [np.packbits(bits[:, o:], axis=1, bitorder="little") for o in range(8)]

    def lanes(self, start: int, n: int) -> np.ndarray:
        """The planes of n lanes (more, to a whole byte) from ``start`` on."""
        return self.begun[start % 8][:, start // 8 : start // 8 + -(-n // 8)]


def within_radius(left: np.ndarray, right: np.ndarray, out: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places of lanes where two rows of planes differ in at most ``radius`` (3 or less) bits; ``out``: lanes that do not count.

    The planes' differences are added into ones and twos with a carry out of them; a lane beyond 3 keeps that carry. A
    block whose lanes have all gone beyond is left before the other planes are read.
    """
    found = []
    valid = np.packbits(~out, bitorder="little")
    width = min(left.shape[1], right.shape[1], len(valid))
    for at in range(0, width, LANES // 8):
        x, y = left[:, at : at + LANES // 8], right[:, at : at + LANES // 8]
        beyond = ~valid[at : min(at + LANES // 8, width)]
        x, y = x[:, : len(beyond)], y[:, : len(beyond)]
        ones, twos = np.zeros_like(beyond), np.zeros_like(beyond)
        for k in range(BITS):
            plane = x[k] ^ y[k]
            carry = ones & plane
            ones ^= plane
            beyond |= twos & carry
            twos ^= carry
            if k % 4 == 3 and k > 8 and (beyond == 255).all():
                break
        else:
            over = [beyond, beyond | (twos & ones), beyond | twos, beyond | twos | ones][RADIUS - radius]
            found.append(at * 8 + np.flatnonzero(~np.unpackbits(over, bitorder="little").astype(bool)))
    return np.concatenate([np.zeros(0, np.int64), *found])


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while (found != (up := self.parent[found])).any():
            found = up
        self.parent[at] = found
        return found

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins pairs; returns the places of pairs that joined two trees."""
        made = []
        places = np.arange(len(a))
        while len(places):
            ra, rb = self.roots(a[places]), self.roots(b[places])
            apart = ra != rb
            places, low, high = places[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            _, first = np.unique(high, return_index=True)  # each tree is hung up once a round
            self.parent[high[first]] = low[first]
            made.append(places[first])
        return np.concatenate([np.zeros(0, np.int64), *made])


def compare_buckets(lefts: list[np.ndarray], rights: list[np.ndarray | None], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a spanning forest of each bucket."""
    out_a, out_b = [], []
    cross = [(x, y) for x, y in zip(lefts, rights) if y is not None]
    own = sorted((x for x, y in zip(lefts, rights) if y is None), key=len, reverse=True)
    if own:
        fps, sizes = np.concatenate(own), np.array([len(x) for x in own])
        rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(fps))  # places to the bucket's end
        forest, planes = Forest(len(fps)), Planes(fps)
        for shift in range(1, int(sizes[0])):
            # Buckets stand from large to small: those with a partner at this shift come first.
            n = int(sizes[: np.searchsorted(-sizes, -shift)].sum()) - shift
            near = within_radius(planes.lanes(0, n), planes.lanes(shift, n), rest[:n] <= shift, radius)
            made = near[forest.union(near, near + shift)]
            out_a.append(fps[made])
            out_b.append(fps[made + shift])
    for x, y in cross:
        forest, both = Forest(len(x) + len(y)), np.concatenate([x, y])
        around = np.arange(len(x) + len(y)) % len(y)
        still, moved, out = Planes(x), Planes(y[around]), np.zeros(len(x), bool)
        for shift in range(len(y)):
            turned = around[shift : shift + len(x)]
            near = within_radius(still.lanes(0, len(x)), moved.lanes(shift, len(x)), out, radius)
            made = near[forest.union(near, len(x) + turned[near])]
            out_a.append(x[made])
            out_b.append(both[len(x) + turned[made]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def links(pairs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between different fingerprints, a < b."""

    def arrays(values: pa.Array) -> list[np.ndarray | None]:
        flat, offsets = values.values.to_numpy().view(np.uint64), values.offsets.to_numpy()
        return [flat[offsets[i] : offsets[i + 1]] if values[i].is_valid else None for i in range(len(values))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "n", FINGERPRINTS):
            a, b = compare_buckets(arrays(common.column(batch, "left")), arrays(common.column(batch, "right")), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    found = pairs.mapInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component with a link, by alternating large and small stars.

    Each round is written to the shared folder. A round's change is told by a count and a sum of hashes.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        joined = common.keyed_join(both, low, "a")  # a hub holds all links of its component
        if large:
            out = joined.where("b > a").select(F.col("low").alias("a"), F.col("b").alias("b"))
        else:
            out = joined.select(F.col("low").alias("a"), F.col("b").alias("b")).unionByName(low.select(F.col("low").alias("a"), F.col("a").alias("b")))
        return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    seen = None
    for number in range(rounds):
        large = common.written(stars(edges, True), "large-stars")
        before, edges = edges, common.written(stars(large, False), "stars")
        common.drop_written(large, *([before] if number else []))
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    found._crosspanel_path = edges._crosspanel_path
    return found


def near_duplicates(df: DataFrame, radius: int = RADIUS, keyed: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp[, root, key]) for each row."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the bands hold for at most 3 differing bits")
    common.without_shuffle_files(df.sparkSession)
    marked = common.written(fingerprints(df, keyed), "fingerprints")
    distinct = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    linked = common.written(links(buckets(distinct.select("fp")), radius), "links")
    roots = components(linked)
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    more = ["root", "key"] if keyed else []
    named = common.written(classes.join(smallest, "root").select("fp", "component_id", *more[:1]), "named")
    common.drop_written(distinct, linked, roots)
    return common.keyed_join(marked, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp", *more)


def keep_one(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component one row stays, the first by doc_id (null ones last), fingerprint, text.

    What stays is decided on ids and digests; texts are shuffled once. A doc_id that is repeated in several components stays in each of them;
    of rows with equal id and text the first by the other columns stays.
    """
    found = near_duplicates(df, radius, keyed=True)
    texts = found.groupBy("root", "doc_id", "fingerprint").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fingerprint", "key", "last")).alias("m"))
    first = common.written(first.select("root", "m.*"), "first")
    best = first.where("key = last").select(F.col("key").alias("_key"))
    keyed = df.withColumn("_key", row_key(F.col("doc_id"), F.col("text")))
    if not first.where("key <> last").isEmpty():  # one id has several texts with one fingerprint
        open_ = first.where("key <> last").select(F.col("root").alias("_root"), F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_fingerprint"))
        keys = found.join(open_, (found["root"] == open_["_root"]) & found["doc_id"].eqNullSafe(open_["_id"]) & (found["fingerprint"] == open_["_fingerprint"])).select("_root", F.col("key").alias("_key")).distinct()
        least = keyed.select("_key", "text").join(keys, "_key").groupBy("_root").agg(F.min(F.struct("text", "_key")).alias("m"))
        best = best.unionByName(least.select("m._key"))
    best = common.written(best, "best")
    kept = keyed.join(best, "_key", "left_semi")
    # Rows of one key lie together already; which of them comes first needs their other columns only.
    order = Window.partitionBy("_key").orderBy(*(F.col(f"`{c}`") for c in df.columns if c not in ("doc_id", "text")), F.lit(0))
    return kept.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(*(F.col(f"`{c}`") for c in df.columns))



"""Sequence packing: shortest pack first over the histogram of lengths.

Each document's ids (word BPE of the whole text, then an end id) are cut into full pieces and a rest. The
histogram of piece lengths, whose size the sequence length bounds, is packed on the driver: lengths go from
the longest to the shortest, each piece into the pack that is shortest so far and still has room, with counts of
equal packs (patterns) moved together. A piece's rank among the pieces of its length then says which
copy of which pattern it belongs to. Ranks come from counts for each write task and length, so no length,
however common, is ranked in one task.

Null texts count as empty and give one piece with the end id. Null doc_ids and repeated rows each get their
own pieces; an empty table gives no rows; other columns are not read. Ties (equal lengths) go by rank.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from . import common
from .byte_bpe import PieceCache

#: Stands between words in a string given to the library; words that hold it are encoded by themselves.
MARK = "\x01"
JOINED = 256
#: How the library's special tokens begin.
SPECIAL = "<|"

#: Letters below this keep their number and kind when normalized and lower-cased.
PLAIN_BELOW = "\u0130"
CLOSING = ",.|;:!?)"


def one_run(piece: str) -> bool:
    """Whether the library surely sees one run of letters in the piece."""
    return piece.isalpha() and (piece.isascii() or max(piece) < PLAIN_BELOW)


class WordPieces(PieceCache):
    """Pieces between ASCII white space, which no token of the word BPE crosses; a closing sign after letters is a piece too."""

    def __init__(self, path: str, limit: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        super().__init__(limit)

    def _joined(self, pieces: list[str], between: str) -> np.ndarray:
        joined = [between.join([*pieces[i : i + JOINED], ""]) for i in range(0, len(pieces), JOINED)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(e.ids, np.uint32) for e in found)])

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters go in one string and part at word ends; other pieces have marks between, or go alone where they hold one."""
        order = sorted(range(len(pieces)), key=lambda i: (MARK in pieces[i]) * 2 or not one_run(pieces[i]))
        kinds = np.array([(MARK in pieces[i]) * 2 or not one_run(pieces[i]) for i in order], int)
        runs, others, alone = ([pieces[order[i]] for i in np.flatnonzero(kinds == k)] for k in range(3))
        if len(self.mark) != 1:
            others, alone = [], others + alone
        ids = [self._joined(runs, " ")]
        counts = [np.diff(np.flatnonzero(self.closes[ids[0]]), prepend=-1)]
        with_marks = self._joined(others, f" {MARK} ")
        marks = np.flatnonzero(with_marks == self.mark[0])
        ids.append(with_marks[with_marks != self.mark[0]])
        counts.append(np.diff(marks, prepend=-1) - 1)
        for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False) if alone else []:
            ids.append(np.asarray(e.ids, np.uint32))
            counts.append(np.array([len(e.ids)]))
        lengths = np.concatenate(counts)
        assert [len(c) for c in counts[:2]] == [len(runs), len(others)], "pieces and what the library found differ"
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        flat, ends = np.concatenate(ids), np.cumsum(lengths)
        picked = lengths[back]
        at = np.repeat((ends - lengths)[back] - (np.cumsum(picked) - picked), picked) + np.arange(int(picked.sum()))
        return flat[at], picked

    def clear(self) -> None:
        super().clear()
        self.row: dict[str, int] = {}
        self.pairs = np.zeros((1 << 14, 2), np.int64)

    def pairs_of(self, words: list[str]) -> np.ndarray:
        """The slots of each distinct word: its letters and its closing sign, or all of it and nothing."""
        if len(self.slot) > self.limit:
            self.clear()
        rows = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(rows < 0)):
            names = [words[i] for i in new.tolist()]
            parts = [part for w in names for part in ((w[:-1], w[-1]) if w and w[-1] in CLOSING and one_run(w[:-1]) else (w, ""))]
            if fresh := [p for p in dict.fromkeys(parts) if p not in self.slot]:
                self._add(fresh)
            n = len(self.row)
            while n + len(new) > len(self.pairs):
                self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
            self.pairs[n : n + len(new)] = np.fromiter(map(self.slot.__getitem__, parts), np.int64, len(parts)).reshape(-1, 2)
            self.row.update(zip(names, range(n, n + len(new))))
            rows[new] = np.arange(n, n + len(new))
        return self.pairs[rows]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        spaced = common.plain_strings(texts)
        for sign in "\n\t\r":
            spaced = pc.replace_substring(spaced, sign, " ")
        lists = pc.split_pattern(spaced, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        # Lower-cased there are fewer words; the library looks for its special tokens in the text as it stands, so words that may hold one stay too.
        plain = lists.flatten()
        lower = pc.ascii_lower(plain)
        if pc.any(special := pc.match_substring(plain, SPECIAL)).as_py():
            lower = pc.if_else(special, plain, lower)
        coded = lower.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        pairs = self.pairs_of(words)
        ids, counts = self.gather(pairs[coded.indices.to_numpy(zero_copy_only=False)].ravel())
        ends = np.concatenate([[0], np.cumsum(counts)])[offsets * 2]
        return [ids[ends[i] : ends[i + 1]] for i in range(len(texts))]


@cache
def word_encoder(path: str) -> WordPieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    return WordPieces(path)


PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, local_rank bigint"


def cut_documents(df: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and its rank in its task and length[, ids]."""
    source = common.texts_of(df)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, task = word_encoder(tokenizer_path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in common.slices(batches, limit=4 << 20):
            rows, whose, held = [], [], []
            for doc, ids in enumerate(enc.encode(common.column(batch, "text"))):
                data = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(data), size):
                    part = data[start : start + size]
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(data), task, seen[len(part)]))
                    seen[len(part)] += 1
                    whose.append(doc)
                    held.append(part.astype(np.int32))
            columns = np.array(rows, np.int64).T
            arrays = [common.column(batch, "doc_id").take(pa.array(whose))] + [pa.array(c) for c in columns[:4]] + [pa.array(columns[4], pa.int32()), pa.array(columns[5])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "local_rank"]
            if with_ids:
                arrays, names = [*arrays, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        enc.clear()
        common.give_back()

    return source.mapInArrow(run, f"doc_id {kind}, {PIECE}" + ", ids array<int>" * with_ids)


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) patterns for a histogram {length: count}: each piece, longest first, goes to the shortest pack that has room.

    Packs of one room are alike, so a group of them takes one piece each before the next shorter room is due, and goes to its new room at
    once. A length splits one group and opens two at most: there are at most three patterns for each length.
    """
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by room left; a pack is (length, rest of it)
    rooms: list[int] = []  # heap of rooms, largest first

    def put(room: int, count: int, pack: tuple) -> None:
        if not open_packs[room]:
            heapq.heappush(rooms, -room)
        open_packs[room].append((count, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            count, pack = open_packs[room].pop()
            if not open_packs[room]:
                heapq.heappop(rooms)
            used = min(count, left)
            left -= used
            if count > used:
                put(room, count - used, pack)
            put(room - length, used, (length, pack))
        each = size // length  # a new pack stays the shortest until it has no room for another of this length
        for count, k in ((left // each, each), (1, left % each)):
            if count and k:
                pack: tuple = ()
                for _ in range(k):
                    pack = (length, pack)
                put(size - k * length, count, pack)
    out = []
    for packs in open_packs.values():
        for count, pack in packs:
            lengths = []
            while pack:
                lengths.append(pack[0])
                pack = pack[1]
            out.append((count, lengths[::-1]))
    return sorted(out, key=lambda p: (p[1], p[0]))


#: Ranks of a length fall into at most so many buckets, so that a piece meets the slots of its bucket only.
BUCKETS = 64


def width_of(count: int) -> int:
    return -(-count // BUCKETS)


def slots_of(patterns: list[tuple[int, list[int]]], histogram: dict[int, int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, bucket, first rank, end rank, first sequence, offset, repeat) for each length in each pattern, once for each bucket its ranks reach.

    A pattern's lengths add up to the sequence length s at most, so fewer than sqrt(2 s) of them differ; with 3 s patterns at most there
    are fewer than 3 s sqrt(2 s) + 64 s rows (0.52 million for 2048), whatever the data.
    """
    out, next_rank, sequence = [], defaultdict(int), 0
    for count, lengths in patterns:
        at = 0
        for length, same in groupby(lengths):
            repeat = len(list(same))
            first, end = next_rank[length], next_rank[length] + count * repeat
            width = width_of(histogram[length])
            out += [(length, bucket, first, end, sequence, at, repeat) for bucket in range(first // width, (end - 1) // width + 1)]
            next_rank[length] = end
            at += length * repeat
        sequence += count
    return out


SLOT = T.StructType([T.StructField(n, T.LongType(), False) for n in ("length", "bucket", "rank_from", "rank_to", "sequence_from", "offset_from", "repeat")])


def assign(pieces: DataFrame, size: int) -> DataFrame:
    """sequence_id and offset for written pieces: the patterns' slots, whose number the sequence length bounds, joined by length and rank."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("length")
    width = F.ceil(F.sum("n").over(whole) / BUCKETS)
    ranks = by_task.select("length", "task", (F.sum("n").over(whole.orderBy("task")) - F.col("n")).alias("rank_base"), width.alias("width"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    rows = slots_of(pack_histogram(histogram, size), histogram)
    assert len(rows) < 3 * size * (2 * size) ** 0.5 + BUCKETS * size
    slots = F.broadcast(spark.createDataFrame(rows, SLOT))
    ranked = pieces.join(ranks, ["length", "task"]).withColumn("rank", F.col("rank_base") + F.col("local_rank")).withColumn("bucket", F.floor(F.col("rank") / F.col("width")))
    found = ranked.join(slots, ["length", "bucket"]).where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    place = F.col("rank") - F.col("rank_from")
    found = found.withColumns({"sequence_id": F.col("sequence_from") + F.floor(place / F.col("repeat")), "offset": F.col("offset_from") + place % F.col("repeat") * F.col("length")})
    return found.drop("task", "local_rank", "rank_base", "rank", "width", *(f.name for f in SLOT if f.name != "length"))


def pack_documents(df: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    The pieces are written to the shared folder first, so that ranks stay the same when an executor is lost.
    """
    common.without_shuffle_files(df.sparkSession)
    pieces = common.written(cut_documents(df, tokenizer_path, size, end_id, with_ids), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return assign(pieces, size).select(*names)

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary comes as ranks of byte strings. Each byte maps to a printable character, so that the
library's BPE model works on text; merges follow from the ranks. Texts are cut at ASCII spaces that a
word follows, where no match of the pattern can cross, and each distinct piece is encoded once per
batch (or found in a bounded cache of the worker). Texts in which a space meets other white space are
encoded whole. Decoding reverses the byte table; characters that tokens split are joined again.

Null texts count as empty and give no ids. Null doc_ids and repeated rows pass through unchanged, an empty
table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from . import common

#: Distinct pieces that a worker keeps; beyond that it starts anew.
CACHE_PIECES = 250_000
#: Pieces in one string given to the library.
JOINED = 512


@cache
def byte_chars() -> tuple[str, ...]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return tuple(chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merges_from(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each longer token, in rank order, the two parts that the earlier merges leave of it."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [ranks.get(parts[i] + parts[i + 1], rank) for i in range(len(parts) - 1)]
            best = min(joined)
            if best >= rank:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def mapped(token: bytes) -> str:
    return "".join(byte_chars()[b] for b in token)


@cache
def byte_tokenizer(ranks_path: str) -> tuple[Tokenizer, list[bytes]]:
    """The library's tokenizer and each id's bytes, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    ranks = read_ranks(ranks_path)
    vocab = {mapped(token): rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=[(mapped(a), mapped(b)) for a, b in merges_from(ranks)], ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    back = {char: byte for byte, char in enumerate(byte_chars())}
    table = [b""] * (max(ranks.values()) + 1)
    for chars, token_id in vocab.items():
        table[token_id] = bytes(back[c] for c in chars)
    return tokenizer, table


class PieceCache:
    """Ids of distinct pieces, flat in one array, for a library tokenizer; subclasses say how to encode pieces."""

    def __init__(self, limit: int = CACHE_PIECES):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, joined, and the count for each."""
        raise NotImplementedError

    def _add(self, pieces: list[str]) -> None:
        ids, counts = self.encode_pieces(pieces)
        n, k = len(self.slot), len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + k > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + k] = self.used + np.cumsum(counts) - counts
        self.length[n : n + k] = counts
        self.used += len(ids)
        self.slot.update(zip(pieces, range(n, n + k)))

    def slots(self, pieces: list[str]) -> np.ndarray:
        if len(self.slot) > self.limit:
            self.clear()
        if new := [p for p in dict.fromkeys(pieces) if p not in self.slot]:
            self._add(new)
        return np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these slots in order, and the count for each."""
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[slots] - (ends - lengths), lengths) + np.arange(total)
        return self.flat[at], lengths


class BytePieces(PieceCache):
    """Pieces that begin with a space, the only space in them."""

    def __init__(self, tokenizer: Tokenizer, table: list[bytes], limit: int = CACHE_PIECES):
        super().__init__(limit)
        self.tokenizer = tokenizer
        self.opens = np.array([t[:1] == b" " for t in table])

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = ["".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        starts = np.flatnonzero(self.opens[ids])
        assert len(starts) == len(pieces), "a piece does not begin with one space"
        return ids, np.diff(np.append(starts, len(ids)))


class ByteEncoder:
    """Encodes Arrow string arrays; ids equal those of the whole texts."""

    def __init__(self, ranks_path: str):
        self.tokenizer, self.table = byte_tokenizer(ranks_path)
        self.pieces = BytePieces(self.tokenizer, self.table)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        n = len(texts)
        if not n:
            return []
        lists = pc.split_pattern(common.plain_strings(texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        base = offsets[0]
        offsets = offsets - base
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = np.fromiter((not w or w[0].isspace() for w in distinct), bool, len(distinct))
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        rest = np.flatnonzero(~first)
        doc_of = np.repeat(np.arange(n), np.diff(offsets))
        slow = np.zeros(n, bool)
        slow[doc_of[rest[odd[codes[rest]]]]] = True
        take = rest[~slow[doc_of[rest]]]
        needed = np.unique(codes[take])
        slot = np.zeros(len(distinct), np.int64)
        slot[needed] = self.pieces.slots([f" {distinct[c]}" for c in needed.tolist()])
        ids, counts = self.pieces.gather(slot[codes[take]])
        ends = np.cumsum(np.bincount(doc_of[take], counts, n).astype(np.int64))
        heads = self.whole([texts[i].as_py() if slow[i] else distinct[codes[offsets[i]]] for i in range(n)])
        return [heads[i] if slow[i] else np.concatenate([heads[i], ids[ends[i - 1] if i else 0 : ends[i]]]) for i in range(n)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@cache
def encoder(ranks_path: str) -> ByteEncoder:
    return ByteEncoder(ranks_path)


def decode_stream(table: list[bytes], ids: Iterable[int]) -> Iterator[str]:
    """Text token by token: a character that several tokens share comes with the last of them; broken bytes give U+FFFD."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for token_id in ids:
        yield decoder.decode(table[token_id])
    yield decoder.decode(b"", True)


def char_offsets(table: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's first and past-the-last character in the text; tokens that share a character overlap there."""
    raw = np.frombuffer(b"".join(map(table.__getitem__, ids.tolist())), np.uint8)
    ends = np.cumsum(np.array([len(table[i]) for i in ids.tolist()], np.int64))
    leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    inside = starts < len(raw)
    begin = leads[starts] - np.where(inside, (raw[np.minimum(starts, max(len(raw) - 1, 0))] & 0xC0) == 0x80, False) if len(raw) else starts
    return begin.astype(np.int64), leads[ends].astype(np.int64)


def encode_documents(df: DataFrame, ranks_path: str, offsets: bool = False) -> DataFrame:
    """(doc_id, ids[, starts, ends]) for each row: ids of the whole text, with character offsets if asked for."""
    source = common.texts_of(df)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in common.slices(batches):
            ids = enc.encode(common.column(batch, "text"))
            names, columns = ["doc_id", "ids"], [common.column(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                spans = [char_offsets(enc.table, x) for x in ids]
                names += ["starts", "ends"]
                columns += [pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names)
        enc.pieces.clear()
        common.give_back()

    extra = ", starts array<bigint>, ends array<bigint>" if offsets else ""
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>{extra}")


def decode_documents(df: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, data) from (doc_id, ids): the exact bytes; null ids give none."""
    source = common.only(df, "doc_id", "ids")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            data = [enc.decode(x) for x in (x or [] for x in common.column(batch, "ids").to_pylist())]
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return source.mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip_digests(df: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: encodes, decodes the ids, keeps digests of both."""
    source = common.texts_of(df)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in common.slices(batches):
            ids = enc.encode(common.column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    common.column(batch, "doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(enc.decode(x.tolist())).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        enc.pieces.clear()
        common.give_back()

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

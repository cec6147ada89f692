"""License scans by diagonal voting.

Words are runs of a-z, 0-9 and characters beyond ASCII after A-Z are lower-cased. Every 2-word gram of every
text has a 64-bit hash and a second, independent one. Spark joins all of them to the positions of the same grams
in the templates (a fixed table, so its broadcast is bounded by this file); a hit votes for the diagonal text position
minus template position. Votes add up by document, template and diagonal. Neighbouring diagonals merge as far as a template may drift by
inserted and missing words, the share of its grams that need not be there; where their votes together cannot cover the template, they go.
What is left is verified: of the hits on the merged diagonals the longest sequence in which both text and template go forward,
with steps of at most ``DRIFT`` diagonals, must cover the template. Each verified span begins and ends at hits of its own, and spans of one
template do not overlap: those that cover more come first, then those that start earlier. Short templates (the phrases) need all
their grams on one diagonal.

Null texts count as empty. Null doc_ids and repeated rows each get a result: votes go by a key of id and text, and a
place counts once for it. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

GRAM = 2
#: The base phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening or identifying passages of public licenses, with the labels this method adds.
PASSAGES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: How far apart diagonals of one step may lie, and the share of a passage's grams that a span must cover.
DRIFT, COVERED = 2, 0.7

_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


def gram_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each 2-word gram, as signed numbers."""
    digest = xxhash.xxh64_intdigest
    word = np.fromiter(map(digest, words), np.uint64, len(words))
    left, right = word[:-1], word[1:]
    first = (left ^ (left >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + right
    second = (left + np.uint64(0x632BE59BD9B4E019)) * (right | np.uint64(1))
    return first.view(np.int64), (second >> np.uint64(33)).astype(np.int32)


@cache
def templates() -> list[tuple[str, bool, int, int, int, int]]:
    """(label, phrase, grams, template position, hash, second hash) for each gram of each template."""
    rows = []
    for label, phrase, text in [*((v, True, k) for k, v in PHRASES.items()), *((k, False, v) for k, v in PASSAGES.items())]:
        first, second = gram_hashes(words_of(text))
        rows += [(label, phrase, len(first), at, int(h), int(s)) for at, (h, s) in enumerate(zip(first, second))]
    return rows


TEMPLATE = T.StructType(
    [T.StructField(n, t, False) for n, t in (("label", T.StringType()), ("phrase", T.BooleanType()), ("grams", T.IntegerType()), ("at", T.IntegerType()), ("hash", T.LongType()), ("second", T.IntegerType()))]
)


def hashed(df: DataFrame, with_grams: bool) -> DataFrame:
    """(key, doc_id, n_words[, hashes, seconds]) for each row; the key tells id and text."""
    source = common.texts_of(df)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, texts = common.column(batch, "doc_id"), common.column(batch, "text").to_pylist()
            words = [words_of(t) for t in texts]
            keys = [xxhash.xxh3_128_digest(f"{i}:{t}".encode("utf-8", "surrogatepass")) for i, t in zip(ids.to_pylist(), texts)]
            arrays, names = [pa.array(keys, pa.binary()), ids, pa.array([len(w) for w in words], pa.int64())], ["key", "doc_id", "n_words"]
            if with_grams:
                both = [gram_hashes(w) for w in words]
                offsets = np.cumsum([0, *(len(h) for h, _ in both)]).astype(np.int32)
                for k, name in ((0, "hashes"), (1, "seconds")):
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([b[k] for b in both]))))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names)

    grams = ", hashes array<bigint>, seconds array<int>" if with_grams else ""
    return source.mapInArrow(run, f"key binary, doc_id {kind}, n_words bigint{grams}")


def spans(grams: DataFrame) -> DataFrame:
    """(key, label, phrase, first_word, end_word, covered): verified spans, phrases and passages."""
    spark = grams.sparkSession
    table = spark.createDataFrame(templates(), TEMPLATE)
    rolled = grams.select("key", F.posexplode(F.arrays_zip("hashes", "seconds")).alias("place", "gram")).select("key", "place", F.col("gram.hashes").alias("hash"), F.col("gram.seconds").alias("check"))
    hits = rolled.join(F.broadcast(table), "hash").where("check = second")
    # A place counts once for a key, however often the row is repeated.
    votes = hits.groupBy("key", "label", "phrase", "grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places"))
    votes = common.written(votes, "votes")
    phrases = votes.where("phrase AND size(places) = grams").select(
        "key", "label", "phrase", F.col("diagonal").cast("bigint").alias("first_word"), (F.col("diagonal") + F.col("grams") + 1).cast("bigint").alias("end_word"), F.lit(1.0).alias("covered")
    )
    # As far as the longest template may drift: what a shorter one may is looked at when spans are verified.
    reach, near = max(drift_of(t[2]) for t in templates()), Window.partitionBy("key", "label").orderBy("diagonal")
    enough = F.sum(F.size("places")).over(near.rangeBetween(0, reach)) >= F.lit(COVERED) * F.col("grams")
    apart = votes.where("NOT phrase").withColumn("_enough", enough).withColumn("_near", F.max("_enough").over(near.rangeBetween(-reach, 0)))
    sets = apart.where("_near").groupBy("key", "label", "grams").agg(F.collect_list(F.struct("diagonal", "places")).alias("diagonals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, label, grams, diagonals in zip(*(common.column(batch, n).to_pylist() for n in ("key", "label", "grams", "diagonals"))):
                rows += [(key, label, False, *span) for span in verified({d["diagonal"]: d["places"] for d in diagonals}, grams)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, _SPAN)], ["key", "label", "phrase", "first_word", "end_word", "covered"])

    return phrases.unionByName(sets.mapInArrow(run, "key binary, label string, phrase boolean, first_word bigint, end_word bigint, covered double"))


_SPAN = (pa.binary(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())


def drift_of(grams: int) -> int:
    """How many diagonals a span may take: one for each gram that it need not cover, at least ``DRIFT``."""
    return max(DRIFT, int(grams * (1 - COVERED)))


def longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of (place, at) in which both go forward, by steps of at most ``DRIFT`` diagonals; of equal ones that which ends first."""
    pairs = sorted(pairs)
    best: list[tuple[int, int]] = []  # (length, index of the one before)
    for place, at in pairs:
        length, before = 1, -1
        for k, (p, a) in enumerate(pairs[: len(best)]):
            if p < place and a < at and abs(p - a - place + at) <= DRIFT and best[k][0] >= length:
                length, before = best[k][0] + 1, k
        best.append((length, before))
    end = max(range(len(pairs)), key=lambda i: (best[i][0], -i), default=-1)
    out = []
    while end >= 0:
        out.append(pairs[end])
        end = best[end][1]
    return out[::-1]


def verified(diagonals: dict[int, list[int]], grams: int) -> list[tuple[int, int, float]]:
    """(first_word, end_word, covered) of a template's spans, from the template positions hit on each diagonal."""
    order, reach, found = sorted(diagonals), drift_of(grams), set()
    low = held = 0
    for high, diagonal in enumerate(order):
        held += len(diagonals[diagonal])
        while order[low] < diagonal - reach:
            held -= len(diagonals[order[low]])
            low += 1
        if held >= COVERED * grams:  # at most (reach + 1) * grams hits
            chain = longest([(d + at, at) for d in order[low : high + 1] for at in diagonals[d]])
            if len(chain) >= COVERED * grams:
                found.add((-len(chain), chain[0][0], chain[-1][0] + GRAM))
    out: list[tuple[int, int, float]] = []
    taken: list[tuple[int, int]] = []
    for length, start, end in sorted(found):
        at = bisect.bisect(taken, (start, end))
        if (not at or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            taken.insert(at, (start, end))
            out.append((start, end, -length / grams))
    return sorted(out)


def scan(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans) for each row: all verified spans as structs, by place."""
    documents, found = _scanned(df)
    listed = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word", "label", "covered"))).alias("spans"))
    return documents.join(listed, "key", "left").drop("key")


def _scanned(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, n_words) of all rows and their spans. The votes are written: phrases and passages come from one join."""
    common.without_shuffle_files(df.sparkSession)
    found = common.written(spans(hashed(df, True)), "license")
    return hashed(df, False), found


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    The score is the share of the best template that a span covers: 0 without a span.
    """
    documents, found = _scanned(df)
    labels = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    base = F.when(F.col("phrase"), F.col("label"))
    summed = found.groupBy("key").agg(
        F.count(base).alias("n_base"), F.min(F.when(F.col("phrase"), F.col("first_word"))).alias("first_word"), F.max(F.when(F.col("phrase"), F.col("first_word"))).alias("last_word"),
        F.collect_set(base).alias("base"), F.collect_set("label").alias("all"), F.max("covered").alias("score"),
    )
    return documents.join(summed, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word", labels(F.col("base")).alias("base_labels"), labels(F.col("all")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

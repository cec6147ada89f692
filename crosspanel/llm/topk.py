"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components become integers; a component that is not zero is a term. Queries come in blocks of bounded size, candidates in chunks
turned to postings, a column of weights for each term; each block meets each chunk. A block's dense score array gets, term after
term, each query's weight times the term's postings. A task keeps k of each query's scores with ties to the
smaller vec_id; a window merges those of all tasks.

Vectors that are null, or hold null or non-finite components, take no part; nor do rows with a null vec_id.
Vectors shorter than others count as having zeros there; empty ones score 0. Repeated vec_ids are candidates each
for itself (a query's own row is every row with its vec_id); repeated queries count once. A component whose multiple leaves 64 bits, or a
sum that does, raises. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Queries in a block, about.
QUERY_BLOCK = 4096
#: Queries and candidates whose dense scores are held at once.
ROWS, COLUMNS = 256, 8192


def whole_vectors(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, terms array<bigint>) of the rows that take part."""
    rows = common.only(df, "vec_id", "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: _term(F.lit(float(scale)) * x.cast("double"))).alias("terms")
    )


def _term(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float(1 << 63)), F.floor(x)).otherwise(F.raise_error(F.lit("a component's multiple leaves 64 bits")).cast("bigint"))


def postings(terms: pa.Array) -> np.ndarray:
    """A row of weights for each term, one place for each vector."""
    flat, offsets = terms.values.to_numpy().astype(np.int64), terms.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((int(lengths.max(initial=0)), len(terms)), np.int64)
    rows = np.repeat(np.arange(len(terms)), lengths)
    out[np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], lengths), rows] = flat[offsets[0] : offsets[-1]]
    return out


def accumulate(weights: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Scores of all queries for a block: each term's postings are added with the weights of the queries that have it."""
    scores = np.zeros((len(weights), columns.shape[1]), np.int64)
    reach = float(np.abs(weights).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(1, len(columns))
    if reach >= 2**63:
        bound = np.abs(weights).astype(float).sum(1).max() * np.abs(columns).astype(float).max()
        if bound >= 2**63:
            raise OverflowError("an inner product may leave 64 bits")
    narrow = np.int32 if reach < 2**31 else np.int64  # the same sums in half the memory, where they surely fit
    dense, own, terms = scores.astype(narrow), weights.astype(narrow), columns.astype(narrow)
    spare = np.empty(columns.shape[1], narrow)
    for term in range(min(weights.shape[1], len(columns))):
        for query in np.flatnonzero(own[:, term]):
            np.multiply(terms[term], own[query, term], out=spare)
            dense[query] += spare
    return dense.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest by score, then smaller id: by partition of the scores, then a sort of those not below the k-th."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    order = at[np.lexsort((ids[at], -scores[at]))][:k]
    return scores[order], ids[order]


def chunks(candidates: DataFrame) -> DataFrame:
    """(ids, vectors): candidates in rows of at most COLUMNS vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COLUMNS):
                part = batch.slice(at, COLUMNS)
                offsets = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, common.column(part, n)) for n in ("vec_id", "terms")], ["ids", "vectors"])

    return candidates.mapInArrow(run, "ids array<bigint>, vectors array<array<bigint>>")


def scan(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) from pairs of a candidate chunk and a query block: each task's k best for each query that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        asked: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = common.column(row, "block")[0].as_py()
                ids, columns = common.column(row, "ids").flatten().to_numpy(), postings(common.column(row, "vectors").flatten())
                queries = common.column(row, "queries").flatten()
                query_ids, weights = queries.field("vec_id").to_numpy(), postings(queries.field("terms")).T.copy()
                if block not in kept:
                    kept[block], asked[block] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids), query_ids
                order = np.searchsorted(asked[block], query_ids)
                for q in range(0, len(query_ids), ROWS):
                    for n, scores in enumerate(accumulate(weights[q : q + ROWS], columns), q):
                        others = ids != query_ids[n]
                        found = best(scores[others], ids[others], k)
                        kept[block][order[n]] = best(*(np.concatenate(x) for x in zip(kept[block][order[n]], found)), k)
        for block, rows in kept.items():
            sizes = [len(s) for s, _ in rows]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked[block], sizes)), pa.array(np.concatenate([x[1] for x in rows])), pa.array(np.concatenate([x[0] for x in rows]))], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query vector.

    One job: every block of about QUERY_BLOCK queries, dealt by hash, meets every chunk of candidates, pairs of a few MB, and each task keeps its best.
    """
    common.without_shuffle_files(candidates.sparkSession)
    rows = whole_vectors(candidates, scale)
    asked = common.written(whole_vectors(queries, scale).groupBy("vec_id").agg(F.min("terms").alias("terms")), "queries")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "terms"))).alias("queries"))
    return _ranked(scan(chunks(rows).crossJoin(common.written(blocks, "query-blocks")), k), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

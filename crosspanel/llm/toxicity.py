"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Learning: up to ``positives`` toxic and ``negatives`` other labelled rows (those with the smallest hashes of
their ids; both bounds are parameters) are picked out. Spark counts in how many rows of each label a hashed
n-gram occurs; the log ratio of smoothed counts scales the feature. A logistic regression with a ridge is fitted on
the scaled features of the same rows, weighted back to the labels' shares in all labelled rows. The size of the model is set by
parameters of the fit: ``features``, how many n-grams the regression takes (those whose shares differ most for their counts; None: all),
``least_rows``, in how many of the sample's rows one must be, and ``hash_bits``. They bound what the driver fits, not what is
read: scoring reads every text whole, with the intercept and the weights of the distinct n-grams it has.

Null texts count as empty and get the intercept's score. Rows with a null doc_id are scored (and are not held out);
null labels and ids are not learned from; repeated rows get equal scores. With no label, or one kind only, each score is
the share of toxic labels. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of an n-gram's hash, so a model has at most 2 ** 20 features.
HASH_BITS = 20
THRESHOLD = 0.3


def _letters() -> np.ndarray:
    """Code points under 0x3000 as they count in n-grams: letters lower-case, anything else a space."""
    table = np.full(0x3000, 32, np.uint32)
    for point in range(0x3000):
        low = chr(point).lower()
        if chr(point).isalpha():
            table[point] = ord(low) if len(low) == 1 else point
    return table


LETTERS = _letters()


def ngrams(text: str, hash_bits: int = HASH_BITS) -> list[np.ndarray]:
    """Hashes of all 4-, 7- and 10-grams of the text between two spaces, repeats included."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = np.where(points < 0x3000, LETTERS[np.minimum(points, 0x2FFF)], points)
    one = one[(one != 32) | (np.concatenate([[0], one[:-1]]) != 32)]  # white space and signs count as one space
    base = 0x9E3779B1

    def joined(left: np.ndarray, k: int, right: np.ndarray) -> np.ndarray:
        n = max(0, len(right) - k)
        return left[:n] * np.uint32(pow(base, k, 1 << 32)) + right[k : k + n]

    first = one * np.uint32(0x85EBCA6B) ^ (one >> np.uint32(3))
    two = joined(first, 1, first)
    four = joined(two, 2, two)
    seven = joined(four, 3, four)  # the fourth letter counts twice, with two weights
    ten = joined(seven, 3, seven)
    out = []
    for k, h in enumerate((four, seven, ten)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
        out.append((h >> np.uint32(32 - hash_bits)).astype(np.int32))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, by feature, with the log-count ratio in it
    intercept: float

    def score(self, text: str) -> float:
        found = [h[self.weights[h] != 0] for h in ngrams(text, len(self.weights).bit_length() - 1)]
        return float(_sigmoid(self.intercept + self.weights[np.unique(np.concatenate(found))].sum(dtype=np.float64)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the rows to learn from, and how many labels there are of each kind."""
    usable = common.only(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = common.written(usable, "labels")
    shares = {int(r["toxic"]): r["count"] for r in usable.groupBy("toxic").count().collect()}
    picked = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, positives), (0, negatives))]
    ids = picked[0].unionByName(picked[1])  # bounded by the two parameters
    return common.written(common.texts_of(docs).join(F.broadcast(ids), "doc_id").select("toxic", "text"), "labelled"), shares


def count_features(sample: DataFrame, least_rows: int, hash_bits: int) -> np.ndarray:
    """In how many rows of label 0 and 1 each feature occurs: at most 2 ** hash_bits rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << hash_bits), np.int32)
        for batch in batches:
            for toxic, text in zip(common.column(batch, "toxic").to_pylist(), common.column(batch, "text").to_pylist()):
                counts[int(toxic), np.unique(np.concatenate(ngrams(text, hash_bits)))] += 1
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["feature", "clean", "toxic"])

    summed = sample.mapInArrow(run, "feature int, clean int, toxic int").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = summed.where(F.col("clean") + F.col("toxic") >= least_rows).toArrow()
    out = np.zeros((2, 1 << hash_bits), np.int64)
    out[:, rows["feature"].to_numpy()] = [rows["clean"].to_numpy(), rows["toxic"].to_numpy()]
    return out


def log_count_ratios(counts: np.ndarray, rows: np.ndarray, features: int | None) -> np.ndarray:
    """Smoothed log ratio of the shares of toxic and other rows that have a feature; 0 for features that are not taken."""
    shares = (counts + 0.5) / (rows[:, None] + 1)
    ratio = np.log(shares[1] / shares[0])
    pooled = (counts.sum(0) + 1) / (rows.sum() + 2)
    z = np.abs(shares[1] - shares[0]) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / (rows[0] + 1) + 1 / (rows[1] + 1)))
    z[counts.sum(0) == 0] = 0
    if features is not None and (z > 0).sum() > features:
        z[z < np.partition(z, -features)[-features]] = 0
    return np.where(z > 0, ratio, 0).astype(np.float32)


def fit_regression(rows: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray, row_weights: np.ndarray, ridge: float = 1e-3, rounds: int = 150) -> Model:
    """Logistic regression on scaled features, by Adam over all rows; the same numbers give the same model."""
    used = np.flatnonzero(ratios)
    place = np.zeros(len(ratios), np.int32)
    place[used] = np.arange(len(used))
    columns = place[np.concatenate([np.zeros(0, np.int32), *rows])]
    ends = np.cumsum([len(r) for r in rows])
    which = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(ends, prepend=0))
    scale = ratios[used].astype(np.float64)
    w, b = np.zeros(len(used)), float(np.log((row_weights * toxic).sum() / (row_weights * (1 - toxic)).sum()))
    share = row_weights / row_weights.sum()
    m, v, mb, vb, rate = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.03
    for t in range(1, rounds + 1):
        z = b + np.bincount(which, (w * scale)[columns], len(rows))
        error = share * (_sigmoid(z) - toxic)
        g = np.bincount(columns, error[which], len(used)) * scale + ridge * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(len(ratios), np.float32)
    weights[used] = w * scale
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, positives: int = 2500, negatives: int = 4000, features: int | None = 40_000, least_rows: int = 4, hash_bits: int = HASH_BITS) -> Model:
    """Fits the classifier on a bounded sample of labelled rows; only the features that it takes reach the driver."""
    common.without_shuffle_files(docs.sparkSession)
    sample, shares = labelled_sample(docs, labels, positives, negatives)
    if not shares.get(0) or not shares.get(1):
        return Model(np.zeros(1 << hash_bits, np.float32), 40.0 if shares.get(1) else -40.0)
    taken = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not taken.get(0) or not taken.get(1):
        return Model(np.zeros(1 << hash_bits, np.float32), float(np.log(shares[1] / shares[0])))
    counts = np.array([taken[0], taken[1]], float)
    ratios = log_count_ratios(count_features(sample, least_rows, hash_bits), counts, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.unique(np.concatenate([h[ratios[h] != 0] for h in ngrams(t, hash_bits)])).astype(np.int32) for t in common.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([common.column(batch, "toxic").cast(pa.int32()), pa.array(kept, pa.list_(pa.int32()))], ["toxic", "features"])

    rows = sample.mapInArrow(run, "toxic int, features array<int>").toArrow().combine_chunks()
    toxic = rows["toxic"].to_numpy().astype(float)
    listed = rows["features"].combine_chunks()
    flat, offsets = listed.values.to_numpy(), listed.offsets.to_numpy()
    order = sorted(range(len(toxic)), key=lambda i: (toxic[i], flat[offsets[i] : offsets[i + 1]].tobytes()))  # whatever order Spark returned
    weight = {k: shares[k] / taken[k] for k in (0, 1)}
    vectors = [flat[offsets[i] : offsets[i + 1]] for i in order]
    return fit_regression(vectors, toxic[order], ratios, np.array([weight[int(toxic[i])] for i in order]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row. The model's size is fixed (4 MB), whatever the data."""
    source = common.texts_of(docs)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in common.column(batch, "text")], float)
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns; each text decides by itself, so no join is needed."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(t.as_py() or "") < threshold for t in common.column(batch, "text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)

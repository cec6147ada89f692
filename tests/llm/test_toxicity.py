import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import toxicity


def corpus(n=600):
    rng = random.Random(1)
    words = ["river", "stone", "table", "window", "garden", "winter", "paper", "music"]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["vilest", "grubby"])
        rows.append((i, " ".join(text), 9.0, "k"))
        labels.append((i, int(bad)))
    return rows, labels


def test_ngrams_follow_the_text():
    grams = [set(x.tolist()) for x in toxicity.ngrams("Some words, HERE")]
    same = [set(x.tolist()) for x in toxicity.ngrams("some words here")]
    assert grams == same and [len(toxicity.ngrams("")[k]) for k in range(3)] == [0, 0, 0]
    assert len(toxicity.ngrams("abcdefgh")[2]) == 1 and toxicity.ngrams("ab\U0001f600cd\ud800".encode("utf-8", "ignore").decode())[0].size


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, None, 1.0, "k"), (7000, "", 1.0, "k"), (7001, "x" * 200_000, 1.0, "k"), (0, rows[0][1], 1.0, "k")], "doc_id bigint, text string, score double, toxic string")
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, table)
    got = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + 4
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    again = toxicity.train(docs.repartition(5), table)
    assert np.array_equal(again.weights, model.weights) and again.intercept == model.intercept


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)])
def test_without_both_labels(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    found = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))).first().score
    assert found == pytest.approx(score, abs=1e-9)
    assert toxicity.score(docs.where("false"), toxicity.Model(np.zeros(1 << toxicity.HASH_BITS, np.float32), 0.0)).count() == 0


def plain_features(text, bits):
    """The n-grams' hashes by loops over whole numbers."""
    letters = []
    for c in f" {text} ":
        low = c.lower() if ord(c) < 0x3000 and c.isalpha() and len(c.lower()) == 1 else c
        low = low if ord(c) >= 0x3000 or c.isalpha() else " "
        if low != " " or letters[-1:] != [" "]:
            letters.append(low)
    mod, base = 1 << 32, 0x9E3779B1
    level = [(ord(c) * 0x85EBCA6B % mod) ^ (ord(c) >> 3) for c in letters]
    out = set()
    for shift, k in ((1, None), (2, 0), (3, 1), (3, 2)):
        level = [(level[i] * pow(base, shift, mod) + level[i + shift]) % mod for i in range(len(level) - shift)]
        if k is not None:
            out |= {((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * k) % mod) >> (32 - bits) for h in level}
    return sorted(out)


def plain_scores(train, texts, bits, ridge=1e-3, rounds=150):
    """Log-count ratios and the regression with dictionaries."""
    rows = [(plain_features(t, bits), y) for t, y in train]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    counts = {}
    for found, y in rows:
        for f in found:
            counts.setdefault(f, [0, 0])[y] += 1
    scale = {f: float(np.float32(math.log((c[1] + 0.5) / (n[1] + 1) / ((c[0] + 0.5) / (n[0] + 1))))) for f, c in counts.items()}
    scale = {f: s for f, s in scale.items() if (counts[f][1] + 0.5) / (n[1] + 1) != (counts[f][0] + 0.5) / (n[0] + 1)}
    w, m, v, b, mb, vb = dict.fromkeys(scale, 0.0), dict.fromkeys(scale, 0.0), dict.fromkeys(scale, 0.0), math.log(n[1] / n[0]), 0.0, 0.0
    for t in range(1, rounds + 1):
        g, gb = {f: ridge * w[f] for f in w}, 0.0
        for found, y in rows:
            z = b + sum(w[f] * scale[f] for f in found if f in w)
            error = (1 / (1 + math.exp(-z)) - y) / len(rows)
            gb += error
            for f in found:
                if f in w:
                    g[f] += error * scale[f]
        step = lambda m, v: 0.03 * m / (1 - 0.9**t) / (math.sqrt(v / (1 - 0.99**t)) + 1e-8)
        for f in w:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.99 * v[f] + 0.01 * g[f] ** 2
            w[f] -= step(m[f], v[f])
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        b -= step(mb, vb)
    return [1 / (1 + math.exp(-b - sum(w[f] * scale[f] for f in plain_features(t, bits) if f in w))) for t in texts]


def test_scores_match_plain_loops(spark):
    rows, labels = corpus(40)
    texts = [r[1] for r in rows] + ["", "GRUBBY! stone, \u00c9t\u00e9 \u65e5\u672c", "vilest"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), features=None, least_rows=1, hash_bits=16)
    learned = [(texts[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    got = [r.score for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(plain_scores(learned, texts, 16), abs=1e-5)


def test_given_tables_held_out(spark):
    """On 94 held-out labels, 14 of them toxic, from 305 others; and the taken features decide nearly as all features do."""
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    taken, every = toxicity.train(docs, labels), toxicity.train(docs, labels, features=None, least_rows=1)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    got, whole = ({r.doc_id: r.predicted for r in toxicity.score(docs, m).collect() if r.doc_id in truth} for m in (taken, every))
    assert truth and np.mean([got[i] == truth[i] for i in got]) > 0.9
    assert np.mean([got[i] == whole[i] for i in got]) > 0.95

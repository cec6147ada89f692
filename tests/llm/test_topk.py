import math
import random

import pytest

from crosspanel.llm import topk


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "COLUMNS", 16)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(90)]
    rows += [(100, [0.5] * 6), (101, [0.5] * 6), (102, None), (103, [0.1, None]), (104, [math.inf] * 6), (105, [math.nan] * 6), (None, [9.0] * 6), (106, []), (107, [3.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score int, rank int").repartition(4)
    got = topk.top_k(df, df.where("vec_id % 5 = 0"), k=5).collect()
    import numpy as np

    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wanted = {}
    for q, a in whole:
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:5]
            wanted[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found == wanted
    assert topk.top_k(df, df.where("false")).count() == 0 and topk.top_k(df.where("vec_id = 5"), df.where("vec_id = 5")).count() == 0


def test_beyond_64_bits_raises(spark):
    for rows in ([(1, [1e300]), (50, [1.0])], [(1, [1e16] * 3), (50, [1e16] * 3)]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(df, df.where("vec_id = 50")).collect()

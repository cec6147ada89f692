import random

import numpy as np
import pytest
import xxhash

from crosspanel.llm import simhash


def brute_components(fps, radius=3):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " \n\t ", "one", "One two", "a b c d e f g a b c", "É è  É\nÀ x", "x " * 5000, "same same same same"])
def test_fingerprint_matches_plain_counting(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_compare_buckets_finds_each_link(radius):
    rng = random.Random(radius)
    lefts, rights, expected = [], [], []
    for size in (2, 3, 9, 40, 2, 17):
        seed = rng.getrandbits(64)
        fps = list({near(rng, seed, rng.randrange(7)) for _ in range(size)} | {rng.getrandbits(64) for _ in range(3)})
        lefts.append(np.array(fps, np.uint64))
        rights.append(None)
        expected += [(fps, brute_components(fps, radius))]
    a, b = simhash.compare_buckets(lefts, rights, radius)
    for fps, labels in expected:
        at = {fp: i for i, fp in enumerate(fps)}
        parent = list(range(len(fps)))
        for x, y in zip(a.tolist(), b.tolist()):
            if x in at and y in at:
                assert (x ^ y).bit_count() <= radius
                i, j = parent[at[x]], parent[at[y]]
                parent = [min(i, j) if p in (i, j) else p for p in parent]
        assert parent == labels


@pytest.mark.parametrize("sizes", [(5, 3), (3, 11), (30, 30), (1, 1)])
def test_cross_blocks_meet_in_every_pair(sizes):
    rng = random.Random(4)
    seed = rng.getrandbits(64)
    x, y = ([near(rng, seed, rng.randrange(1, 8)) for _ in range(n)] for n in sizes)
    a, b = simhash.compare_buckets([np.array(x, np.uint64)], [np.array(y, np.uint64)])
    near_pairs = {(p, q) for p in x for q in y if (p ^ q).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) <= near_pairs
    label = {p: p for p in [*x, *y]}
    for links in (near_pairs, zip(a.tolist(), b.tolist())):
        own = dict(label)
        for p, q in links:
            low, high = sorted((own[p], own[q]))
            own = {k: low if v == high else v for k, v in own.items()}
        if links is near_pairs:
            wanted = own
    assert own == wanted


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(7)
    base = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split() for _ in range(3)]
    rows = [(None, "null id text"), (5, None), (6, ""), (7, " \n "), (8, "alone"), (8, "alone")]
    for i in range(20, 110):
        words = list(base[i % 3]) * 4
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z"])
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t or "") for _, t in rows]
    labels = brute_components(fps)
    ids = {}
    for (doc, _), lab in zip(rows, labels):
        if doc is not None:
            ids[lab] = min(doc, ids.get(lab, doc))
    expected = sorted([(str(d), f"{f:016x}", ids.get(lab)) for (d, _), f, lab in zip(rows, fps, labels)], key=str)
    assert sorted([(str(r.doc_id), r.fingerprint, r.component_id) for r in got], key=str) == expected
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(ids.values()))


def test_one_row_of_each_component_stays(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    rows = [(1, long), (2, "quite another text of its own here"), (2, long), (2, "and a third one that nobody repeats"), (None, long.upper()), (None, "nobody has this one"), (None, "nobody has this one")]
    rows += [(3, "The  same words again"), (3, "the same words again"), (3, "the same words again"), (4, None), (5, ""), (None, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    wanted = [(1, long), (2, "quite another text of its own here"), (2, "and a third one that nobody repeats"), (None, "nobody has this one"), (3, "The  same words again"), (4, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_long_chain_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).count() == 0

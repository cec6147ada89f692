import random
import re

from crosspanel.llm import license_scan


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_phrases_match_brute_force_and_passages_are_found(spark):
    rng = random.Random(1)
    bits = ["GNU", "General", "Public", "License", "license", "Apache", "MIT", "mit", "CC", "cc", "BY", "by-nc", "é", "\x7f", "-", "_", "日本", "gnu general public license", "apache  license\n"]
    texts = [None, "", "  ", "Cc By", "MIT", "license", "mit license " * 4000, *(" ".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(200))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "cc by cc by", "x", 1), (3, "Cc By", "x", 1), (3, "other", "x", 1)]
    got = license_scan.digests(spark.createDataFrame(rows, "doc_id bigint, text string, label string, key int")).collect()
    fields = lambda r: (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
    assert sorted(map(fields, got), key=str) == sorted([(i, *brute(t)) for i, t, *_ in rows], key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_passage_with_changed_words(spark):
    text = "x y Permission is hereby granted, free of charge, to any natural person obtaining a copy of this software and documentation files z"
    df = spark.createDataFrame([(1, text), (2, "permission granted to any person")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [(s.label, s.first_word) for s in got[1].spans] == [("mit-grant", 2)] and got[1].spans[0].end_word == 22  # files is word 21
    assert got[2].spans is None
    assert license_scan.digests(df.where("false")).count() == 0


def alignments(words, label):
    """All places of a template by plain loops: the best forward sequence of equal grams in each stretch of text, by the same limits."""
    template = license_scan.words_of(license_scan.PASSAGES[label])
    grams = [tuple(template[i : i + 2]) for i in range(len(template) - 1)]
    text = [tuple(words[i : i + 2]) for i in range(len(words) - 1)]
    diagonals = {}
    for place, g in enumerate(text):
        for at, t in enumerate(grams):
            if g == t:
                diagonals.setdefault(place - at, []).append((place, at))
    reach, found = max(license_scan.DRIFT, int(len(grams) * (1 - license_scan.COVERED))), set()
    for low in diagonals:
        pairs = sorted(p for d, x in diagonals.items() if low - reach <= d <= low for p in x)
        chains = []
        for p, a in pairs:
            before = [c for c in chains if c[-1][0] < p and c[-1][1] < a and abs(c[-1][0] - c[-1][1] - p + a) <= license_scan.DRIFT]
            chains.append(max(before, key=len, default=[]) + [(p, a)])
        most = max(map(len, chains))
        if most >= license_scan.COVERED * len(grams):
            found.add((-most, *next((c[0][0], c[-1][0] + 2) for c in chains if len(c) == most)))
    out = []
    for n, start, end in sorted(found):
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, -n))
    return sorted(out)


GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"


def test_spans_are_those_of_plain_alignment(spark):
    rng = random.Random(7)
    words = GRANT.split()
    scattered = " ".join(f"{a} {b} filler{i}" for i, (a, b) in enumerate(zip(words, words[1:])))
    prose = " ".join(rng.choices(["of", "the", "this", "a", "copy", "software", "to", "any", "person", "is", "free", "and", "files", "charge", "obtaining", "associated"], k=4000))
    texts = [scattered, prose, f"{GRANT} then {GRANT}", f"x {GRANT.replace('free', 'quite free').replace('any', '')} y", " ".join(reversed(words)), f"{GRANT} " * 40]
    for _ in range(60):
        out = []
        for w in words * rng.randrange(1, 3):
            out += rng.choices([[w], [], [w, "extra"], ["other"]], [12, 1, 1, 1])[0]
        texts.append(" ".join(rng.choices(["of", "charge", "x"], k=rng.randrange(9)) + out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(s.first_word, s.end_word, round(s.covered * (len(words) - 1))) for s in r.spans or () if s.label == "mit-grant"] for r in license_scan.scan(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == alignments(license_scan.words_of(text), "mit-grant"), text[:200]
    assert got[0] == [] and got[1] == [] and got[2] == [(0, 20, 19), (21, 41, 19)] and len(got[3]) == 1 and got[4] == [] and len(got[5]) == 40

import hashlib
import random
import re
import time

from crosspanel.llm import pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


RULES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (rule, ok) in enumerate(RULES) for m in re.finditer(rule, text) if ok(m[0]))


def test_base_spans_match_plain_patterns():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", "d.e", "x@y.z", ".", "1", "25", "255", "256", "1.2.3.4", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-2030", "+", " ", "-", "(", "é", "٣", "\n", "%", "5"]
    for _ in range(20000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 12)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@b" * 50_000, "+1" + "(" * 100_000):
        pii.base_spans(text)
        pii.candidates(text, [])


def test_candidates_do_not_overlap_base_spans():
    rng = random.Random(3)
    bits = ["x@y.zz", " ", " ", "ab12", "1.2.3.4", ",", "id-99", "4111 1111 1111 1111", "+1 555 010 2030", "@", "abc"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 12)))
        base = pii.base_spans(text)
        for a, b in pii.candidates(text, base):
            assert b - a >= pii.LEAST_LENGTH and not any(x < b and a < y for x, _, y in base), text


def plain_contexts(text, items):
    """The words around each item by cutting the text anew for each."""
    def words(part):
        return [w for w in (c if c.isalpha() else "".join(x for x in c if x.isalpha()) or ("0" if any(x.isdigit() for x in c) else "") for c in part.lower().replace("ς", "σ").split()) if w]

    out = []
    for i, (start, end) in enumerate(items):
        left, at = ["^", "^"], 0
        for a, b in items[:i]:
            left += [*words(text[at:a]), "#"]
            at = max(at, b)
        left += words(text[at:start])
        rest = words(text[max(at, end) : items[i + 1][0] if i + 1 < len(items) else len(text)])
        after = rest[0] if rest else "#" if i + 1 < len(items) else "$"
        shape = pii.shape_of(text[start:end])
        out.append([pii.number_of("1", *left[-2:]), pii.number_of("2", left[-1], after), pii.number_of("3", left[-1], shape), pii.number_of("4", shape, after)])
    return out


def test_contexts_match_plain_cutting():
    rng = random.Random(4)
    bits = ["One", "two", " ", " ", "\n", " " * 70, "1 22 333 " * 12, "x" * 63, "y" * 70, "https://a.b/" + "c/" * 50, "-", "İ", "ΟΔΟΣ", "é", " 7@q.rs ", " 123456789 "]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 16)))
        base = pii.base_spans(text)
        items = sorted([(a, b) for a, _, b in base] + pii.candidates(text, base))
        got, _ = pii.contexts(text, items)
        assert [x[:4] for x in got] == plain_contexts(text, items), (text, items)
    for text in ("12345 " * 100_000, "a" * 300_000 + "@1" * 100_000, "a@b.c," * 60_000, " " * 300_000 + "12345 " * 50_000, "word " * 200_000 + "a1234"):  # linear
        base = pii.base_spans(text)
        items = sorted([(a, b) for a, _, b in base] + pii.candidates(text, base))
        began = time.perf_counter()
        pii.contexts(text, items)
        assert time.perf_counter() - began < 30


def test_ordinary_words_in_a_pattern_are_counted():
    text = "call me at a@b.cc or call me at home or call me at 12 or me at z@b.cc"
    items = [(a, b) for a, _, b in pii.base_spans(text)]
    patterns, ordinary = pii.contexts(text, items)
    assert patterns[0][0] == patterns[1][0] and ordinary[patterns[0][0]] == 2  # home, 12
    assert pii.contexts("no items here", [])[0] == []


def test_shapes():
    assert pii.shape_of("+1 (017) 555-7713") == pii.shape_of("(555) 010-2030") == "d-d-4"
    assert pii.shape_of("1.2.3.4") == "d.d.d.d" and pii.shape_of("4111111111111111") == "16" and pii.shape_of("QX-7781-ZZ") == "a-4-a"
    assert pii.shape_of("me.x@y.org") == pii.shape_of("me@localhost") == "a@a" and pii.shape_of("@me") == "@a"


def graph_by_hand(edges, instances, ordinary):
    """The rounds of scores by plain loops."""
    patterns = {}
    for p, i in edges:
        patterns.setdefault(p, set()).add(i)
    score = {i: 1.0 if seed else prior for i, (seed, prior) in instances.items()}
    for _ in range(pii.ROUNDS):
        conf = {p: sum(score[i] for i in x) / (len(x) + ordinary.get(p, 0) + pii.DOUBT) for p, x in patterns.items()}
        for i, (seed, prior) in instances.items():
            best = max([conf[p] for p, x in patterns.items() if i in x and len(x) >= pii.LEAST_INSTANCES], default=0.0)
            score[i] = 1.0 if seed else max(prior, best)
    return conf, score


def test_graph_scores_match_plain_loops(spark):
    rng = random.Random(6)
    edges = sorted({(rng.randrange(20), rng.randrange(60)) for _ in range(260)})
    instances = {i: (rng.random() < 0.3, rng.choice([0.0, 0.5])) for i in {i for _, i in edges}}
    ordinary = {p: rng.randrange(1, 9) for p in range(0, 20, 3)}
    frames = (edges, "pattern bigint, instance bigint"), ([(i, *x) for i, x in instances.items()], "instance bigint, seed boolean, prior double"), (list(ordinary.items()), "pattern bigint, n bigint")
    conf, score = graph_by_hand(edges, instances, ordinary)
    patterns, scores = pii.score_graph(*(spark.createDataFrame(rows, schema) for rows, schema in frames))
    assert {r.pattern: round(r.confidence, 9) for r in patterns.collect()} == {p: round(c, 9) for p, c in conf.items()}
    assert {r.instance: round(r.score, 9) for r in scores.collect()} == {i: round(s, 9) for i, s in score.items()}


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"Please my account is user{i}@mail.example.org now") for i in range(12)]
    rows += [(50, "Please my account is QX-7781-ZZ, now"), (51, "we bought the car7781 in may"), (52, "Please my account is nothing"), (None, None), (53, ""), (50, "Please my account is QX-7781-ZZ, now")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, start int, key string")
    got = pii.scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[50].spans == "context:21:31" and by[51].spans == "" and by[52].spans == ""
    assert sum(r.spans == "context:21:31" for r in got) == 2
    assert by[0].spans == "email:21:43" and by[0].base_sha256 == hashlib.sha256(b"email:21:43").hexdigest()
    assert pii.scan(df.where("false")).count() == 0


def test_planted_unseen_kinds_recall_and_precision(spark):
    """Passports, handles, phones without a plus and mistyped cards after the words that emails, phones and cards stand after; years, versions and counts elsewhere."""
    rng = random.Random(8)
    words = "the of a on with river market seven green house while many people left early from it was".split()
    filler = lambda: " ".join(rng.choices(words, k=12))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    rows, wanted, harmless = [], {}, {}

    def plant(label, value, at):
        text = f"{filler()} {label} {value} {filler()}"
        rows.append((len(rows), text))
        if at is not None:
            at[len(rows) - 1] = (text.index(value), text.index(value) + len(value))

    for i in range(150):
        plant("contact me at", f"user{i}@mail.example.org", None)
        plant("my number is", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", None)
        plant("paid by card", "4111111111111111" if i % 3 else "5500005555555559", None)
    for i in range(40):
        plant("contact me at", f"@friend{i}x", wanted)
        plant("my number is", f"({digits(3)}) {digits(3)}-{digits(4)}", wanted)
        plant("my number is", f"AB{digits(6)}", wanted)
        plant("in the year", f"{1950 + i}-{1951 + i}", harmless)
        plant("version", f"v1.{i}.{digits(3)}", harmless)
        plant("of the", f"{digits(3)},{digits(3)}", harmless)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("context")] for r in pii.scan(df).collect()}
    found = sum(wanted[i] in got[i] for i in wanted)
    marked = sum(map(len, got.values()))
    assert found >= 0.9 * len(wanted) and found >= 0.95 * marked, (found, len(wanted), marked, sum(bool(got[i]) for i in harmless))

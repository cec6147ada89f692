"""PII by fixed forms and bootstrapped contexts.

Fixed forms (email, ip, card, phone) are found in each text, leftmost and not overlapping for each kind. They are the
seeds. What stands around a seed induces lexical patterns, from the exact to the general: the two words before it; the word before and
the word after; the word before and the token's shape; the shape and the word after; the kinds of the characters on both sides and the
shape. Other tokens with a digit or an at sign, and groups of digits that belong together, are candidates, with the same patterns. Spark
builds the graph of patterns and instances and scores it in rounds. A pattern's confidence is the share of its instances' scores, where
ordinary words that stand in its place (in the texts that have one of its instances) and ``DOUBT`` more count as instances of score 0. An
instance's score is the confidence of its best pattern, 1 for a seed, and at least ``RESEMBLANCE`` for a candidate with the shape of
``LEAST_INSTANCES`` seeds. Patterns with enough distinct instances and confidence then mark their candidates as ``context``.

Null texts count as empty. Null doc_ids and repeated rows each get a result: spans go by a key of id and text. An empty
table gives no rows; other columns are not read. Ties cannot arise: scores depend on the graph only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, DOUBT, RESEMBLANCE, LEAST_INSTANCES, LEAST_CONFIDENCE = 3, 2.0, 0.5, 3, 0.5
#: The least length of a candidate.
LEAST_LENGTH = 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_GROUPS = re.compile(r"\(?[0-9][0-9().-]*+(?: \(?[0-9][0-9().-]*+)+(?!\S)")
_EDGE = "()[]{}<>\"'.,;:!?|"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign with a domain back to where the local part begins; time in proportion to the text."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def letters_of(part: str) -> str:
    """The word that a part between white space counts as: its letters, 0 for digits alone, nothing for signs alone."""
    if part.isalpha():
        return part
    return "".join(c for c in part if c.isalpha()) or ("0" if any(c.isdigit() for c in part) else "")


def shape_of(token: str) -> str:
    """What a token is made of. Digits, spaces and signs: the groups' lengths (1 to 3 count alike; a leading plus takes its group away). With an at sign:
    what stands around it. Others: letters as one, and the lengths of groups of digits.
    """
    if "@" in token:
        left, _, right = token.partition("@")
        return f"{'a' if left else ''}@{'a' if right else ''}"
    if not any(c.isalpha() for c in token):
        body = re.sub(r"^\+[0-9]+", "", token)
        groups = re.findall(r"[0-9]+", body)
        return (".".join if "." in body else "-".join)(["d" if len(n) < 4 else str(len(n)) for n in groups])
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "d" if len(m[0]) < 4 else str(len(m[0])), token))[:64]


def class_of(char: str) -> str:
    """The back-off of a neighbour: kind of its nearest character."""
    return "^" if not char else "w" if char.islower() else "W" if char.isalpha() else "d" if char.isdigit() else char if char in ":=#" else "s"


def number_of(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def contexts(text: str, items: list[tuple[int, int]]) -> tuple[list[list[int]], dict[int, int]]:
    """The five patterns of each item, by start, and how many ordinary words stand in the text where the patterns without a shape have their item.

    The patterns: two words before; word before and word after; word before and shape; shape and word after; kinds of the characters before
    and after and shape. Words are lower-case letters; an item counts as one sign. The text is read once.
    """
    words: list[str] = ["^", "^"]
    at, place, edges = 0, [], []
    for start, end in [*items, (len(text), len(text))]:
        gap = text[at:start]  # the lower-case form of a letter does not hang on the cut
        words += [w for w in map(letters_of, gap.lower().replace("\u03c2", "\u03c3").split()) if w]
        shorn = gap.strip()
        edges.append((shorn[:1] or ("#" if at and start < len(text) else ""), shorn[-1:] or ("#" if at else "")))
        place.append(len(words))
        words.append("#")
        at = max(at, end)
    words[-1] = "$"
    out, free = [], {}
    for i, (start, end) in enumerate(items):
        k, shape = place[i], shape_of(text[start:end])
        before, after = words[k - 1], words[k + 1]
        two, around = (words[k - 2], before), (before, after)
        free[1, two] = number_of("1", *two)
        free[2, around] = number_of("2", *around)
        out.append([free[1, two], free[2, around], number_of("3", before, shape), number_of("4", shape, after), number_of("5", class_of(edges[i][1]), shape, class_of(edges[i + 1][0]))])
    ordinary: dict[int, int] = {}
    for k in range(2, len(words) - 1):
        if words[k] != "#":
            for key in ((1, (words[k - 2], words[k - 1])), (2, (words[k - 1], words[k + 1]))):
                if key in free:
                    ordinary[free[key]] = ordinary.get(free[key], 0) + 1
    return out, ordinary


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign that overlap no base span, without the signs at their ends; groups of digits with one space between are one."""
    out, done, i = [], 0, 0
    reach = list(accumulate((t[2] for t in taken), max))  # by start; no span before i ends after the token's start
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        if whole := _GROUPS.match(text, start):
            end = whole.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        done, first = end, start
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if start > first and text[start - 1] == "(" and text.find(")", start, end) >= 0:
            start -= 1  # the bracket closes within
        while i < len(reach) and reach[i] <= start:
            i += 1
        if end - start >= LEAST_LENGTH and (i == len(taken) or taken[i][0] >= end):
            out.append((start, end))
    return out


FOUND = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<struct<start:bigint,kind:int,end:bigint>>, "
    "seen array<struct<patterns:array<bigint>,instance:bigint,shape:bigint,seed:boolean,start:bigint,end:bigint>>, ordinary array<struct<pattern:bigint,n:bigint>>"
)
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SEEN = pa.list_(pa.struct([("patterns", pa.list_(pa.int64())), ("instance", pa.int64()), ("shape", pa.int64()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))
_ORDINARY = pa.list_(pa.struct([("pattern", pa.int64()), ("n", pa.int64())]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(df: DataFrame) -> DataFrame:
    """One row for each row: key, doc_id, base spans and counts, seeds and candidates with their patterns, and ordinary words in these patterns."""
    source = common.texts_of(df)
    kind = source.schema["doc_id"].dataType.simpleString()

    def seen(text: str, base: list[tuple[int, int, int]]) -> tuple[list[dict], list[dict]]:
        items = sorted([(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in candidates(text, base)])
        if not items:
            return [], []
        patterns, ordinary = contexts(text, [i[:2] for i in items])
        rows = [{"patterns": p, "instance": number_of(text[a:b].lower()), "shape": number_of(shape_of(text[a:b])), "seed": s, "start": a, "end": b} for (a, b, s), p in zip(items, patterns)]
        return rows, [{"pattern": p, "n": n} for p, n in ordinary.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, texts = common.column(batch, "doc_id"), common.column(batch, "text").to_pylist()
            base = [base_spans(t) for t in texts]
            found = [seen(t, spans) for t, spans in zip(texts, base)]
            counts = [[sum(s[1] == k for s in spans) for spans in base] for k in range(4)]
            arrays = [
                pa.array([xxhash.xxh3_128_digest(f"{i}:{t}".encode("utf-8", "surrogatepass")) for i, t in zip(ids.to_pylist(), texts)], pa.binary()), ids,
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]),
                pa.array([[dict(zip(("start", "kind", "end"), s)) for s in spans] for spans in base], _BASE),
                pa.array([f[0] for f in found], _SEEN), pa.array([f[1] for f in found], _ORDINARY),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen", "ordinary"])

    return source.mapInArrow(run, f"key binary, doc_id {kind}, {FOUND}")


def score_graph(edges: DataFrame, instances: DataFrame, ordinary: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence, instances) and (instance, score) from written tables: distinct edges (pattern, instance), instances (instance, seed, prior)
    and counts (pattern, n) of ordinary words.

    Each round is a join on instances and a sum by pattern, then a join on patterns and a maximum by instance; no group is
    gathered, hot instances and patterns are joined apart, and each round's scores are written.
    """
    scores = common.written(instances.select("instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("prior")).alias("score")), "instances")
    for _ in range(rounds):
        summed = common.keyed_join(edges, scores, "instance").groupBy("pattern").agg(F.sum("score").alias("score"), F.count("*").alias("instances"))
        trust = F.col("score") / (F.col("instances") + F.coalesce("n", F.lit(0)) + F.lit(DOUBT))
        patterns = common.written(summed.join(ordinary, "pattern", "left").select("pattern", trust.alias("confidence"), "instances"), "patterns")
        trusted = patterns.where(F.col("instances") >= LEAST_INSTANCES)
        best = common.keyed_join(edges, trusted, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        score = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.greatest("prior", F.coalesce("best", F.lit(0.0))))
        scores = common.written(instances.join(best, "instance", "left").select("instance", score.alias("score")), "instances")
    return patterns, scores


def discovered(found: DataFrame, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(key, learned): candidates that stand in a trusted pattern."""
    seen = found.select("key", F.explode("seen").alias("s")).select("key", "s.*")
    places = common.written(seen.select("key", "instance", "shape", "seed", "start", "end", F.explode("patterns").alias("pattern")), "places")
    edges = common.written(places.select("pattern", "instance").distinct(), "edges")
    ordinary = common.written(found.select("key", F.explode("ordinary").alias("o")).distinct().groupBy("o.pattern").agg(F.sum("o.n").alias("n")), "ordinary")
    marked = common.written(places.groupBy("instance").agg(F.max("seed").alias("seed"), F.min("shape").alias("shape")), "marked")
    shapes = marked.where("seed").groupBy("shape").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= LEAST_INSTANCES)
    alike = common.keyed_join(marked, shapes, "shape", "left")
    instances = common.written(alike.select("instance", "seed", F.when(F.col("seeds").isNotNull(), F.lit(RESEMBLANCE)).otherwise(F.lit(0.0)).alias("prior")), "priors")
    patterns, scores = score_graph(edges, instances, ordinary)
    trusted = patterns.where((F.col("confidence") >= least_confidence) & (F.col("instances") >= LEAST_INSTANCES)).select("pattern")
    free = common.written(places.where("NOT seed").select("key", "instance", "start", "end", "pattern"), "free")
    near = common.written(common.keyed_join(free, trusted, "pattern").select("key", "instance", "start", "end").distinct(), "near")
    likely = common.keyed_join(near, scores.where(F.col("score") >= least_confidence), "instance")
    span = F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")
    return likely.groupBy("key").agg(F.collect_set(span).alias("learned"))


def as_text(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context, n_spans) for each row."""
    common.without_shuffle_files(df.sparkSession)
    found = common.written(find(df), "pii")
    extra = discovered(found, least_confidence)
    every = F.concat("base", F.coalesce("learned", F.expr("CAST(array() AS array<struct<start:bigint,kind:int,end:bigint>>)")))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    return common.keyed_join(found, extra, "key", "left").select("doc_id", *counts, "base_sha256", as_text(every).alias("spans"), F.coalesce(F.size("learned"), F.lit(0)).cast("bigint").alias("n_context"), F.size(every).cast("bigint").alias("n_spans"))

"""Secret scans with DataFrame functions only.

Fixed forms (assignments, access keys, hex runs) come from patterns; where each match stands follows from running totals of
the lengths of the matches and of what lies between. The learned form: two character Markov models of first order, one of
random strings and one of ordinary identifiers, trained on labelled samples. Random: values that the fixed forms find and
strings from digests in the alphabets that keys are written in. Ordinary: words of the corpus and common words of
identifiers, by themselves and joined to names, paths, dates, versions and numbers, and the corpus's names with short
numbers. Spark counts pairs of neighbouring characters. Each run of 16 or more characters, whatever it is made of, is judged
by the mean log-likelihood ratio of its pairs; the ratio from which it is marked ``markov`` comes from a fifth of the samples
that the models were not trained on: what all but one in a hundred random ones reach, or more where that many ordinary ones
(over one in a thousand) do.

Null texts count as empty. Null doc_ids and repeated rows pass through, each with its own result; an empty table gives no rows;
other columns are not read. A corpus without words leaves the common words and the digests to learn from. Equal spans of
two kinds both stay; a learned span that overlaps one of a fixed form does not. Work grows with a text's length and its
matches; no match is compared with all others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: kind: pattern of Java's regular expressions. A match's value is its group 2, or all of it.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs that the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Words, and names of words with short numbers, from which the ordinary samples come. Longer runs of letters are judged, so they are no samples.
WORD = r"(?<![A-Za-z0-9])[A-Za-z]{2,15}+(?![A-Za-z0-9])"
NAME = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,15}+(?:[_/-][A-Za-z]{2,15}+|[_/-]?[0-9]{1,4}+(?![A-Za-z]))*+(?![A-Za-z0-9+/_=-])"
#: Whatever has a span matches this.
MAY = r"""[0-9a-f]{16}|AKIA[A-Z0-9]|[A-Za-z0-9+/_=-]{16}|(?i:pass|secret|token|api)"""
KINDS = ("assign", "access", "hex", "markov")
LEARNED = KINDS.index("markov")
LEAST_VALUE = 12
#: Characters that count as themselves; others share one class.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CLASSES = len(ALPHABET) + 1
#: Words that identifiers are often made of: ordinary samples for a corpus that has few of its own.
COMMON_WORDS = (
    "account address admin alpha amount application archive array backup base batch beta block branch buffer build bundle cache calendar catalog category channel chapter child class client cloud cluster code column "
    "command comment common config connection container content context control copy core count country create currency current customer data database date default delete description device directory display document "
    "domain download draft email engine entity entry environment error event example export factory feature field figure file filter final folder form format frame function global graph group handler header height "
    "history home host identifier image import index info input instance internal invoice item iteration journal label language layer length level library license limit link list local location logger machine main "
    "manager master member memory message method metric mobile mode model module month name network node notes number object offset operation option order output package page parameter parent part path payment "
    "people period phone platform player plugin point policy position post prefix price print private process product profile program project property public python quantity query queue quick random range record "
    "region release report request resource response result review role root route sample schema scope script search section selected sequence server service session setting shared simple single site size source "
    "stage standard start state static status storage stream string style subject summary support system table target task team template temp test text thread time title total transaction type update upload user "
    "utility value variable vendor version video view volume warehouse week weight width window worker workspace writer year"
)

SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"
#: Entries that ``running`` folds one after another.
FOLDED = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, also within its own lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each entry the merge of all before it. Entries lie in blocks of FOLDED; n of them cost about n * FOLDED + (n / FOLDED) ** 2 steps."""
    fold = lambda part: F.aggregate(part, zero, merge)

    def dealt(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLDED).cast("int")), lambda b: F.slice(v, b * FOLDED + 1, F.lit(FOLDED)))
        return let(blocks, lambda bs: let(F.transform(bs, fold), lambda sums: F.flatten(F.transform(bs, lambda part, b: let(fold(F.slice(sums, F.lit(1), b)), lambda base: within(part, base))))))

    def within(part: Column, base: Column) -> Column:
        return F.transform(part, lambda _, i: F.aggregate(F.slice(part, F.lit(1), i), base, merge))

    return let(values, lambda v: F.when(F.size(v) > 0, dealt(v)).otherwise(F.slice(v, F.lit(1), F.lit(0))))


def placed(text: Column, pattern: str, kind: int) -> Column:
    """An array of spans, one for each match, with code-point places: matches and the gaps between them in turn."""
    pairs = lambda gaps, matches: F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("match"), F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("own")))
    found = pairs(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def spans(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["gap"] + x["own"]), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["own"]).alias("end"), x["match"].alias("value")).cast(SPAN))

    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.expr(f"CAST(array() AS array<{SPAN}>)"))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed forms; assignments whose value is short have been dropped after matching."""
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    assigns = F.filter(placed(text, ASSIGN, 0), lambda s: F.length(value(s)) >= LEAST_VALUE)
    return F.concat(assigns, placed(text, ACCESS, 1), placed(text, HEX, 2))


def class_of(char: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at > 0, at - 1).otherwise(len(ALPHABET))


def pairs_of(token: Column) -> Column:
    """The class pairs of neighbouring characters, each as one number."""
    codes = F.transform(F.split(token, ""), class_of)
    return let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * CLASSES + b))


def train(samples: DataFrame) -> tuple[dict[int, float], float]:
    """The log-likelihood ratio of each class pair and the least mean ratio of a random string, from a table (random, token).

    Pairs are counted in four fifths of the samples, by hash; the rest sets the least ratio. At most two counts for each pair and two
    numbers reach the driver. Without samples of either kind there are no ratios.
    """
    known = samples.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(5)) == 0)
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in known.where("NOT held").select("random", F.explode(pairs_of(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect():
        counts[row["random"]][row["pair"]] = row["n"]
    if not counts[True] or not counts[False]:
        return {}, 0.0
    chances = [_log_chances(counts[k]) for k in (True, False)]
    ratios = {pair: chances[0][pair] - chances[1][pair] for pair in range(CLASSES * CLASSES)}
    judged = known.where(F.col("held") & (F.length("token") >= 16)).select("random", mean_ratio(F.col("token"), ratios).alias("ratio"))
    ordinary, random = judged.agg(F.expr("percentile(IF(random, NULL, ratio), 0.999)"), F.expr("percentile(IF(random, ratio, NULL), 0.01)")).first()
    return ratios, max(0.0, ordinary or 0.0, random or 0.0)


def _log_chances(counts: Mapping[int, int], backing: float = 4.0) -> list[float]:
    """Log chance of the second class after the first for each pair; rare firsts lean on how common the second is at all."""
    seconds = [0.5] * CLASSES
    for pair, n in counts.items():
        seconds[pair % CLASSES] += n
    shares = [n / sum(seconds) for n in seconds]
    out = []
    for first in range(CLASSES):
        row = [counts.get(first * CLASSES + k, 0) for k in range(CLASSES)]
        out += [math.log((n + backing * share) / (sum(row) + backing)) for n, share in zip(row, shares)]
    return out


def mean_ratio(token: Column, ratios: Mapping[int, float]) -> Column:
    # Catalyst folds the split and the cast into one constant array.
    table = F.split(F.lit(",".join(repr(float(ratios.get(p, 0.0))) for p in range(CLASSES * CLASSES))), ",").cast("array<double>")
    return let(pairs_of(token), lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda total, p: total + F.get(table, p)) / F.greatest(F.size(pairs), F.lit(1)))


def free(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span. Over all spans by start: the furthest end before and the nearest start after a token tell."""
    far = F.lit(1 << 62).cast("bigint")
    largest = lambda a, b: F.greatest(a, b)
    is_base = lambda s: s["kind"] != LEARNED

    def judged(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), largest)
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), -s["start"]).otherwise(-far))), -far, largest))
        both = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("end"), (-s).alias("start")))
        kept = F.filter(F.zip_with(spans, both, lambda s, x: F.struct(s.alias("span"), x.alias("base"))), lambda x: ~is_base(x["span"]) & (x["base"]["end"] <= x["span"]["start"]) & (x["base"]["start"] >= x["span"]["end"]))
        return F.transform(kept, lambda x: x["span"])

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(base, tokens)), judged)).otherwise(tokens)


def learned_spans(tokens: Column, base: Column, ratios: Mapping[int, float], least: float) -> Column:
    """The tokens that look random and do not overlap a base span."""
    return F.filter(free(tokens, base), lambda t: mean_ratio(t["value"], ratios) > F.lit(least)) if ratios else F.slice(tokens, F.lit(1), F.lit(0))


def random_strings(spark: SparkSession, count: int) -> DataFrame:
    """(token): strings from digests of numbers, in the alphabets of hex (both cases), base 64 (both forms), base 62, base 36 and letters."""
    whole = F.concat(*(F.unhex(F.sha2(F.concat_ws(":", F.lit(k), F.col("id")), 256)) for k in range(2)))
    coded = F.base64(whole)
    plain = F.translate(coded, "+/=\n\r", "")
    forms = [F.lower(F.hex(whole)), F.hex(whole), F.translate(coded, "=\n\r", ""), F.translate(F.translate(coded, "+/", "-_"), "=\n\r", ""), plain, F.upper(plain), F.lower(plain), F.translate(plain, "0123456789", "")]
    length = (F.lit(20) + F.col("id") % 30).cast("int")
    return spark.range(count).select(F.element_at(F.array(*forms), (F.pmod(F.col("id"), F.lit(len(forms))) + 1).cast("int")).substr(F.lit(1), length).alias("token"))


def ordinary_strings(words: DataFrame) -> DataFrame:
    """(token): names, paths, dates, versions and numbers made of each word of a bounded table (word), three that follow it by hash, and its hash's digits."""
    listed = words.unionByName(words.sparkSession.range(1).select(F.explode(F.array(*(F.lit(w) for w in COMMON_WORDS.split()))).alias("word"))).distinct()
    order = Window.orderBy(F.xxhash64("word"), "word")  # one task for a bounded table
    following = [F.coalesce(F.lead("word", k).over(order), F.col("word")).alias(n) for k, n in enumerate("bcd", 1)]
    drawn = lambda k, low, n: (F.lit(low) + F.pmod(F.xxhash64(F.lit(k), "a"), F.lit(n))).cast("string")
    two = lambda k, n: F.lpad(drawn(k, 1, n), 2, "0")
    a, b, c, d = (F.col(n) for n in "abcd")
    rows = listed.select(F.col("word").alias("a"), *following).select("*", drawn(1, 1980, 60).alias("year"), two(2, 12).alias("month"), two(3, 28).alias("day"), drawn(4, 1, 20).alias("few"), drawn(5, 0, 10**6).alias("many"), drawn(6, 10**12, 9 * 10**12).alias("long"))
    day = lambda sign: F.concat_ws(sign, "year", "month", "day")
    forms = [
        F.concat_ws("_", a, b, c), F.concat_ws("_", a, b, "year", c, F.concat(F.lit("v"), "few")), F.concat_ws("_", a, b, day("-"), F.concat(F.lit("version"), "few")), F.concat_ws("-", a, b, c, "few"), F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)),
        F.upper(F.concat_ws("_", a, b, c)), F.concat(F.lit("/"), F.concat_ws("/", a, b, c, d)), F.concat(F.lit("/"), F.concat_ws("/", a, F.concat(b, "few"), F.concat_ws("-", c, d))), F.concat_ws("/", a, "year", "month", F.concat_ws("-", b, "many")),
        F.concat(day("-"), F.lit("T"), two(11, 23), two(12, 59), two(13, 59), F.lit("Z")), F.concat(day(""), two(11, 23), two(12, 59), two(13, 59)), F.concat(F.upper(F.substring(a, 1, 4)), "long"), F.concat(F.upper(F.substring(a, 1, 4)), "long", F.substring(b, 1, 2)), F.concat(F.initcap(a), F.lit("-"), "many", F.lit("-"), "long"),
        F.concat_ws("_", a, "many"), F.concat_ws("=", a, F.concat_ws("_", b, c)), F.concat(a, b, c), F.concat(F.upper(a), F.upper(b), F.upper(c)), F.concat_ws("-", F.initcap(a), F.initcap(b), F.initcap(c)), *(F.repeat(F.lit(sign), F.length(a) + 14) for sign in "-=_/"),
    ]
    return rows.select(F.explode(F.array(*forms)).alias("token"))


def labelled_samples(docs: DataFrame, found: DataFrame, sample_docs: int, sample_values: int, sample_words: int) -> DataFrame:
    """(random, token): the labelled samples, written. ``docs`` has (doc_id, text), ``found`` (doc_id, base).

    From the corpus come at most ``sample_values`` distinct values of the fixed forms, and of at most ``sample_docs`` documents at most
    ``sample_words`` distinct words and ``sample_values`` distinct names, each time those with the smallest hashes; ``sample_values`` random strings are made.
    """
    spark = docs.sparkSession
    least = lambda df, name, n: df.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.xxhash64(name), name).limit(n).select(name)
    secret = F.transform("base", lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
    values = found.where(F.size("base") > 0).select(F.explode(secret).alias("token")).where("token RLIKE '[0-9]' AND token RLIKE '[A-Za-z]' AND NOT token RLIKE '[_.-]'")
    taken = docs.join(F.broadcast(least(found.where("doc_id IS NOT NULL"), "doc_id", sample_docs)), "doc_id", "left_semi")  # bounded by sample_docs
    taken = common.written(taken.select(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for p, n in ((WORD, "words"), (NAME, "names")))), "names")
    words = least(taken.select(F.explode("words").alias("word")), "word", sample_words)
    names = least(taken.select(F.explode("names").alias("token")), "token", sample_values)
    random = least(values, "token", sample_values).unionByName(random_strings(spark, sample_values)).select(F.lit(True).alias("random"), "token")
    return common.written(random.unionByName(names.unionByName(ordinary_strings(words)).select(F.lit(False).alias("random"), "token")).coalesce(8), "samples")


def _found(df: DataFrame, *kept: Column | str) -> DataFrame:
    """``kept`` columns of (doc_id, text) rows with their ``base`` spans and ``tokens``, written."""
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    # A row without sixteen token characters in a run, or an assignment's sign after a word, cannot have a span.
    may = F.coalesce(F.col("text").rlike(MAY), F.lit(False))
    spans = [F.when(may, f).otherwise(none).alias(n) for f, n in ((base_spans(F.col("text")), "base"), (placed(F.col("text"), TOKEN, LEARNED), "tokens"))]
    return common.written(df.select(*kept, *spans), "secrets")


def scan(df: DataFrame, sample_docs: int = 1000, sample_values: int = 10_000, sample_words: int = 1000, least_ratio: float | None = None) -> DataFrame:
    """(doc_id, base, learned): arrays of (start, kind, end, value) for each row. ``least_ratio`` stands in for the learned threshold."""
    docs = common.texts_of(df)
    found = _found(docs, "doc_id")
    ratios, least = train(labelled_samples(docs, found, sample_docs, sample_values, sample_words))
    return found.select("doc_id", "base", learned_spans(F.col("tokens"), F.col("base"), ratios, least if least_ratio is None else least_ratio).alias("learned"))


def as_text(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(df: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for each row."""
    found = scan(df, **parameters)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.concat("base", "learned")).alias("spans"), F.size("learned").cast("bigint").alias("n_markov"),
    )


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each run of overlapping spans: what lies between is cut from its code points as 4 bytes each, and joined once."""
    zero = F.lit(0).cast("bigint")

    def cut(ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda s: s["end"]), zero, lambda a, b: F.greatest(a, b))
        gaps = F.filter(F.zip_with(ordered, ends, lambda s, e: F.struct(e.alias("from"), s["start"].alias("to"))), lambda g: g["to"] >= g["from"])
        last = F.struct(F.array_max(F.transform(ordered, lambda s: s["end"])).alias("from"), F.length(text).cast("bigint").alias("to"))
        piece = lambda points, g: F.decode(F.substring(points, (g["from"] * 4 + 1).cast("int"), ((g["to"] - g["from"]) * 4).cast("int")), "UTF-32")
        return let(F.encode(text, "UTF-32"), lambda points: F.array_join(F.transform(F.concat(gaps, F.array(last)), lambda g: piece(points, g)), mark))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), cut)).otherwise(text)


def redact(df: DataFrame, mark: str = "[SECRET]", sample_docs: int = 1000, sample_values: int = 10_000, sample_words: int = 1000) -> DataFrame:
    """The rows of ``df`` with each secret's characters replaced by a mark: texts are written with their spans, so patterns read them once.

    Equal texts get equal results, whatever their doc_id. Other columns stay; null texts stay null.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")  # no name of theirs can clash
    found = _found(df.select(kept, F.col("text")), "row").select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "base", "tokens")
    ratios, least = train(labelled_samples(found.select("doc_id", "text"), found, sample_docs, sample_values, sample_words))
    spans = F.concat("base", learned_spans(F.col("tokens"), F.col("base"), ratios, least))
    return found.select(*((without_spans(F.col("text"), spans, mark) if c == "text" else F.col("row").getField(c)).alias(c) for c in df.columns))

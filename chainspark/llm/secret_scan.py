"""Secret scans with two character Markov models, on DataFrame functions only.

Fixed patterns give the base spans.  Beside them, long runs of identifier characters are scored
by the log-likelihood ratio of two first-order character models, trained from labelled samples of
a bounded number of texts: what the base patterns find there and digests of the ids are labelled
random, all other words ordinary.  Runs whose ratio is ``MIN_RATIO`` or more a character pair, and
which touch no base span, are added as kind ``markov``.

Spans are counted in code points, end exclusive, from the lengths of what lies between matches.
Matches are handled in blocks, so a text with very many of them costs about as much a match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import documents

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WORD = r"[A-Za-z0-9+/_=-]{4,}"

KINDS = ("assign", "access", "hex", "markov")
TRAIN_DOCS = 2_000
#: Nats a character pair.  Random runs lie above (lower-case letters lowest), ordinary words below -1.
MIN_RATIO = 0.25
LEAN = 5.0
BLOCK = 128
_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(token: Column) -> Column:
    """Index of each character pair of a token in the transition table."""
    rest = F.substring(token, 2, 1 << 30)
    pairs = F.arrays_zip(_codes(F.substring(token, 1, F.length(token) - 1)).alias("a"), _codes(rest).alias("b"))
    return F.transform(pairs, lambda p: p["a"] * (len(ALPHABET) + 1) + p["b"])


def labelled_samples(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``t, random``: labelled strings of at most ``train_docs`` texts, drawn by a hash of the id over the whole table."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(train_docs)
    # Of an id that stands on several rows the least text counts, so the sample stays bounded.
    drawn = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = lambda p, group: F.regexp_extract_all("text", F.lit(p), F.lit(group))
    values = F.filter(F.concat(found(ASSIGN, 2), found(ACCESS, 0), found(HEX, 0)), lambda v: F.length(v) >= 6)
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 512)
    made = F.array(F.base64(F.unhex(digest)), digest, F.upper(F.translate(F.base64(F.unhex(digest)), "+/=", "XYZ")))
    bare = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        bare = F.regexp_replace(bare, pattern, " ")
    random = drawn.select(F.explode(F.concat(values, made)).alias("t"), F.lit(1).alias("random"))
    ordinary = drawn.select(F.explode(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0))).alias("t"), F.lit(0).alias("random")).distinct()
    return random.union(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each character pair, from labelled samples."""
    counted = samples.select("random", F.explode(_steps(F.col("t"))).alias("step")).groupBy("random", "step").count().collect()
    size = len(ALPHABET) + 1
    seen = [[0] * (size * size) for _ in range(2)]
    for row in counted:
        seen[row["random"]][row["step"]] += row["count"]
    cells = range(size)
    # A transition leans on how often its second character stands at all.
    alone = [[(sum(t[a * size + b] for a in cells) + 0.5) / (sum(t) + 0.5 * size) for b in cells] for t in seen]
    from_ = [[sum(t[a * size : (a + 1) * size]) for a in cells] for t in seen]
    chance = lambda label, k: math.log((seen[label][k] + LEAN * alone[label][k % size]) / (from_[label][k // size] + LEAN))
    return [chance(1, k) - chance(0, k) for k in range(size * size)]


def _blocks(rows: Column) -> Column:
    """An array cut into arrays of ``BLOCK``, the last one shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(BLOCK))
    return F.transform(starts, lambda i: F.slice(rows, i, BLOCK))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches of a pattern: start, kind, end, and the text of a group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern), F.length)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.transform(found, F.length).alias("size"), value.alias("text"))

    def laid(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end"), x["text"].alias("text"))
            return F.struct((begin + x["size"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(block, start, step, lambda acc: acc["spans"])

    # Blocks first get their own lengths, then their starts, and only then their spans.
    length = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"])
    sized = F.transform(_blocks(rows), lambda b: F.struct(b.alias("rows"), length(b).alias("length")))
    placed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = lambda of: F.aggregate(of, placed, lambda acc, b: F.struct((acc["at"] + b["length"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
    # One-element transform: the blocks are made once.
    some = F.transform(F.array(sized), lambda of: F.flatten(F.zip_with(of, starts(of), lambda b, at: laid(b["rows"], at))))
    return F.when(text.rlike(pattern), F.get(some, 0)).otherwise(F.array().cast(_SPAN))


def _random_runs(runs: Column, base: Column, weights: Column, min_ratio: float) -> Column:
    """Runs that look random and touch no base span; a block of runs meets only the spans around it."""
    ratio = lambda s: F.aggregate(_steps(s["text"]), F.lit(0.0), lambda acc, k: acc + F.get(weights, k))
    looks = F.filter(runs, lambda s: ratio(s) >= min_ratio * (F.length(s["text"]) - 1))

    def near(block: Column) -> Column:
        first, last = F.get(block, 0)["start"], F.element_at(block, -1)["end"]
        return F.filter(base, lambda b: (b["start"] < last) & (first < b["end"]))

    met = F.transform(F.filter(_blocks(looks), lambda b: F.size(b) > 0), lambda b: F.struct(b.alias("runs"), near(b).alias("near")))
    apart = lambda s, close: ~F.exists(close, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.flatten(F.transform(met, lambda m: F.filter(m["runs"], lambda s: apart(s, m["near"]))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, ratios: list[float] | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Per row ``doc_id, base, spans`` (arrays of start, kind, end, text), by start, then kind.

    A null or empty text has no spans.  Repeated rows are scanned alike; an empty table gives no
    rows.  Without ``ratios`` the models are trained on samples of ``docs``.
    """
    table = ",".join(repr(x) for x in (train(labelled_samples(docs)) if ratios is None else ratios))
    weights = F.split(F.lit(table), ",").cast("array<double>")
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["text"]) >= 6).alias("assign"),
        _spans(text, ACCESS, 1).alias("access"),
        _spans(text, HEX, 2).alias("hex"),
        _spans(text, RUN, 3).alias("runs"),
    )
    rows = rows.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    added = _random_runs(F.col("runs"), F.col("base"), weights, min_ratio)
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        count(3).alias("n_markov"),
    )

"""License scans, on DataFrame functions only.

A text is read in overlapping windows a little longer than the license templates, so that each
passage of a template's length lies whole in one window.  MinHash bands of one row each retrieve
templates: with ``BANDS`` bands, a window that holds 80 % of a template's shingles (Jaccard 0.35 or
more by the window sizes below) meets it with probability over 0.999999.  Exact containment of the
template's five-word shingles then verifies each meeting.  Texts that share no shingle with any
template cannot contain 80 % of one and are not windowed.

Templates are a table of any size: they meet the documents in blocks of a bounded number of shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.common import SHINGLE, SIMILARITY_PERCENT, ascii_lower, documents
from chainspark.llm.license_texts import TEMPLATES
from chainspark.llm.line_dedup import BLANKS

BANDS = 32
#: Shingles of the templates that meet the documents at once; a longer template is a block alone.
BLOCK_SHINGLES = 20_000
FOUND = "doc_id long, template string, start_word long, containment double"


def sizes_for(longest: int) -> list[int]:
    """Window sizes in words, each half as long again, until the longest template has room."""
    out = [8]
    while out[-1] < _wanted(longest):
        out.append(-(-out[-1] * 3 // 2))
    return out


def _wanted(words: int) -> int:
    """Words of the window that a template needs: room for a third more, three at least."""
    return max(words + 3, -(-words * 4 // 3))


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; a shorter text is one, an empty one has none."""
    bare = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    words = F.transform(F.split(bare, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))
    # One-element transform: the words are hashed once and shared by all shingles; missing words add nothing.
    of = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    last = lambda w: F.greatest(F.size(w) - SHINGLE, F.lit(0))
    hashed = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: of(w, i)))
    return F.when(F.length(bare) > 0, F.get(hashed, 0)).otherwise(F.array().cast("array<long>"))


def _bands(held: Column, bands: int) -> Column:
    def least(band: int) -> Column:
        return F.array_min(F.transform(held, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*[least(b) for b in range(bands)])


def default_templates(spark: SparkSession) -> DataFrame:
    """``template, text``: several wordings may share a name."""
    rows = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(t).alias("text")) for n, t in TEMPLATES])
    return spark.range(1).select(F.inline(rows))


def _blocks(held: DataFrame, block_shingles: int) -> list[list[str]]:
    """Names and sizes of templates, packed in order into blocks; the names alone reach the driver."""
    out: list[list[str]] = []
    room = 0
    for r in held.groupBy("template").agg(F.sum(F.size("wanted")).alias("n")).orderBy("template").toLocalIterator():
        if not out or room < r["n"]:
            out.append([])
            room = max(block_shingles, r["n"])
        out[-1].append(r["template"])
        room -= r["n"]
    return out


def _find(rows: DataFrame, held: DataFrame, percent: int, bands: int) -> DataFrame:
    """Matches of one block of templates in ``rows`` (``doc_id, s``)."""
    lengths = sorted(r["n"] for r in held.select("n").distinct().collect())
    sizes = sizes_for(lengths[-1])
    size_of = {n: next(s for s in sizes if s >= _wanted(n)) for n in lengths}
    # Every window size, with a stride that leaves each passage of the size's longest template whole.
    cuts = [(size, size - max(n for n in lengths if size_of[n] == size) + 1) for size in sorted(set(size_of.values()))]
    known = held.select(F.explode("wanted").alias("x")).distinct().collect()
    mine = F.expr(f"exists(s, x -> x in ({','.join(str(r['x']) for r in known)}))")
    held = held.withColumn("size", F.element_at(F.expr(f"map({','.join(f'{n},{s}' for n, s in size_of.items())})"), F.col("n")))

    def windows(size: int, stride: int) -> Column:
        span = size - SHINGLE + 1
        starts = F.sequence(F.lit(0), F.greatest(F.size("s") - span + stride - 1, F.lit(0)), F.lit(stride))
        return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("start"), F.slice("s", i + 1, span).alias("held")))

    cut = rows.where(mine).select("doc_id", F.explode(F.flatten(F.array(*[windows(*c) for c in cuts]))).alias("w")).select("doc_id", "w.*").where(F.size("held") > 0)
    keyed = cut.select("doc_id", "size", "start", "held", F.posexplode(_bands(F.col("held"), bands)).alias("band", "least"))
    index = held.select("template", "wanted", "size", F.posexplode(_bands(F.col("wanted"), bands)).alias("band", "least"))
    met = keyed.join(F.broadcast(index), ["size", "band", "least"])
    share = F.size(F.array_intersect("wanted", F.col("held"))) / F.size("wanted")
    checked = met.select("doc_id", "template", F.col("start").cast("long").alias("start"), share.alias("containment"))
    return checked.where(F.col("containment") * 100 >= percent)


def find_licenses(
    docs: DataFrame, templates: DataFrame, percent: int = SIMILARITY_PERCENT, bands: int = BANDS, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """``doc_id, template, start_word, containment``: each document's best window of a template.

    Containment is the share of the template's distinct shingles found in the window; ties go to
    the first window.  Null or empty texts and templates match nothing, nor do rows with a null id;
    rows of one id are one document; empty tables give no rows.  Wordings that share a name are one
    template, whose best wording counts.
    """
    whole = shingles(F.col("text"))
    held = templates.where("template is not null").select("template", F.array_distinct(whole).alias("wanted"), (F.size(whole) + SHINGLE - 1).alias("n"))
    held = held.where(F.size("wanted") > 0)
    rows = docs.where("doc_id is not null").select("doc_id", whole.alias("s"))
    found = docs.sparkSession.createDataFrame([], "doc_id long, template string, start long, containment double")
    for names in _blocks(held, block_shingles):
        found = found.unionByName(_find(rows, held.where(F.col("template").isin(names)), percent, bands))
    best = found.groupBy("doc_id", "template").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "template", (-F.col("b.back")).alias("start_word"), F.col("b.containment").alias("containment"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir), default_templates(spark))

"""The pipeline against a brute-force version of its stages, on an empty table, and the registered names."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from chainspark.llm.queries import QUERIES
from chainspark.llm.quality import classify
from chainspark.llm.sentencepiece_codec import default_model

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def near_losers(texts):
    sets = {i: frozenset(shingles(words_of(t))) for i, t in texts.items()}
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i for i in texts if root(i) != i}


def leaked(texts, items):
    out = set()
    bags = [(len(words_of(t)), shingles(words_of(t))) for t in items if words_of(t)]
    for i, t in texts.items():
        line = shingles(words_of(t))
        for n, item in bags:
            known, size = set(item), len(item)
            near = [x in known for x in line]
            if sum(near) < 0.8 * min(size, len(line)):
                continue
            windows = [line] if len(line) <= size else (line[k : k + size] for k in range(len(line) - size + 1) if any(near[k : k + size]))
            want = Counter(item)
            if any((Counter(x) & want).total() >= 0.8 * (Counter(x) | want).total() for x in windows):
                out.add(i)
                break
    return out


def test_pipeline_rows(spark):
    """All but the classifier's decisions (a fitted model) are worked out anew in plain Python."""
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    assert 0.5 * docs.count() < len(texts) < docs.count()
    last = {}
    for i in sorted(texts):
        last[texts[i] or ""] = i
    texts = {i: texts[i] for i in last.values()}
    texts = {i: t for i, t in texts.items() if i not in near_losers(texts)}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = leaked(texts, items)
    texts = {i: t for i, t in texts.items() if i not in gone}
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = library.encode(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else ""))
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert len(rows) == len(got) and got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import random
import re
from collections import Counter
from hashlib import sha256
from itertools import product
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainspark.llm import conversation_repair as repair
from chainspark.llm import spelling, token_counts

DOCS = "doc_id long, text string"


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def model():
    return token_counts.default_model()


@pytest.fixture(scope="module")
def library(model):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model)


def odd_texts(seed=5):
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<|endo", "ftext|>", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", " ", "\x85", "\x1c", "can't", "we'll", "'", "ab" * 40, "x" * 900, "12345", "é", "ǘ", "日本語", "😀", "🏳️‍🌈", "!!", "...", "\0", "word", "Longer", "_", "͏", "ᲀ", " "]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(150)]


def test_stretches_hold_whole_pieces_of_every_character(library):
    """A stretch's border is a border of the library's own pieces, for every code point there is."""
    scan = token_counts.Stretches(library.to_str())
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            text = f"a{c} {c}1{c}{c} b  {c}"
            ends = {0, *(e for _, (_, e) in library.pre_tokenizer.pre_tokenize_str(text))}
            at, found = 0, []
            for s in scan.split(text):
                at += len(s)
                found.append(at)
            assert ends.issuperset(found), hex(cp)


def test_token_counts_equal_the_library(spark, model, library):
    texts = odd_texts() + ["", None, "x" * 5000, " " * 5000, "a b " * 2000, ("y" * 700 + " ") * 9, "<|endoftext|>" * 300]
    rows = [(None if i % 40 == 7 else i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n_tokens": F.lit("clash"), "digest": F.lit(1), "value": F.lit(2)})
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows)
    for chunk, overlap in ((10**6, 8), (64, 8), (37, 2), (400, 50)):
        got = token_counts.count_tokens(docs, model, chunk, overlap)
        assert Counter(tuple(r) for r in got.collect()) == want, (chunk, overlap)


def test_special_strings_over_chunk_borders(spark, model, library):
    """White space before a special string that begins in the overlap, at every shift."""
    texts = ["w" * k + " " * 20 + "<|endoftext|> tail  " + "z" * 9 + " end" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, model, 40, 3).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


def test_token_counts_of_no_rows_and_of_other_models(spark, model):
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), model).count() == 0
    assert token_counts.over_limit(spark.createDataFrame([(1, 1, 1024), (2, 1, 1025)], token_counts.COUNTED)).where("over_limit").count() == 1
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.count_tokens(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json"))


# ----------------------------------------------------------- spelling variants


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_position_index_equals_brute_force():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(900)})
    index = spelling.PositionIndex(words)
    letters, sizes, first = spelling.code_points(words)
    found = set()
    for size in set(sizes.tolist()):
        rows = np.flatnonzero(sizes == size)
        q, w = index.near(letters[first[rows][:, None] + np.arange(size)])
        pairs = list(zip(rows[q].tolist(), w.tolist()))
        assert len(pairs) == len(set(pairs))
        found |= set(pairs)
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_apart(a, b)}


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def spelling_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("aeioustrÉé") for _ in range(rng.randrange(5, 10))) for _ in range(25)]
    rows = []
    for i in range(700):
        words = []
        for _ in range(rng.randrange(0, 80)):
            w = rng.choice(base[: rng.randrange(1, 26)])
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "t" + w[k:], w[:k] + "s" + w[k + 1 :], w.upper()])
            words.append(w)
        rows.append((i if i % 50 else None, rng.choice([" ", ", ", "\n", "×"]).join(words) if i % 60 else rng.choice([None, ""])))
    return rows + rows[:200] + [(1, "longword" * 300 + " ") , (2, "longword" * 300)] + [(k, "q" * 500 + " " + "q" * 501) for k in range(6)]


def test_spelling_variants_equal_brute_force(spark):
    rows = spelling_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"word": F.lit("clash"), "n": F.lit(1), "run": F.lit("x")})
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    want = brute_variants(rows)
    assert set(got) == want and len(got) == len(want)
    assert any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1]) or sum(1 for r in want if r[1]) > 20
    assert spelling.variants(docs.limit(0)).count() == 0


def test_a_hot_half_is_dealt_over_blocks(spark):
    """Every word shares its first half; pairs stay whole in blocks of few words."""
    words = sorted({"common" + "".join(p) for p in product("abc", repeat=5)} | {"common" + "".join(p) for p in product("ab", repeat=6)})
    table = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.near, r.near_n) for r in spelling.near_pairs(table, block=40).collect()]
    n = dict(zip(words, range(5, 5 + len(words))))
    assert len(got) == len(set(got)) and set(got) == {(a, b, n[b]) for a in words for b in words if one_apart(a, b)}


def test_roots_of_long_ways(spark):
    steps = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, root string")
    assert {r.root for r in spelling.ends(steps).collect()} == {"w21"}


# --------------------------------------------------------- conversation repair

LEGAL = re.compile("(s?(ua)+)?")


def exhaustive(symbols):
    """Cheapest edits of a few rows, by trying all of them."""
    gaps = [g for k in range(3) for g in product("ua", repeat=k)]
    best = None
    for inserts in product(gaps, repeat=len(symbols) + 1):
        for acts in product("DKua", repeat=len(symbols)):
            cost, audit, roles = 0, "", ""
            for i, gap in enumerate(inserts):
                cost, audit, roles = cost + 3 * len(gap), audit + "I" * len(gap), roles + "".join(gap)
                if i < len(symbols):
                    s, a = symbols[i], acts[i]
                    if s == "x" and a != "D":
                        break
                    audit += a if a in "DK" else "R"
                    cost += {"D": 4, "K": 0}.get(a, 3) + 3 * (s.isupper() and a != "D")
                    roles += {"D": "", "K": s.lower()}.get(a, a)
            else:
                if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def forward(symbols):
    """Cheapest edits from the first row to the last, whole audits compared."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def spread(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                new = (c + 3, a + "I")
                if step[q] not in best or new < best[step[q]]:
                    best[step[q]] = new
        return best

    best = spread({0: (0, "")})
    for s in symbols:
        new = {}

        def offer(q, value):
            if q not in new or value < new[q]:
                new[q] = value

        for q, (c, a) in best.items():
            offer(q, (c + 4, a + "D"))
            if s != "x":
                more = 3 * s.isupper()
                offer(step[q], (c + 3 + more, a + "R"))
                if s.lower() == "s" and q == 0:
                    offer(1, (c + more, a + "K"))
                elif s.lower() == {2: "u", 3: "a"}[step[q]]:
                    offer(step[q], (c + more, a + "K"))
        best = spread(new)
    return min(best[q] for q in (0, 3) if q in best)


def test_agenda_equals_all_edits_tried():
    rng = random.Random(2)
    few = ["", *"suaoxSUAO", "us", "Ux", "AU", "ss", "oo"] + ["".join(rng.choice("suaoxSUAO") for _ in range(3)) for _ in range(6)]
    for symbols in few:
        cost, edits, _ = repair.derive(symbols)[repair.START]
        assert (cost, "".join(e.letter for e in edits)) == exhaustive(symbols) == forward(symbols), symbols
    for _ in range(500):
        symbols = "".join(rng.choice("suauauaoxSUA") for _ in range(rng.randrange(0, 30)))
        cost, edits, _ = repair.derive(symbols)[repair.START]
        assert (cost, "".join(e.letter for e in edits)) == forward(symbols), symbols


def brute_repair(rows):
    """The query's rows from the original ones, in plain Python."""
    space = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = set()
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            end = text.strip(space)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
            seen.add((role, text))
        first = ["o" if r[1][:1] not in ("s", "u", "a") else r[1][0] for r in kept]
        symbols = "".join("x" if f in ("blank", "duplicate") else c.upper() if f else c for c, f in zip(first, faults))
        cost, audit = forward(symbols)
        lines, at, state = [], 0, ""
        for a in audit:
            made = "assistant" if state == "u" else "user"
            if a == "I":
                lines.append(f"{made}:")
            else:
                if a != "D":
                    lines.append(f"{kept[at][1] if a == 'K' else made}:{kept[at][2]}")
                at += 1
            if a != "D":
                state = lines[-1][0]
        turns = {r[0] for r in kept} - {None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        tally = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, *tally, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversation_rows():
    rng = random.Random(8)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rng.choice(["Fine.", "And so", "yes!  ", "", " \n", None, "why?\n", "\xa0", "long. " * 50])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    return rows + [(9000, t, "system" if t % 7 == 0 else "user" if t % 2 else "assistant", f"Line {t % 40}" + "." * (t % 3)) for t in range(400)]


ROWS = "conv_id long, turn long, role string, text string"


def test_repairs_equal_brute_force(spark):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, ROWS).withColumns({"segment": F.lit(1), "cost": F.lit("clash"), "place": F.lit(0)})
    got = [tuple(r) for r in repair.digests(*repair.repair(repair.damaged(table))).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_repair(rows)


def test_long_conversations_by_segments(spark):
    rng = random.Random(4)
    rows = conversation_rows()
    rows = [(c, t, r, x) for c, t, r, x in rows if c == 9000] + [(None, t, rng.choice(["user", "assistant", "system"]), f"t{t % 150}" + rng.choice([".", ""])) for t in range(300)]
    rows += [(7, None, "user", "Same.")] * 200 + [(8, 1, "user", "One."), (8, 2, "assistant", "Two.")]
    table = spark.createDataFrame(rows, ROWS)
    for segment in (4, 64, 4096):
        summaries = repair.repair(repair.damaged(table), most_rows=50, segment=segment)
        assert summaries[0].count() == 1
        got = [tuple(r) for r in repair.digests(*summaries).collect()]
        assert set(got) == brute_repair(rows) and len(got) == 4


def test_repair_of_no_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert repair.digests(*repair.repair(repair.damaged(empty))).count() == 0
    conv = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    one = repair.digests(*repair.repair(repair.damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], ROWS)))).first()
    assert tuple(one) == (conv, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())

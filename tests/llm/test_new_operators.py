"""Substring repeats, source divergence and periodic runs against plain loops."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from factsieve.llm import divergence, periodic_runs, queries, suffix_trees

WORD = re.compile("[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def write(spark, tmp_path, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def collected(df, *keys):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: [(r[k] is None, r[k]) for k in keys])


# ---- runs -----------------------------------------------------------------------------------------------------------------

def runs_of(w, least=6):
    """All diagonals, each whole stretch with its smallest period."""
    out = []
    for d in range(1, len(w)):
        i = d
        while i < len(w):
            s = i
            while i < len(w) and w[i] == w[i - d]:
                i += 1
            length = i - s + d
            if i > s and length >= max(least, 4 * d):
                x = w[s - d:i]
                if not any(all(x[j] == x[j - q] for j in range(q, len(x))) for q in range(1, d)):
                    out.append((s - d, length, d))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    kept = [w[i] for i in range(n) if not any(s + q <= i < s + m for s, m, q in runs)]
    return {"doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), "collapsed_sha256": sha(" ".join(kept))}


def run_texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "ab " * 50, "a b " * 3, "A a " * 4, "é\x0bé\ré é é é é", "x\x85y " * 8, "x\x1cy " * 8]
    for _ in range(120):
        w = []
        for _ in range(rng.randint(1, 14)):
            piece = [rng.choice("abcdéf"[:rng.choice([1, 2, 3, 6])]) * rng.randint(1, 2) for _ in range(rng.randint(1, 9))]
            w += piece * rng.choice([1, 1, 2, 4, 5, 8])
        out.append(rng.choice([" ", "\n", " \t"]).join(w) + rng.choice(["", " "]))
    return out


def test_runs_query_against_all_diagonals(spark, tmp_path):
    texts = run_texts()
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[20], "en", "s", 1), (None, texts[21], None, None, None)]
    got = collected(queries.op13(spark, write(spark, tmp_path, rows)), "doc_id", "runs_sha256", "collapsed_sha256")
    want = sorted([runs_row(r[0], r[1]) for r in rows], key=lambda r: [(r[k] is None, r[k]) for k in ("doc_id", "runs_sha256", "collapsed_sha256")])
    assert got == want
    assert sum(r["n_runs"] for r in got) > 100
    assert {zlib.crc32(str(r[0]).encode()) % 10 for r in rows if r[0] is not None} >= {0}  # some tails are planted


def test_runs_of_long_texts_and_ties(spark):
    line = "one two three four five "
    texts = {"word": "word " * 200_000, "line": line * 40_000 + "end", "tie": "a a a a a a b b b b b b", "nested": ("a b " * 4 + "c ") * 5}
    df = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "id string, text string, runs int")
    got = {r.id: r.r for r in df.select("id", periodic_runs.periodic_runs(F.col("text")).alias("r")).collect()}
    assert [tuple(x) for x in got["word"]["runs"]] == [(0, 200_000, 1)] and got["word"]["collapsed"] == "word"
    assert [tuple(x) for x in got["line"]["runs"]] == [(0, 200_000, 5)] and got["line"]["collapsed"] == line + "end"
    assert tuple(got["tie"]["strongest"]) == (0, 6, 1) and got["tie"]["collapsed"] == "a b"
    assert [tuple(x) for x in got["nested"]["runs"]] == runs_of(texts["nested"].split())
    assert spark.createDataFrame([], "text string").select(periodic_runs.periodic_runs(F.col("text")).alias("r")).count() == 0


# ---- repeated windows -----------------------------------------------------------------------------------------------------

def strip(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        hit = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(hit), " ".join(x for i, x in enumerate(w) if i not in hit)))
    return out


def repeat_texts():
    rng = random.Random(8)
    new = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))
    passage, whole = new(60), new(90)
    near = whole.split()
    near[44] = "CHANGED"
    out = [None, "", " \n", "one two", whole, whole, " ".join(near), new(34), " ".join(new(34).split() + ["x"]), "same " * 34, "same " * 35, "same " * 36,
           "same " * 200, "a b c " * 50]
    out += [f"{new(rng.randint(0, 60))}\n{passage}\t{new(rng.randint(0, 60))}" for _ in range(25)]  # a hot passage
    out += [new(20) + " " + " ".join(passage.split()[:34]), new(20) + " " + " ".join(passage.split()[:35]), "é " + passage + " é"]
    edge = new(35)
    out += [edge + " tail one", "head " + edge, new(100), new(30) + " " + edge + " " + edge.upper()]
    return out


@pytest.mark.parametrize("group_words", [1 << 20, 300])
def test_repeated_windows_against_all_windows(spark, group_words):
    texts = repeat_texts()
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ranges int").repartition(5)
    got = suffix_trees.remove_repeats(df, group_words=group_words).select("doc_id", "n_words", "n_removed", "kept").collect()
    want = [(r[0], *s) for r, s in zip(rows, strip(texts, 35))]
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)
    assert sum(w[2] for w in want) > 1500


def test_repeated_windows_split_to_whole_windows(spark):
    """A group whose suffixes agree in the longest prefix is counted, not loaded."""
    rng = random.Random(2)
    shared = " ".join(f"w{i}" for i in range(50))
    texts = [f"{rng.random()} {rng.random()} {shared} {rng.random()}" for _ in range(80)] + ["z " * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in suffix_trees.remove_repeats(df, group_words=40).collect()}
    assert [got[i] for i in range(len(texts))] == strip(texts, 35)
    assert suffix_trees.remove_repeats(df.limit(0)).count() == 0


def test_repeats_give_spans_and_keep_structured_texts_apart(spark):
    words = ["a"]
    for _ in range(10):
        words += ["b" if w == "a" else "a" for w in words]
    one = "".join(words)
    other = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, " ".join([one] + [f"x{i}" for i in range(34)])), (2, " ".join([other] + [f"x{i}" for i in range(34)]))],
                               "doc_id long, text string")
    assert suffix_trees.repeats(df).count() == 0
    longer = df.select("doc_id", F.concat("text", F.lit(" end"), F.when(F.col("doc_id") == 2, " more").otherwise("")).alias("text"))
    assert [[tuple(x) for x in r.ranges] for r in suffix_trees.repeats(longer).collect()] == [[(1, 36)], [(1, 36)]]


# ---- divergence -----------------------------------------------------------------------------------------------------------

def audit(rows, min_docs, top):
    texts = [((r[2] or ""), (r[3] or ""), [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(r[1] or "")]) for r in rows]
    docs, uses, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for lang, source, found in texts:
        groups[lang].add(source)
        docs.update({(lang, t) for t in found})
        uses.update((lang, source, t) for t in found)
    out = []
    for lang, sources in groups.items():
        kept = [t for (at, t), n in docs.items() if at == lang and n >= min_docs]
        p, whole = {}, {t: sum(uses[lang, s, t] for s in sources) for t in kept}
        share = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))
        for s in sources:
            total = sum(uses[lang, s, t] for t in kept)
            p[s] = {t: share(uses[lang, s, t], total) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s],
                     "term": [(p[s][t] - q[t], t) for t in kept if uses[lang, s, t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def audit_rows():
    rng = random.Random(4)
    words = ["the", "Of", "é", "ÉTÉ", "été", "x", "日本", "don't", "a1b", "Z"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S1", None, "s4", "s5"])
        pool = words if lang != "de" else words[:20]
        rows.append((i, rng.choice([" ", "\n", "_", "--"]).join(rng.choices(pool, weights=range(len(pool), 0, -1), k=rng.randint(0, 25))), lang, source, 1))
    return rows + [(1, None, "en", "null text", 1), (2, "", "en", "empty", 1), (3, "none kept", "xx", "a", 1), (None, "", "xx", "b", 1),
                   (5, "the the", "yy", "alone", 1), rows[0], rows[0]]


@pytest.mark.parametrize("sizes", [{}, {"tile_terms": 7, "block_groups": 2}, {"tile_terms": 1, "block_groups": 1}])
def test_audit_against_whole_matrices(spark, sizes):
    rows = audit_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, value long").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=3, top_terms=9, **sizes).collect())
    assert got == audit(rows, 3, 9)
    assert any(r[2] == "pair" and r[4] == 0 for r in got)


def test_audit_pieces_of_long_texts_and_empty_table(spark, monkeypatch):
    text = "Alpha beta, gamma_" * 2000
    want = TERM.findall(text.lower())
    monkeypatch.setattr(divergence, "PIECE_BYTES", 100)
    assert [t.decode() for piece in divergence.terms(text) for t in piece] == want
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).collect() == []


def test_audit_counts_beyond_64_bits(spark):
    """Shares of very large counts stay exact."""
    row = spark.sql("SELECT 9000000000000000L AS n, 27000000000000007L AS t, 1000L AS k").select(
        divergence.share(F.col("n"), F.col("t"), F.col("k")).alias("p")).first()
    assert row.p == 1 + 10**9 * (9000000000000000 + 5) // (27000000000000007 + 5000)

"""Operators over the whole corpus: near-duplicates, mixing, personal data, embeddings, and the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from factsieve.llm import components, minhash_forest, mixing, pii, projection_passes  # noqa: E402


def smallest_reachable(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in nodes:
        seen, stack = {n}, [n]
        while stack:
            for m in near[stack.pop()] - seen:
                seen.add(m)
                stack.append(m)
        out[n] = min(seen)
    return out


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    links += [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == smallest_reachable({x for p in real for x in p}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def near_copies(rng, count, edits=5):
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("bounds", [{}, {"region_sets": 12, "region_shingles": 10_000}])
def test_near_duplicates_against_brute_force(spark, bounds):
    rng = random.Random(2)
    texts = [t for n in (40, 15, 5, 2) for t in near_copies(rng, n)] + ["", None, " ", "A b", "a B", "a b c d e", "a b c d e f", "Éa b", "éa b"]
    texts += [" ".join(f"u{rng.randint(0, 10 ** 6)}" for _ in range(80)) for _ in range(20)] + [texts[0]] * 10
    rows = list(enumerate(texts)) + [(0, texts[0])]
    df = spark.createDataFrame(rows + [(None, texts[0])], "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    out = minhash_forest.near_duplicates(df, **bounds).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash_forest.near_duplicates(df.where("1 = 0")).count() == 0


def water_level(sizes, weights, share=1.5, most=2):
    """Shares given out again and again until no source is above its limit."""
    targets, open_, left = {}, set(sizes), share * sum(sizes.values())
    while True:
        unit = left / sum(weights[s] for s in open_) if open_ else 0
        over = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not over:
            return targets | {s: unit * weights[s] for s in open_}
        for s in over:
            targets[s] = most * sizes[s]
            left -= targets[s]
        open_ -= over


def test_mix_reaches_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 50, 300, 2000])), rng.choice(["a"] * 6 + ["b", "c", "é", None])) for i in range(600)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "x y z", "b"), (700, None, "d"), (701, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df, block_tokens=64, shard_docs=50).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7), block_tokens=64, shard_docs=50).collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = water_level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 64
    quotas = {(r.source, r.shard): r.quota for r in out}
    assert sum(quotas.values()) == round(sum(want.values()) / 64) or min(v for v in want.values() if v) < 64 * 200
    assert mixing.mix(df.where("1 = 0")).count() == 0


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(4)
    for trial in range(4):
        parties = [(1, i, rng.choice([0, 1, 3, 100, 5000]) * rng.random(), 10 ** 6, 37) for i in range(12)] + [(2, 0, 5.0, 3, 3), (2, 1, 1.0, 9, 3)]
        df = spark.createDataFrame(parties, "g int, k int, w double, cap long, seats long")
        got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], ["k"], "w", "cap", "seats").collect()}
        for g in (1, 2):
            own = [p for p in parties if p[0] == g]
            best = sorted(((-p[2] / (2 * j + 1), p[1], j) for p in own for j in range(min(p[3], 60))))[:own[0][4]]
            want = {(g, p[1]): sum(b[1] == p[1] for b in best) for p in own}
            assert {k: v for k, v in got.items() if k[0] == g} == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def passes(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
        return kind != "phone" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_personal_data_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab.-_@1234567890 +()é\U0001f600﷐%") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["", None, "a.b@c.de_x@y.zz 4111 1111 1111 1111 +1 (222) 333-4444 1.2.3.4.5.6.7.8 " * 20, "1" * 20000 + " " + "a" * 20000 + "@" + "b." * 9000]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "x a@b.cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = pii.find_spans(df).select("doc_id", "base", "spans", pii.written(F.col("base")).alias("w")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = base_spans("x a@b.cc" if r.doc_id is None else texts[r.doc_id])
        assert [tuple(s) for s in r.base] == want
        assert set(want) <= {tuple(s) for s in r.spans}
        assert r.w == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    for r in clean.collect():
        assert (r.text is None) == (r.doc_id == 151)
        assert r.text is None or not re.search(r"[a-z]@[a-z]+\.[a-z]", r.text)
    assert pii.find_spans(df.where("1 = 0")).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"hello there please write to user{i}@mail.example.com today") for i in range(12)]
    rows += [(20, "hello there please write to someone1(at)mail today"), (21, "we met on 2021-05-06 today"), (22, "call me at 77 now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert [tuple(s) for s in out[20].spans] == [("email", 28, 44)] and not out[20].base
    assert not out[21].spans and not out[22].spans
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[20] == "hello there please write to [EMAIL] today"


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows, at = [], 0
    for label, count in (("a", 60), ("b", 25), ("c", 3)):
        centre = rng.standard_normal(32)
        for _ in range(count):
            rows.append((at, (centre + 0.06 * rng.standard_normal(32)).tolist(), label))
            at += 1
    rows += [(at + i, rng.standard_normal(32).tolist(), "a") for i in range(40)]
    at += 40
    same = rows[0][1]
    rows += [(at + i, same, "a") for i in range(5)] + [(at + 10, same, "b"), (at + 11, same, None), (at + 12, None, "a"), (at + 13, [0.0] * 32, "a"),
             (at + 14, [1.0, None] * 16, "a"), (at + 15, [float("nan")] * 32, "a"), (at + 16, [float("inf")] * 32, "a"), (at + 17, [], "a"),
             (at + 18, [2 * x for x in same], "a"), (at + 19, [1.0, 2.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("n", F.lit("clash"))

    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = {i: (unit(v), lab) for i, v, lab in rows}
    links = [(a, b) for a, (u, x) in units.items() for b, (v, y) in units.items()
             if a < b and x is not None and x == y and u is not None and v is not None and len(u) == len(v) and u @ v >= 0.98]
    want, degree = smallest_reachable(units, links), defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for settings in ({}, {"window": 16, "block": 8}):
        out = projection_passes.near_duplicates(df, **settings).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], want[r.vec_id], r.vec_id == want[r.vec_id])
    assert projection_passes.near_duplicates(df.where("1 = 0")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    group = near_copies(rng, 9, 2)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(group)]
    rows += [(10 + i, " ".join(f"u{rng.randint(0, 10 ** 6)}" for _ in range(90)) + f" mail{i}@x.example.org", "en", rng.choice("abc"), 5) for i in range(30)]
    rows += [(50, "too short", "en", "a", 9), (51, None, "en", "b", 0), (52, "same line again\n" * 60, "en", "b", 0), rows[8], (None, rows[9][1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = docs.collect()
        if name == "quality_rules":
            assert not {50, 51, 52} & {r.doc_id for r in out} and len(out) == len(rows) - 3
        if name == "near_duplicates":
            ids = [r.doc_id for r in out]
            sets = {i: shingles(t) for i, t in enumerate(group)}
            links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
            kept = set(smallest_reachable(sets, links).values())
            assert links and {i for i in ids if i is not None and i < 10} == kept
            assert len(ids) == len(set(ids)) == 31 + len(kept)
        if name == "personal_data":
            assert not any("@" in r.text for r in out) and all(r.n_chars == len(r.text) for r in out)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in out)
    empty = docs.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    assert corpus_pipeline.run.__name__ == "run" and hashlib.sha256(b"").hexdigest()

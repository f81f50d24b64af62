"""Tests of the findings of the second round of advice."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from factsieve.llm import minhash_forest, mixing, projection_passes  # noqa: E402


def test_whole_documents_keep_the_target_of_each_source(spark):
    rng = random.Random(11)
    # b is hot and of small weight; most texts are many blocks of 256 words
    rows = [(i if i % 8 else None, "w " * rng.choice([30, 200, 1500, 3000]), "en", rng.choices("abcdefg", [15, 30, 10, 15, 5, 10, 15])[0], i % 3)
            for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    words = F.size(F.split(F.trim("text"), " "))
    out = corpus_pipeline.source_mix(spark, docs, "").groupBy("source", "doc_id", "text").count().withColumn("words", words).collect()
    emitted, long_ones = defaultdict(int), defaultdict(int)
    for r in out:
        emitted[r.source] += r.words * r["count"]
        long_ones[r.source, r.words] += r["count"]
        assert r.doc_id is None or r["count"] <= 2
    for s in "abcdefg":
        assert emitted[s] == pytest.approx(target[s], rel=0.05)
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s, t.count(" ")] += 1
    share = target["b"] / sum(n * c for (s, n), c in size.items() if s == "b")
    for n in (1500, 3000):
        assert share < 0.5 and long_ones["b", n] == pytest.approx(share * size["b", n], rel=0.15)
    again = corpus_pipeline.source_mix(spark, docs.repartition(7), "").groupBy("source", "doc_id", "text").count().withColumn("words", words).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_number_of_orders_follows_the_threshold():
    chance = lambda share: 1 - (1 - (share / 100) ** minhash_forest.BASE_DEPTH) ** minhash_forest.orders_for(share)
    assert minhash_forest.orders_for(85) == minhash_forest.ORDERS
    for share in (50, 70, 80, 84, 85):
        assert chance(share) >= chance(85)
    first = minhash_forest._random(minhash_forest.ORDERS)
    for part, more in zip(first, minhash_forest._random(minhash_forest.orders_for(80))):
        assert (more[:len(part)] == part).all() and len(set(more.tolist())) == len(more)


def test_near_duplicates_at_80(spark):
    from test_corpus_operators import near_copies, shingles, smallest_reachable

    rng = random.Random(12)
    texts = [t for _ in range(60) for t in near_copies(rng, 3, 2)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a // 3 == b // 3 and a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    out = minhash_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), share=80).collect()
    assert {r.doc_id: r.component_id for r in out} == want


@pytest.mark.parametrize("bounds", [{"region_sets": 8, "region_shingles": 10_000}])
def test_pairs_inside_a_crowd_below_the_threshold(spark, bounds):
    """Form letters at about 0.75 to each other, with pairs of real copies, some of which share a common rare phrase."""
    from test_corpus_operators import shingles, smallest_reachable

    rng = random.Random(13)
    form = [f"f{rng.randint(0, 900)}" for _ in range(150)]
    texts = []
    for i in range(400):
        own = [f"o{rng.randint(0, 10 ** 7)}" for _ in range(22)]
        if i % 3 == 0:
            own[:8] = [f"p{j}" for j in range(8)]
        texts.append(form + own)
        if i % 2 == 0:  # thirteen shingles of 168 changed: similarity 0.856
            copy, at = list(texts[-1]), rng.randrange(10, 130)
            copy[at] = copy[at + 3] = f"c{i}"
            copy[5] = f"d{i}"
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    assert len(links) >= 200 and len(set(want.values())) > 200
    out = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **bounds).collect()
    assert {r.doc_id: r.component_id for r in out} == want


def test_embeddings_of_a_dense_label_against_brute_force(spark):
    rng = np.random.default_rng(14)
    unit = lambda x: x / np.linalg.norm(x)
    mean, rows = unit(rng.standard_normal(64)), []
    for _ in range(400):
        x = unit(0.95 ** 0.5 * mean + 0.05 ** 0.5 * unit(rng.standard_normal(64)))
        rows.append(x)
        if len(rows) % 4 == 0:
            away = rng.standard_normal(64)
            rows.append(unit(0.983 * x + (1 - 0.983 ** 2) ** 0.5 * unit(away - (away @ x) * x)))
    all_ = np.array(rows)
    near = all_ @ all_.T >= 0.98
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b]
    from test_corpus_operators import smallest_reachable

    want = smallest_reachable(range(len(rows)), links)
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    for settings in ({"window": 8, "block": 64}, {"window": 256}):
        out = projection_passes.near_duplicates(df, **settings).collect()
        assert {r.vec_id: r.component_id for r in out} == want
        assert {r.vec_id: r.n_links for r in out} == {i: int(n) - 1 for i, n in enumerate(near.sum(1))}

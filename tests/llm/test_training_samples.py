"""Bounded training samples, and ids that are repeated with other texts."""

import random

import pytest
from pyspark.sql import functions as F

from factsieve.llm import compression_quality, language_filters, minhash_forest


def words(rng, stems, n):
    return " ".join(rng.choice(stems) for _ in range(n))


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    rng = random.Random(3)
    a, b = ([f"{p}{rng.randrange(10 ** 6)}" for _ in range(80)] for p in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1] + ["new"])), (3, " ".join(b[:-1] + ["new"])), (4, "quite another text of seven words")]
    out = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_an_id_with_two_texts_inside_a_crowd(spark):
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"w{rng.randrange(10 ** 6)}" for _ in range(12)])) for i in range(60)]
    other = shared + [f"z{i}" for i in range(12)]
    rows += [(7, " ".join(other)), (100, " ".join(other[:-1] + ["end"]))]
    out = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region_sets=8).collect()
    assert {r.doc_id: r.component_id for r in out}[100] == 7
    assert sum(r.kept for r in out) == 61 and len(out) == 62


def open_ids(n, start=0):
    """Ids that are not held out."""
    import zlib
    return [i for i in range(start, start + 3 * n) if zlib.crc32(str(i).encode()) % 5][:n]


def test_quality_learns_one_text_of_an_id_and_classes_of_long_texts(spark):
    rng = random.Random(5)
    good, bad = [f"good{i}" for i in range(60)], [f"spam{i}" for i in range(60)]
    ids = open_ids(60)
    rows = [(i, words(rng, good, 60) if k % 2 else words(rng, bad, 6000), int(k % 2)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    # 3,000 more rows of one id reach the driver as one text
    many = docs.unionAll(spark.range(3000).select(F.lit(ids[0]).alias("doc_id"), F.concat(F.lit("spam1 spam2 "), F.col("id").cast("string")).alias("text")))
    seen = []
    fit = compression_quality.fit
    compression_quality.fit = lambda rows: seen.append(rows) or fit(rows)
    try:
        model = compression_quality.train(many, labels)
    finally:
        compression_quality.fit = fit
    assert len(seen[0]) == 60 and max(len(t) for t, _, _ in seen[0]) <= compression_quality.SAMPLE_BYTES
    assert isinstance(model, compression_quality.Model)
    a, b = model.score([words(rng, good, 200).encode(), words(rng, bad, 200).encode()])
    assert a > b
    nothing = compression_quality.train(docs.where("false"), labels)
    assert nothing.score([b"x"])[0] == 0.5


def test_languages_with_long_texts_only_are_learned(spark):
    rng = random.Random(6)
    north, south = ["skog", "fjell", "vinter", "hvit", "elv"], ["praia", "verao", "quente", "mar", "sol"]
    ids = open_ids(40)
    rows = [(i, words(rng, north, 80), "no") if k % 2 else (i, words(rng, south, 8000), "pt") for k, i in enumerate(ids)]
    rows += [(ids[1], words(rng, north, 10) + f" {k}", "no") for k in range(2000)] + [(None, "x", "no"), (ids[2], None, "pt"), (5000, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_filters.train(docs)
    assert sorted(model.languages) == ["no", "pt"]
    test = spark.createDataFrame([(1, "vinter skog elv"), (2, "praia sol mar verao"), (3, None), (4, ""), (5, words(rng, south, 100_000))], "doc_id long, text string")
    out = {r.doc_id: r.p.lang_pred for r in test.select("doc_id", language_filters.predict(model, test, F.col("text")).alias("p")).collect()}
    assert out == {1: "no", 2: "pt", 3: "und", 4: "und", 5: "pt"}


@pytest.mark.parametrize("empty", ["text", "labels"])
def test_training_without_rows(spark, empty):
    docs = spark.createDataFrame([(1, "a text", "en")] if empty == "labels" else [], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = compression_quality.classify(docs, labels).collect()
    assert len(out) == (1 if empty == "labels" else 0)
    assert language_filters.identify(docs).count() == len(out)

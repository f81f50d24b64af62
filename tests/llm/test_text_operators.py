"""Operators that work inside a row: repetition, language, quality, tokens."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from factsieve.llm import bpe, compression_quality, language_filters, repetition, token_store  # noqa: E402
from factsieve.plans.store import new_path  # noqa: E402

WORD = "[^\x20\x09-\x0D]+"
ODD = ["", None, " \t\n", "a", "a b c d", "word " * 30, "The same line here\n" * 40, "x" * 5000, "é中\U0001f600 ok\n\nok é中\U0001f600",
       "it's <|endoftext|>  we'll\r\n 123 +-*/ \x85 \xa0 　 end  ", "\x1c\x1d a\x1f İ! ̇ ﬁ Σας"]


def texts(seed: int, count: int) -> list:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    made = [rng.choice(["", "\n", " "]).join(rng.choice(words) + rng.choice([" ", " ", "\n", ", ", "  "]) for _ in range(rng.randint(0, 300)))
            for _ in range(count)]
    return ODD + made


def frame(spark, rows, extra=True):
    """Repeated rows, a null id, and columns whose names the operators use themselves."""
    data = [(i, t, "en", "s", 1, "x") for i, t in enumerate(rows)] + [(0, rows[0], "en", "s", 1, "x"), (None, rows[5], None, None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n long, id string")


def counts(text):
    w = re.findall(WORD, text or "")
    tri = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered, seen, dup = set(), set(), 0
    for i in range(len(w) - 2):
        if tri[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def coverage(text, n):
    w = re.findall(WORD, text or "")
    grams = collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    hit = {j for i in range(len(w) - n + 1) if grams[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in hit) / max(1, sum(map(len, w)))


def test_repetition_against_brute_force(spark):
    rows = texts(1, 40)
    df = frame(spark, rows)
    out = df.select("doc_id", "text", repetition.repetition(F.col("text")).alias("r")).select("doc_id", "text", "r.*").collect()
    assert len(out) == len(rows) + 2
    for r in out:
        want = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        for n in repetition.COVER_LIMITS:
            assert r[f"cover_{n}"] == pytest.approx(coverage(r.text, n))
        assert not (r.base_failed and r.kept)
    assert df.where("1 = 0").select(repetition.repetition(F.col("text"))).count() == 0


def test_byte_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), texts(2, 40)
    for size in (0, 50, 5000):
        out = bpe.round_trip(frame(spark, rows), path, lexicon_words=size).collect()
        assert len(out) == len(rows) + 2
        for r in out:
            text = rows[5 if r.doc_id is None else r.doc_id] or ""
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(r.ids, np.uint32).tolist() == want
            assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(frame(spark, rows).where("1 = 0"), path).count() == 0


def test_lexicon_is_minimal_and_holds_its_words():
    words = {w.encode(): np.array([i], np.uint32).tobytes() for i, w in enumerate(["taps", "tops", "tap", "top", "stops", "é"])}
    block = bpe.compile_lexicon(words)
    lexicon = bpe.Lexicon(block)
    number = lexicon.find([*words, b"to", b"tapss", b""])
    assert sorted(number[:6].tolist()) == [*range(6)] and number[6:].tolist() == [-1, -1, -1]
    for (w, ids), n in zip(words.items(), number):
        assert lexicon.ids[lexicon.bounds[n]:lexicon.bounds[n + 1]].tobytes() == ids
    assert len(lexicon.final) < 12  # 16 states without shared suffixes


def test_token_store_equals_the_library(spark):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "store")
    library, rows = Tokenizer.from_file(path), texts(3, 40)
    token_store.write_store(frame(spark, rows), path, folder, shard_tokens=500)
    out = sorted(token_store.store_digests(spark, folder).collect(), key=lambda r: r.start)
    assert len(out) == len(rows) + 2 and out[0].doc_id is None
    assert [r.doc_id for r in out[1:]] == sorted([*range(len(rows)), 0])
    at = 0
    for r in out:
        ids = np.array(library.encode(rows[5 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids + [1], np.uint32)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = token_store.fetch(spark, folder, [7, 8, 10 ** 6])
    assert set(found) == {7, 8}
    assert found[7].tolist() == library.encode(rows[7], add_special_tokens=False).ids + [1]
    assert token_store.encode_store(frame(spark, rows).where("1 = 0"), path).count() == 0


def test_perfect_hash_has_no_holes():
    for count in (1, 2, 17, 5000):
        keys = token_store.key_hashes(np.arange(count), np.zeros(count, bool), np.zeros(count))
        pilots = token_store.build_pilots(keys)
        slots = token_store._slots(keys, pilots[token_store._bucket(keys, count)], count)
        assert sorted(slots.tolist()) == list(range(count))


def make_language(rng, letters):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    return lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 60)))


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    makers = {"aa": make_language(rng, "abcdefg"), "bb": make_language(rng, "mnopqrä"), "cc": make_language(rng, "дежзиклм")}
    rows = [(i, makers[k](), k) for i, k in enumerate(rng.choice(list(makers)) for _ in range(300))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 + 3!", "bb"), (None, rows[0][1], None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = language_filters.identify(df).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in language_filters.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_filters.identify(df.where("1 = 0")).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    good = make_language(rng, "abcdefghij")
    rows = [(i, good() if i % 3 else "".join(rng.choice("#$%&*|<>") for _ in range(rng.randint(20, 300))), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x"), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(902, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = compression_quality.classify(docs.withColumn("y", F.lit(1)), labels).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) >= 0.95 * len(held)
    one = compression_quality.classify(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert {r.score for r in compression_quality.classify(docs, labels.where("1 = 0")).collect()} == {0.5}
    assert compression_quality.classify(docs.where("1 = 0"), labels).count() == 0


def test_digest_of_ids_is_little_endian():
    assert hashlib.sha256(np.array([1, 258], np.uint32).tobytes()).hexdigest() == hashlib.sha256(b"\x01\0\0\0\x02\x01\0\0").hexdigest()

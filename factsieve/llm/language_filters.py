"""Language by bit-sliced n-gram filters (operator 10).

A Bloom filter whose slots hold one bit for each language: looking an n-gram up gives, by the conjunction of its slots,
all languages whose training texts hold it often.  A text's n-grams are looked up at once; each language's bits are
counted, lowered by the hits that the fill of its slice alone would give, and divided by the same rate on its own training texts.

Training takes at most ``SAMPLE_DOCS`` texts of each language, by the hash of their ids, one for each id.  Texts beyond ``SAMPLE_BYTES``
come after all others and give a stretch of that size, so that a language with long texts only is learned too.
Prediction stays inside a row: no shuffle, and the filter (a fixed number of slots) is broadcast.

Defined results: a null text and one without a letter are ``und`` with score 0; a text with letters but no known n-gram gets
the language with most training rows and score 0.  Without any training row everything is ``und``.  Equal rates go to the
language with more training rows, then to the smaller name.  Repeated rows get equal results; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.llm import textbytes as tb
from factsieve.llm.compression_quality import held_out, training_texts

LENGTHS = (3, 4)
SLOT_BITS, HASHES = 18, 2
SAMPLE_DOCS, SAMPLE_BYTES = 500, 20_000
#: An n-gram belongs to a language that holds it in this share of its training texts, and in two at least.
MIN_SHARE = 0.04
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_CLEAN = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts with the number of their text: bytes of lower-case letters, with one blank at word edges."""
    count = len(offsets) - 1
    padded = np.full(len(data) + 2 * count, 0x20, np.uint8)
    owner = np.repeat(np.arange(count), np.diff(offsets) + 2)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(count), np.diff(offsets)) + 1] = _CLEAN[data]
    blank = padded == 0x20
    twice = np.concatenate([[0], np.cumsum(blank[1:] & blank[:-1])])  # two blanks part words, and texts
    keys, texts = [], []
    for n in LENGTHS:
        size = max(len(padded) - n + 1, 0)
        fine = twice[n - 1:n - 1 + size] == twice[:size]
        value = np.zeros(size, np.uint64)
        for i in range(n):
            value |= padded[i:i + size].astype(np.uint64) << np.uint64(8 * i)
        keys.append((value | np.uint64(n << 40))[fine])
        texts.append(owner[:size][fine])
    return np.concatenate(keys), np.concatenate(texts)


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((keys * m) >> np.uint64(64 - bits)).astype(np.int64) for m in _MULTIPLIERS[:HASHES]]


class Filter:
    """Slots of language bits with what is needed to read them."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], bits: int = SLOT_BITS) -> None:
        """Languages stand in the order in which equal rates are decided."""
        self.languages, self.bits = languages, bits
        self.words = -(-max(len(languages), 1) // 8)  # bytes of bits in a slot
        self.table = np.zeros((self.words, 1 << bits), np.uint8)
        for i, keys in enumerate(grams):
            for slots in _slots(keys, bits):
                self.table[i // 8, slots] |= np.uint8(1 << i % 8)
        fill = [float((self.table[i // 8] >> np.uint8(i % 8) & np.uint8(1)).mean()) for i in range(len(languages))]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.99)
        self.usual = np.ones(len(languages))

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Share of each text's n-grams in each language, false hits taken off."""
        count = len(offsets) - 1
        keys, texts = ngrams(data, offsets)
        slots = _slots(keys, self.bits)
        total = np.maximum(np.bincount(texts, minlength=count), 1)[:, None]
        parts = []
        for row in self.table:
            mask = row[slots[0]]
            for s in slots[1:]:
                mask &= row[s]
            seen = np.bincount(texts * 256 + mask, minlength=count * 256).reshape(count, 256)
            parts.append(seen @ (np.arange(256)[:, None] >> np.arange(8) & 1))
        hits = np.concatenate(parts, 1)[:, :len(self.languages)] / total
        return np.maximum(hits - self.false, 0) / (1 - self.false)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        readable = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
        rates = [self.rates(data, offsets) for _, _, data, offsets in tb.text_chunks(pc.utf8_lower(texts))]
        rated = (np.concatenate(rates) if rates else np.zeros((0, len(self.languages)))) / self.usual
        best = rated.argmax(1) if len(rated) else np.zeros(0, int)
        whole = rated.sum(1)
        score = np.where(whole > 0, rated[np.arange(len(rated)), best] / np.maximum(whole, 1e-300), 0)
        names = [self.languages[b] if r else UNKNOWN for b, r in zip(best.tolist(), readable.tolist())]
        return names, np.where(readable, np.clip(score, 0, 1), 0.0)


def fit(rows: list[tuple[str, str]], bits: int = SLOT_BITS, min_share: float = MIN_SHARE) -> Filter:
    """From rows (text, language)."""
    by: dict[str, list[str]] = {}
    for text, language in rows:
        by.setdefault(language, []).append(text)
    languages = sorted(by, key=lambda x: (-len(by[x]), x))
    grams, chunks = [], []
    for language in languages:
        texts = pc.utf8_lower(pa.array(by[language], pa.large_string()))
        keys, _ = [], chunks.append(list(tb.text_chunks(texts)))
        for _, _, data, offsets in chunks[-1]:
            found, text = ngrams(data, offsets)
            pairs = np.unique(np.stack([found, text.astype(np.uint64)], 1), axis=0) if len(found) else np.zeros((0, 2), np.uint64)
            keys.append(pairs[:, 0])
        values, held = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_counts=True)
        grams.append(values[held >= max(min_share * len(by[language]), min(2, len(by[language])))])
    out = Filter(languages, grams, bits)
    for i, parts in enumerate(chunks):
        rates = np.concatenate([out.rates(data, offsets)[:, i] for _, _, data, offsets in parts])
        out.usual[i] = max(float(rates.mean()), 1e-6)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS,
          sample_bytes: int = SAMPLE_BYTES) -> Filter:
    """Fits the filter on a bounded sample of the rows that have a language and are not held out."""
    usable = training_texts(docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).withColumn(
        id_col, F.struct(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))), id_col, text_col, sample_bytes).where("id.id is not null")
    # one row for each id and language, whatever the number of its rows
    open_rows = usable.groupBy("id").agg(F.min("long").alias("long")).select("id", "id.lang", "long", F.md5(
        F.concat(F.lit("language:"), F.col("id.id").cast("string"))).alias("h"))
    # a salted first cut keeps the rows of a hot language in many tasks
    salted = W.partitionBy("lang", F.substring("h", -1, 1)).orderBy("long", "h", "id")
    first = open_rows.withColumn("at", F.row_number().over(salted)).where(F.col("at") <= sample_docs)
    picked = first.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("long", "h", "id"))).where(
        F.col("at") <= sample_docs).select("id", "h")
    # sample_docs texts for each language
    rows = (usable.join(F.broadcast(picked), "id").groupBy("h", "id").agg(F.min(F.struct("long", "text")).alias("t"))
            .select("h", "id.id", "t.text", "id.lang").collect())
    rows.sort(key=lambda r: (r.h, r.id, r.text))
    return fit([(r.text, r.lang) for r in rows])


def predict(model: Filter, docs: DataFrame, text: Column) -> Column:
    """Struct (lang_pred, score) for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        names, score = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(run, "struct<lang_pred:string,score:double>")(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of ``docs``: id, held_out, lang_pred, score."""
    model = train(docs, id_col, text_col, lang_col)
    return docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
                       predict(model, docs, F.col(text_col)).alias("p")).select(id_col, "held_out", "p.*")

"""Quality by compression with two dictionaries (operator 4).

One zstandard dictionary is trained on good and one on bad labelled text.  A text is compressed whole with either; the
difference of the two sizes over their sum, and how well the better one compresses it, go through a logistic calibration.

The model is fitted on a bounded sample of the labelled rows (``SAMPLE_DOCS`` of each class for the dictionaries and twice as
many others, in their natural proportion, for the calibration), taken by the hash of the id, one text for each id, and never from
held-out rows.  Texts beyond ``SAMPLE_BYTES`` come after all others and give a stretch of that size, so that a class of long texts only is learned.
Scoring stays inside a row: no shuffle, and a worker keeps two compressors.

Defined results: a null text scores as an empty one; an empty text has the score of its compressed sizes, as any
other.  Labels that are null, or differ between rows of one id, are not learned; a label without a text neither.  If a class has no sample the score
is the share of label 1 in the other (0.5 without any).  Repeated rows get equal scores.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_BYTES = 2000, 20_000
DICTIONARY_BYTES, LEVEL = 112_640, 3
THRESHOLD = 0.3


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string")) % 5 == 0


def _dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained if the sample is rich enough, else the texts themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"\n".join(texts)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Model:
    """Two dictionaries and the calibration of what they tell."""

    def __init__(self, good: bytes, bad: bytes, raw: tuple[bool, bool]) -> None:
        self.parts = (good, bad, raw)
        self.weights, self.centre, self.spread = np.zeros(6), np.zeros(5), np.ones(5)
        self._open()

    def _open(self) -> None:
        good, bad, raw = self.parts
        self.sides = []
        for data, plain in ((good, raw[0]), (bad, raw[1])):
            kind = zstandard.DICT_TYPE_RAWCONTENT if plain else zstandard.DICT_TYPE_FULLDICT
            known = zstandard.ZstdCompressionDict(data, dict_type=kind)
            known.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_dict_id=False,
                                                       write_checksum=False))

    def __getstate__(self) -> tuple:
        return self.parts, self.weights, self.centre, self.spread

    def __setstate__(self, state: tuple) -> None:
        self.parts, self.weights, self.centre, self.spread = state
        self._open()

    def features(self, texts: list[bytes]) -> np.ndarray:
        good, bad = (np.array([len(side.compress(t)) for t in texts], float) for side in self.sides)
        size = np.array([len(t) for t in texts], float)
        difference = (bad - good) / (bad + good)
        packed = np.log((np.minimum(good, bad) + 8) / (size + 16))
        return np.stack([difference, np.abs(difference), packed, packed ** 2, difference * packed], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.clip((self.features(texts) - self.centre) / self.spread, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))

    def calibrate(self, texts: list[bytes], label: np.ndarray, penalty: float = 1.0) -> None:
        """Logistic regression by Newton steps."""
        x = self.features(texts)
        self.centre, self.spread = x.mean(0), np.maximum(x.std(0), 1e-9)
        x = np.column_stack([np.ones(len(x)), np.clip((x - self.centre) / self.spread, -8, 8)])
        ridge = penalty * np.eye(x.shape[1])
        ridge[0, 0] = 1e-6
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


class Constant:
    """Stands in where one class has no sample."""

    def __init__(self, value: float) -> None:
        self.value = value

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def fit(rows: list[tuple[bytes, int, bool]]) -> Model | Constant:
    """From rows (text, label, for the dictionaries or for the calibration)."""
    good, bad = ([t for t, y, first in rows if y == k and first and t] for k in (1, 0))
    if not good or not bad:
        labels = [y for _, y, _ in rows]
        return Constant(sum(labels) / len(labels) if labels else 0.5)
    trained = [_dictionary(x) for x in (good, bad)]
    model = Model(*[d.as_bytes() for d in trained], tuple(d.dict_id() == 0 for d in trained))
    rest = [(t, y) for t, y, first in rows if not first] or [(t, y) for t, y, _ in rows]
    model.calibrate([t for t, _ in rest], np.array([y for _, y in rest], float))
    return model


def training_texts(docs: DataFrame, id_col: str, text_col: str, sample_bytes: int) -> DataFrame:
    """id, text, long: texts to learn from. Of a text beyond ``sample_bytes`` a stretch from a place by its hash; such texts come last."""
    text = F.col(text_col)
    chars = sample_bytes // 4  # at most four bytes each
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - chars + 1, F.lit(1))).cast("int") + 1
    long = F.octet_length(text) > sample_bytes
    return docs.where(text.isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.when(long, F.substring(text, start, F.lit(chars))).otherwise(text).alias("text"), long.alias("long"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model | Constant:
    """Fits the model on a bounded sample of the labelled rows that are not held out."""
    agreed = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
              .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").where(~held_out(F.col("id"))))
    usable = training_texts(docs, id_col, text_col, sample_bytes)
    with_text = usable.groupBy("id").agg(F.min("long").alias("long"))
    hashed = agreed.join(with_text, "id").withColumn("h", F.md5(F.concat(F.lit("quality:"), F.col("id").cast("string")))).withColumn("first", F.col("h") < "8")
    # each a top-k by hash: the dictionaries get as many rows of either class, the calibration rows in their natural proportion
    picked = hashed.where("not first").orderBy("long", "h", "id").limit(2 * sample_docs)
    for y in (0, 1):
        picked = picked.unionAll(hashed.where(F.col("first") & (F.col("y") == y)).orderBy("long", "h", "id").limit(sample_docs))
    picked = picked.select("id", "y", "h", "first")
    # one text for each id, whatever its number of rows: 4 * sample_docs texts at most
    rows = (usable.join(F.broadcast(picked.select("id", "y", "h", "first")), "id").groupBy("h", "id", "y", "first")
            .agg(F.min(F.struct("long", "text")).alias("t")).select("h", "id", F.encode("t.text", "UTF-8").alias("text"), "y", "first").collect())
    rows.sort(key=lambda r: (r.h, r.id, bytes(r.text)))
    return fit([(bytes(r.text), r.y, r["first"]) for r in rows])


_MODELS: dict[str, Model | Constant] = {}


def score(model: Model | Constant, docs: DataFrame, text: Column) -> Column:
    """Probability of label 1 for each whole text."""
    data = pickle.dumps(model)
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))

    def run(texts: pa.Array) -> pa.Array:
        key, packed = shared.value
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = pickle.loads(packed)
        return pa.array(_MODELS[key].score([(t.as_py() or "").encode() for t in texts]), pa.float64())

    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
                         score(model, docs, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

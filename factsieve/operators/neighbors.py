"""k nearest neighbours among all labelled rows.

Labelled rows and rows to be labelled are packed into blocks, and each block of the ones meets each block of the others in some task, so
neither the driver nor a task holds all rows of either.  What tasks find for one block is merged.  A stream's rows meet a broadcast of all
labelled rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.columns import ref
from factsieve.operators.features import Features
from factsieve.operators.splits import stratified_sample
from factsieve.plans.sampling import row_id
from factsieve.plans.store import materialize

BLOCK_ROWS, BLOCK_BYTES = 2_048, 1 << 20  # vectors of a block, at most
BLOCKS = 16  # blocks to be labelled that one task takes
STEP = 128  # rows compared at once
MANY = 4  # times k rows for each asked one: with more in reach than that, the nearest of a block are picked first
ROUNDING = 1e-13  # of a distance from products, as a share of the squares and for each feature: far above the real one


def _held(rows: int, k: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of k neighbours for each row, still empty: these come after all others."""
    return np.full((rows, k), np.nan), np.full((rows, k), classes, np.int32)


def _first(row: np.ndarray, dist: np.ndarray, codes: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row, equal distances by class; every row has as many."""
    order = np.lexsort((codes, dist, row))
    kept = order[np.searchsorted(row[order], np.arange(rows))[:, None] + np.arange(k)]
    return dist[kept], codes[kept]


def _nearest(asked: np.ndarray, known: np.ndarray, codes: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> None:
    """Takes the known rows into ``held``, the distances and classes of the k nearest rows met so far.

    Products of matrices leave the known rows that may be among the nearest, then distances are summed gap by gap for these alone.
    """
    k = held[0].shape[1]
    top, square = min(k, len(known)), (known * known).sum(1)
    for start in range(0, len(asked), STEP):
        part, dist, code = asked[start:start + STEP], held[0][start:start + STEP], held[1][start:start + STEP]
        own = (part * part).sum(1)
        rough = square[None, :] - 2.0 * (part @ known.T)  # less the square of the asked row
        slack = ROUNDING * (known.shape[1] + 1) * (own + square.max())
        with np.errstate(invalid="ignore"):
            far = np.where(np.isnan(dist[:, -1]), np.inf, dist[:, -1] - own) + slack
            near = ~(rough > far[:, None])
            if top < len(known) and np.count_nonzero(near) > MANY * k * len(part):
                near &= ~(rough > (np.partition(rough, top - 1, axis=1)[:, top - 1] + slack)[:, None])
        row, place = np.nonzero(near)
        found = np.zeros(len(row))
        for j in range(known.shape[1]):
            gap = part[row, j] - known[place, j]
            found += gap * gap
        row = np.concatenate([np.repeat(np.arange(len(part)), k), row])
        dist[:], code[:] = _first(row, np.concatenate([dist.ravel(), found]), np.concatenate([code.ravel(), codes[place]]), len(part), k)


def _shares(codes: np.ndarray, classes: int) -> np.ndarray:
    """Share of each class in the rows of ``codes``."""
    out = np.zeros((len(codes), classes))
    np.add.at(out, (np.arange(len(codes))[:, None], codes), 1.0 / codes.shape[1])
    return out


def _votes(asked: np.ndarray, known: np.ndarray, codes: np.ndarray, classes: int, k: int) -> np.ndarray:
    """Share of each class among the k nearest known rows; equal distances go to the smaller class."""
    held = _held(len(asked), min(k, len(known)), classes)
    _nearest(asked, known, codes, held)
    return _shares(held[1], classes)


def _size(width: int) -> int:
    """Rows of a full block."""
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1))))


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and vectors of each block in a batch with its vectors in the column ``at``."""
    if not len(batch):
        return
    x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(batch), -1)
    rows = _size(x.shape[1])
    for low in range(0, len(batch), rows):
        yield low, x[low:low + rows]


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (label, x)."""
    for batch in batches:
        codes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
        for low, x in _parts(batch, 1):
            own = codes[low:low + len(x)]
            yield pa.RecordBatch.from_pydict({"codes": pa.array([own.tobytes()], pa.binary()), "y": pa.array([x.tobytes()], pa.binary()),
                                              "n": pa.array([len(x)], pa.int64()), "width": pa.array([x.shape[1]], pa.int32())})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, y, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            x = np.frombuffer(y)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (len(x) // n))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(codes, np.int32).astype(float)), pa.ListArray.from_arrays(offsets, pa.array(x))],
                                             ["label", "x"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (at, x)."""
    for batch in batches:
        at = batch.column(0).to_numpy()
        for low, x in _parts(batch, 1):
            yield pa.RecordBatch.from_pydict({"at": pa.array([at[low:low + len(x)].tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})


def _met(how: dict):
    """The nearest rows of each block (at, x) among the blocks (codes, y) beside it; those of a block come one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, held = None, None, ()

        def out() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in (at, *(h.tobytes() for h in held))], ["at", "dist", "codes"])

        for batch in batches:
            own, x, codes, y = (batch.column(i) for i in range(4))
            for i in range(len(batch)):
                if own[i].as_py() != at:
                    yield from out()
                    at, asked = own[i].as_py(), np.frombuffer(x[i].as_py()).reshape(-1, how["width"])
                    held = _held(len(asked), how["k"], how["classes"])
                _nearest(asked, np.frombuffer(y[i].as_buffer()).reshape(-1, how["width"]), np.frombuffer(codes[i].as_buffer(), np.int32), held)
        yield from out()

    return run


def _merged(how: dict):
    """The votes of the rows of one block, from all that was found for it."""
    def run(table: pa.Table) -> pa.Table:
        at = np.frombuffer(table.column("at")[0].as_py(), np.int64)
        dist, codes = (np.concatenate([np.frombuffer(v, kind) for v in table.column(name).to_pylist()]) for name, kind in (("dist", np.float64), ("codes", np.int32)))
        row = np.repeat(np.tile(np.arange(len(at)), len(table)), how["k"])
        votes = _shares(_first(row, dist, codes, len(at), how["k"])[1][:, :how["top"]], how["classes"])
        offsets = pa.array(np.arange(len(votes) + 1, dtype=np.int32) * how["classes"])
        return pa.table({"at": pa.array(at), "votes": pa.ListArray.from_arrays(offsets, pa.array(votes.ravel()))})

    return run


class Neighbors:
    """Known rows with their classes; adds ``prediction`` and ``probability`` like the library's models, in place of ``features``."""

    def __init__(self, rows: DataFrame, classes: int, k: int = 5):
        """From rows (label, x)."""
        if k < 1:
            raise ValueError(f"a row is told by one neighbour or more, not by {k}")
        self.known = materialize(rows.mapInArrow(_known, "codes binary, y binary, n long, width int"), "known")
        self.classes, self.k = classes, k
        self.rows, self.width = self.known.agg(F.sum("n"), F.max("width")).first()
        if not self.rows:
            raise ValueError("there are no labelled rows to compare with")

    @staticmethod
    def fit(data: DataFrame, classes: int, k: int = 5) -> Neighbors:
        """From rows (label, features), all of them."""
        return Neighbors(data.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x")), classes, k)

    def transform(self, df: DataFrame) -> DataFrame:
        others, x = [c for c in df.columns if c != "features"], vector_to_array("features")
        if df.isStreaming:
            scored = df.select(*[ref(c).alias(f"c{i}") for i, c in enumerate(others)], self._voted()(x).alias("votes"))
        else:
            how = {"classes": self.classes, "k": self.k, "top": min(self.k, self.rows), "width": self.width}
            plain = [i for i, c in enumerate(others) if not isinstance(df.schema[c].dataType, T.NullType)]  # a table cannot hold the others
            rows = materialize(df.select(F.monotonically_increasing_id().alias("at"), *[ref(others[i]).alias(f"c{i}") for i in plain], x.alias("x")), "asked")
            count = -(-rows.count() // _size(self.width))
            tasks = max(1, -(-count // BLOCKS), min(count, df.sparkSession.sparkContext.defaultParallelism))
            blocks = rows.select("at", "x").mapInArrow(_asked, "at binary, x binary").repartition(tasks)
            pairs = blocks.hint("shuffle_replicate_nl").crossJoin(self.known.select("codes", "y"))
            votes = pairs.mapInArrow(_met(how), "at binary, dist binary, codes binary").groupBy("at").applyInArrow(_merged(how), "at long, votes array<double>")
            scored = rows.join(votes, "at").select("*", *[F.lit(None).alias(f"c{i}") for i in range(len(others)) if i not in plain])
        best = F.array_position("votes", F.array_max("votes")) - 1  # the first of equal shares
        return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], array_to_vector("votes").alias("probability"),
                             best.cast("double").alias("prediction"))

    def _voted(self):
        """Votes as a function of vectors, with all known rows in each worker."""
        known = [(np.frombuffer(r["y"]).reshape(-1, self.width), np.frombuffer(r["codes"], np.int32)) for r in self.known.select("codes", "y").toLocalIterator()]
        shared, classes, k = self.known.sparkSession.sparkContext.broadcast(known), self.classes, min(self.k, self.rows)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                held = _held(len(x), k, classes)
                for y, codes in shared.value if len(x) else []:
                    _nearest(np.vstack(x.to_numpy()), y, codes, held)
                yield pd.Series(list(_shares(held[1], classes)) if len(x) else [], dtype=object)

        return F.pandas_udf(run, "array<double>")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.known.mapInArrow(_unpacked, "label double, x array<double>").write.parquet(f"{path}/rows")
        spark.createDataFrame([(self.classes, self.k)], "classes int, k int").write.parquet(f"{path}/settings")

    @staticmethod
    def load(path: str) -> Neighbors:
        spark = SparkSession.getActiveSession()
        settings = spark.read.parquet(f"{path}/settings").first()
        return Neighbors(spark.read.parquet(f"{path}/rows").select("label", "x"), settings["classes"], settings["k"])


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, key: list[str], k: int = 5,
                max_train_rows: int | None = None) -> DataFrame:
    """id (row key as text), prediction: majority of the k nearest train rows, the smallest label among ties.

    All train rows are compared unless ``max_train_rows`` is given (a stratified sample).
    """
    fitted = Features.fit(train, features)
    kept = train.where(ref(label).isNotNull())
    if max_train_rows is not None:
        kept = stratified_sample(kept, key, max_train_rows, label)
    names = [r["c"] for r in kept.select(ref(label).cast("string").alias("c")).distinct().orderBy("c").collect()]
    code = F.array_position(F.array(*[F.lit(c) for c in names]), ref(label).cast("string")) - 1
    model = Neighbors.fit(fitted.vectors(kept, code.cast("double").alias("label")), len(names), k)
    scored = model.transform(fitted.vectors(test, row_id(key).alias("id")))
    return scored.select("id", F.get(F.array(*[F.lit(c) for c in names]), F.col("prediction").cast("int")).alias("prediction"))


# workers get these functions by value, so the package need not be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

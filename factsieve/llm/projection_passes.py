"""Embedding near-duplicates by sorted projection passes (operator 6).

Each pass gives a vector the concatenated signs of its own random projections and sorts the vectors of a label by them; vectors
in the same run of equal leading signs are neighbours and are compared, a run longer than ``WINDOW`` in sorted
order with the next ``WINDOW`` vectors, and then also exactly, block against block in tasks of their own.  The confirmed pairs of all passes are
united to components; a linked pair always lies inside one, so the links of a vector are then counted there exactly, block against
block, without emitting pairs.

How many leading signs part a label's runs follows from the label: two vectors at the threshold agree in a sign with a known
probability, so each number of signs has a number of passes in which all but ``MISS`` of such pairs meet, whatever the data.  A
sample of ``SAMPLE`` vectors tells how many pairs share that many signs, and the number with the least work is taken.  More vectors take more
signs and a few more passes; a label whose vectors lie close together takes more of both.  The sample sets the work only, not what is found.

Equal vectors of a label are one class with a multiplicity before the passes, whatever their number.  A component
is cut into blocks of ``BLOCK`` vectors, so no task holds an unbounded one.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows without label or id, link with nothing:
``n_links`` 0 and their own id as component.  Vectors of different lengths link with nothing of another length.  Repeated rows link
with each other as other vectors do; their common id is their component.  Other columns are never read.  An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.llm.components import components
from factsieve.plans.store import materialize

COSINE = 0.98
#: The chance that a pair at the threshold meets in no pass.
MISS = 1e-5
#: Signs that part the runs, at most, and those after them, which only order a run.
MAX_DEPTH, ORDER = 40, 16
#: Vectors of a label that estimate its runs; moving a vector costs about as much as so many comparisons.
SAMPLE, MOVE = 2000, 256
WINDOW, BLOCK = 256, 1024


def passes_for(depth: int, cosine: float = COSINE) -> int:
    """Passes in which two vectors at the threshold share all of ``depth`` signs at least once, but for MISS."""
    together = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** depth
    return 1 if together >= 1 else math.ceil(math.log(MISS) / math.log1p(-together))


@lru_cache(maxsize=512)
def _projections(width: int, number: int) -> np.ndarray:
    """The projections of one pass."""
    return np.random.default_rng([7, width, number]).standard_normal((width, MAX_DEPTH + ORDER))


def _keys(x: np.ndarray, number: int, signs: int) -> np.ndarray:
    """The signs of one pass as bits, the first sign highest."""
    return (x @ _projections(x.shape[1], number)[:, :signs] > 0) @ (np.int64(1) << np.arange(signs - 1, -1, -1, dtype=np.int64))


def _depth(cosine: float, window: int, block: int):
    """Signs and passes of one label from its sample: the least of comparisons and moved vectors."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, m = int(rows["n"].iloc[0]), len(rows)
        best = 0
        if m > 1:
            x = np.array(rows["v"].tolist(), float)
            keys = [_keys(x, number, MAX_DEPTH) for number in range(4)]

            def work(depth: int) -> float:
                runs = [np.unique(k >> (MAX_DEPTH - depth), return_counts=True)[1].astype(float) for k in keys]
                share = max(float(np.mean([(r * (r - 1)).sum() for r in runs])) / (m * (m - 1)), 0.5 ** depth)
                copies = 1 + (2 * n * share / block if n * share > window else 0)
                return passes_for(depth, cosine) * (n * n * share / 2 + n * MOVE * copies)

            # vectors in all directions are left in runs of a quarter of the window, so no label is met as a whole
            least = max(0, min(MAX_DEPTH, math.ceil(math.log2(4 * n / window))))
            best = min(range(least, MAX_DEPTH + 1), key=work)
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "depth": [best], "passes": [passes_for(best, cosine)]})

    return run


def _signs(vectors: pa.Array, depths: pa.Array, passes: pa.Array) -> pa.Array:
    """For each vector a list with one number a pass: its depth and ORDER further signs as bits."""
    offsets = np.asarray(vectors.offsets)
    flat = np.asarray(vectors.values, float)
    each = np.column_stack([np.diff(offsets), depths.to_numpy(zero_copy_only=False), passes.to_numpy(zero_copy_only=False)]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(each[:, 2])])
    out = np.zeros(ends[-1], np.int64)
    for width, depth, count in np.unique(each, axis=0):
        rows = np.flatnonzero((each == (width, depth, count)).all(1))
        for low in range(0, len(rows), 1024):
            part = rows[low:low + 1024]
            x = flat[offsets[part][:, None] + np.arange(width)]
            for number in range(count):
                out[ends[part] + number] = _keys(x, number, int(depth) + ORDER)
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(out))


def _matrix(rows: list) -> np.ndarray:
    x = np.array(rows, float)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _neighbours(cosine: float, window: int):
    """Links of sorted rows (run, key, id, vector): each with the next ``window`` of its run; only a spanning forest of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, rows = None, [], []

        def links(ids: list, rows: list) -> pa.RecordBatch:
            x = _matrix(rows)
            a, b = [], []
            for low in range(0, len(x), window):
                left, right = x[low:low + window], x[low:low + 2 * window]
                i, j = np.nonzero(left @ right.T >= cosine - 1e-12)
                near = (j > i) & (j - i <= window)
                i, j = i[near], j[near]
                a += (i + low).tolist()
                b += (j + low).tolist()
            parent = list(range(len(x)))

            def top(v: int) -> int:
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            kept = []
            for u, v in zip(a, b):
                p, q = top(u), top(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    kept.append((ids[u], ids[v]))
            pairs = np.array(kept, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for r, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if r != name or len(ids) >= 16 * window:
                    if len(ids) > 1:
                        yield links(ids, rows)
                    # a long run goes on with its last window, so that no neighbours are parted
                    keep = window if r == name else 0
                    name, ids, rows = r, ids[len(ids) - keep:], rows[len(rows) - keep:]
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
        if len(ids) > 1:
            yield links(ids, rows)

    return run


def _within(cosine: float):
    """Links of rows (region, id, vector) by all pairs of a region; only a spanning forest of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(ids: list, rows: list) -> pa.RecordBatch:
            x = _matrix(rows)
            linked = x @ x.T >= cosine - 1e-12
            np.fill_diagonal(linked, False)
            out, new = [], np.ones(len(x), bool)
            for root in np.flatnonzero(linked.any(1)):
                queue = [root] if new[root] else []
                new[root] = False
                while queue:
                    at = queue.pop()
                    near = np.flatnonzero(linked[at] & new)
                    new[near] = False
                    out += [(ids[at], ids[n]) for n in near]
                    queue += near.tolist()
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        name, ids, rows = None, [], []
        for batch in batches:
            for r, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if r != name:
                    if len(ids) > 1:
                        yield links(ids, rows)
                    name, ids, rows = r, [], []
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
        if len(ids) > 1:
            yield links(ids, rows)

    return run


def _long_links(passed: DataFrame, runs: DataFrame, cosine: float, window: int, block: int) -> DataFrame:
    """Links of the runs longer than the window, by all pairs of the run."""
    parts = passed.join(runs.where(F.col("n") > window).select("run", "n"), "run").select(F.col("run").alias("cell"), "n", "id", "v")
    # two blocks of a pair hold about ``block`` vectors
    dealt = parts.withColumn("blocks", F.ceil(F.col("n") * 2 / F.lit(block)).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("id", "cell"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or block <> other")
    regions = paired.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "id", "v")
    return regions.repartition("region").sortWithinPartitions("region", "id").mapInArrow(_within(cosine), "a long, b long")


def _counts(cosine: float):
    """Rows (pair of blocks, side, id, copies, vector): for each vector of the first block, its links into the second."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            left, right = sides
            found = _matrix([v for _, _, v in left]) @ _matrix([v for _, _, v in right]).T >= cosine - 1e-12
            same = np.array([i for i, _, _ in left])[:, None] == np.array([i for i, _, _ in right])[None, :]
            total = (found & ~same) @ np.array([c for _, c, _ in right], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in left], pa.int64()), pa.array(total, pa.int64())], ["id", "n"])

        for batch in batches:
            for r, side, i, c, v in zip(*[batch.column(k).to_pylist() for k in range(4)], batch.column(4)):
                if r != name:
                    if sides[0] and sides[1]:
                        yield links()
                    name, sides = r, ([], [])
                sides[side].append((i, c, v.values.to_numpy(zero_copy_only=False)))
        if sides[0] and sides[1]:
            yield links()

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors``: id, n_links, component_id, kept."""
    v = F.col("v")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine, F.lit(False))
    table = materialize(rows.select("id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.transform(v, lambda x: x + F.lit(0.0))).alias("v")), "vectors")
    classes = materialize(table.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    celled = classes.select("id", "v", F.xxhash64("label", F.size("v")).alias("cell"))
    first = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sample = celled.withColumn("place", first).where(F.col("place") <= SAMPLE).drop("place").join(sizes, "cell")
    plan = materialize(sample.groupBy("cell").applyInPandas(_depth(cosine, window, block), "cell long, depth int, passes int"), "depths")
    signs = F.arrow_udf(_signs, "array<bigint>")
    passed = celled.join(plan, "cell").select("id", "v", "cell", F.posexplode(signs("v", "depth", "passes")).alias("pass", "key")).select(
        F.xxhash64("pass", "cell", F.shiftright("key", ORDER)).alias("run"), "key", "id", "v")
    runs = materialize(passed.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "runs")
    sorted_runs = passed.join(runs.select("run"), "run", "left_semi").repartition("run").sortWithinPartitions("run", "key", "id").select("run", "id", "v")
    links = sorted_runs.mapInArrow(_neighbours(cosine, window), "a long, b long")
    if runs.where(F.col("n") > window).limit(1).count():
        links = links.unionAll(_long_links(passed, runs, cosine, window, block))
    found = materialize(components(links, "vector-links"), "groups")
    sizes = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = materialize(found.join(sizes, "component").join(classes.select("id", "copies", "v"), F.col("node") == F.col("id")).select(
        "component", "blocks", "id", "copies", "v", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "members")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = members.withColumn("other", other).select(
        F.xxhash64("component", "block", "other").alias("pair"), F.lit(0).alias("side"), "id", "copies", "v").unionAll(
        members.withColumn("other", other).select(F.xxhash64("component", "other", "block").alias("pair"), F.lit(1).alias("side"), "id", "copies", "v"))
    counted = sides.repartition("pair").sortWithinPartitions("pair", "side", "id").mapInArrow(_counts(cosine), "id long, n long")
    degree = counted.groupBy("id").agg(F.sum("n").alias("n"))
    linked = materialize(classes.join(found, F.col("id") == F.col("node"), "left").join(
        degree.withColumnRenamed("id", "counted"), F.col("id") == F.col("counted"), "left").where("copies > 1 or component is not null").select(
        F.col("label").alias("of"), F.col("v").alias("of_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "id").alias("component")), "linked")
    joined = table.join(linked, (F.col("label") == F.col("of")) & (F.col("v") == F.col("of_v")), "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")
                         ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

"""Decision trees and random forests whose cost does not grow with the number of their nodes.

Splits are sought among at most ``bins`` ranges of each feature, so rows of the same ranges are one cell, and a tree is grown from the sums
of its cells (labels of each class, or count, sum and sum of squares).  Each task draws the samples of all trees from its rows; the
draws follow from a row's content and number among its equals, so they do not depend on how rows are spread.  Cells of one
tree go to one task while they are few; a node with more cells is split by summing the tables of its features over all tasks,
until its parts are few enough.  Candidate splits, gains, ties, leaves and the merging of equal leaves are the library's, but that
candidates are taken from all rows and not from a sample.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.plans.store import materialize

#: Parameters that are read here, by the library's names.
PARAMS = {"numTrees", "maxDepth", "maxBins", "seed", "featureSubsetStrategy", "minInstancesPerNode", "minInfoGain"}
MAX_CELLS = 20_000        # cells of a node that one task splits on its own
RANGES = 1 << 16          # ranges of values that one pass counts, over all features
VALUES = 1 << 18          # values that reach the driver one by one, at most
MANY = 4                  # a feature of two bins is read by its upper one if that has at most one of so many rows
DRAWN = 1 << 18           # rows drawn at once
TABLE_BYTES = 64 << 20    # tables of features that a task holds before it hands them on
DIGITS = 8                # of a variance's decrease that count, as a share of the node's
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
#: Arrays of a subtree and the types of their numbers.
PARTS = {"feature": np.int32, "cut": np.int16, "left": np.int32, "values": np.float64, "gains": np.float64}
_CELL = np.dtype([("n", "<i8"), ("low", "<f8"), ("high", "<f8")])
_NODE = np.dtype([("node", "<i8"), ("feature", "<i4"), ("cut", "<i4"), ("gain", "<f8")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(*numbers: int) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for n in numbers:
        out = _mix(out + np.array([n & (2 ** 64 - 1)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out[0]


def _poisson(hashes: np.ndarray) -> np.ndarray:
    """Draws with the mean 1 from hashes."""
    return np.searchsorted(_POISSON, (hashes >> np.uint64(11)) * 2.0 ** -53, side="right")


def _copies(counts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and number among its equals of every copy, some at a time."""
    ends = np.cumsum(counts)
    for low in range(0, int(ends[-1]) if len(ends) else 0, limit):
        place = np.arange(low, min(low + limit, int(ends[-1])))
        row = np.searchsorted(ends, place, side="right")
        yield row, place - (ends[row] - counts[row])


def _walk(cells: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate splits of one feature, midpoints between all its values or those nearest to equal shares, and the cells to divide first.

    Cells are its ranges of values in order, each with its rows (``n``), lowest and highest value.  One in which no share ends is
    passed as a whole; while there are others with more than one value, the splits are not known yet.
    """
    n, low, high = cells["n"], cells["low"], cells["high"]
    ends, several = np.cumsum(n), low < high
    if len(cells) + np.count_nonzero(several) <= bins:
        return (high[:-1] + low[1:]) / 2.0, np.flatnonzero(several)
    stride = float(n.sum()) / bins
    out, divided, target, before, last, at = [], [], stride, 0, None, 0
    while at < len(cells):
        if several[at] and ends[at] > target:
            divided.append(at)
            while target < ends[at]:  # a guess, the cells behind are looked at again when this one is divided
                target += stride
        elif not several[at] and last is not None and abs(before - target) < abs(ends[at] - target):
            out.append((last + low[at]) / 2.0)
            target += stride
        if ends[at] <= target:
            at = max(at, int(np.searchsorted(ends, target, side="right")) - 1)
        before, last, at = ends[at], high[at], at + 1
    return np.array(out), np.array(divided, np.int64)


def _digits(value: float) -> int:
    """Whole numbers in the order of the values, neighbours for neighbouring values."""
    number = int(np.float64(value).view(np.int64))
    return number if number >= 0 else -(number & (1 << 63) - 1)


def _steps(low: float, high: float, parts: int) -> np.ndarray:
    """Ends of the ranges that ``low`` to ``high`` is divided into, but the last: even ones, and some even in the digits of the values,
    so that few rounds reach single values however they are spread."""
    with np.errstate(invalid="ignore", over="ignore"):
        even = low + (high - low) * (np.arange(parts) / parts)
    first, last = _digits(low), _digits(high)
    numbers = [first + (last - first) * i // 16 for i in range(16)]
    spread = np.array([abs(i) for i in numbers], np.int64).view(np.float64) * np.where(np.array(numbers, float) < 0, -1.0, 1.0)
    found = np.unique(np.concatenate([spread, even[np.isfinite(even)]]))
    return found[(found >= low) & (found < high)]


def _ranges(cells: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the ranges that cells are divided into, and which of the ranges are inside of a cell."""
    ends, inside = [], []
    for low, high in zip(cells["low"].tolist(), cells["high"].tolist()):
        before = np.nextafter(low, -np.inf)
        if low > -np.inf and not (ends and ends[-1] >= before):
            ends.append(before)
            inside.append(False)
        ends += [*_steps(low, high, parts), high]
        inside += [True] * (len(ends) - len(inside))
    return np.array(ends), np.array(inside, bool)


def _ordered(batch: pa.RecordBatch, features: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The features' values of rows (x, n) in their order, and the rows up to each."""
    if len(batch):
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        for f in features:
            value = np.where(np.isnan(x[:, f]), np.inf, x[:, f])
            order = np.argsort(value)
            yield f, value[order], np.concatenate([[0], np.cumsum(batch.column(1).to_numpy()[order])])


def _counted(ranges: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Rows, lowest and highest value of each range of the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: (np.zeros(len(e), np.int64), np.full(len(e), np.inf), np.full(len(e), -np.inf)) for f, (e, _) in ranges.items()}
        for batch in batches:
            for f, value, upto in _ordered(batch, [*ranges]):
                n, low, high = held[f]
                stop = np.searchsorted(value, ranges[f][0], side="right")
                start = np.concatenate([[0], stop[:-1]])
                some = np.flatnonzero(stop > start)
                n[some] += upto[stop[some]] - upto[start[some]]
                low[some], high[some] = np.minimum(low[some], value[start[some]]), np.maximum(high[some], value[stop[some] - 1])
        for f, (n, low, high) in held.items():
            kept = np.flatnonzero(ranges[f][1] & (n > 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), f, np.int32)), pa.array(kept), *[pa.array(a[kept]) for a in (n, low, high)]],
                                             ["feature", "place", "n", "low", "high"])

    return run


def _listed(cells: dict[int, np.ndarray]):
    """Rows of each single value in the cells of the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, value, upto in _ordered(batch, [*cells]):
                stop = np.append(np.flatnonzero(value[1:] != value[:-1]), len(value) - 1) + 1
                found, n = value[stop - 1], np.diff(upto[np.append(0, stop)])
                at = np.searchsorted(cells[f]["high"], found)
                kept = np.flatnonzero(at < len(cells[f]))
                kept = kept[cells[f]["low"][at[kept]] <= found[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), f, np.int32)), pa.array(found[kept]), pa.array(n[kept])], ["feature", "low", "n"])

    return run


def _candidates(rows: DataFrame, total: int, width: int, bins: int) -> list[np.ndarray]:
    """Candidate splits of each feature from all rows (x, n): cells are divided where they matter until the rest does not."""
    cells = {f: np.array([(total, -np.inf, np.inf)], _CELL) for f in range(width)}
    cuts: list[np.ndarray] = [np.zeros(0)] * width
    while cells:
        wanted = {}
        for f in list(cells):
            cuts[f], divided = _walk(cells[f], bins)
            if len(divided):
                wanted[f] = cells[f][divided]
                cells[f] = np.delete(cells[f], divided)
            else:
                del cells[f]
        if not wanted:
            break
        if sum(int(c["n"].sum()) for c in wanted.values()) <= VALUES:
            found = rows.mapInArrow(_listed(wanted), "feature int, low double, n long").groupBy("feature", "low").agg(F.sum("n").alias("n"))
            found = found.select("feature", "n", "low", F.col("low").alias("high"))
        else:
            most = max(8, RANGES // width)
            ranges = {f: _ranges(c, max(2, most // len(c))) for f, c in wanted.items()}
            found = rows.mapInArrow(_counted(ranges), "feature int, place long, n long, low double, high double").groupBy("feature", "place").agg(
                F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        found = found.select("feature", "n", "low", "high").toArrow()
        feature, parts = found.column("feature").to_numpy(), np.zeros(len(found), _CELL)
        for name in _CELL.names:
            parts[name] = found.column(name).to_numpy()
        order = np.argsort(feature, kind="stable")
        for f, of in zip(np.unique(feature).tolist(), np.split(order, np.flatnonzero(np.diff(feature[order])) + 1)):
            cells[f] = np.sort(np.concatenate([cells[f], parts[of]]), order="low")
    return cuts


def _impurity(s: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and weight of rows of sums: Gini's for classes, else the variance."""
    if classes:
        total = s.sum(1)
        out = np.ones(len(s))
        with np.errstate(invalid="ignore", divide="ignore"):
            for c in range(classes):
                part = s[:, c] / total
                out -= part * part
        return np.where(total > 0, out, 0.0), total
    with np.errstate(invalid="ignore", divide="ignore"):
        out = (s[:, 2] - s[:, 1] * s[:, 1] / s[:, 0]) / s[:, 0]
    return np.where(s[:, 0] > 0, out, 0.0), s[:, 0]


def _allowed(nodes: np.ndarray, salt: np.uint64, width: int, wanted: int) -> np.ndarray | None:
    """Which features each node may split on; None for all."""
    if wanted >= width:
        return None
    ranks = _mix(_mix(nodes.astype(np.uint64) + salt)[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(nodes), width), bool)
    np.put_along_axis(out, np.argsort(ranks, axis=1, kind="stable")[:, :wanted], True, 1)
    return out


def _order(keys: np.ndarray, top: int) -> np.ndarray:
    """Stable order of keys below ``top``; short keys are ordered by counting."""
    return np.argsort(keys.astype(np.uint16) if top <= 1 << 16 else keys, kind="stable")


def _gains(left: np.ndarray, whole: np.ndarray, total: np.ndarray, weight: np.ndarray, how: dict) -> np.ndarray:
    """Gains of splits from the sums on their left; the other arrays are those of the node of each split."""
    (li, lw), (ri, rw) = _impurity(left, how["classes"]), _impurity(total - left, how["classes"])
    got = whole - lw / weight * li - rw / weight * ri
    got[(lw < how["min_rows"]) | (rw < how["min_rows"]) | (got < how["min_gain"])] = 0.0
    if not how["classes"]:  # sums of other orders differ in their last digits: equal splits stay equal
        got = np.where(whole > 0, np.round(got / np.where(whole > 0, whole, 1.0), DIGITS) * whole, 0.0)
    return got


def _firsts(got: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node in the ordered ``node``, its highest gain and the first place that has it."""
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    top = np.maximum.reduceat(got, starts)
    place = np.where(got == np.repeat(top, np.diff(np.append(starts, len(node)))), np.arange(len(node)), len(node))
    return node[starts], top, np.minimum.reduceat(place, starts)


def _ones(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with more than two bins (or with the upper of two in many rows), and row and feature of the others' rows in the upper bin, by feature."""
    wide = (bins.max(0, initial=0) > 1) | (np.count_nonzero(bins, axis=0) * MANY > len(bins))
    two = np.flatnonzero(~wide)
    feature, row = np.nonzero(bins[:, two].T)
    return np.flatnonzero(wide), row, two[feature]


def _best_splits(bins: np.ndarray, sums: np.ndarray, at: np.ndarray, total: np.ndarray, allowed: np.ndarray | None, how: dict,
                 only: np.ndarray | None = None, ones: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and last bin on the left of the best split of each node (gain 0 without one).

    Rows hold the bins of all features, or of the feature ``only`` each; ``at`` is the node of a row.  Features of two bins need
    their ``ones`` (as of ``_ones``) only, so a category costs the rows that have it; the rest of a node is on the left.
    """
    nodes, width = len(total), how["width"]
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.full(nodes, -1)
    whole, weight = _impurity(total, how["classes"])
    for f in range(width) if ones is None else ones[0].tolist():
        rows = np.arange(len(at)) if only is None else np.flatnonzero(only == f)
        if allowed is not None:
            rows = rows[allowed[at[rows], f]]
        if len(rows) < 2:
            continue
        value = bins[rows, f] if only is None else bins[rows, 0]
        order = _order(value, 256)
        order = order[_order(at[rows[order]], nodes)]
        rows, key = rows[order], at[rows[order]] * 256 + value[order]
        stop = np.flatnonzero(key[1:] != key[:-1])          # last row of each bin of a node but the very last bin
        node = key[stop] >> 8
        inside = (key[stop + 1] >> 8) == node
        if not inside.any():
            continue
        run = np.cumsum(sums[rows], axis=0)
        first = np.flatnonzero(np.concatenate([[True], (key[1:] >> 8) != (key[:-1] >> 8)]))
        before = np.zeros((nodes, sums.shape[1]))
        before[key[first] >> 8] = np.where((first > 0)[:, None], run[first - 1], 0.0)
        stop, node = stop[inside], node[inside]
        got = _gains(run[stop] - before[node], whole[node], total[node], weight[node], how)
        owner, top, place = _firsts(got, node)
        better = top > gain[owner]
        owner, place = owner[better], place[better]
        gain[owner], feature[owner], cut[owner] = top[better], f, key[stop[place]] & 255
    if ones is not None and len(ones[1]):
        rows, of = ones[1:]
        if allowed is not None:
            kept = allowed[at[rows], of]
            rows, of = rows[kept], of[kept]
        order = _order(at[rows], nodes)
        rows, of = rows[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], (at[rows[1:]] != at[rows[:-1]]) | (of[1:] != of[:-1])])) if len(rows) else rows
        node, of, size = at[rows[first]], of[first], np.diff(np.append(first, len(rows)))
        inside = size < np.bincount(at, minlength=nodes)[node]
        if inside.any():
            right = np.add.reduceat(sums[rows], first, axis=0)[inside]
            node, of = node[inside], of[inside]
            owner, top, place = _firsts(_gains(total[node] - right, whole[node], total[node], weight[node], how), node)
            found = of[place]
            better = (top > gain[owner]) | ((top == gain[owner]) & (top > 0) & (found < feature[owner]))
            owner = owner[better]
            gain[owner], feature[owner], cut[owner] = top[better], found[better], 0
    return gain, feature, cut


def _per_node(at: np.ndarray, sums: np.ndarray, nodes: int) -> np.ndarray:
    return np.stack([np.bincount(at, sums[:, k], nodes) for k in range(sums.shape[1])], 1)


def _records(ids, feature, cut, gain) -> np.ndarray:
    out = np.zeros(len(ids), _NODE)
    out["node"], out["feature"], out["cut"], out["gain"] = ids, feature, cut, gain
    return out


def _grow(tree: int, root: int, bins: np.ndarray, sums: np.ndarray, how: dict) -> tuple[np.ndarray, np.ndarray]:
    """All nodes under ``root``, level by level, and their sums."""
    ids, at = np.array([root]), np.zeros(len(bins), np.int64)
    found, values, salt = [], [], _salt(how["seed"], tree)
    wide, row, of = _ones(bins)
    while len(ids):
        total = _per_node(at, sums, len(ids))
        impurity, weight = _impurity(total, how["classes"])
        deep = ids >= 1 << how["depth"]
        live = ~deep & ~((np.abs(impurity) < 1e-6) & (ids > 1))
        keep = live[at]
        number = np.cumsum(live) - 1
        bins, sums, at, row, of = _left(keep, bins, sums, number[at], row, of)
        allowed = _allowed(ids[live], salt, how["width"], how["subset"])
        gain, feature, cut = (np.zeros(len(ids)), np.full(len(ids), -1), np.full(len(ids), -1))
        gain[live], feature[live], cut[live] = _best_splits(bins, sums, at, total[live], allowed, how, None, (wide, row, of))
        found.append(_records(ids, feature, cut, gain * weight))
        values.append(total)
        split = feature[live] >= 0
        bins, sums, at, row, of = _left(split[at], bins, sums, at, row, of)
        side = bins[np.arange(len(at)), feature[live][at]] > cut[live][at]
        at = (np.cumsum(split) - 1)[at] * 2 + side
        parents = ids[live][split]
        ids = np.stack([parents * 2, parents * 2 + 1], 1).ravel()
    return np.concatenate(found), np.concatenate(values)


def _left(keep: np.ndarray, bins: np.ndarray, sums: np.ndarray, at: np.ndarray, row: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows to keep, and their ones under the new row numbers."""
    ones = keep[row]
    return bins[keep], sums[keep], at[keep], (np.cumsum(keep) - 1)[row[ones]], of[ones]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _sums(batch: pa.RecordBatch | pa.Table, stats: int) -> np.ndarray:
    return np.stack([batch.column(f"s{k}").to_numpy() if isinstance(batch, pa.Table) else
                     batch.column(f"s{k}").to_numpy(zero_copy_only=False) for k in range(stats)], 1)


def _bagged(how: dict):
    """Cells of each tree and their sums, from rows (bins, label, n) and the samples drawn from them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(0).dictionary_encode()
            cell, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
            label, counts, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            hashes = hashes.view(np.uint64)
            for tree in range(how["trees"]):
                if how["drawn"]:
                    weight, salt = np.zeros(len(label)), _salt(how["seed"], tree, 7)
                    for row, copy in _copies(counts, DRAWN):
                        weight += np.bincount(row, _poisson(_mix(_mix(hashes[row] + salt) + copy.astype(np.uint64))), len(label))
                else:
                    weight = counts.astype(float)
                if how["classes"]:
                    sums = np.bincount(cell * how["classes"] + label.astype(np.int64), weight, len(names) * how["classes"])
                    sums = sums.reshape(len(names), -1)
                else:
                    sums = np.stack([np.bincount(cell, weight * label ** p, len(names)) for p in range(3)], 1)
                kept = np.flatnonzero(sums[:, 0] > 0) if not how["classes"] else np.flatnonzero(sums.sum(1) > 0)
                if len(kept):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(kept), tree, np.int32)), names.take(pa.array(kept)), *[pa.array(sums[kept, k]) for k in range(how["stats"])]],
                        ["tree", "bins", *[f"s{k}" for k in range(how["stats"])]])

    return run


def _tables(how: dict, big: dict):
    """Sums by feature and bin of the nodes ``big``, from the cells of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = how["width"] * 256 * how["stats"]

        def out():
            for (tree, node), table in held.items():
                f, b = np.nonzero(table.any(2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(f), tree, np.int32)), pa.array(np.full(len(f), node, np.int64)), pa.array(f.astype(np.int32)),
                     pa.array(b.astype(np.int32)), *[pa.array(table[f, b, k]) for k in range(how["stats"])]],
                    ["tree", "node", "feature", "bin", *[f"s{k}" for k in range(how["stats"])]])
            held.clear()

        for batch in batches:
            if not len(batch):
                continue
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            bins, sums = _matrix(batch.column("bins"), how["width"]), _sums(batch, how["stats"])
            for key in {k for k in zip(tree.tolist(), node.tolist()) if k in big}:
                rows = np.flatnonzero((tree == key[0]) & (node == key[1]))
                table = held.setdefault(key, np.zeros((how["width"], 256, how["stats"])))
                for f in range(how["width"]):
                    table[f] += _per_node(bins[rows, f].astype(np.int64), sums[rows], 256)
                if len(held) * size * 8 > TABLE_BYTES:
                    yield from out()
        yield from out()

    return run


def _split_tables(how: dict):
    def run(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        sums, feature = _sums(table, how["stats"]), table.column("feature").to_numpy()
        total = sums[feature == 0].sum(0)[None, :]
        impurity, weight = _impurity(total, how["classes"])
        gain, f, cut = np.zeros(1), np.full(1, -1), np.full(1, -1)
        if node < 1 << how["depth"] and not (abs(impurity[0]) < 1e-6 and node > 1):
            allowed = _allowed(np.array([node]), _salt(how["seed"], tree), how["width"], how["subset"])
            gain, f, cut = _best_splits(table.column("bin").to_numpy()[:, None], sums, np.zeros(len(sums), np.int64), total, allowed, how, feature)
        return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([_records([node], f, cut, gain * weight).tobytes()], pa.binary()),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    return run


def _subtrees(how: dict):
    def run(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        bins = _matrix(table.column("bins"), how["width"])
        order = np.lexsort(bins.T[::-1])  # the same sums however the rows came
        nodes, sums = _grow(tree, node, bins[order], _sums(table, how["stats"])[order], how)
        flat = zip(PARTS, _flat(nodes, sums, how))
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()),
                         **{name: pa.array([a.tobytes()], pa.binary()) for name, a in flat}})

    return run


def _flat(nodes: np.ndarray, sums: np.ndarray, how: dict) -> tuple[np.ndarray, ...]:
    """The arrays of a forest (see there) for one subtree with its root first, and its gains by feature."""
    ids, feature, kept, guess = nodes["node"], nodes["feature"].copy(), np.ones(len(nodes), bool), _guess(sums, how)
    level = np.frexp(ids.astype(float))[1]
    for d in range(int(level.max()) - 1, int(level.min()) - 1, -1):  # two leaves with the same prediction are one
        here = np.flatnonzero((level == d) & (feature >= 0))
        child = np.searchsorted(ids, ids[here] * 2)
        same = (feature[child] < 0) & (feature[child + 1] < 0) & (guess[child] == guess[child + 1])
        feature[here[same]] = -1
        kept[child[same]] = kept[child[same] + 1] = False
    nodes, sums, feature = nodes[kept], sums[kept], feature[kept]
    inner, leaf = np.flatnonzero(feature >= 0), feature < 0
    left = np.zeros(len(nodes), np.int32)
    left[inner] = np.searchsorted(nodes["node"], nodes["node"][inner] * 2)
    left[leaf] = -1 - np.arange(int(leaf.sum()))
    gains = np.bincount(feature[inner], nodes["gain"][inner], how["width"])
    return feature.astype(np.int32), nodes["cut"].astype(np.int16), left, _values(sums[leaf], how), gains


def _guess(sums: np.ndarray, how: dict) -> np.ndarray:
    return sums.argmax(1).astype(float) if how["classes"] else sums[:, 1] / sums[:, 0]


def _values(sums: np.ndarray, how: dict) -> np.ndarray:
    """Shares of the classes, or the mean less the centre."""
    return sums / sums.sum(1, keepdims=True) if how["classes"] else (sums[:, 1] / sums[:, 0])[:, None]


def _joined(top: dict, parts: dict, how: dict) -> tuple[np.ndarray, ...]:
    """One tree from the nodes split over all tasks (by number: record and sums) and the subtrees below them."""
    if not top:
        return parts[1]
    same = {}  # what a leaf predicts
    for n, (record, sums) in top.items():
        if record["feature"] < 0:
            same[n] = _guess(sums, how)[0]
    for n, part in parts.items():
        if part[0][0] < 0:
            same[n] = float(part[3][0].argmax()) if how["classes"] else part[3][0, 0]
    for n in sorted(top, reverse=True):
        if n not in same and 2 * n in same and 2 * n + 1 in same and same[2 * n] == same[2 * n + 1]:
            same[n] = _guess(top[n][1], how)[0]
    feature, cut, left, values = [np.full(1, -1, np.int32)], [np.full(1, -1, np.int16)], [np.zeros(1, np.int32)], []
    gains, size, leaves, waiting = np.zeros(how["width"]), 1, 0, [(1, 0, 0)]  # node, its array and place in it
    while waiting:
        n, array, place = waiting.pop()
        if n in parts:
            f, c, le, v, g = parts[n]
            le = np.where(le < 0, le - leaves, le + size - 1)
            feature[array][place], cut[array][place], left[array][place] = f[0], c[0], le[0]
            feature, cut, left = feature + [f[1:]], cut + [c[1:]], left + [le[1:].astype(np.int32)]
            size, gains = size + len(f) - 1, gains + g
        elif n in same:
            v = _values(top[n][1], how)
            left[array][place] = -1 - leaves
        else:
            record = top[n][0]
            feature[array][place], cut[array][place], left[array][place] = record["feature"], record["cut"], size
            gains[record["feature"]] += record["gain"]
            feature, cut, left = feature + [np.full(2, -1, np.int32)], cut + [np.full(2, -1, np.int16)], left + [np.zeros(2, np.int32)]
            waiting += [(2 * n, len(left) - 1, 0), (2 * n + 1, len(left) - 1, 1)]
            size += 2
            continue
        values.append(v)
        leaves += len(v)
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(values), gains


def _moved(how: dict, splits: dict):
    """Cells of split nodes go to their children, those of leaves are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy().copy()
            bins, keep = _matrix(batch.column("bins"), how["width"]), np.ones(len(node), bool)
            for key in {k for k in zip(tree.tolist(), node.tolist()) if k in splits}:
                rows, (feature, cut) = np.flatnonzero((tree == key[0]) & (node == key[1])), splits[key]
                if feature < 0:
                    keep[rows] = False
                else:
                    node[rows] = key[1] * 2 + (bins[rows, feature] > cut)
            columns = [pa.array(node) if name == "node" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep))

    return run


def _cells(data: DataFrame, how: dict, max_bins: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (bins, label, n) and the candidate splits of each feature."""
    rows = materialize(data.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
                       .groupBy("label", "x").agg(F.count(F.lit(1)).alias("n")), "distinct")
    total, widest, mean = rows.agg(F.sum("n"), F.max(F.size("x")), F.try_divide(F.sum(F.col("label") * F.col("n")), F.sum("n"))).first()
    if not total:
        raise ValueError("there are no labelled rows to learn from")
    width = how["width"] = widest
    how["centre"] = 0.0 if how["classes"] else float(f"{mean:.3g}")  # squares of small numbers keep their digits
    cuts = _candidates(rows.select("x", "n"), total, width, min(max_bins, total))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _bins(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(0), batch.column(2)], ["bins", "label", "n"])

    cells = rows.select((F.col("label") - F.lit(how["centre"])).alias("label"), "x", "n").mapInArrow(binned, "bins binary, label double, n long")
    return materialize(cells.groupBy("bins", "label").agg(F.sum("n").alias("n")), "cells"), cuts


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1).astype(np.uint8)


def _subset(strategy: str, width: int, trees: int, classes: int) -> int:
    """Features that a node may split on, by the library's names."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}
    if strategy in named:
        return named[strategy]
    number = float(strategy)
    return min(width, int(number)) if number > 1 or "." not in strategy else math.ceil(number * width)


class Forest:
    """Trees as flat arrays; adds ``prediction`` and, for classes, ``probability`` like the library's models.

    ``left`` is the place of a node's left child (the right one follows), or -1 - the row of ``values`` of a leaf.
    """

    def __init__(self, classes: int, cuts: list, roots: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray,
                 values: np.ndarray, importances: np.ndarray):
        self.classes, self.cuts, self.roots, self.feature, self.cut = classes, cuts, roots, feature, cut
        self.left, self.values, self.importances = left, values, importances

    @property
    def featureImportances(self):  # noqa: N802  (the library's name)
        return Vectors.dense(self.importances)

    @staticmethod
    def fit(data: DataFrame, classes: int, settings: dict) -> Forest:
        """From rows (label, features). ``settings`` has the library's parameters by name; without ``numTrees`` one tree is grown from all rows."""
        trees, depth, max_bins = settings.get("numTrees", 1), settings["maxDepth"], settings["maxBins"]
        if trees < 1 or not 0 <= depth <= 30 or not 2 <= max_bins <= 256:
            raise ValueError(f"no forest has {trees} trees of depth {depth} over {max_bins} bins; at least one, 0 to 30 and 2 to 256")
        how = {"classes": classes, "stats": classes or 3, "trees": trees, "drawn": trees > 1, "depth": depth, "seed": settings["seed"],
               "min_rows": settings["minInstancesPerNode"], "min_gain": settings["minInfoGain"]}
        rows, cuts = _cells(data, how, max_bins)
        how["subset"] = _subset(settings.get("featureSubsetStrategy", "all"), how["width"], trees, classes)
        spark, stats = data.sparkSession, [f"s{k}" for k in range(how["stats"])]
        shape = ", ".join(f"{s} double" for s in stats)
        tasks = max(spark.sparkContext.defaultParallelism, 1)
        drawn = rows.repartition(tasks, "bins", "label").withColumn("h", F.xxhash64("label", "bins")).mapInArrow(
            _bagged(how), f"tree int, bins binary, {shape}")
        cells = materialize(drawn.groupBy("tree", "bins").agg(*[F.sum(s).alias(s) for s in stats]).withColumn("node", F.lit(1).cast("long")), "bag")
        upper: dict[int, dict] = {}
        while True:
            big = {(r["tree"], r["node"]) for r in cells.groupBy("tree", "node").count().where(F.col("count") > MAX_CELLS).collect()}
            if not big:
                break
            tables = cells.mapInArrow(_tables(how, big), f"tree int, node long, feature int, bin int, {shape}")
            tables = tables.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(s).alias(s) for s in stats])
            found = tables.groupBy("tree", "node").applyInArrow(_split_tables(how), "tree int, nodes binary, sums binary").collect()
            nodes = [(r["tree"], np.frombuffer(r["nodes"], _NODE)[0]) for r in found]
            for (t, n), r in zip(nodes, found):
                upper.setdefault(t, {})[int(n["node"])] = n, np.frombuffer(r["sums"])[None, :]
            splits = {(t, int(n["node"])): (int(n["feature"]), int(n["cut"])) for t, n in nodes}
            cells = materialize(cells.mapInArrow(_moved(how, splits), cells.schema), "bag")
        grown = cells.groupBy("tree", "node").applyInArrow(_subtrees(how), "tree int, node long, " + ", ".join(f"{p} binary" for p in PARTS))
        lower: dict[int, dict] = {}
        for r in grown.collect():
            part = [np.frombuffer(r[p], kind) for p, kind in PARTS.items()]
            part[3] = part[3].reshape(-1, classes or 1)
            lower.setdefault(r["tree"], {})[r["node"]] = tuple(part)
        return Forest._of(upper, lower, cuts, how)

    @staticmethod
    def _of(upper: dict, lower: dict, cuts: list, how: dict) -> Forest:
        trees = {t: _joined(upper.get(t, {}), lower.get(t, {}), how) for t in sorted(upper.keys() | lower.keys())}
        roots = np.cumsum([0] + [len(t[0]) for t in trees.values()])[:-1]
        leaves = np.cumsum([0] + [len(t[3]) for t in trees.values()])[:-1]
        feature, cut, values = (np.concatenate([t[i] for t in trees.values()]) for i in (0, 1, 3))
        left = np.concatenate([np.where(t[2] < 0, t[2] - k, t[2] + r).astype(np.int32) for t, r, k in zip(trees.values(), roots, leaves)])
        own = np.zeros((how["trees"], how["width"]))
        own[list(trees)] = [t[4] for t in trees.values()]
        totals = own.sum(1, keepdims=True)
        mean = np.divide(own, totals, out=np.zeros_like(own), where=totals > 0).sum(0)
        return Forest(how["classes"], cuts, roots, feature, cut, left, values + how["centre"], mean / mean.sum() if mean.sum() > 0 else mean)

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.cuts, self.roots, self.feature, self.cut, self.left, self.values))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cuts, roots, feature, cut, left, values = shared.value
            for x in batches:
                if not len(x):
                    yield pd.Series([], dtype=object)
                    continue
                cells, of = np.unique(_bins(np.vstack(x.to_numpy()), cuts), axis=0, return_inverse=True)
                total = np.zeros((len(cells), values.shape[1]))
                for root in roots.tolist():
                    place = np.full(len(cells), root)
                    while True:
                        open_ = np.flatnonzero(left[place] >= 0)
                        if not len(open_):
                            break
                        at = place[open_]
                        place[open_] = left[at] + (cells[open_, feature[at]] > cut[at])
                    total += values[-1 - left[place]]
                yield pd.Series(list((total / len(roots))[of.ravel()]))

        scored = df.withColumn("_mean", F.pandas_udf(run, "array<double>")(vector_to_array("features")))
        if not self.classes:
            return scored.select(*df.columns, F.get("_mean", F.lit(0)).alias("prediction"))
        best = F.array_position("_mean", F.array_max("_mean")) - 1  # the first of equal shares
        return scored.select(*df.columns, array_to_vector("_mean").alias("probability"), best.cast("double").alias("prediction"))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        parts = {"roots": self.roots.astype(np.int64), "feature": self.feature, "cut": self.cut, "left": self.left, "importances": self.importances}
        rows = [(name, str(a.dtype), 0, bytearray(a.tobytes())) for name, a in parts.items()]
        rows += [("values", str(self.values.dtype), self.values.shape[1], bytearray(self.values.tobytes()))]
        rows += [(f"cuts{f}", "float64", self.classes, bytearray(np.asarray(c, float).tobytes())) for f, c in enumerate(self.cuts)]
        spark.createDataFrame(rows, "name string, kind string, number int, data binary").coalesce(1).write.parquet(f"{path}/forest")

    @staticmethod
    def load(path: str) -> Forest:
        spark = SparkSession.getActiveSession()
        rows = {r["name"]: (np.frombuffer(r["data"], r["kind"]), r["number"]) for r in spark.read.parquet(f"{path}/forest").collect()}
        cuts = [rows[f"cuts{f}"] for f in range(sum(n.startswith("cuts") for n in rows))]
        values, width = rows["values"]
        return Forest(cuts[0][1], [c for c, _ in cuts], *[rows[n][0] for n in ("roots", "feature", "cut", "left")],
                      values.reshape(-1, width), rows["importances"][0])


# workers get these functions by value, so the package need not be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

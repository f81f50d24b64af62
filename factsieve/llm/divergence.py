"""Source divergence audit over a k-squared quadtree (operator 12).

Each language has a matrix of term counts, a row for each kept term and a column for each source.  A count gives the term's smoothed
share in parts of ``SCALE``; the audit sums the differences of the shares over all terms for each pair of sources, and names
the terms that a source uses more than its language does.

The matrix is cut into tiles of about ``TILE_TERMS`` terms and two blocks of about ``BLOCK_GROUPS`` sources; a tile is one group of one
task.  In it each block is a k-squared tree (k = 2): a node is a square of terms and sources, and a square without any
count has no children.  Two trees are walked together.  Where both have an empty square, its part of all sums is known without
looking inside: the number of its terms times the difference of the two sources' shares of an absent term.  Squares that
hold a count in either tree are opened down to leaves of ``LEAF`` terms, which are compared in numpy.  Rows are ordered by the number of sources
that hold the term and columns by their counts, so that counts lie together and empty squares are large.

Counting is one pass over the texts with bounded counters in each task, so a hot source reaches the shuffle pre-aggregated.  Shares
are computed with exact decimals; sums of shares stay below 2 * ``SCALE`` plus the number of terms.

Defined results: null text, language or source counts as ''.  A group without terms has the share of an absent term everywhere; a language
without kept terms has differences of 0.  Repeated rows count as often as they stand there.  Ties are broken by the bytes of the item.
An empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.plans.store import materialize

MIN_DOCS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50
#: A tile has about this many terms, a block of sources about this many columns, a leaf of the tree this many of both.
TILE_TERMS, BLOCK_GROUPS, LEAF = 4096, 64, 8
#: Terms in a task's counters before they are handed on, and bytes of a text counted at once.
COUNTED, PIECE_BYTES = 400_000, 1 << 22
#: Leaf pairs compared at once.
LEAVES = 4096

# A term is a run of ASCII letters and of bytes of non-ASCII characters; only A to Z are lower-cased.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in pieces of bounded size."""
    data = text.encode().translate(_TABLE)
    low = 0
    while low < len(data):
        high = low + PIECE_BYTES
        if high < len(data):
            high = data.find(b" ", high)
            high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; the empty term stands for the group itself."""
    uses: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), used in uses.items():
            used[b""] += 0
            found, n = docs[lang, source], len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(used), pa.binary()).cast(pa.string()),
                 pa.array(list(used.values()), pa.int64()), pa.array([found[t] for t in used], pa.int64())], ["lang", "source", "term", "uses", "docs"])
        uses.clear()
        docs.clear()

    for batch in batches:
        for text, lang, source in zip(*[batch.column(i) for i in range(3)]):
            key = (lang.as_py(), source.as_py())
            used = uses[key]
            before, distinct = len(used), set()
            for piece in terms(text.as_py()):
                used.update(piece)
                distinct.update(piece)
            docs[key].update(distinct)
            held += len(used) - before
            if held > COUNTED:
                yield from rows()
                held = 0
    yield from rows()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, term, uses, docs); each group also has a row for the empty term."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col)]
    counted = docs.select(*columns).mapInArrow(_count, "lang string, source string, term string, uses long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def share(uses: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (uses + SMOOTH) / (total + SMOOTH * kept)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (uses + F.lit(SMOOTH)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + F.lit(SMOOTH) * kept).cast("decimal(20,0)"))


# ---- one tile -------------------------------------------------------------------------------------------------------------

class Quadtree:
    """Occupied squares of a matrix of terms and sources, from leaves of LEAF x LEAF up to one square over all."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, absent: np.ndarray, height: int) -> None:
        self.absent, self.levels = np.append(absent, np.zeros(-len(absent) % LEAF, np.int64)), []
        row, column = rows // LEAF, columns // LEAF
        for level in range(height + 1):
            side = 1 << (height - level)
            self.levels.append(np.unique((row >> level) * side + (column >> level)))
        side = 1 << height
        code = row * side + column
        at = np.searchsorted(self.levels[0], code)
        # a leaf holds shares; a place without a count has its source's share of an absent term
        leaves = self.levels[0] % side
        self.leaves = np.repeat(self.absent.reshape(-1, LEAF)[leaves][:, None, :], LEAF, axis=1)
        self.leaves[at, rows % LEAF, columns % LEAF] = values

    def holds(self, level: int, code: np.ndarray) -> np.ndarray:
        known = self.levels[level]
        if not len(known):
            return np.zeros(len(code), bool)
        return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code

    def leaf(self, code: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The leaves of the codes; empty ones are filled with the shares of absent terms."""
        out = np.repeat(self.absent.reshape(-1, LEAF)[column][:, None, :], LEAF, axis=1)
        here = self.holds(0, code)
        out[here] = self.leaves[np.searchsorted(self.levels[0], code[here])]
        return out


def joint_differences(a: Quadtree, b: Quadtree, height: int, n_terms: int) -> np.ndarray:
    """Sum of the absolute differences over all terms for each column of ``a`` and each of ``b``."""
    wide, tall = len(a.absent) // LEAF, len(b.absent) // LEAF
    total = np.zeros((wide * LEAF, tall * LEAF), np.int64)
    empty = np.zeros((wide, tall), np.int64)  # terms in squares that are empty in both trees, for each pair of leaf columns
    row = x = y = np.zeros(1, np.int64)
    for level in range(height, -1, -1):
        side, span = 1 << (height - level), 1 << level
        blank = ~a.holds(level, row * side + x) & ~b.holds(level, row * side + y)
        # the squares on the matrix's edge are only as large as the matrix
        height_of = np.clip(n_terms - row * span * LEAF, 0, span * LEAF)
        for r, c, d in zip(height_of[blank].tolist(), x[blank].tolist(), y[blank].tolist()):
            empty[c * span:(c + 1) * span, d * span:(d + 1) * span] += r
        row, x, y = row[~blank], x[~blank], y[~blank]
        if level:
            children = [(2 * row + i, 2 * x + j, 2 * y + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
            row, x, y = (np.concatenate(c) for c in zip(*children))
            below = span // 2
            inside = (row * below * LEAF < n_terms) & (x * below < wide) & (y * below < tall)
            row, x, y = row[inside], x[inside], y[inside]
    side = 1 << height
    for low in range(0, len(row), LEAVES):
        r, c, d = row[low:low + LEAVES], x[low:low + LEAVES], y[low:low + LEAVES]
        gap = np.abs(a.leaf(r * side + c, c)[:, :, :, None] - b.leaf(r * side + d, d)[:, :, None, :])
        gap[(r[:, None] * LEAF + np.arange(LEAF)) >= n_terms] = 0
        np.add.at(total.reshape(wide, LEAF, tall, LEAF).transpose(0, 2, 1, 3), (c, d), gap.sum(1))
    return total + np.repeat(np.repeat(empty, LEAF, 0), LEAF, 1) * np.abs(a.absent[:, None] - b.absent[None, :])


_TILE_OUT = "lang string, source string, item string, value long"


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Differences of all pairs of one tile. Rows with ``row`` -1 are the sources; the others are counted terms."""
    lang, _, low, high = (k.as_py() for k in key)
    n_terms, row, side, col, share_of = (rows[c].to_numpy() for c in ("tile_terms", "row", "side", "col", "share"))
    names, sides = rows["source"], []
    for which in (0,) if low == high else (0, 1):
        head = np.flatnonzero((row < 0) & (side == which))
        head, cell = head[np.argsort(col[head])], (row >= 0) & (side == which)
        sides.append((names.take(pa.array(head)).to_pylist(), share_of[head], row[cell], col[cell], share_of[cell]))
    n_terms, (left, right) = int(n_terms[0]), (sides[0][0], sides[-1][0])
    a, b, found = [], [], np.zeros(0, np.int64)
    if left and right:  # by chance a block may hold no source
        height = (-(-max(n_terms, len(left), len(right)) // LEAF) - 1).bit_length()
        trees = [Quadtree(*cells, absent, height) for _, absent, *cells in sides]
        value = joint_differences(trees[0], trees[-1], height, n_terms)
        i, j = np.divmod(np.arange(len(left) * len(right)), len(right))
        if low == high:
            i, j = i[i != j], j[i != j]
        a, b, found = np.array(left, object)[i], np.array(right, object)[j], value[i, j]
        if low != high:
            a, b, found = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([found, found])
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array(a, pa.string()), "item": pa.array(b, pa.string()),
                     "value": pa.array(found, pa.int64())})


# ---- the audit ------------------------------------------------------------------------------------------------------------

def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
          top_terms: int = TOP_TERMS, tile_terms: int = TILE_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` for each other source of the language, ``term`` for a source's own terms."""
    counts = materialize(count_terms(docs, text_col, lang_col, source_col), "term-counts")
    real = counts.where("term <> ''")
    kept = materialize(real.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("uses").alias("lang_uses"), F.count(F.lit(1)).alias("holders")).where(F.col("docs") >= min_docs), "kept-terms")
    cells = materialize(real.select("lang", "source", "term", "uses").join(kept.select("lang", "term"), ["lang", "term"]), "cells")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_uses").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    langs = counts.where("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(sizes, "lang", "left").na.fill(0).withColumns(
        {"tiles": F.greatest(F.lit(1), F.ceil(F.col("kept") / tile_terms)).cast("int"),
         "blocks": F.greatest(F.lit(1), F.ceil(F.col("groups") / block_groups)).cast("int")})
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")).withColumns({
        "col": (F.row_number().over(W.partitionBy("lang", "block").orderBy(F.desc("total"), "source")) - 1).cast("long"),
        "absent": F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(0).cast("long"))})
    groups = materialize(groups, "groups")
    placed = kept.join(langs.select("lang", "kept", "lang_total", "tiles"), "lang").withColumns({
        "tile": F.pmod(F.xxhash64("term"), "tiles").cast("int"), "whole": share(F.col("lang_uses"), F.col("lang_total"), F.col("kept"))})
    placed = materialize(placed.withColumn(
        "row", (F.row_number().over(W.partitionBy("lang", "tile").orderBy(F.desc("holders"), "term")) - 1).cast("long")).select(
        "lang", "term", "tile", "row", "whole"), "placed-terms")
    shared = materialize(cells.join(placed, ["lang", "term"]).join(
        groups.select("lang", "source", "total", "kept", "block", "blocks", "col"), ["lang", "source"]).select(
        "lang", "source", "term", "tile", "row", "whole", "block", "blocks", "col", share(F.col("uses"), F.col("total"), F.col("kept")).alias("share")), "shares")
    return _pairs(groups, placed, shared).unionAll(_terms(shared, top_terms))


def _met(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that its block is in; ``side`` is its place in the pair."""
    both = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({
        "low": F.least("block", "_other"), "high": F.greatest("block", "_other"), "side": (F.col("block") > F.col("_other")).cast("int")})
    return both.drop("_other")


def _pairs(groups: DataFrame, placed: DataFrame, shared: DataFrame) -> DataFrame:
    filled = placed.groupBy("lang", "tile").agg(F.count(F.lit(1)).alias("tile_terms"))
    # a language has one empty tile where it keeps no term, so that its pairs come out with 0
    tiles = groups.select("lang", "tiles").distinct().withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles").join(
        filled, ["lang", "tile"], "left").na.fill(0, ["tile_terms"])
    columns = ["lang", "tile", "low", "high", "side", "col", "source", "row", "share"]
    heads = _met(groups).join(tiles.select("lang", "tile"), "lang").select(
        *[c for c in columns if c not in ("row", "share")], F.lit(-1).cast("long").alias("row"), F.col("absent").alias("share")).select(*columns)
    cells = _met(shared).withColumn("source", F.lit(None).cast("string")).select(*columns)
    rows = heads.unionAll(cells).join(tiles, ["lang", "tile"])
    parts = rows.groupBy("lang", "tile", "low", "high").applyInArrow(_tile, _TILE_OUT)
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(summed, "pair")


def _terms(shared: DataFrame, top_terms: int) -> DataFrame:
    own = shared.where("share > whole").select("lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("whole")).alias("value"))
    return _ranked(own, "term").where(F.col("rank") <= top_terms)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))

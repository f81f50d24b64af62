"""Substring duplicates by prefix-partitioned suffix trees (operator 11).

Every window of ``window`` words is the head of a suffix of its text.  Suffixes are dealt to groups by a prefix, a group's suffixes become a
tree in memory, and an internal node deeper than a window says that the suffixes below it begin with the same window: the node is a
repeat, as long as it is deep.

* The prefix that deals a suffix is the smallest word n-gram (by hash) of its window, read from where it begins.  Equal windows have the
  same one, and neighbouring windows mostly share it, so that a stretch of text is sent once for about 13 suffixes and not
  once for each.  Such a stretch is a context.
* N-grams that occur once in the corpus deal suffixes that cannot repeat; these never leave their row.
* Equal texts are one text and equal contexts one context, whatever their number, before a group is formed.
* A group beyond ``GROUP_WORDS`` is split by the suffixes' own prefixes of variable length: first of ``PREFIXES[0]`` words, where that
  is still too much of ``PREFIXES[1]``, and so on; suffixes that agree in a whole window are only counted.

A tree is kept as its suffixes in order and the depths of the nodes between neighbours: the suffixes are ordered by doubling, pairs of
names of half the length, so words are compared by their bytes and the depths are exact.

Rows stay in place except for texts that a bitmap of bounded size marks as concerned; all links between texts are shuffled tables.

Defined results: a null or empty text, or one of fewer words than a window, loses nothing.  Repeated rows repeat each other: all their
windows are found elsewhere.  Rows without an id are treated like others.  An empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm import textbytes as tb
from factsieve.llm.bitmap import flagged
from factsieve.plans.store import materialize

WINDOW = 35
#: Words of the n-gram that deals suffixes.
GRAM = 10
#: Words of a group of suffixes in one task, and the lengths of own prefixes that split a larger one.
GROUP_WORDS = 1 << 20
PREFIXES = (12, 20)
#: Words of one call that builds trees: many small groups together.
FOREST_WORDS = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RANGES = "array<struct<low:int,high:int>>"


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return tb.mix(left * _STEP + right)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, from pieces of 1, 2, 4 ... words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, piece, width = None, 0, hashes, 1
    while done < size:
        if size & width:
            part = piece[done:done + n]
            out = part if out is None else _joined(out, part)
            done += width
        if done < size:
            piece = _joined(piece[:-width], piece[width:])
            width *= 2
    return out


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of the ``size`` values from each place on."""
    n, width = len(values) - size + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[size - width:size - width + n])


class Segments:
    """Runs of neighbouring windows of one text that the same n-gram deals."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> None:
        self.starts, self.ends, self.text = tb.words(data, offsets)
        self.bounds = np.searchsorted(self.text, np.arange(len(offsets)))
        grams = gram_hashes(tb.span_hashes(data, self.starts, self.ends), gram)
        deals = _least(grams, window - gram + 1)
        whole = np.flatnonzero(self.text[:len(deals)] == self.text[window - 1:window - 1 + len(deals)])
        owner, value = self.text[whole], deals[whole]
        fresh = np.ones(len(whole), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        self.first, self.owner, self.value = whole[at], owner[at], value[at]
        self.windows = np.diff(np.append(at, len(whole)))
        self.grams, self.gram = grams, gram

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of each text that deal windows, twice where the text holds them more than once; text numbers with them."""
        inside = np.flatnonzero(self.text[:len(self.grams)] == self.text[self.gram - 1:self.gram - 1 + len(self.grams)])
        scoped = self.grams[inside] ^ tb.mix(self.text[inside].astype(np.uint64) + np.uint64(1))
        known, count = np.unique(scoped, return_counts=True)
        mine, once = np.unique(self.value ^ tb.mix(self.owner.astype(np.uint64) + np.uint64(1)), return_index=True)
        often = count[np.searchsorted(known, mine)] > 1
        picked = np.sort(np.concatenate([once, once[often]]))
        return self.value[picked].view(np.int64), self.owner[picked]


def _sketch(window: int, gram: int):
    def run(texts: pa.Array) -> pa.Array:
        words, values, ends = [], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in tb.text_chunks(texts):
            found = Segments(data, offsets, window, gram)
            value, owner = found.listed()
            words.append(np.diff(found.bounds))
            values.append(value)
            ends.append(np.searchsorted(owner, np.arange(1, len(offsets)), side="left") + ends[-1][-1])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(values)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(words) if words else [], pa.int64()), lists], ["n_words", "grams"])

    return F.arrow_udf(run, "struct<n_words:bigint,grams:array<bigint>>")


def _cut(window: int, gram: int):
    """Contexts of rows (key, text, grams) dealt by one of the n-grams: key, n-gram, first word, the words with a space after each."""
    def one(data: np.ndarray, offsets: np.ndarray, wanted: pa.Array) -> Iterator[tuple[int, int, int, bytes]]:
        found = Segments(data, offsets, window, gram)
        spaced = np.append(np.where(tb.SPACE[data], np.uint8(0x20), data), np.uint8(0x20))
        keys = found.value.view(np.int64)
        cuts = np.searchsorted(found.owner, np.arange(len(offsets)))
        for i, grams in enumerate(wanted):
            mine = np.flatnonzero(np.isin(keys[cuts[i]:cuts[i + 1]], grams.values.to_numpy(zero_copy_only=False))) + cuts[i]
            if not len(mine):
                continue
            base, stop, low, high = found.bounds[i], found.bounds[i + 1], offsets[i], offsets[i + 1]
            held = tb.span_values(np.append(spaced[low:high], np.uint8(0x20)), found.starts[base:stop] - low, found.ends[base:stop] - low + 1)
            places, flat = np.frombuffer(held.buffers()[1], np.int64), held.buffers()[2].to_pybytes()
            first = found.first[mine] - base
            last = first + found.windows[mine] + window - 1
            for k, f, x, y in zip(keys[mine].tolist(), first.tolist(), places[first].tolist(), places[last].tolist()):
                yield i, k, f, flat[x:y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for low, high, data, offsets in tb.text_chunks(batch.column(1)):
                rows = list(one(data, offsets, batch.column(2).slice(low, high - low)))
                if rows:
                    keys = batch.column(0).take(pa.array([low + r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[i + 1] for r in rows], k) for i, k in enumerate(kinds)]],
                                                     ["key", "gram", "first", "content"])

    return run


# ---- trees ----------------------------------------------------------------------------------------------------------------

class SuffixForest:
    """Suffixes of many contexts in order, with the depths of the nodes between neighbours, up to twice the greatest power of two in ``window``.

    ``ids`` are word numbers, ``bounds`` the contexts' words; suffixes end with their context.  Only suffixes of a whole window are kept.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, window: int) -> None:
        n = len(ids)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        rest = bounds[1:][owner] - np.arange(n)  # words to the end of the context
        names, width = [ids], 1
        while 2 * width <= window:
            # the name of twice the width, -1 where the context ends before
            last = names[-1]
            fits = np.flatnonzero(rest >= 2 * width)
            name = np.full(n, -1, np.int64)
            name[fits] = np.unique(last[fits] * (n + 1) + last[fits + width], return_inverse=True)[1]
            names.append(name)
            width *= 2
        self.places = np.flatnonzero(rest >= window)
        top = names[-1]
        self.order = self.places[np.lexsort((top[self.places + window - width], top[self.places]))]
        left, right = self.order[:-1], self.order[1:]
        depth = np.zeros(len(left), np.int64)
        for level in range(len(names) - 1, -1, -1):
            size, name = 1 << level, names[level]
            inside = (rest[left] >= depth + size) & (rest[right] >= depth + size)
            a, b = np.where(inside, left + depth, 0), np.where(inside, right + depth, 0)
            depth += np.where(inside & (name[a] == name[b]) & (name[a] >= 0), size, 0)
        self.depth, self.owner, self.window = depth, owner, window

    def repeated(self) -> np.ndarray:
        """Places, rising, whose suffix hangs below a node of at least a window's depth."""
        deep = np.concatenate([[False], self.depth >= self.window, [False]])
        return np.sort(self.order[deep[1:] | deep[:-1]]) if len(self.order) else self.order


def _marked(contents: list[bytes], often: np.ndarray, window: int) -> pa.Array:
    """For each context the ranges of words covered by windows that occur elsewhere; ``often`` marks contexts found more than once."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
    starts, ends, owner = tb.words(data, offsets)
    bounds = np.searchsorted(owner, np.arange(len(contents) + 1))
    ids = tb.span_ids(data, starts, ends)[0]
    forest = SuffixForest(ids, bounds, window)
    hit = np.zeros(len(ids), bool)
    hit[forest.repeated()] = True
    hit[forest.places[often[forest.owner[forest.places]]]] = True
    places = np.flatnonzero(hit)
    text = forest.owner[places]
    fresh = np.ones(len(places), bool)
    fresh[1:] = (places[1:] > places[:-1] + window) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    stops = np.append(at[1:], len(places))[:len(at)] - 1
    low, high = places[at] - bounds[text[at]], places[stops] + window - bounds[text[at]]
    cuts = np.searchsorted(text[at], np.arange(len(contents) + 1))
    ranges = pa.StructArray.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["low", "high"])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ranges)


def _grow(window: int):
    """Trees of rows (group, context, often, content), sorted by group; a group is never cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, often, contents, size, group = [], [], [], 0, None

        def rows() -> pa.RecordBatch:
            ranges = _marked(contents, np.array(often, bool), window)
            out = pa.RecordBatch.from_arrays([pa.array(contexts, pa.binary()), ranges], ["context", "ranges"])
            return out.filter(pa.array(np.diff(ranges.offsets.to_numpy()) > 0))

        for batch in batches:
            for g, context, many, content in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if size > FOREST_WORDS and g != group:
                    yield rows()
                    contexts, often, contents, size = [], [], [], 0
                group = g
                contexts.append(context)
                often.append(many)
                contents.append(content)
                size += content.count(b" ")
        if contents:
            yield rows()

    return run


def _trees(rows: DataFrame, window: int) -> DataFrame:
    """Rows (context, ranges) of the contexts with a repeated window."""
    dealt = rows.select("group", "context", "often", "content").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_grow(window), f"context binary, ranges {_RANGES}")


def _suffixes(window: int):
    """The windows of a context: first word, the window's words, hashes of its own prefixes."""
    def one(content: bytes) -> list[dict]:
        words = content.split()
        return [{"at": i, "content": b" ".join(words[i:i + window]) + b" "} for i in range(len(words) - window + 1)]

    def run(contents: pa.Array) -> pa.Array:
        return pa.array([one(c) for c in contents.to_pylist()], pa.list_(pa.struct([("at", pa.int32()), ("content", pa.binary())])))

    return F.arrow_udf(run, "array<struct<at:int,content:binary>>")


def _prefix(words: int) -> Column:
    return F.xxhash64("gram", F.substring_index(F.col("content").cast("string"), " ", words))


def _split_groups(rows: DataFrame, window: int, group_words: int) -> DataFrame:
    """Rows (context, ranges) of contexts in groups beyond the bound, by variable-length prefixes of their suffixes."""
    suffix = F.explode(_suffixes(window)("content")).alias("s")
    open_rows = materialize(rows.select("gram", "context", "often", suffix).select(
        "gram", "context", "often", "s.at", "s.content").withColumn("place", F.xxhash64("context", "at")), "suffixes")
    found = []
    for words in PREFIXES:
        keyed = open_rows.withColumn("group", _prefix(words))
        sizes = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("suffixes"))
        # a suffix of a small group is finished; the others get a longer prefix
        sized = materialize(keyed.join(sizes, "group"), "prefixes")
        small = sized.where(F.col("suffixes") * window <= group_words)
        # (context, at) of a window travels through the tree as its name
        named = small.select("group", F.concat("context", F.unhex(F.lpad(F.hex("at"), 8, "0"))).alias("context"), "often", "content")
        marks = _trees(named, window).select(F.expr("substring(context, 1, 16)").alias("context"),
                                             F.conv(F.hex(F.expr("substring(context, 17, 4)")), 16, 10).cast("int").alias("at"))
        found.append(marks)
        open_rows = sized.where(F.col("suffixes") * window > group_words).select("gram", "context", "often", "at", "content", "place")
        if not open_rows.limit(1).count():
            break
    else:
        # the rest agrees in long prefixes: whole windows are counted, once for each context that stands for one text
        whole = open_rows.groupBy("content").agg((F.count(F.lit(1)) + F.max(F.col("often").cast("int"))).alias("seen")).where("seen > 1")
        found.append(open_rows.join(whole, "content").select("context", "at"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.groupBy("context").agg(F.collect_list(F.struct(F.col("at").alias("low"), (F.col("at") + window).alias("high"))).alias("ranges"))


def repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_words: int = GROUP_WORDS) -> DataFrame:
    """Rows (key, copies, n_words, ranges): for each distinct text with a repeated window (key: MD5 of the text) the ranges of words that
    such windows cover; a text of several rows is covered whole."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = materialize(rows.select(_key(F.col("text")).alias("key"), _sketch(window, gram)(F.col("text")).alias("s")).select("key", "s.*"), "grams")
    texts = materialize(sketched.where(F.col("n_words") >= window).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("grams").alias("grams")), "texts")
    listed = texts.select("key", F.explode("grams").alias("gram"))
    often = materialize(listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "often")
    concerned = materialize(listed.distinct().join(often, "gram").groupBy("key").agg(F.collect_list("gram").alias("grams")), "concerned")
    marked = flagged(rows.withColumn("key", _key(F.col("text"))), F.xxhash64("key"), concerned.select(F.xxhash64("key")))
    # equal texts collapse in each task before they are dealt
    held = marked.where("_maybe").select("key", "text").distinct().join(concerned, "key")
    contexts = materialize(held.select("key", "text", "grams").mapInArrow(
        _cut(window, gram), "key binary, gram long, first int, content binary").withColumn("context", F.unhex(F.md5("content"))), "contexts")
    distinct = contexts.groupBy("gram", "context", "content").agg(F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct.withColumn("often", F.col("n") > 1).drop("n"), "distinct")
    words = F.size(F.split(F.col("content").cast("string"), " ")) - 1
    large = materialize(distinct.groupBy("gram").agg(F.sum(words).alias("words")).where(F.col("words") > group_words).select("gram"), "large-groups")
    small = distinct.join(large, "gram", "left_anti").withColumnRenamed("gram", "group")
    marks = _trees(small, window)
    if large.limit(1).count():
        marks = marks.unionAll(_split_groups(distinct.join(large, "gram", "left_semi"), window, group_words))
    marks = materialize(marks, "marks")
    placed = contexts.select("key", "first", "context").join(marks, "context").select("key", F.explode(F.transform(
        "ranges", lambda r: F.struct((r["low"] + F.col("first")).alias("low"), (r["high"] + F.col("first")).alias("high")))).alias("range"))
    covered = placed.groupBy("key").agg(F.collect_list("range").alias("ranges"))
    return texts.select("key", "copies", "n_words").join(covered, "key", "left").where("copies > 1 or ranges is not null").select(
        "key", "copies", "n_words", F.when(F.col("copies") > 1, F.array(F.struct(F.lit(0).alias("low"), F.col("n_words").cast("int").alias("high"))))
        .otherwise(F.col("ranges")).alias("ranges"))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _strip(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """Number of words, number removed, and the kept words with one space between them."""
    out = []
    for text, cuts in zip(texts.to_pylist(), ranges):
        words = (text or "").encode().split()
        if cuts.is_valid and len(cuts.values):
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, cuts.values.field("low").to_numpy(), 1)
            np.subtract.at(edges, cuts.values.field("high").to_numpy(), 1)
            kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
            out.append((len(words), len(words) - len(kept), b" ".join([words[i] for i in kept]).decode()))
        else:
            out.append((len(words), 0, b" ".join(words).decode()))
    columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.StructArray.from_arrays(columns, ["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                   group_words: int = GROUP_WORDS) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed, and ``kept``, the text without the words of windows that occur elsewhere."""
    found = materialize(repeats(docs, text_col, window, gram, group_words).select(F.col("key").alias("_key"), "ranges"), "repeats")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", _key(F.col("text")))
    marked = flagged(rows, F.xxhash64("key"), found.select(F.xxhash64("_key")))
    strip = F.arrow_udf(_strip, "struct<n_words:bigint,n_removed:bigint,kept:string>")
    untouched = marked.where("not _maybe").select("id", "text", F.lit(None).cast(_RANGES).alias("ranges"))
    touched = marked.where("_maybe").join(found, F.col("key") == F.col("_key"), "left").select("id", "text", "ranges")
    return untouched.unionAll(touched).select("id", strip("text", "ranges").alias("s")).select(F.col("id").alias(id_col), "s.*")

"""MinHash near-duplicates with an LSH forest (operator 2).

Every document's set of word shingles gives a signature; ``ORDERS`` slices of it are the labels of that many sorted orders.
Documents that share a prefix of a label stand next to each other in that order: such a run is a region.  A region that is too
large for one task is cut at the next label value, as deep as needed (the forest's adaptive depth), and the part that leaves
its siblings still meets the region's hubs, the members in the heaviest branch.  Inside a region full shingle sets
are compared, and only a spanning forest of the confirmed links leaves it, never all pairs.

The members of regions beyond the bounds are a crowd: cutting may part two linked members of it, so those that the cut regions have not
united meet once more, exactly.  Shingles are ordered by how often the crowd holds them, rare ones first; two sets at similarity s
share one of the first (1 - s) n + 1 of each, so members that share such a shingle are compared, block against
block in tasks of their own where they are many.

Hot groups: documents with equal sets are one class with its smallest id before any order is built, whatever their
number; a region of distinct near copies is bounded by ``REGION_SETS`` members and ``REGION_SHINGLES`` shingles.

Defined results: a null or empty text, or one of white space only, has an empty set and links with nothing; a text of fewer
than ``words`` words is one shingle.  Repeated rows belong to one class and are all returned.  Rows that share an id and have
different texts link each by its own set.  A row without an id links with nothing: its ``component_id`` is null and ``kept``
true.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm import textbytes as tb
from factsieve.llm.components import components
from factsieve.llm.repetition import ngram_hashes
from factsieve.plans.store import materialize

WORDS = 5
#: A pair at similarity 0.85 shares the first BASE_DEPTH labels of at least one of ORDERS orders with probability 0.99999; other
#: thresholds take as many orders as give a pair at the threshold the same chance.
ORDERS, BASE_DEPTH, DEPTH = 12, 3, 8
ORDERS_SHARE = 85
#: Bounds of a region compared in one task.
REGION_SETS, REGION_SHINGLES = 2048, 4_000_000
HUBS = 8
#: Bits of the bitmap that names the ids whose texts are needed again: 16 MB.
FILTER_BITS = 27
#: Counters of the crowd's shingles, which only order them: 2 MB.
COUNTER_BITS = 18


def orders_for(share: int) -> int:
    """Number of orders for links from ``share`` per cent."""
    missed = lambda percent: math.log1p(-min(percent / 100, 0.9999) ** BASE_DEPTH)
    return max(1, math.ceil(ORDERS * missed(ORDERS_SHARE) / missed(share) - 1e-9))


@functools.cache
def _random(orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and masks of the labels; the first ORDERS are the same for every number."""
    out = [], []
    for low in range(0, orders, ORDERS):
        rng = np.random.default_rng(20240607 if not low else [20240607, low])
        out[0].append(rng.integers(0, 1 << 63, ORDERS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        out[1].append(rng.integers(0, 1 << 63, ORDERS * DEPTH, dtype=np.uint64))
    return np.concatenate(out[0])[:orders * DEPTH], np.concatenate(out[1])[:orders * DEPTH]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside the text, and the bounds of the texts."""
    data = tb.LOWER[data]
    count = len(offsets) - 1
    starts, ends, text = tb.words(data, offsets)
    hashes = tb.span_hashes(data, starts, ends)
    bounds = np.searchsorted(text, np.arange(count + 1))
    n_words = np.diff(bounds)
    keys = ngram_hashes(hashes, size)
    whole = text[:len(keys)] == text[size - 1:size - 1 + len(keys)]
    keys, owner = keys[whole], text[:len(keys)][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):  # the whole sequence is the one shingle; its length keeps it apart from the others
        single = np.array([ngram_hashes(hashes[bounds[i]:bounds[i + 1]], int(n_words[i]))[0] for i in short], np.uint64)
        single = tb.mix(single + n_words[short].astype(np.uint64))
        at = np.searchsorted(owner, short)
        keys, owner = np.insert(keys, at, single), np.insert(owner, at, short)
    cuts = np.searchsorted(owner, np.arange(count + 1))
    for i in np.flatnonzero(np.diff(cuts) > 1):
        keys[cuts[i]:cuts[i + 1]].sort()
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[fresh], np.concatenate([[0], np.cumsum(fresh)])[cuts]


def signatures(keys: np.ndarray, bounds: np.ndarray, orders: int = ORDERS) -> np.ndarray:
    """One row of orders * DEPTH minima for each set; the upper 32 bits of each."""
    multipliers, masks = _random(orders)
    out = np.zeros((len(bounds) - 1, len(multipliers)), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for p, (a, b) in enumerate(zip(multipliers, masks)):
            out[full, p] = np.minimum.reduceat((keys ^ b) * a, bounds[full]) >> np.uint64(32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _fingerprint(mixed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the mixed hashes of each set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _sketch(size: int, orders: int) -> callable:
    def run(texts: pa.Array) -> pa.Array:
        counts, first, second, labels = [], [], [], []
        for _, _, data, offsets in tb.text_chunks(texts):
            keys, bounds = shingle_sets(data, offsets, size)
            counts.append(np.diff(bounds))
            for out, values in ((first, tb.mix(keys)), (second, tb.mix(keys * np.uint64(3) + np.uint64(7)))):
                out.append(_fingerprint(values, bounds))
            labels.append(signatures(keys, bounds, orders))
        if not counts:
            return pa.array([], pa.struct([("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("labels", pa.binary())]))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(first)), pa.array(np.concatenate(second)),
             _binary(np.concatenate(labels))], ["n", "f1", "f2", "labels"])

    return run


def _sets(size: int) -> callable:
    def run(texts: pa.Array) -> pa.Array:
        parts, ends, first = [], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in tb.text_chunks(texts):
            keys, bounds = shingle_sets(data, offsets, size)
            parts.append(keys)
            first.append(_fingerprint(tb.mix(keys), bounds))
            ends.append(bounds[1:] + ends[-1][-1])
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        offsets = (np.concatenate(ends) * 8).astype(np.int64)
        sets = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(first)), sets.cast(pa.binary())], ["f1", "shingles"])

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = WORDS, orders: int = ORDERS) -> DataFrame:
    """Per row: id, set size n, two 64-bit fingerprints of the set, and the labels of all orders."""
    run = F.arrow_udf(_sketch(size, orders), "struct<n:bigint,f1:bigint,f2:bigint,labels:binary>")
    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("s")).select("id", "s.*")


def _prefix(order: int, depth: int) -> Column:
    return F.xxhash64(F.lit(order), F.expr(f"substring(labels, {order * DEPTH * 4 + 1}, {depth * 4})"))


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows whose region holds another row, with the region's size and shingles."""
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    return rows.join(sizes, "region")


def regions(classes: DataFrame, region_sets: int = REGION_SETS, region_shingles: int = REGION_SHINGLES, orders: int = ORDERS) -> DataFrame:
    """Rows (region, id, hub, crowd): members of each region that must be compared; crowd marks those of a region beyond the bounds.

    ``id`` names a class: the smallest document id of the set and the set's first fingerprint, since an id may have several texts.
    A region beyond the bounds is cut at the next label; its hubs (members on the heaviest branch, at most ``HUBS``) go to each
    part, and a part that is still too large at full depth is dealt into parts of bounded size.
    """
    columns = [F.struct(F.lit(t).alias("t"), _prefix(t, BASE_DEPTH).alias("region"),
                        F.array(*[_prefix(t, d) for d in range(BASE_DEPTH + 1, DEPTH + 1)]).alias("deeper")) for t in range(orders)]
    rows = materialize(_crowded(
        classes.select(F.struct("id", "f1").alias("id"), "n", F.explode(F.array(*columns)).alias("r")).select("id", "n", "r.region", "r.deeper")), "forest")
    out = []
    for level in range(DEPTH - BASE_DEPTH + 1):
        small = (F.col("members") <= region_sets) & (F.col("shingles") <= region_shingles)
        out.append(rows.where(small).select("region", "id", F.lit(False).alias("hub"), F.lit(False).alias("crowd")))
        big = rows.where(~small)
        if not big.limit(1).count():
            break
        last = level == DEPTH - BASE_DEPTH
        branch = F.get("deeper", F.lit(level)) if not last else F.lit(0).cast("long")
        weights = big.groupBy("region", branch.alias("branch")).agg(
            F.count(F.lit(1)).alias("weight"), *[F.min_by("id", F.xxhash64("id", F.lit(i))).alias(f"hub{i}") for i in range(HUBS)])
        hubs = materialize(weights.groupBy("region").agg(
            F.max_by(F.array_distinct(F.array(*[f"hub{i}" for i in range(HUBS)])), F.struct("weight", "branch")).alias("hubs")), "hubs")
        # each part of at most about half the bound, so that the hubs fit in
        parts = F.ceil(F.greatest(F.col("members") / F.lit(region_sets / 2), F.col("shingles") / F.lit(region_shingles / 2))).cast("long")
        dealt = big.select(F.xxhash64("region", F.pmod(F.xxhash64("id", F.lit(level)), parts)).alias("part"), "region", "id")
        met = dealt.select("region", "part").distinct().join(hubs, "region").select(
            F.col("part").alias("region"), F.explode("hubs").alias("id"), F.lit(True).alias("hub"), F.lit(True).alias("crowd"))
        out += [dealt.select(F.col("part").alias("region"), "id", F.lit(False).alias("hub"), F.lit(True).alias("crowd")), met]
        if last:
            break
        cut = big.select("id", "n", F.xxhash64("region", branch).alias("region"), "deeper")
        rows = materialize(_crowded(cut), "forest")
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found


def _links_within(sets: list[np.ndarray], share: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= share * union, by all pairs of the sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= share * (sizes.sum() - both) and both else []
    keys = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    runs = np.diff(np.append(edge, len(keys)))
    shared = np.repeat(runs > 1, runs)
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)
    owner, column = owner[shared], column[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, 4_000_000 // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        block = np.zeros((len(sets), min(step, int(column[b - 1]) - low + 1)), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        both += block @ block.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both >= share * union) & (both > 0)
    np.fill_diagonal(linked, False)
    out, new = [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(linked[at] & new)
            new[near] = False
            out += [(at, int(x)) for x in near]
            queue += near.tolist()
    return out


def _compare(share: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
            if len(sets) < 2:
                return None
            found = _links_within(sets, share)
            if not found:
                return None
            pairs = np.array([[ids[a], ids[b]] for a, b in found], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        region, ids, sets = None, [], []
        for batch in batches:
            for r, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if r != region:
                    if (found := links(ids, sets)) is not None:
                        yield found
                    region, ids, sets = r, [], []
                ids.append(i)
                sets.append(np.frombuffer(s.as_buffer(), np.uint64).copy())
        if (found := links(ids, sets)) is not None:
            yield found

    return run


def _place(keys: np.ndarray) -> np.ndarray:
    return (tb.mix(keys) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters over one task's sets."""
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for batch in batches:
        for s in batch.column(0):
            np.add.at(total, _place(np.frombuffer(s.as_buffer(), np.uint64)), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])


def _prefixes(share: int, counters) -> callable:
    """The shingles of each set that a set linked with it shares at least one of, in one order for all sets."""
    def run(sets: pa.Array) -> pa.Array:
        out, ends, often = [np.zeros(0, np.uint64)], [0], counters.value
        for s in sets:
            keys = np.frombuffer(s.as_buffer(), np.uint64)
            keep = len(keys) - (share * len(keys) + 99) // 100 + 1
            out.append(keys[np.lexsort((keys, often[_place(keys)]))[:keep]])
            ends.append(ends[-1] + len(out[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out).view(np.int64)))

    return run


def crowd_links(crowd: DataFrame, sets: DataFrame, links: DataFrame, share: int, region_sets: int, region_shingles: int) -> DataFrame:
    """Links (a, b) among the classes of ``crowd`` that unite what ``links`` do not: with them, all links of the crowd are covered."""
    spark = crowd.sparkSession
    known = components(links, "crowd-near")
    members = materialize(crowd.join(sets, "id").join(known, F.col("id.id") == F.col("node"), "left").select(
        "id", F.coalesce("component", "id.id").alias("united"), "shingles"), "crowd")
    often = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in members.select("shingles").mapInArrow(_count_shingles, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator():
        often[r["place"]] = r["n"]
    prefix = F.arrow_udf(_prefixes(share, spark.sparkContext.broadcast(often)), "array<bigint>")
    held = materialize(members.select("id", "united", (F.octet_length("shingles") / 8).cast("long").alias("n"), F.explode(prefix("shingles")).alias("key")), "prefixes")
    groups = held.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all"),
                                     F.min("united").alias("low"), F.max("united").alias("high")).where("low <> high")
    # two blocks of a pair are at most about the bounds of a region
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(region_sets / 2), F.col("all") / F.lit(region_shingles / 2))).cast("int")
    dealt = held.join(groups.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a pair of blocks is one region whichever of the two a member is in; a block alone is met with each other one
    region = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    met = paired.where("blocks = 1 or block <> other").select(region.alias("region"), "id")
    compared = met.join(members.select("id", "shingles"), "id").select("region", "id.id", "shingles").repartition("region").sortWithinPartitions("region", "id")
    return compared.mapInArrow(_compare(share), "a long, b long")


def _perhaps(rows: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose id may be among the wanted ones, by a bitmap of id hashes, so that few other texts reach the exact join.

    The bitmap is broadcast: at most 2**bits bits in blocks of 4 kB, whatever the number of ids.  Where it is full it only
    lets all rows through.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    bitmap = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), "bucket")
    return joined.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select(rows.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 85, size: int = WORDS,
                    region_sets: int = REGION_SETS, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept. Links need 100 * intersection >= share * union."""
    orders = orders_for(share)
    table = materialize(sketches(docs, id_col, text_col, size, orders), "sketches")
    real = table.where("n > 0 and id is not null")
    classes = materialize(real.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "labels")).alias("m"), F.count(F.lit(1)).alias("copies"))
                          .select("f1", "f2", "n", "m.id", "m.labels", "copies"), "classes")
    members = materialize(regions(classes, region_sets, region_shingles, orders), "regions")
    wanted = members.select("id.id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = _perhaps(texts, wanted)
    build = F.arrow_udf(_sets(size), "struct<f1:bigint,shingles:binary>")
    # an inner join, since the optimizer would move a semi join below the bitmap
    exact = texts.join(wanted.withColumnRenamed("id", "wanted_id"), F.col("id") == F.col("wanted_id"))
    sets = materialize(exact.select("id", build("text").alias("s")).select(F.struct("id", "s.f1").alias("id"), "s.shingles")
                       .groupBy("id").agg(F.max("shingles").alias("shingles")), "sets")
    compared = (members.select("region", "id").distinct().join(sets, "id").select("region", "id.id", "shingles")
                .repartition("region").sortWithinPartitions("region", "id"))
    links = compared.mapInArrow(_compare(share), "a long, b long")
    crowd = members.where("crowd").select("id").distinct()
    if crowd.limit(1).count():
        links = materialize(links, "links")
        links = links.unionAll(crowd_links(crowd, sets, links, share, region_sets, region_shingles))
    found = components(links, "near")
    linked = classes.select("f1", "f2", "n", "copies", "id").join(found, F.col("id") == F.col("node"), "left").select(
        "f1", "f2", "n", F.coalesce("component", "id").alias("component"), "copies")
    # only classes with copies or links differ from their own id, so the others need no join
    changed = materialize(linked.join(classes.select("f1", "f2", "n", "id"), ["f1", "f2", "n"]).where("copies > 1 or component <> id")
                          .select("f1", "f2", "n", "component"), "changed")
    return (table.select("id", "n", "f1", "f2").join(changed, ["f1", "f2", "n"], "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))

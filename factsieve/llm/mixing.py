"""Mixing sources to target weights by Sainte-Lague apportionment (operator 1); DataFrame functions only.

Tokens are words.  Each source's share of the mix is its target; the targets compete for blocks of equally many tokens by
highest quotients ``target / (2 * blocks held + 1)``, and each source's blocks are apportioned to its shards (hash slices of
bounded size) by the same rule, which gives an integer quota for every shard.  A shard's documents stand in a seeded order and
are cut into blocks; a quota of q out of n blocks takes every block ``q div n`` times and ``q mod n`` blocks, spaced evenly
from a seeded start, once more.  A document's ``taken`` is the number of its words in taken blocks, repeats counted.

Only quotients near the threshold are ranked: with W weight, N seats and n parties, the threshold lies between
``W / (N + n / 2)`` and ``W / (N - n / 2)`` (as long as no cap binds), so about two candidates a party are enough.

A hot source is many shards, and only sums per source and per shard leave the counting pass.

Defined results: a null text, and one without words, has size 0 and nothing is taken from it; a null source is a source of its own,
last in order; a source without words has target 0.  Repeated rows are documents of their own; ties in the seeded
order are broken by size.  A null id is an id like any other.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.plans.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_TOKENS = 256
#: The smallest target gets at least this many blocks, as far as its words allow.
BLOCKS_OF_SMALLEST = 200
SHARD_DOCS, SHARD_TOKENS = 4096, 8_000_000


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per row: id, source and number of words."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to rows (source, source_size): shares by weight, none above its source's limit.

    Sources fill up in the order of limit to weight; the level of all others follows from the running sums.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    limit = (F.col("source_size") * max_repeats).cast("double")
    rated = (totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
             .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
             .withColumn("limit", limit))
    before = W.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = rated.withColumn("level", level)
    # the level rises as long as it fills sources and falls after the first that it does not fill, which sets that of all others
    return levelled.select("source", "source_size", F.least("limit", F.max("level").over(everything) * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, groups: list[str], keys: list[str], weight: str, cap: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group go to the highest quotients weight / (2 k + 1), at most ``cap`` to a party.

    ``seats`` has the same value in all rows of a group; equal quotients go in the order of the keys.
    """
    group = W.partitionBy(*groups)
    names = parties.columns
    total, count = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    rated = parties.withColumn("_w", F.col(weight).cast("double")).withColumn("_all_w", total.cast("double")).withColumn("_n", count)
    share_of = lambda extra: F.col("_w") * (F.col(seats) + extra) / F.col("_all_w")
    low = F.greatest(F.lit(0), F.least(F.col(cap), F.floor(share_of(-F.col("_n") / 2) - 0.5) - 1)).cast("long")
    high = F.least(F.col(cap), F.ceil(share_of(F.col("_n") / 2) + 0.5) + 2).cast("long")
    ranged = rated.withColumn("_low", F.when(F.col("_w") > 0, low).otherwise(0)).withColumn(
        "_high", F.when(F.col("_w") > 0, high).otherwise(0)).withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    tries = ranged.where("_high > _low").select(
        *groups, *keys, "_w", "_open", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    best = W.partitionBy(*groups).orderBy((F.col("_w") / (2 * F.col("_k") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in keys], "_k")
    won = tries.withColumn("_rank", F.row_number().over(best)).where("_rank <= _open").groupBy(*groups, *keys).agg(
        F.count(F.lit(1)).alias("_won"))
    same = None
    for c in groups + keys:
        test = F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}"))
        same = test if same is None else same & test
    return ranged.alias("p").join(won.alias("q"), same, "left").select(
        *[F.col(f"p.{c}").alias(c) for c in names], (F.col("p._low") + F.coalesce("q._won", F.lit(0))).alias("quota"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that are not negative; the difference is a multiple of ``b``."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def _taken_before(x: Column) -> Column:
    """Words taken once more among the first ``x`` words of a shard: its extra blocks lie evenly from a seeded start."""
    chosen = lambda k: _div(k * F.col("extra") + F.col("start"), F.col("blocks"))
    whole = _div(x, F.col("block_tokens"))
    return chosen(whole) * F.col("block_tokens") + F.pmod(x, F.col("block_tokens")) * (chosen(whole + 1) - chosen(whole))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS,
        share: float = SHARE, max_repeats: int = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = "mix",
        shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, taken, and the shard with its blocks and quota."""
    counted = materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    totals = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    with_target = targets(totals, weights, share, max_repeats).alias("t").join(
        totals.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "s.docs")
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy())
    plan = materialize(with_target.select(
        "*", F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(least / BLOCKS_OF_SMALLEST))).cast("long").alias("block_tokens"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / shard_docs), F.ceil(F.col("source_size") / shard_tokens)).cast("long").alias("shards")), "targets")
    known = plan.select(F.col("source").alias("of"), "source_size", "target", "block_tokens", "shards")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    placed = counted.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("digest", digest).withColumn(
        "shard", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = materialize(
        placed.groupBy("source", "shard", "block_tokens").agg(F.sum("size").alias("shard_size"), F.first("target").alias("target"))
        .withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block_tokens")).cast("long")), "shards")
    parties = shards.groupBy("source").agg(F.first("target").alias("target"), F.sum("blocks").alias("blocks"), F.first("block_tokens").alias("b"))
    whole = parties.select(F.lit(0).alias("one"), "source", "target", (F.col("blocks") * max_repeats).alias("cap"),
                           F.round(F.sum("target").over(W.partitionBy()) / F.col("b")).cast("long").alias("seats"))
    seats = apportion(whole, ["one"], ["source"], "target", "cap", "seats").select(F.col("source").alias("of"), F.col("quota").alias("seats"))
    in_shards = shards.join(seats, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "shard", "shard_size", "blocks", (F.col("blocks") * max_repeats).alias("cap"), "seats")
    quotas = materialize(apportion(in_shards, ["source"], ["shard"], "shard_size", "cap", "seats"), "quotas")
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")), "shard")), 1, 8), 16, 10).cast("long"),
                   F.greatest("blocks", F.lit(1)))
    shard_plan = quotas.select(
        F.col("source").alias("of"), F.col("shard").alias("at"), "blocks", "quota", start.alias("start"),
        F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(0).cast("long").alias("full"),
        F.when(F.col("blocks") > 0, F.pmod("quota", "blocks")).otherwise(0).cast("long").alias("extra"))
    line = W.partitionBy("source", "shard").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, -1)
    laid = placed.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    joined = laid.join(shard_plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")))
    more = _taken_before(F.col("before") + F.col("size")) - _taken_before(F.col("before"))
    taken = F.when(F.col("size") > 0, F.col("full") * F.col("size") + more).otherwise(0).cast("long")
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"),
                         "shard", "blocks", "quota")


def whole_documents(mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Adds ``copies`` to the rows of ``mix``: taken / size, rounded down or up so that each source keeps its words.

    A shard's documents stand by size; the running sum of taken / size, from a seeded start, passes a whole number for each copy.  So a
    document of any length gets its share of copies on average, and documents of like size together get theirs almost exactly.
    """
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 8), 16, 10).cast("double")
    start = number(F.lit("copies"), F.coalesce(F.col(source_col), F.lit("")), "shard") / F.lit(2.0 ** 32)
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0))
    line = W.partitionBy(source_col, "shard").orderBy("size", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), "taken")
    passed = F.floor(start + F.sum("_share").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    laid = mixed.withColumn("_share", share).withColumn("_passed", passed)
    return laid.withColumn("copies", (F.col("_passed") - F.coalesce(F.lag("_passed").over(line), F.lit(0))).cast("int")).drop("_share", "_passed")

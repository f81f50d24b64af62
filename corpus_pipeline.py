"""Training-data pipeline: quality rules, near-duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is written and reread as the next one's docs.
Null texts fail the quality rules; rows without an id pass the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.llm import bpe, minhash_forest, mixing, pii, repetition
from factsieve.llm.bitmap import flagged
from factsieve.plans.store import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return docs.select(*COLUMNS).where(repetition.repetition(F.col("text"))["kept"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; of rows that share an id, one."""
    found = materialize(minhash_forest.near_duplicates(docs), "found")
    per_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    special = materialize(per_id.where("not kept or rows > 1"), "special")  # all other documents stay where they are
    marked = flagged(docs.select(*COLUMNS), F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), special.select(F.xxhash64("doc_id")))
    known = special.select(F.col("doc_id").alias("_id"), F.col("kept").alias("_kept"))
    doubtful = marked.where("_maybe").join(known, F.col("doc_id") == F.col("_id"), "left").where("coalesce(_kept, true)")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    return marked.where("not _maybe").select(*COLUMNS).unionAll(
        doubtful.withColumn("_row", first).where("_row = 1").select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source comes near its target: taken / size copies, rounded down or up without bias.

    A row without an id is a document of its own.  Rows that share an id share its copies evenly, a remainder by the hash of the row.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null").withColumn("_key", F.col("doc_id").cast("string"))
    # equal rows without an id can stand for each other, so each gets a name that does not depend on the order of rows
    nameless = materialize(docs.where("doc_id is null").groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).withColumn(
        "_key", F.concat_ws(":", F.lit("null"), F.sha2(F.to_json(F.struct("text", "lang", "source", "n_chars")), 256), "_row")).select(
        *COLUMNS, "_key"), "nameless")
    keyed = named.select(*COLUMNS, "_key").unionAll(nameless)
    mixed = mixing.whole_documents(mixing.mix(keyed, "_key"), "_key")
    copies = materialize(mixed.groupBy(F.col("_key").alias("_mixed")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0"), "copies")
    # both sides are dealt by id at every size: each document has its own number
    joined = keyed.join(copies.hint("merge"), F.col("_key") == F.col("_mixed"))
    place = F.pmod(F.xxhash64("_key", "text", "lang", "n_chars", "source"), F.lit(1 << 20)) / F.lit(1 << 20)
    count = F.when(F.col("rows") == 1, F.col("copies")).otherwise(F.floor(F.col("copies") / F.col("rows") + place)).cast("int")
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), count))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit), their number, and whether decoding gives the text back."""
    shared = bpe.prepare(docs, public_tokenizers.path("byte_bpe_50k.json"))
    coded = docs.select("doc_id", "source", "text", bpe.encode(shared, F.col("text")).alias("ids"))
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        (bpe.decode(shared, F.col("ids")) == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("source_mix", source_mix), ("tokens", tokens)]

#: SQL has no tokenizer, rolling hash coverage or pattern graph; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

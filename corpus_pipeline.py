"""From raw documents to token ids: five stages, each written as Parquet and read again.

1. language    rows whose language cannot be told (``und``, or a score under ``MIN_SCORE``) go
2. near_dedup  of each class of near-duplicate texts (five-word shingles, Jaccard 0.8) one document stays; candidates by SimHash, then by min-wise keys
3. decontaminate  documents that hold a benchmark item go
4. mix         whole and fractional repetitions bring each source to its target, to the nearest whole document
5. tokens      ids go to a token store; its digests are the result

Null and empty texts are rejected by the first stage.  A class keeps its row with the
smallest doc_id, then source and text hash; rows without a doc_id come last and stay
where no other row of their class has one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm import decontaminate, language_id, mixing, near_copies, token_store
from quillspark.llm._common import bounded, new_path, stored, table

MIN_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    model = language_id.parts(language_id.training_rows(docs))
    named = language_id.identify(docs.select(*COLUMNS), model)
    return named.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    # a row's own key, as doc_id may repeat or be null; rows that share all of it hold one text
    own = {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "from": F.coalesce("source", F.lit("")), "hash": F.xxhash64("text")}
    named = docs.select(*COLUMNS, *[c.alias(k) for k, c in own.items()])
    found = stored(near_copies.sketches(named, list(own)), "near-sketches")
    roots = near_copies.roots(found, named)
    rooted = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min(F.struct(*own)).alias("k")).select("k.*")
    kept = named.join(first, list(own), "left_semi")
    order = W.partitionBy(*own).orderBy("lang", "n_chars")
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    mixed = mixing.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    return mixing.repeat(mixing.uncut(mixed)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    store = new_path(spark, "tokens")
    token_store.write(docs, store, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return token_store.digests(spark, store)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mix), ("tokens", tokens)]

#: The first three stages and the last cannot be written in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this package, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, html_text, language_id, mixing, multiprobe, nbsvm, prefix_trie, quality_rules, simhash, substring_dedup, token_store
from ._common import new_path, stored, table


def _crc(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc() % 4 == 2, F.lit(False))
    model = language_id.parts(language_id.training_rows(docs, held_out=held_out))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, drop=("text",))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.conversations(chat_format.read_back(chat_format.format_turns(turns)))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = new_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), store, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return token_store.digests(spark, store)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs.select("doc_id", "text"), model, drop=("text",))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), digest=True)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc() % 5 == 0, F.lit(False))
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    return nbsvm.score(docs.select("doc_id", "text", held_out.alias("held_out")), model, drop=("text",))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.Audit(table(spark, sf_dir, "documents")).report()


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_html_text, op3_chat_format, op4_token_store, op5_mixing, op6_quality_rules, op7_decontaminate, op8_simhash, op9_substring_dedup, op10_quality_classifier, op11_source_divergence, op12_prefix_trie, op13_nearest_neighbours)
}

ORACLES = {"op3_chat_format": chat_format.ORACLE, "op5_mixing": mixing.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}

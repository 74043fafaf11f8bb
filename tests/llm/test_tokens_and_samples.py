"""Ids of odd Unicode texts, the shared dictionary, and samples whose bounds hold at any size."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import _labelled, language_id, mixing, token_store
from quillspark.llm._common import drawn, new_path, share

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n, seed=4):
    draw = random.Random(seed)
    letters = "abcJHTWYxyzIKS \n\t " + "̸̧̱̌̈̊́" + "éÉßİıſKÅǰΣςσ中文한글가" + "'’.,!<|>_^`~1²½ⅧⅠ😀‍﻿"
    for _ in range(n):
        yield "".join(draw.choice(letters) for _ in range(draw.randrange(1, 24)))


def test_ids_are_those_of_whole_texts():
    e = token_store.Encoder(TOKENIZER)
    assert e.by_word
    texts = ["J̌", "aJ̌b J̌! H̱ T̈ W̊ Y̊", *odd_texts(20_000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        whole = [x.ids for x in e.tokenizer.encode_batch(part, add_special_tokens=False)]
        got = e.encode(pa.array(part))
        for text, ids, raw in zip(part, whole, got, strict=True):
            assert [*ids, 1] == memoryview(raw).cast("H").tolist(), repr(text)


def test_registered_store_equals_whole_texts(spark, sf_dir):
    from quillspark.llm.queries import op4_token_store

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op4_token_store(spark, sf_dir).collect())
    assert got == brute.token_rows(rows, token_store.Encoder(TOKENIZER).tokenizer)


def test_rows_without_an_id_fill_many_tasks(spark):
    docs = spark.createDataFrame([(None, f"text number {i}") for i in range(400)], "doc_id long, text string")
    to = new_path(spark, "test-store")
    token_store.write(docs, to, tokenizer=TOKENIZER)
    packs = spark.read.parquet(f"{to}/packs")
    assert packs.select("shard").distinct().count() > 2
    assert token_store.digests(spark, to).count() == 400


def test_share_is_fine_enough_for_any_table(spark):
    for of in (10, 10**6, 10**10, 10**13):
        assert abs(share(600, of) / 2**63 * of - min(600, of)) < 1e-3 * 600
    n = spark.range(200_000).where(drawn(share(2000, 200_000), "id", seed=5)).count()
    assert 1700 < n < 2300
    assert spark.range(50).where(drawn(share(60, 50), "id", seed=5)).count() == 50


def test_samples_stay_bounded_on_a_hot_key(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(7, 1), (None, 0)], "doc_id long, quality int")
    assert len(_labelled.sample(docs, labels, per_class=20, row_bytes=1000)) <= 40
    for key in ("doc_id", "none"):
        found = language_id.training_rows(docs.withColumn("none", F.lit(None).cast("long")), key=key, rows=50)
        assert 20 <= len(found) <= 110


def test_mixing_spreads_rows_without_an_id(spark):
    docs = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs).collect()
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in "ab"}
    for r in rows:
        assert abs(taken[r.source] - r.target) <= 2 and r.taken <= 2 * r.size

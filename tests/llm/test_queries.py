"""The registered queries: columns, SQL results, and the pipeline against its operators' rules."""

from collections import Counter

import duckdb
import pytest

from quillspark.llm import mixing, token_store

from . import brute
from .test_near_copies import _heads

public_tokenizers = pytest.importorskip("public_tokenizers")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_html_text": {"page_id", "url", "text", "n_chars"},
    "op3_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op4_token_store": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_decontaminate": {"doc_id", "item_id"},
    "op8_simhash": {"doc_id", "fingerprint", "component_id"},
    "op9_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op13_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op12_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op11_source_divergence": {"lang", "source", "part", "item", "value", "rank"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, sf_dir, name):
    from quillspark.llm.queries import ORACLES, QUERIES

    out = QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(out.columns)
    rows = out.collect()
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(out.columns)
        assert sorted(tuple(r[c] for c in sorted(names)) for r in rows) == sorted(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in cur.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline
    from quillspark.llm._common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        clean = docs
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == list(pipeline.COLUMNS)
        kept[name] = {(r.doc_id, r.text) for r in docs.collect()}
    raw = {(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert kept["language"] == {x for x in raw if any(map(str.isalpha, x[1] or ""))}
    texts = {}
    for d, t in sorted(kept["language"]):
        assert texts.setdefault(d, t) == t  # an id is one row in these tables
    assert {d for d, _ in kept["near_dedup"]} == _heads(texts)
    assert kept["decontaminate"] == {x for x in kept["near_dedup"] if x[0] not in {d for d, _ in brute.leaks(kept["near_dedup"], bench)}}
    # the mix takes whole documents, twice at most, and comes within one document of each source's target
    assert kept["mix"] <= kept["decontaminate"]
    mixed = docs.collect()
    copies, words, longest = Counter(r.doc_id for r in mixed), Counter(), Counter()
    for r in mixed:
        words[r.source] += len(brute.words(r.text))
        longest[r.source] = max(longest[r.source], len(brute.words(r.text)))
    assert max(copies.values()) <= 2
    for r in mixing.mix(clean).select("source", "target").distinct().collect():
        assert abs(words[r.source] - r.target) <= longest[r.source]
    final = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    rows = sorted((r.doc_id, r.text) for r in mixed)
    encoder = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in final) == sorted(brute.token_rows(rows, encoder))
    assert sorted(tuple(r) for r in pipeline.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in final)


def test_pipeline_takes_odd_rows(spark, sf_dir):
    import corpus_pipeline as pipeline
    from quillspark.llm._common import stored

    rows = [(1, None, None, None, None), (None, "the and of ing the", None, None, None), (2, "", "en", "a", 0), (3, "the tion ing and of the re", "en", "a", 5), (3, "the tion ing and of the re", "en", "a", 5)]
    for table in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", pipeline.F.lit(1)), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")):
        docs = table
        for name, stage in pipeline.STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"odd-{name}")
            if name == "near_dedup":  # null, empty and repeated rows go; a text without an id stays
                assert sorted(r.text for r in docs.collect()) == (sorted({r[1] for r in rows if r[1]}) if table.count() else [])

"""Bounds that must not show in results: blocks of test items, the border of a mix, many languages."""

import random

from quillspark.llm import decontaminate, language_id, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_item_scores_do_not_depend_on_blocks(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.7)) % 300}" for _ in range(draw.choice((12, 30, 150)))) + ". " + f"a{i} b c.") for i in range(23)] + [(40, None), (41, "")]
    items = spark.createDataFrame(rows, "item_id long, text string").repartition(3)

    def impacts(most):
        out = []
        for index in decontaminate.indexes(items, most):
            name = {i: t for t, i in index.terms.items()}
            out += [(index.items[index.owner[u]].item_id, name[t], round(x, 9)) for t, us in index.units.items() for u, x in zip(us, index.impacts[t], strict=True)]
        return sorted(out)

    whole = impacts(10_000)
    assert whole and all(impacts(most) == whole for most in (1, 8, 20))


def test_mix_takes_whole_documents(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(draw.randrange(1, 60))), "en", draw.choice("abc"), 0) for i in range(120)]
    texts = {r[1] for r in rows}
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame(rows, SCHEMA)
    got = pipeline.mix(spark, docs, "").collect()
    assert got and {r.text for r in got} <= texts
    words = lambda s: sum(len(r.text.split()) for r in got if r.source == s)
    for r in mixing.mix(docs).select("source", "source_size", "target").distinct().collect():
        assert abs(words(r.source) - r.target) <= 31 and words(r.source) <= 2 * r.source_size


def _tongues(n):
    draw = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(n):
        own = ["".join(draw.choice(letters) for _ in range(6)) for _ in range(5)]
        yield f"l{k:03}", [" ".join(draw.choice(own) for _ in range(40)) for _ in range(2 if k else 1)]


def test_parts_of_a_model_say_what_the_whole_says():
    rows = [(k, t) for k, ts in _tongues(12) for t in ts]
    texts = [t for _, t in rows] + [None, "", "7 8", rows[0][1][:9]]
    named, score = language_id.train(rows).predict(texts)
    for most in (1, 5, 12):
        n, s = language_id.predict_by_parts(language_id.parts(rows, most), texts)
        assert n == named and abs(s - score).max() < 1e-6


def test_every_language_is_learned(spark):
    rows = [(i, t, k, "s", 0) for i, (k, t) in enumerate((k, t) for k, ts in _tongues(205) for t in ts)]
    rows.append((len(rows), "kwyjibo zzyzx " * 8000, "long", "s", 0))  # all its rows are over 100,000 bytes
    docs = spark.createDataFrame(rows, SCHEMA)
    found = language_id.training_rows(docs)
    assert {k for k, _ in found} == {r[2] for r in rows} and ("long", rows[-1][1]) in found
    got = language_id.identify(docs, language_id.parts(found)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)

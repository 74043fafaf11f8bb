"""The near_dedup stage against five-word Jaccard similarity of all pairs, and on odd keys."""

import random
from itertools import combinations

import pytest

from quillspark.llm import near_copies
from quillspark.llm._common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _pairs(texts):
    sets = {k: _set(t) for k, t in texts.items()}
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            yield a, b


def _heads(texts):
    head, pairs, before = {k: k for k in texts}, list(_pairs(texts)), None
    while before != head:
        before = dict(head)
        for a, b in pairs:
            head[a] = head[b] = min(head[a], head[b])
    return {k for k in texts if head[k] == k}


def _corpus():
    draw = random.Random(7)
    texts, n = {}, 0
    for _ in range(12):
        words = [f"w{draw.randrange(4000)}" for _ in range(200)]
        for changed in (0, 1, 2, 3, 4, 6, 9):
            own = list(words)
            for at in draw.sample(range(200), changed):
                own[at] = f"x{draw.randrange(4000)}"
            texts[n] = " ".join(own)
            n += 1
    return texts


@pytest.mark.parametrize(("hubs", "size"), [((1, 8), 1024), ((), 3), ((1,), 2)])
def test_classes(spark, hubs, size):
    texts = _corpus()
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "xxhash64(text) hash")
    found = stored(near_copies.sketches(docs, ["doc_id", "hash"]), "test-sketches")
    roots = {r.node: r.root for r in near_copies.roots(found, docs, hubs=hubs, size=size).collect()}
    least = {}
    for r in found.orderBy("doc_id").collect():
        least.setdefault(roots.get(r.node, r.node), r.doc_id)
    assert set(least.values()) == _heads(texts)


def test_stage_drops_near_copies(spark, sf_dir):
    import corpus_pipeline as pipeline

    texts = _corpus()
    docs = stored(spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts.items()], SCHEMA), "test-near")
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, sf_dir).collect()} == _heads(texts)


def test_stage_keeps_a_row_of_each_class_whatever_its_id(spark, sf_dir):
    import corpus_pipeline as pipeline

    draw = random.Random(8)
    a, b, c, d, e, f = (" ".join(f"w{draw.randrange(4000)}" for _ in range(60)) for _ in range(6))
    rows = [
        (None, a, "en", "s", 1), (None, a, "en", "t", 1),  # unique but for a copy, both without an id
        (5, b, "en", "s", 1), (5, c, "en", "s", 1),  # unrelated texts of one id
        (6, d, "en", "s", 1), (7, d, "en", "a", 1), (7, e, "en", "z", 1),  # the first row of an id is a copy
        (8, f, "en", "s", 1), (8, f, "en", "s", 1), (None, f, "en", "a", 1),
    ]
    docs = stored(spark.createDataFrame(rows, SCHEMA), "test-near-odd")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([(None, a), (5, b), (5, c), (6, d), (7, e), (8, f)], key=str)


def test_candidates_come_from_fingerprints(spark):
    texts = _corpus()
    texts |= {1000 + k: f"{t} {t}" for k, t in list(texts.items())[:3]}  # nearly the same shingles
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) hash")
    found = stored(near_copies.sketches(docs, ["doc_id", "hash"]), "test-sketches")
    of = {r.node: r.doc_id for r in found.collect()}
    likely = {tuple(sorted((of[r.node], of[r.hub]))) for r in near_copies.fingerprinted(found.dropDuplicates(["node"]), docs).collect()}
    from quillspark.llm import simhash

    prints = {k: simhash.fingerprint(t) for k, t in texts.items()}
    classes = {k: k for k in texts}
    for a, b in combinations(sorted(texts), 2):
        if (prints[a] ^ prints[b]).bit_count() <= simhash.TAU:
            old, new = classes[b], classes[a]
            classes = {k: new if c == old else c for k, c in classes.items()}
    assert likely and all(classes[a] == classes[b] for a, b in likely)

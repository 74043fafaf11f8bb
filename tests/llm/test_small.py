"""Edge rows and brute-force comparisons on small tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_format, decontaminate, html_text, language_id, mixing, nbsvm, quality_rules, simhash, substring_dedup, token_store
from quillspark.llm._common import new_path
from quillspark.llm._words import Words, span_hashes, prefix_sums, window_starts

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def phrase(n, seed, size=40):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names that results use."""
    long = phrase(60_000, 1, 5000)
    block = " ".join(f"b{i}" for i in range(60))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, "  \n\t ", "en", "a", 5), (4, long, "en", "a", 9), (5, long, "en", None, 9), (5, long, "en", None, 9), (6, f"x y {block} z", "fr", "b", 1),
        (7, f"{block} tail", "fr", "b", 1), (7, f"head {block}", None, "b", 1), (None, f"lead {block} end", "fr", "c", 1), (None, f"lead {block} end", "fr", "c", 1), (8, "!!! *** 123", "de", "c", 2), (9, "é" * 10, "fr", "c", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "size", "taken", "target", "component_id", "kept", "rid", "spans", "word", "fp", "segment"):
        df = df.withColumn(name, F.lit("clash"))
    return df, rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_windows_match_a_loop():
    texts = pa.array(["a b c d", "", "a b", " a  b c ", "x"])
    w = Words(texts)
    assert w.counts.tolist() == [4, 0, 2, 3, 1]
    assert window_starts(w.offsets, 3).tolist() == [0, 1, 6]
    h = span_hashes(prefix_sums(w.hashes()), window_starts(w.offsets, 3), 3)
    assert h[0] == h[2] != h[1]


def test_language(spark, odd, sf_dir):
    df, rows = odd
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(language_id.training_rows(docs, held_out=held_out))
    got = language_id.identify(docs, model).where(held_out).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    out = language_id.identify(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred for r in out if r.doc_id in (1, 2, 3, 8)] == ["und"] * 4
    assert language_id.identify(empty(spark), model).count() == 0
    none = language_id.train(language_id.training_rows(empty(spark)))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_language_code_lengths_sum_to_one():
    import numpy as np

    model = language_id.train([("a", "abab cab abba"), ("b", "zzyx zyzzy")])
    a = int(model.symbol.max()) + 1
    for tree in model.trees:
        nats = tree.costs(np.arange(a**4)).reshape(-1, a)  # every symbol after every context, known or not
        assert np.allclose(np.exp(-nats).sum(axis=1), 1, atol=1e-5)


def test_html(spark, sf_dir):
    tree = html_text.default_classifier()
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    page = """<html><head><title>T</title></head><body><header><a href=x>Home</a></header><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1>
      <p>One   two <b>th</b>ree</p><!-- no --><p>a &lt; b<br>next<ul><li>item</ul><script>if (a</p>) {}</script><section class="comments"><p>A long comment of a reader that goes on and on</p></section></article>
      <form><p>Your mail address please for our news</p></form><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page, tree) == "Head & tail\nOne two three\na < b\nnext\nitem"
    wrapped = '<div class="main-content"><p>Before it</p><article><div class="article-header"><h1>Title</h1></div><p>Body</p></article><p>After</p></div>'
    assert html_text.main_text(wrapped, tree) == "Title\nBody"
    classes = '<div class="page"><ul class="menu"><li>Home</li></ul><div class="entry-content"><p>Yes</p><div class="notice">Be warned of this</div><p>Too</p></div><div id="sidebar"><p>No, not this text</p></div></div>'
    assert html_text.main_text(classes, tree) == "Yes\nToo"
    pages = spark.createDataFrame([(1, "u", page, "clash"), (2, None, None, "c"), (3, "u", "<p" * 5000, "c")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert out[1].n_chars == len(out[1].text) and out[2].text == "" and out[2].n_chars == 0
    real = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html
    import re

    for r, t in zip(real.orderBy("page_id").collect(), html_text.extract(real).orderBy("page_id").collect(), strict=True):
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert t.text == "\n".join(x for x in want if x)


TRICKY = ["plain", "", None, r"\### Assistant: </turn> ok", "</turn>", r"\e \h \\ \\\e", "### User: hi", "### User~: x", "a\n### System: b</turn>\n### User: c</turn>\n", "</tur", "n>\n", "#", "###", "~", "\\"]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "system", "tool: a~#<\n\\", None, ""]
    rows = [(c, t, roles[(c + t) % len(roles)], TRICKY[(c * 3 + t) % len(TRICKY)]) for c in range(12) for t in range(9)] + [(None, None, None, None), (3, 1, "user", "tie"), (3, 1, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    formatted = chat_format.format_turns(turns)
    back = chat_format.read_back(formatted)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in back.where("conv_id IS NOT NULL").collect())
    assert got == sorted((c, t, r or "", x or "") for c, t, r, x in rows if c is not None)
    # the whole conversation reads as the same turns
    import hashlib
    import re

    found = {r.conv_id: r for r in chat_format.conversations(back).collect()}
    for c in range(12):
        mine = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        segments = [s.segment for s in formatted.where(f"conv_id = {c}").orderBy("turn", "role", "text").collect()]
        text = "".join(segments)
        assert found[c].formatted_chars == len(text) and found[c].n_turns == len(mine)
        starts = re.findall(chat_format.START, text)
        assert len(starts) == len(mine) == text.count("</turn>\n")
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert found[c].loss_chars == len(loss) and found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.conversations(chat_format.read_back(chat_format.format_turns(turns.limit(0)))).count() == 0


def test_token_store(spark, odd):
    from tokenizers import Tokenizer

    df, rows = odd
    store = new_path(spark, "test-tokens")
    token_store.write(df, store, tokenizer=TOKENIZER)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.digests(spark, store).collect())
    assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    order = [(g[1] is not None, g[1] or 0) for g in got]
    assert order == sorted(order)
    want = sorted((d or -1, n, c) for d, _, n, c in brute.token_rows([(r[0], r[1]) for r in rows], tokenizer))
    assert sorted((d or -1, n, c) for _, d, n, c in got) == want
    ids = {r.doc_id: r.ids for r in token_store.read(spark, store).where("doc_id IN (8, 9)").collect()}
    assert ids[8] == [*tokenizer.encode("!!! *** 123", add_special_tokens=False).ids, 1]
    none = new_path(spark, "test-tokens")
    token_store.write(empty(spark), none, tokenizer=TOKENIZER)
    assert token_store.digests(spark, none).count() == 0


def test_encoder_equals_whole_texts():
    e = token_store.Encoder(TOKENIZER)
    assert e.by_word
    texts = ["", "A<|endoftext|>b", "<|ENDOFTEXT|> x", "don't can'T o'clock", "ΑΣ ΟΔΟΣ", "école ÉCOLE é", "x́ , ́a", "a_b c-d, e.. f!'s", "12.3 ²x ½", " nb sp ", "İstanbul ǅ", "a\x1cb \x00c", "日本語 text、", "ﬁne", "Straße, GROẞ", "🙂🙂 ok🙂!", "क़", "x" * 3000]
    want = [e._ids([t])[0].tobytes() + e.end for t in texts]
    assert e.encode(pa.array(texts)) == want
    assert e.encode(pa.array(texts)) == want
    byte_level = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), end_id=50256)
    assert not byte_level.by_word and byte_level.encode(pa.array(["a b"]))[0].endswith(byte_level.end)


def test_mixing(spark, odd):
    df, rows = odd
    out = mixing.mix(df.select("doc_id", "text", "source", "size")).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    sources = {r.source: r for r in out}
    total = sum(r["size"] for r in out)
    assert abs(sum(r.target for r in sources.values()) - min(1.5 * total, sum(2 * r.source_size for r in sources.values()))) < 1e-6 * max(1, total)
    for s, r in sources.items():
        assert abs(sum(x.taken for x in out if x.source == s) - r.target) <= 1
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_against_rounds(spark):
    draw = random.Random(4)
    rows = [(i, phrase(draw.randrange(0, 40), i), "en", draw.choice(["s1", "s2", "s3", "s4", "Z", None, "big", "big", "big"]), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, keep=("text",))
    got = {r.source: r.target for r in out.collect()}
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(brute.words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(size.values()), set(names)
    while True:  # clamp, give what is left to the others, again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
        free -= over
    assert {s: round(v, 6) for s, v in got.items()} == {s: round(v, 6) for s, v in want.items()}
    again = mixing.mix(docs.repartition(7), keep=("text",)).select("doc_id", "taken").collect()
    assert sorted(again) == sorted(out.select("doc_id", "taken").collect())
    mixed = mixing.repeat(out).collect()
    for s, v in want.items():
        assert abs(sum(len(brute.words(r.text)) for r in mixed if r.source == s) - v) <= 1


def test_quality_rules(spark, odd, sf_dir):
    df, rows = odd
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    texts = [r[1] for r in rows] + [r.text for r in docs.collect()] + ["a b c a b c\n\n a \n a\n#<|>", "x x x x", "p q\np q\np q"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in quality_rules.apply(table, model).collect():
        want = brute.base_counts(r.text)
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]) and not (r.kept and r.base_failed)
    good = quality_rules.apply(docs, model, drop=("text",)).withColumnRenamed("quality", "p").join(labels, "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in good) >= 0.95 * len(good)
    assert quality_rules.fit(empty(spark), labels.limit(0)) is None
    assert quality_rules.apply(empty(spark), None).count() == 0


def test_quality_classifier(spark, odd, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest has 19 held-out labels
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = nbsvm.fit(docs, labels, held_out=held_out)
    got = nbsvm.score(docs, model).where(held_out).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    out = nbsvm.score(odd[0], model).collect()
    assert len(out) == len(odd[1]) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert nbsvm.fit(docs.limit(0), labels) is None
    assert {r.score for r in nbsvm.score(odd[0], None).collect()} == {0.5}


def test_dual_descent_separates():
    import numpy as np

    rows = [(np.array([0, 2]), np.array([1.0, 1.0])), (np.array([1, 2]), np.array([1.0, 1.0]))] * 5
    y = np.array([1, -1] * 5)
    w = nbsvm.dual_descent(rows, y, 3, np.ones(10))
    assert all(y[i] * (w[c] @ v) > 0.99 for i, (c, v) in enumerate(rows))


def test_decontaminate(spark, odd, sf_dir):
    draw = random.Random(2)
    items = [(i, " ".join(f"q{draw.randrange(900)}" for _ in range(draw.choice([6, 20, 60, 200]))) + ". And the answer is " + f"a{i} b{i} c{i}.") for i in range(40)] + [(50, None), (51, ""), (52, "..."), (53, "yes")]
    texts = []
    for k in range(120):
        body = [f"q{draw.randrange(900)}" for _ in range(draw.choice([0, 5, 80, 700]))]
        if k % 3 == 0:
            at = draw.randrange(len(body) + 1)
            body[at:at] = items[k % 40][1].upper().split() if k % 2 else items[k % 40][1].split()
        texts.append((k, " ".join(body)))
    docs = spark.createDataFrame(texts + [(None, None)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()}
    want = {(d, i) for d, i in brute.leaks(texts, [x for x in items[:40]])}
    assert got == want and len(got) == 40
    left = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert left == {t[0] for t in texts} - {d for d, _ in want} | {None}
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), bench).count() == 0
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(spark.createDataFrame(real, "doc_id long, text string"), bench).collect()}
    assert got == brute.leaks(real, [(r.item_id, r.text) for r in bench.collect()])


def test_wand_finds_what_a_scan_finds():
    draw = random.Random(5)
    items = [decontaminate.Item(i, [f"t{int(draw.random() ** 3 * 200)}" for _ in range(draw.randrange(1, 60))], ["x"]) for i in range(150)]
    index = decontaminate.Index(items)
    terms = sorted(index.units)
    for k in range(200):
        q = sorted({*draw.sample(terms, 20), *[index.terms[w] for w in items[k % 150].question[: draw.randrange(60)]]})
        score = {}
        for t in q:
            for u, x in zip(index.units[t], index.impacts[t], strict=True):
                score[u] = score.get(u, 0) + x
        assert sorted(u for u, _ in index.search(q)) == sorted(u for u, s in score.items() if s >= 1 - 1e-6)


@pytest.mark.parametrize("bucket", [256, 2])
def test_simhash(spark, odd, sf_dir, bucket):
    df, rows = odd
    assert all(simhash.fingerprint(t or "") == brute.fingerprint(t) for _, t, *_ in rows)
    draw = random.Random(6)
    prints = []
    for c in range(25):
        f = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 6, 40])):
            for _ in range(draw.randrange(3)):
                f ^= 1 << draw.randrange(64)
            prints.append((len(prints) if len(prints) % 17 else None, f))
    prints += [(1000, 0), (1001, 0), (1002, 3), (1003, 1 << 63)]
    table = spark.createDataFrame([(d, simhash._long(f)) for d, f in prints], "doc_id long, fp long")
    got = sorted((r.doc_id or -1, r.fp, r.component_id) for r in simhash.classes(table, bucket=bucket).collect())
    assert got == sorted((d or -1, simhash._long(f), c) for d, f, c in brute.components(prints))
    out = simhash.classes(simhash.fingerprints(df), bucket=bucket).collect()
    assert len(out) == len(rows) and {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    assert simhash.classes(simhash.fingerprints(empty(spark))).count() == 0


def test_pigeonring_budgets_lose_no_pair():
    draw = random.Random(7)
    for tau, segments in ((2, 3), (2, 5), (2, 31), (1, 2), (3, 4), (3, 10), (5, 16)):
        chains = {n: simhash._chains(segments, n) for n in range(1, segments + 1)}
        equal = simhash._equal_chain(segments, tau)
        assert equal * tau // segments == 0 < (equal + 1) * tau // segments
        for _ in range(1000):
            d = sum(1 << b for b in draw.sample(range(64), draw.randrange(tau + 1)))
            # the key is an equal chain, so every chain counts, from one segment at least
            assert any(all((d & chains[n][i]).bit_count() <= n * tau // segments for n in chains) for i in range(segments))


def test_rings_grow_with_the_fingerprints():
    sizes = [simhash.ring(n) for n in (0, 10**5, 10**8, 10**10, 10**14)]
    assert sizes[0] == 3 and sizes == sorted(sizes) and sizes[2] > 3 and sizes[-1] <= 64


@pytest.mark.parametrize("options", [{"tau": 2, "segments": 7}, {"tau": 3, "bucket": 3}, {"tau": 1, "bucket": 2}, {"tau": 4, "segments": 13, "bucket": 8}])
def test_links_are_all_pairs_within_tau(spark, options):
    draw = random.Random(11)
    base = [draw.getrandbits(64) for _ in range(6)]
    prints = {draw.choice(base) ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(5))) for _ in range(300)}
    table = spark.createDataFrame([(simhash._long(f),) for f in prints], "fp long")
    found = [(r.u, r.v) for r in simhash.links(table, **options).collect()]
    got, every = set(found), sorted(map(simhash._long, prints))
    assert len(found) == len(got)  # each pair once
    assert got == {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= options["tau"]}


def test_substring_dedup(spark, odd):
    df, rows = odd
    draw = random.Random(8)
    shared = [[f"s{j}_{draw.randrange(50)}" for _ in range(draw.randrange(50, 140))] for j in range(4)]
    texts = []
    for k in range(60):
        body = [f"u{draw.randrange(10_000)}" for _ in range(draw.randrange(0, 200))]
        for s in draw.sample(shared, draw.randrange(3)):
            at, cut = draw.randrange(len(body) + 1), draw.randrange(30)
            body[at:at] = s[cut:]
        texts.append((draw.choice([k, k // 2]), " ".join(body)))
    texts += [(900, " ".join(["same"] * 120)), (901, " ".join(["same"] * 70)), (902, " ".join(["same"] * 49))]
    for table, plain in ((spark.createDataFrame(texts, "doc_id long, text string"), texts), (df, [(r[0], r[1]) for r in rows])):
        got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(table).collect())
        assert got == sorted((d or -1, n, g, k) for d, n, g, k in brute.substring_dedup(plain))
    digest = substring_dedup.dedup(df, digest=True).where("doc_id = 8").first()
    assert digest.kept_sha256 == brute.sha("!!! *** 123")
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_substring_dedup_of_many_rows_without_an_id(spark):
    """Rows that share an id, or have none, are told apart by their texts: none waits for the others' hits."""
    block = [f"s{i}" for i in range(60)]
    texts = [(None, " ".join([f"u{k}", *block[k % 7 :], f"v{k}"])) for k in range(300)] + [(5, " ".join([*block, f"w{k}"])) for k in range(40)] + [(None, " ".join(block))] * 50
    texts += [(2, " ".join(block[3:57]))]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(table).collect())
    assert got == sorted((d or -1, n, g, k) for d, n, g, k in brute.substring_dedup(texts))
    spans = substring_dedup.repeats(table).collect()
    assert len({(r.rid, r.tkey) for r in spans}) == len(spans) > 300  # a row a text, not one with all

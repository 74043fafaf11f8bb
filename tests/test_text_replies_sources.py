"""Column functions, readers, adapters, dedup and streams."""

import gzip
import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions import replies
from quillspark.functions import text as T
from quillspark.operators import adapters, dedup
from quillspark.sources import landed as landing
from quillspark.sources import readers, search
from quillspark.sources.landed import LandedPapers, LandedReader
from quillspark.streaming import events


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    L = F.lit
    r = one(
        spark, T.arxiv_id(L("https://arxiv.org/abs/2101.12345v2")), T.arxiv_id(L("none")), T.doi(L(" HTTPS://dx.doi.org/10.1/AB ")), T.doi(L("")), T.slug(L("  Active Vibration: H2! ")), T.parent_level(L("L3-Alg")), T.parent_level(L("L1")), T.level_number(L("x l4 L2")),
        T.duration(L(5.25)), T.duration(L(125)), T.duration(L(7260)), T.search_terms(L("A Novel Approach for Tracking of Robust Wheels")), T.search_terms(L("of")), T.year_in(L("c. 1897, 2019")), T.jaccard(F.array(L("a")), F.array().cast("array<string>")),
        T.tokens(L("Éa1-B \u212a")), T.has_cjk(L("振动")), T.on_computing(L("A Neural thing")), T.unfenced(L("```json\n{}\n```")), T.filled("a {x} {y}", {"x": L(1)}), T.paragraphs(L("aa\n\nbb\n\n" + "c" * 9), 7), T.file_name(L(' a/b: "c" ')), T.token_set(L("The PID of it and ANC")),
    )
    assert list(r) == [
        "2101.12345", None, "10.1/ab", None, "active-vibration-h2", "L2", None, 2, "5.3s", "2m 5s", "2h 1m", "tracking wheels", "of", 2019, 0.0, ["a1", "b"], True, True, "{}", "a 1 {y}", ["aa\n\nbb", "c" * 9], "a_b_ _c_", ["pid", "anc"],
    ]


@pytest.mark.parametrize(
    "reply,want",
    [
        ('{"score": 4, "reason": "x"}', (4, 1.0)), ('```json\n{"score": 2}\n```', (2, 1.0)), ('{"score": 3, "confidence": 0.4}', (3, 0.4)), ('so {"score": 5} it is', (5, 0.9)), ('see {"a": {"b": 1}, "score": 3} end', (3, 0.7)), ("score: 4", (4, 0.5)), ("Score = 9", None),
        ("the relevance is 3", (3, 0.5)), ("I say 2.", (2, 0.3)), ("7", None), ("", None), (None, None),
    ],
)
def test_relevance(spark, reply, want):
    r = one(spark, replies.relevance(F.lit(reply).cast("string")).alias("r")).r
    assert (None if r is None else tuple(r)) == want


def test_scores(spark):
    f = lambda j: one(spark, replies.review_scores(F.lit(j)).alias("s")).s
    assert f('{"C1": 4, "c2": "3", "L": "x"}') == {"contribution": 4.0, "correctness": 3.0, "likelihood": 0.0}
    assert f('{"scores": {"contribution": 5, "C4": 1}}') == {"contribution": 5.0, "connectedness": 1.0}
    m = one(spark, replies.mean_score(F.create_map(F.lit("a"), F.lit(4.0), F.lit("b"), F.lit(0.0), F.lit("c"), F.lit(3.0)), F.lit(0.0)), replies.mean_score(F.create_map(F.lit("a"), F.lit(4.0)), F.lit(2.5)), replies.mean_score(F.create_map().cast("map<string,double>")))
    assert list(m) == [3.5, 2.5, 0.0]
    assert list(one(spark, replies.percent(F.lit("85")), replies.percent(F.lit("x")), replies.percent(F.lit(-3)), replies.json_text(F.lit('a {"b": 1} c')), replies.listed(F.lit("a → b"), True), replies.listed(F.lit("a, b")))) == [0.85, 0.0, 0.0, '{"b": 1}', ["a", "b"], ["a", "b"]]


PAPERS = [
    {"paper_id": "1", "title": "A study of plates", "abstract": "short", "year": 2020, "source": "x", "doi": "10.1/A", "arxiv_id": ""}, {"paper_id": "2", "title": "A study of plate", "abstract": "a longer abstract", "year": 2021, "source": "x", "doi": "", "arxiv_id": ""},
    {"paper_id": "3", "title": "Other", "abstract": "", "year": 2019, "source": "y", "doi": "https://doi.org/10.1/a", "arxiv_id": ""}, {"paper_id": "4", "title": "Third thing", "abstract": "", "year": 2018, "source": "y", "doi": "", "arxiv_id": "2001.00001v1"},
    {"paper_id": "5", "title": "Something else", "abstract": "", "year": 0, "source": "y", "doi": "", "arxiv_id": "2001.00001v3"}, {"paper_id": "6", "title": "", "abstract": "", "year": 0, "source": "y", "doi": "", "arxiv_id": ""}, {"paper_id": "7", "title": "", "abstract": "", "year": 0, "source": "y", "doi": "", "arxiv_id": ""},
]


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    lines = [json.dumps({"type": "search_metadata", "query": "q", "year_min": 2018, "sources": ["x", "y", "z"]}), *map(json.dumps, PAPERS), "{broken", json.dumps({"type": "sources_status", "statuses": {"x": {"status": "ok", "count": 2}}, "total_papers": 7})]
    (folder / "a.jsonl").write_text("\n".join(lines))
    return str(folder)


def test_search_file(spark, landed, tmp_path):
    papers = readers.search_file(spark, landed)
    assert [r.paper_id for r in papers.orderBy("pos").collect()] == list("1234567")
    assert readers.search_header(spark, landed).first().year_min == 2018 and readers.search_footer(spark, landed).first().total_papers == 7
    out = str(tmp_path / "out")
    readers.write_search_file(papers, out, "q", sources=["x", "y", "z"])
    assert readers.search_file(spark, out).count() == 7
    status = readers.search_footer(spark, out).first()
    assert status.total_papers == 7 and status.statuses["z"].status == "empty" and status.statuses["y"]["count"] == 5


def test_data_source(spark, landed):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPapers)
    df = spark.read.format("landed_papers").option("path", landed).load()
    assert df.count() == 7 and df.where("year >= 2020").count() == 2 and df.where("year > 2018 AND year < 2021").count() == 2
    assert spark.read.format("landed_papers").option("path", landed).option("max_results", 3).load().count() == 3


def test_data_source_by_ranges(spark, tmp_path):
    rows = [{"paper_id": str(i), "title": f"é {'x' * (i % 7)}", "year": 2000 + i % 30, "source": f"s{i % 3}", "abstract": "Robust wheels" if i % 2 else None} for i in range(60)]
    rows[5] |= {"year": "2005", "authors": "none", "venue": 3, "citations": 1e300}
    rows[6] |= {"year": "soon", "authors": ["a", 1]}
    text = [json.dumps(r, ensure_ascii=False) for r in rows]
    (tmp_path / "in" / "_hidden").mkdir(parents=True)
    (tmp_path / "in" / "_hidden" / "x.json").write_text(text[0])
    (tmp_path / "in" / "a.json").write_text("\n".join(text[:25]) + "\nno json\n\n[1]\n")
    (tmp_path / "in" / "b.json").write_text("\n".join(text[25:50]))
    (tmp_path / "in" / "c.json").write_text("")
    with gzip.open(tmp_path / "in" / "d.json.gz", "wt") as f:
        f.write("\n".join(text[50:]))
    of = lambda **o: landing.load(spark, f"file://{tmp_path}/in", **o)
    ids = lambda df: sorted(int(r.paper_id) for r in df.select("paper_id").collect())
    for size in (1, 7, 100, 101, 1000, 1 << 20):
        reader = LandedReader({"path": str(tmp_path / "in"), "split_bytes": str(size)})
        assert sorted(int(r[0]) for part in reader.partitions() for r in reader.read(part)) == list(range(60))
    assert ids(of(split_bytes=500)) == list(range(60))
    assert of(split_bytes=1000).rdd.getNumPartitions() > 3 and of().rdd.getNumPartitions() == 1
    odd = {r.paper_id: r for r in of().where("paper_id IN ('5', '6')").collect()}
    assert (odd["5"].year, odd["5"].authors, odd["5"].venue, odd["5"].citations) == (2005, [], "3", 0) and (odd["6"].year, odd["6"].authors) == (0, ["a", "1"])
    assert ids(of(query="ROBUST wheels", year_min=2010, year_max=2012, sources="s0, s1")) == [i for i in range(60) if i % 2 and 10 <= i % 30 <= 12 and i % 3 < 2]
    assert ids(of(max_results=4, split_bytes=50)) == [0, 1, 2, 3]
    few = of(split_bytes=500).where("source IN ('s1', 's2') AND source = 's1' AND year > 2003 AND title <> ''")
    assert ids(few) == [i for i in range(60) if i % 3 == 1 and i % 30 > 3 and i != 6]
    conditions = [x for x in few._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter (" in x]
    assert conditions and not any("source" in x or "year" in x for x in conditions)  # the reader has them
    (tmp_path / "none").mkdir()
    assert landing.load(spark, str(tmp_path / "none")).count() == 0


def test_connectors(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"results": [{"标题": "T", "作者": "A; B", "日期": "2020-01-02", "id": "arXiv:2101.00001v2", "cited_by": "7"}, {"name": " ", "id": "x"}]}))
    rows = readers.unified(readers.records(spark, str(tmp_path / "w.json")), "cn").collect()
    assert len(rows) == 1 and rows[0].authors == ["A", "B"] and rows[0].year == 2020 and rows[0].arxiv_id == "2101.00001" and rows[0].citations == 7
    (tmp_path / "l.json").write_text('{"title": "One", "doi": "DOI:x"}\nnot json\n{"title": "Two", "citations": "many"}')
    assert [r.title for r in readers.unified(readers.records(spark, str(tmp_path / "l.json")), "s").collect()] == ["One", "Two"]
    work = [{"id": "w1", "title": "W", "publication_year": 2020, "doi": "https://doi.org/10.2/B", "authorships": [{"author": {"display_name": "N"}}], "abstract_inverted_index": {"b": [1, 2], "a": [0]}, "locations": [{"landing_page_url": "http://arxiv.org/abs/1901.12345v1"}]}, {"id": "w2", "title": "no abstract", "publication_year": 2020}]
    (tmp_path / "works.json").write_text("\n".join(map(json.dumps, work)))
    got = readers.works(spark.read.schema(readers.WORK).json(str(tmp_path / "works.json")), year_min=2019).collect()
    assert [(r.paper_id, r.abstract, r.doi, r.arxiv_id, r.authors) for r in got] == [("w1", "a b", "10.2/b", "1901.12345", ["N"])]


def test_seed_files(spark, tmp_path):
    seed = lambda i, level: {"node_id": i, "name": i, "level": level, "category": "c", "description": "", "aliases": [], "keywords": ["k"]}
    (tmp_path / "seed_L1.json").write_text(json.dumps([seed("axiom-2", 1), seed("axiom-10", 1)]))
    (tmp_path / "seed_L0.json").write_text(json.dumps([seed("meta-1", 0)]))
    assert [r.node_id for r in readers.seeds(spark, str(tmp_path / "seed_L*.json")).orderBy("seed_pos").collect()] == ["meta-1", "axiom-2", "axiom-10"]  # in order of the files
    (tmp_path / "seed_L2.json").write_text(json.dumps([{"name": "x"}]))
    with pytest.raises(Exception, match="lacks"):
        readers.seeds(spark, str(tmp_path / "seed_L*.json")).collect()
    (tmp_path / "m").mkdir()
    (tmp_path / "m/s.md").write_text('---\nnode_id: "x-1"\nname: X\nlevel: 2\n---\nBody')
    r = readers.markdown_seeds(spark, str(tmp_path / "m")).first()
    assert (r.node_id, r.name, r.level, r.body) == ("x-1", "X", 2, "Body")
    assert readers.prompt("intro\n## System\na\n## User\nb") == {"": "intro", "system": "a", "user": "b"}


def test_dedup(spark):
    schema = "paper_id string, title string, abstract string, year int, source string, doi string, arxiv_id string, pos bigint"
    rows = spark.createDataFrame([(*[p[k] for k in ("paper_id", "title", "abstract", "year", "source", "doi", "arxiv_id")], i) for i, p in enumerate(PAPERS)], schema)
    assert SequenceMatcher(None, "a study of plate", "a study of plates").ratio() >= 0.85
    kept = {r.paper_id: r for r in dedup.replay(rows).collect()}
    assert set(kept) == {"2", "4", "6", "7"}  # 2 took over the record of 1
    assert sorted(dedup.whole(rows).collect()) == sorted(kept.values())
    assert {r.paper_id for r in dedup.exact(rows).collect()} == {"1", "2", "4", "6", "7"}


def _wild(n, seed):
    import random

    draw = random.Random(seed)
    titles = ["a study of the control of plates", "noise in long ducts and pipes", "adaptive filters for rooms", "", "entirely other matters"]
    rows = []
    for i in range(n):
        doi, arxiv = draw.choice(["", None, f"10.1/{draw.randrange(12)}"]), draw.choice(["", None, f"2101.{draw.randrange(10000, 10008)}"])
        t = list(draw.choice(titles))
        for _ in range(draw.randrange(7)):  # chains of titles, each near the next and not the one after
            if t:
                t[draw.randrange(len(t))] = draw.choice("abcxyz ")
        rows.append((str(i), "".join(t) if t else draw.choice(["", None, f"unlike {draw.getrandbits(90):x}"]), draw.choice([None, "w" * draw.randrange(60)]), doi, arxiv, 7 * i))
    return rows


WILD = "paper_id string, title string, abstract string, doi string, arxiv_id string, pos bigint"


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_components_replay_as_one_sequence(spark, seed):
    table = spark.createDataFrame(_wild(250, seed), WILD).withColumn("near", F.lit("clash")).withColumn("p", F.lit("clash"))
    key = lambda r: r.pos
    assert sorted(dedup.whole(table).collect(), key=key) == sorted(dedup.replay(table).collect(), key=key)


def test_a_later_title_meets_the_record_that_took_over(spark):
    a, b, c = "abcdefghijklmnopqrst", "abcdefghijklmnopqrXX", "abcdefghijklmnopXXXX"
    rows = [("1", a, "w", "", "", 1), ("2", b, "ww", "", "", 2), ("3", c, "", "", "", 3), ("4", a, "", "", "", 4)]
    assert SequenceMatcher(None, c, a).ratio() < 0.85 <= SequenceMatcher(None, c, b).ratio()
    assert {r.paper_id for r in dedup.whole(spark.createDataFrame(rows, WILD)).collect()} == {"2"}  # 3 is near 2, which stands for 1
    rows[1] = ("2", b, "", "", "", 2)
    assert {r.paper_id for r in dedup.whole(spark.createDataFrame(rows, WILD)).collect()} == {"1", "3"}
    assert dedup.whole(spark.createDataFrame([], WILD)).count() == 0


def test_one_title_for_a_third_of_the_papers(spark):
    rows = [(str(i), "the very same title" if i % 3 == 0 else f"{i:040b}"[::-1] + f"{i * 7919:x}", "w" * (i % 50), "", "", i) for i in range(300)]
    table = spark.createDataFrame(rows, WILD)
    assert {r.paper_id for r in dedup.whole(table).collect()} == {r.paper_id for r in dedup.replay(table).collect()}


def test_similar_titles_lose_no_pair(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pos"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"))
    titles = sorted({(r.title.strip().lower(), r.pos) for r in d.collect()}, key=lambda x: x[1])
    first = {}
    for t, p in titles:
        if t:
            first.setdefault(t, p)
    names = sorted(first, key=first.get)
    want = {(b, a) for i, a in enumerate(names) for b in names[i + 1 :] if SequenceMatcher(None, b, a).ratio() >= 0.85}
    got = {(r.new_title, r.old_title) for r in dedup.similar_titles(d).collect()}
    assert got == want


def test_unified_search(spark):
    schema = "paper_id string, title string, abstract string, year int, citations int, source string, doi string, arxiv_id string, pos bigint"
    make = lambda name, n, k=0: lambda q: spark.createDataFrame([(f"{name}{i}", f"{name} {'xyzwvu'[i % 6] * (i + 1)} {i * k}", "", 2000 + i, i, name, "", "", i) for i in range(n)], schema)
    papers, status = search.unified_search("振动 neural", {"a": make("a", 2), "b": make("b", 0)}, computing={"c": make("cc", 3)}, scholar={"s": make("sss", 2)}, chinese={"k": make("kkkk", 1)}, year_min=2001)
    assert {r.source: r.n for r in status.collect()} == {"a": 2, "b": 0, "c": 0, "s": 0, "k": 0, "cc": 3, "sss": 2, "kkkk": 1}
    got = [r.year for r in papers.collect()]
    assert got == sorted(got, reverse=True) and min(got) == 2001
    plain, status = search.unified_search("plates", {"a": make("a", 2)}, computing={"c": make("cc", 3)}, chinese={"k": make("kkkk", 1)})
    assert {r.source for r in status.collect()} == {"a"}


def test_adapters(spark):
    papers = spark.createDataFrame([("1", "T1", "A1", 2020, 5, 0), ("2", "T2", "A2", 2021, 9, 1)], "paper_id string, title string, abstract string, year int, citations int, pos bigint")
    said = adapters.Replay({adapters.prompt_key("s", "T1|A1"): 'x {"C1": 4, "C2": 5} y'}, default="no")
    rows = {r.paper_id: r for r in adapters.reviewed(papers, said, system="s", template="{title}|{abstract}").collect()}
    assert rows["1"].mean_score == 4.5 and rows["1"].llm_passed and rows["2"].error and rows["2"].mean_score is None and not rows["2"].llm_passed
    assert {r.reply for r in adapters.ask(papers, adapters.Noop(), "s", F.col("title")).collect()} == {json.dumps({"skipped": True, "reason": "no language model"})}
    broken = adapters.Replay({})
    assert all("KeyError" in r.error for r in adapters.ask(papers, broken, "s", F.col("title")).collect())
    kept = adapters.relevance(papers, adapters.Replay({}, "score: 4"), "topic", system="s", template="{topic} {title} {abstract_snippet}").collect()
    assert len(kept) == 2 and kept[0].confidence == 0.5
    reply = json.dumps({"knowledge_level": ["L1-a"], "knowledge_level_confidence": "80", "structure_template": {"signal_chain": "a → b", "constraint_type": "x, y", "abstract_pattern": ["p", "q"], "control_architecture": "ff"}})
    s = adapters.structures(papers, adapters.Replay({}, reply), system="s", template="{title}").first()
    assert s.knowledge_level_confidence == 0.8 and s.structure_template.signal_chain == ["a", "b"] and s.structure_template.constraint_type == ["x", "y"] and s.structure_template.abstract_pattern == "p → q"
    assert {r.phase for r in adapters.further_queries(papers, 1).collect()} == {"C", "D"}
    assert "| 1 | T2" in adapters.review_text(papers.withColumns({"mean_score": F.lit(None).cast("double"), "dry_score": F.col("citations") / 10}), None)
    notes = spark.createDataFrame([("n", "---\ntags: [a, 'b']\n---\nx\n\ny")], "name string, text string")
    assert {r.term for r in adapters.technical_terms(notes).collect()} == {"a", "b"}
    assert adapters.translated(notes, adapters.Replay({}, "Z"), template="{text}").first().text == "Z"


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(live).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((r.window_start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert rows(spark.table("tumbled")) == rows(events.tumbling(batch))
    q = events.first_seen(live, ["user_id", "event_type"], late="1000 days").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == events.first_seen(batch, ["user_id", "event_type"]).count()


def test_event_log(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01T00:00:00", "phase_start", "B1", None), ("2026-01-01T00:00:09", "item_error", "B1", {"tokens_in": "5"}), ("2026-01-01T00:01:00", "phase_end", "B1", {"tokens_out": "7"}), ("2026-01-01T00:00:00", "run_start", None, {"query": "q"})], "t string, e string, p string, rest map<string,string>").withColumn("t", F.col("t").cast("timestamp"))
    log = str(tmp_path / "log")
    events.append(rows, log)
    (tmp_path / "log" / "bad.txt").write_text("{broken\n")
    back = events.read(spark, log)
    assert back.count() == 4 and back.where("e = 'run_start'").first().rest == {"query": "q"}
    c = events.counters(back).where("p = 'B1'").first()
    assert (c.tokens, c.errors, c.elapsed_s, c.status) == (12, 1, 60.0, "done_with_errors")
    out, mark = str(tmp_path / "copy"), str(tmp_path / "mark")
    for _ in range(2):
        events.to_table(events.read(spark, log, stream=True), out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == 4


def test_keyword_pass_on_lines(spark):
    rows = spark.createDataFrame([("Adaptive control", "x"), ("LMS", None), (None, None)], "title string, abstract string")
    assert events.keyword_pass(rows).count() == 1

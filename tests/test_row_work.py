"""What is worked out inside a row: no word is shuffled, nothing is worked out twice."""

from pyspark.sql import functions as F

from quillspark.operators import seeds
from quillspark.plans import queries
from quillspark.sources import readers


def test_inverted_index_shuffles_no_word(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "é"]), (2, ["x"]), (3, ["k"]), (3, ["k", "l"]), (None, ["n"]), (None, ["m", "n"])], "id long, w array<string>")
    index = readers.inverted_index(rows, "id", "w")
    got = {r.id: r.i for r in index.collect()}
    assert got == {1: {"b": [0, 2], "a": [1], "é": [3]}, 2: {"x": [0]}, 3: {"k": [0, 0], "l": [1]}, None: {"n": [0, 1], "m": [0]}}
    text = {r.id: r.t for r in index.select("id", readers.rebuilt_abstract(F.col("i")).alias("t")).collect()}
    assert text[1] == "b a é" and text[2] == "x"


def test_words_of_a_template_are_cut_once(spark, sf_dir):
    plan = queries.QUERIES["template_similarity"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # the join has sets of words, not texts


def test_seeds_are_scored_once_a_paper(spark):
    s = spark.createDataFrame([("method-1", "control", 1, "m", ["noise"], ["control", "noise", "duct"], 1)], "node_id string, name string, level int, category string, aliases array<string>, keywords array<string>, seed_pos int")
    p = spark.createDataFrame([(1, "Noise control", "of a duct"), (2, None, None), (3, "", "nothing")], "paper_id long, title string, abstract string")
    found = seeds.match(p, s)
    assert [(r.paper_id, r.node_id, r.rank, round(r.score, 3)) for r in found.collect()] == [(1, "method-1", 1, 1.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_sort") + found._jdf.queryExecution().optimizedPlan().toString().count("arraysort") <= 2  # papers', and the seeds' own

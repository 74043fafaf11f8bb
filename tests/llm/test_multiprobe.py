"""Nearest neighbours against all inner products: recall, ties, copies, unequal lengths, odd vectors."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import multiprobe

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=20, every=20):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok], float)
    out = {}
    for i, v in ok:
        if i % every == 0:
            score = (np.array(v, float) * x).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def got(df):
    out = defaultdict(list)
    for r in sorted(df.collect()):
        out[r.query_id].append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return dict(out)


def recall(found, want):
    return sum(len({i for i, _ in found[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_steps_come_in_order_of_estimated_success():
    inside = np.random.default_rng(1).random(4)
    cost = lambda s: sum(0 if x == 0 else inside[i] ** 2 if x < 0 else (1 - inside[i]) ** 2 for i, x in enumerate(s))
    every = sorted(itertools.product((-1, 0, 1), repeat=4), key=cost)
    assert [tuple(s) for s in multiprobe.steps(inside, 81).tolist()] == every
    assert len(multiprobe.steps(inside, 500)) == 81 and not multiprobe.steps(inside, 1).any()


@pytest.mark.parametrize("cell", [2048, 40])
def test_recall_and_scores(spark, monkeypatch, cell):
    monkeypatch.setattr(multiprobe, "CELL_ROWS", cell)
    monkeypatch.setattr(multiprobe, "CELL_QUERIES", max(2, cell // 10))
    draw = np.random.default_rng(3)
    centre = draw.standard_normal((40, 12))
    # clusters, and rows of very unequal length, so that largest product is not smallest distance
    x = (centre[draw.integers(40, size=3000)] + 0.3 * draw.standard_normal((3000, 12))) * np.exp(draw.standard_normal(3000))[:, None]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("c", F.lit("clash")).withColumn("rank", F.lit(0)).withColumn("v", F.lit("clash"))
    found, want = got(multiprobe.nearest(df)), plain(rows)
    assert found.keys() == want.keys() and {len(f) for f in found.values()} == {20}
    assert recall(found, want) >= 0.9
    for q, f in found.items():
        for i, s in f:
            assert i != q and s == pytest.approx(float(np.dot(x[q], x[i])), abs=1e-9)
        assert f == sorted(f, key=lambda r: (-r[1], r[0]))
    assert found == got(multiprobe.nearest(df.repartition(3)))  # reruns agree


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20 * i, [1.0, 0.0, 0.0]) for i in range(3)] + [(7 + i, [1.0, 0.0, 0.0]) for i in range(60)]  # one vector for many ids
    rows += [(100, [0.0, 2.0, 0.0]), (101, [0.0, 1.0, 0.0]), (102, [0.0, 0.0, 5.0]), (120, [-1.0, 0.0, 0.0]), (140, [0.5, 0.5, 0.0])]
    rows += [(100, [0.0, 2.0, 0.0])] * 3 + [(None, [1.0, 1.0, 1.0]), (160, None), (180, []), (200, [0.0, 0.0, 0.0]), (220, [nan, 1.0, 1.0]), (240, [inf, 0.0, 0.0]), (260, [None, 1.0, 0.0]), (280, [1.0, 1.0])]
    want = plain([r for r in rows if r[0] != 280])
    assert got(multiprobe.nearest(spark.createDataFrame(rows, SCHEMA))) == want
    assert [i for i, _ in want[0]] == list(range(7, 27)) and 160 not in want and 280 not in want


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])]
    assert got(multiprobe.nearest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert multiprobe.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert multiprobe.nearest(spark.createDataFrame([(3, [1.0]), (4, [2.0])], SCHEMA)).count() == 0
    assert multiprobe.nearest(spark.createDataFrame([(0, [1.0])], SCHEMA)).count() == 0


def test_query_recall(spark, sf_dir):
    from quillspark.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert recall(got(QUERIES["op13_nearest_neighbours"](spark, sf_dir)), plain(rows)) >= 0.9


def test_a_setting_that_cannot_reach_the_target_gives_way_to_one_bucket():
    draw = np.random.default_rng(5)
    queries, rows = draw.standard_normal((4, 3)), draw.standard_normal((50, 3))
    near = np.full((4, 2, 3), np.nan)
    assert multiprobe.fit(queries, near, rows, 50, 5.0).probes == 1
    near[:, 0] = queries
    h = multiprobe.fit(queries, near, rows, 50, float(np.linalg.norm(rows, axis=1).max()))
    assert 1 <= h.probes <= multiprobe.PROBES

"""The prefix trie against one built of plain tuples: odd rows, long and hot conversations, ends in several blocks."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in by.items()}
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + said[h:]
    return out


def plain(rows):
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 2048])
def test_nodes_are_the_plain_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    draw = random.Random(4)
    openings = [("user", "hello  there\tyou"), ("system", "be brief"), ("user", "a"), (None, "a"), ("user", None)]
    rows = []
    for c in [*range(-45, 90), 10**12, 10**12 + 3, 985, 999]:
        for turn in range(draw.randrange(6)):
            rows.append((c, turn, *(openings[draw.randrange(5)] if draw.random() < 0.8 else ("assistant", f"only {c} {turn}"))))
    rows += [(200 + i, 0, "user", "the same words for all") for i in range(300)]  # ends of one node in many blocks
    rows += [(620, k, "user", f"long {k % 7}") for k in range(700)] + [(621, None, "user", "null first"), (621, 0, "user", "then"), (621, 5, "user", "twice"), (621, 5, "user", "twice")]
    rows += [(None, 0, "user", "nobody's"), (640, 1, "user", "x" * 50_000), (660, 0, None, None), (661, 0, "", "")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("base", F.lit("clash")).withColumn("depth", F.lit(0)).withColumn("words", F.lit("clash"))
    assert got(prefix_trie.nodes(df)) == plain(rows)


def test_empty(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_order_of_equal_turns_is_fixed(spark):
    rows = [(0, 1, "user", x) for x in "abcdefgh"]
    one = got(prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA)))
    assert one == got(prefix_trie.nodes(spark.createDataFrame(rows[::-1], SCHEMA)))


def test_turns_move_once_and_without_texts(spark):
    plan = prefix_trie.paths(spark.createDataFrame([(0, 1, "user", "x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "text#" not in plan[: plan.index("Exchange")]

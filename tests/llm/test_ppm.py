"""Code lengths against a plain coder that walks the contexts and keeps a set of what it excludes."""

import math
import pickle
import random
from collections import Counter, defaultdict

import pytest

from quillspark.llm import language_id


class Plain:
    """Order 3, escape method C with exclusion, over the symbols of all training texts and one for the rest."""

    def __init__(self, texts, alphabet):
        self.seen = defaultdict(Counter)
        self.alphabet = alphabet | {None}
        line = b"   " + b"   ".join(texts) + b"   "
        for i in range(3, len(line)):
            for k in range(4):
                self.seen[line[i - k : i]][line[i]] += 1

    def nats(self, text):
        line, total = b"   " + text, 0.0
        fold = lambda x: x if x in self.alphabet else None
        for i in range(3, len(line)):
            symbol, tried, bits = fold(line[i]), set(), 0.0
            for k in (3, 2, 1, 0):
                here = {s: n for s, n in self.seen.get(line[i - k : i], {}).items() if s not in tried}
                if not here:
                    continue
                whole = sum(here.values()) + len(here)
                if symbol in here:
                    bits += math.log(whole / here[symbol])
                    break
                bits += math.log(whole / len(here))
                tried |= set(here)
            else:
                bits += math.log(len(self.alphabet - tried))
            total += bits
        return total


def _texts(n, letters, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 8))) for _ in range(60)]
    return [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "éüabcç日本"])
def test_code_lengths(letters):
    train = {"x": _texts(12, letters, 1), "y": _texts(8, letters[::-1], 2), "z": _texts(3, "klm", 3), "none": [""]}
    model = language_id.train((k, t) for k, ts in train.items() for t in ts)
    lines = {k: [language_id._normal(t) for t in ts] for k, ts in train.items()}
    alphabet = {b for ts in lines.values() for t in ts for b in t} | {32} | set(range(97, 123))
    probes = [language_id._normal(t) for t in ["", "a", "zq zq", "ñandú 7", *_texts(20, letters + "klmñq", 4), *train["x"][:3]]]
    got, size = model.totals(probes)
    assert size.tolist() == [len(p) for p in probes]
    for k, name in enumerate(model.languages):
        plain = Plain(lines[name], alphabet)
        for i, p in enumerate(probes):
            # three spaces come before each text, and a context of bytes that nobody saw is one of unseen symbols
            if all(b in alphabet for b in p):
                assert abs(got[i, k] - plain.nats(p)) <= 1e-5 * max(1.0, plain.nats(p)), (name, p)


def test_parts_add_what_they_hold():
    def size(n):
        rows = []
        for k in range(n):
            draw = random.Random(k)
            rows += [(f"l{k}", t) for t in _texts(100, [chr(draw.randrange(0xC0, 0x17F)) if i % 4 == 0 else chr(97 + draw.randrange(26)) for i in range(26)], k)]
        return len(pickle.dumps(language_id.train(rows)))

    small, large = size(10), size(40)
    assert large < 6 * small and large < 200 << 20


def test_registered_predictions_are_those_of_the_model(spark, sf_dir):
    from quillspark.llm.queries import op1_language_id

    rows = {r.doc_id: r for r in op1_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from pyspark.sql import functions as F

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = language_id.training_rows(docs, held_out=held_out)
    lines = {}
    for k, t in found:
        lines.setdefault(k, []).append(language_id._normal(t))
    alphabet = {b for ts in lines.values() for t in ts for b in t} | {32} | set(range(97, 123))
    plain = {k: Plain(ts, alphabet) for k, ts in lines.items()}
    n = 0
    for r in docs.where(held_out).where("length(text) < 1500").collect():
        if r.text and any(map(str.isalpha, r.text)):
            line = language_id._normal(r.text)
            cost = {k: p.nats(line) for k, p in plain.items()}
            best = min(cost.values())
            assert cost[rows[r.doc_id].lang_pred] <= best * (1 + 1e-5) + 1e-5
            n += 1
    assert n > 20

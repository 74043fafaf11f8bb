"""Plain restatements of what the operators compute, one text or pair at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(hit)}


def fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, tau=2):
    """(doc_id, fp) to doc_id -> smallest doc_id reachable."""
    ids = defaultdict(list)
    for d, f in rows:
        ids[f].append(d)
    prints = list(ids)
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= tau:
                parent[find(a)] = find(b)
    least = {}
    for f in prints:
        r = find(f)
        for d in ids[f]:
            if d is not None:
                least[r] = min(least.get(r, d), d)
    return [(d, f, least.get(find(f))) for d, f in rows]


def substring_dedup(rows, window=50):
    """(doc_id, text) to (doc_id, n_words, n_removed, kept words)."""
    key = lambda d: (d is None, d or 0)
    first = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g not in first or key(d) < key(first[g]):
                first[g] = d
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if key(first[tuple(w[i : i + window])]) < key(d):
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), " ".join(kept)))
    return out


def token_rows(rows, tokenizer, end=1):
    """(doc_id, text) in order to (doc_id, start, n_tokens, crc)."""
    import struct

    out, start = [], 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def normal_tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaks(docs, items, size=5, share=0.8):
    """(doc_id, item_id) where the document has that share of the item's shingles."""
    found = set()
    where = defaultdict(set)
    count = {}
    for i, t in items:
        w = normal_tokens(t)
        own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        count[i] = len(own)
        for s in own:
            where[s].add(i)
    for d, t in docs:
        w = normal_tokens(t)
        seen = Counter(i for s in {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for i in where.get(s, ()))
        found |= {(d, i) for i, n in seen.items() if n >= share * count[i]}
    return found

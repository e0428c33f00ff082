import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from mileglass.llm import simhash as S
from mileglass.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_print(text, shingle=3):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(len(w) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits=3):
    """Root index of each value by plain search."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_quads_meet_any_five_bytes():
    from itertools import combinations
    assert len(S.QUADS) == 14
    assert all(any(set(q) <= set(five) for q in S.QUADS) for five in combinations(range(8), 5))


def test_fingerprints(odd_texts, texts):
    for t in odd_texts + [t for _, t in texts[:40]]:
        assert S.fingerprint_bits(None if t is None else t.encode()) == plain_print(t)


@pytest.mark.parametrize("n", [40, 900])
def test_forest(n):
    rng = random.Random(n)
    values = list({rng.getrandbits(16) << 20 for _ in range(n)})
    got = S.forest(np.array(values, dtype="<u8"), 3)
    want = brute_components(values)
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def near_values(rng):
    out = set()
    for size in (1, 1, 2, 5, 40, 200):
        start = rng.getrandbits(64)
        group = [start]
        while len(group) < size:
            v = rng.choice(group) if size < 100 else start
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            group.append(v)
        out |= set(group)
    base = rng.getrandbits(64)  # two bytes busy: long postings whose members are close
    out |= {base ^ (rng.getrandbits(8) << 24) ^ (rng.getrandbits(4) << 3) for _ in range(300)}
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_give_the_components(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "SHORT_POSTING", 16)
    values = near_values(random.Random(seed))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = S.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    roots = {r.node: r.root for r in components(links).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for i, (v, w) in enumerate(zip(signed, brute_components(values))):
        groups[roots.get(v, v)].add(i)
        want[w].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}


def test_documents(spark, texts, odd_texts):
    docs = texts[:80] + [(1000 + i, t) for i, t in enumerate(odd_texts)] + [(None, "a"), (None, "only here"), (5, texts[5][1])]
    got = S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    prints = [plain_print(t) for _, t in docs]
    root = brute_components(prints)
    least = defaultdict(list)
    for (i, _), r in zip(docs, root):
        if i is not None:
            least[r].append(i)
    want = [(i, p - (1 << 64) if p >> 63 else p, min(least[r], default=None)) for (i, _), p, r in zip(docs, prints, root)]
    assert sorted(map(repr, ((r.doc_id, r.fp, r.component_id) for r in got))) == sorted(map(repr, want))


def test_keep_one(spark):
    rows = [(2, "same words here", 1), (1, "Same words here", 2), (1, "Same words here", 2), (3, "other text", None),
            (None, None, 1), (None, "", 1), (None, None, 1)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp int"))
    assert kept.columns == ["doc_id", "text", "fp"]
    got = sorted(map(repr, map(tuple, kept.collect())))
    assert got[:2] == ["(1, 'Same words here', 2)", "(3, 'other text', None)"] and len(got) == 3


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0

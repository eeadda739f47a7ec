import random

import numpy as np
import pytest
import xxhash

from strandlake.llm import simhash
from strandlake.llm.common import connected_components


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    return [(doc, prints[i], names.get(find(i))) for i, (doc, _) in enumerate(rows)]


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (None, "only this one has no id"), (1003, "one"), (1004, "One two"), (1005, "one two")]
    for group in range(12):
        words = [rng.choice(vocab) for _ in range(300)]
        for k in range(rng.choice([1, 2, 30])):
            copy = list(words)
            for _ in range(k % 4):
                copy[rng.randrange(300)] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 997, " ".join(copy)))
    rows += rows[-3:] + [(5000, "long " * 50_000), (5001, "Ünï " * 10)]
    return rows


@pytest.mark.parametrize("block", [8, 4096])
def test_components_match_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component").repartition(5)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(df, block=block).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


def test_every_pair_within_three_bits_meets():
    rng = np.random.default_rng(2)
    for _ in range(500):
        a = rng.integers(0, 2**63, dtype=np.uint64)
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= np.uint64(1 << int(bit))
        key_a, _, index_a = simhash.keys_of(np.array([a]))
        key_b, _, index_b = simhash.keys_of(np.array([b]))
        assert set(key_a[index_a]) & set(key_b) and set(key_b[index_b]) & set(key_a)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (200, 150), (150, 175)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 150: 150, 175: 150, 200: 150}


def test_keep_one_of_each_component(spark):
    rows = [*corpus(), (None, "a text of nobody else at all"), (None, "a text of nobody else at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'z' as class", "2 as _id")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    components = {(c, p if c is None else None) for _, p, c in brute_components(rows)}
    named = {c for _, _, c in brute_components(rows) if c is not None}
    assert {i for i, _ in got if i is not None} == named and len(got) == len(components)
    assert set(got) <= set(rows)


def test_hubs_are_joined_apart(spark, monkeypatch):
    """Stars and paths with the limits so low that most centres are hubs."""
    from strandlake.llm import common

    monkeypatch.setattr(common, "PLAIN", 4)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(200 + i % 3, 300 + i) for i in range(40)] + [(200, 201)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {i: 0 for i in range(60)} | {i: 100 for i in range(100, 131)} | {n: 202 if n >= 300 and (n - 300) % 3 == 2 or n == 202 else 200 for n in [200, 201, 202, *range(300, 340)]}
    assert got == want

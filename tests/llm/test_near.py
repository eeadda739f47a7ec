import random

import pytest

import corpus_pipeline
from strandlake.llm import near


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] == sets[j] or (union and len(sets[i] & sets[j]) / union >= 0.8):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(min(g) for g in groups.values())


def edited(words, rng, vocab, edits):
    copy = list(words)
    for at in rng.sample(range(len(copy)), edits):
        copy[at] = rng.choice(vocab)
    return " ".join(copy)


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "One"), (5005, "one two")]
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([40, 200, 400]))]
        for edits in (0, 1, 2, 4, 8, 12):
            rows.append((len(rows), edited(words, rng, vocab, min(edits, len(words) // 8))))
    base = [rng.choice(vocab) for _ in range(300)]
    rows += [(len(rows) + k, edited(base, rng, vocab, k % 14)) for k in range(150)]
    return rows


def test_stage_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as key", "3 as class").repartition(5)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def chains(seed=6):
    """A base's copies, most too far from one another to link: the base is not the smallest set of its keys."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(3):
        base = [rng.choice(vocab) for _ in range(150)]
        copy = list(base)
        for k in range(60):
            rows.append((len(rows), edited(base if k % 2 else copy, rng, vocab, 2 + k % 4)))
            if k % 7 == 0:
                copy = rows[-1][1].split()
    return rows


@pytest.mark.parametrize("run_bytes", [near.RUN_BYTES, 6000])
def test_large_groups_in_runs_and_grids(spark, run_bytes):
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in near.keep_one(df, run_bytes=run_bytes).collect()) == brute_kept(rows)


def test_pairs_of_the_least_similarity_meet():
    rng = random.Random(3)
    missed = 0
    for _ in range(300):
        shared, own = [rng.getrandbits(64) for _ in range(80)], [rng.getrandbits(64) for _ in range(20)]
        a, b = (near.band_keys(near.np.array(sorted(shared + part), "u8")) for part in (own[:10], own[10:]))
        missed += not (a == b).any()
    assert missed == 0


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, text), (7, text + " end"), (None, "nobody else has this")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.text) for r in near.keep_one(df).collect()))) == sorted(map(str, [(7, text + " end"), (None, "nobody else has this")]))
    assert near.keep_one(df.limit(0)).count() == 0

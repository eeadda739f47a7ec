import random
import zlib

from strandlake.llm import quality


def corpus(n=600):
    rng = random.Random(3)
    words = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(80)]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(60))
        good = i % 4 > 0
        if not good:
            text = {0: text.upper(), 4: " ".join(w + "%%%" for w in text.split()), 8: " ".join([text.split()[0]] * 60)}[i % 12]
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (None, "x"), (9001, None), (9002, ""), (9003, "word " * 100_000)], "doc_id long, text string").selectExpr("*", "1 as score")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (9001, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, lab)
    got = {r.doc_id: r.score for r in quality.classify(d, model).collect()}
    assert len(got) == len(docs) + 4 and all(0 <= s <= 1 for s in got.values())
    held = [(i, good) for i, good, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= quality.THRESHOLD) == bool(good) for i, good in held) / len(held)
    assert len(held) > 100 and right > 0.95
    kept = {r.doc_id for r in quality.keep_good(d, model).collect()}
    assert kept == {i for i, s in got.items() if s >= quality.THRESHOLD}


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - g if zlib.crc32(str(i).encode()) % 4 == 2 else g, t) for i, g, t in labels]
    scores = [{r.doc_id: r.score for r in quality.classify(d, quality.fit(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int"))).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_without_usable_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(d, quality.fit(d, none)).first().score == 0.5
    assert quality.classify(d.limit(0), quality.fit(d.limit(0), none)).count() == 0


def test_string_ids_and_repeated_ids(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string")
    lab = spark.createDataFrame([(f"d{i}", g) for i, g, _ in labels], "doc_id string, quality int")
    many = d.unionAll(d).unionAll(d)
    a, b = quality.fit(d, lab), quality.fit(many, lab.unionAll(lab))
    assert {(r.doc_id, r.score) for r in quality.classify(d, a).collect()} == {(r.doc_id, r.score) for r in quality.classify(d, b).collect()}

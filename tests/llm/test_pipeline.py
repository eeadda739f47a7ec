import random

import corpus_pipeline
from strandlake.llm import simhash


def write_tables(spark, folder):
    rng = random.Random(2)
    words = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "a", "er"]) for _ in range(300)]
    docs, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60, 200)))
        bad, toxic = i % 6 == 0, i % 6 == 1
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        if toxic:
            text += " idiot scum worthless"
        docs.append((i, text, "en", f"src{i % 5}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000 + k, docs[2][1], "en", "src1", 0) for k in range(5)]
    docs += [(2000, docs[3][1] + " changed", "en", "src1", 0), (2001, docs[4][1] + " secret: 0123456789abcdefX", "en", "src2", 0), (None, docs[8][1], None, None, None), (2002, None, "en", "src0", 0), (2003, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = {d[0]: d for d in write_tables(spark, folder)}
    source = spark.read.parquet(f"{folder}/documents.parquet")
    frames, names = [source], [name for name, _ in corpus_pipeline.STAGES]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], folder).write.parquet(f"{folder}/stage{k}")
        frames.append(spark.read.parquet(f"{folder}/stage{k}"))
    assert len(names) == 5 and all(f.columns == source.columns for f in frames[:-1])
    kept = {r.doc_id for r in frames[1].collect()}
    clean = {i for i in range(300) if i % 6}
    assert len(clean - kept) <= 2 and len({i for i in range(0, 300, 6)} & kept) <= 2
    after = [r.doc_id for r in frames[2].collect()]
    want = {r.doc_id for r in simhash.near_duplicates(frames[1]).where("doc_id = component").collect()}
    assert set(after) == want and len(after) == len(want) and 2 in want and not want & {1000, 1001, None}
    texts = {r.doc_id: r.text for r in frames[3].collect()}
    assert set(texts) == want
    for i, text in texts.items():
        if i == 2001:
            assert "[SECRET]" in text and "0123456789abcdefX" not in text
        else:
            assert text == docs[i][1]
    mixed = [r.doc_id for r in frames[4].collect()]
    assert set(mixed) <= want and len({i for i in clean & want if i % 6 > 1} - set(mixed)) <= 5
    assert sum(i is not None and i % 6 == 1 and i < 300 for i in mixed) < 45
    assert frames[5].count() == len(mixed) and frames[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.run(spark, folder).count() == len(mixed)

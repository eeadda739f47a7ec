import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import repetition

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    covered = {}
    for n in (3, 5, 7, 10):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(n)}
        covered[n] = hit
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    failed = len(words) < 50 or 100 * len(covered[3]) > 50 * len(words)
    share = {n: sum(len(words[i]) for i in hit) / chars if chars else 0 for n, hit in covered.items()}
    dup = sum(len(x) for x in lines if lines.count(x) > 1)
    line_share = dup / sum(map(len, lines)) if "\n" in text and lines else 0
    kept = not failed and line_share <= repetition.LINE_LIMIT and all(share[n] <= m for n, m in repetition.COVERAGE_LIMITS.items())
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered[3]), failed, kept)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bé", "c#", "\n", "\x1c", " ", "a b c d e f g h i j k", "漢 字 x"]), max_size=120).map(" ".join))
def test_measures_match_brute_force(text):
    assert repetition.measure(text)[:7] == brute(text)


def test_collisions_fall_back(monkeypatch):
    monkeypatch.setattr(repetition, "_mix", lambda x: x.astype("uint64") * 0)
    text = "a b c d e f g a b c x y z " * 3
    assert repetition.measure(text)[:7] == brute(text)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "x " * 60), (3, "word" * 100_000), (3, "word" * 100_000), (4, " ".join(f"w{i}" for i in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as kept", "1 as n_words")
    got = sorted((tuple(r)[:8] for r in repetition.repetition_rules(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert repetition.repetition_rules(df.limit(0)).count() == 0

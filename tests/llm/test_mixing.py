import random

import numpy as np
import pytest

from strandlake.llm import mixing


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120)))
        kind = i % 8
        if kind == 0:
            text = " ".join(w + "##" for w in text.split())
        elif kind == 1:
            text += " idiot scum"
        docs.append((i, text, "x"))
        if i % 3 == 0:
            labels.append((i, int(kind != 0), int(kind == 1)))
    docs += [(900, None, None), (901, "", None), (None, "w1 w2", "y"), docs[5], docs[5], (902, "w1 " * 100_000, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, rate string").selectExpr("*", "1 as _tokens", "2 as row"),
        spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"),
        len(docs),
    )


def test_rates_meet_targets(tables):
    docs, labels, n = tables
    shares = {"clean": 0.6, "toxic": 0.1, "low": 0.3}
    rows = mixing.rates(docs, labels, lambda names: mixing.share_targets(shares, names)).collect()
    assert len(rows) == n
    p = np.array([[r.p_clean, r.p_toxic, r.p_low] for r in rows])
    tokens, rate = np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    assert np.allclose((rate * tokens) @ p / tokens.sum(), list(shares.values()), atol=1e-5)
    by = {r.doc_id: r for r in rows}
    assert by[900].n_tokens == by[901].n_tokens == 0 and by[900].rate == by[901].rate and by[902].n_tokens == 100_000
    right = [max(("clean", "toxic", "low"), key=lambda k: by[i][f"p_{k}"]) == ("low" if i % 8 == 0 else "toxic" if i % 8 == 1 else "clean") for i in range(400)]
    assert sum(right) > 380 and {r.target_gap <= 1e-6 for r in rows} == {True}


def test_two_labelled_documents_of_a_domain(spark, tables):
    """A tiny domain's target is met, or the gap is told."""
    docs, labels, _ = tables
    few = labels.where("quality = 1").unionAll(labels.where("quality = 0 and doc_id is not null").orderBy("doc_id").limit(2))
    shares = {"clean": 0.6, "toxic": 0.1, "low": 0.3}
    rows = mixing.rates(docs, few, lambda names: mixing.share_targets(shares, names)).collect()
    p = np.array([[r.p_clean, r.p_toxic, r.p_low] for r in rows])
    tokens, rate = np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    gap = np.abs((rate * tokens) @ p / tokens.sum() - list(shares.values())).max()
    assert rows[0].target_gap == pytest.approx(gap, abs=1e-6) and gap <= 1e-5


def test_repeated_ids_fit_one_text(spark, tables):
    docs, labels, _ = tables
    many = docs
    for _ in range(3):
        many = many.unionAll(many)
    a, b = mixing.fit_classifier(docs, labels), mixing.fit_classifier(many, labels.unionAll(labels))
    assert a.weights == b.weights and a.prior == b.prior


def test_projection_handles_unreachable_targets(tables):
    docs, labels, _ = tables
    rows = mixing.rates(docs, labels, lambda names: lambda totals: [sum(totals), 0.0, 0.0]).collect()
    assert all(r.rate >= 0 for r in rows)
    p = np.array([[r.p_clean, r.p_toxic, r.p_low] for r in rows])
    tokens, rate = np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    shares = (rate * tokens) @ p / tokens.sum()
    assert abs(shares[0] - 1) < 0.1 and shares[1:].max() < 0.06
    # What is left of the targets stands in every row.
    assert len({r.target_gap for r in rows}) == 1 and rows[0].target_gap == pytest.approx(np.abs(shares - np.array([1, 0, 0])).max(), abs=1e-6) and rows[0].target_gap > mixing.TOLERANCE


def test_resample_keeps_columns(tables):
    docs, labels, n = tables
    same = mixing.resample(docs, labels, lambda names: mixing.factor_targets(dict.fromkeys(names, 1.0), names))
    assert same.columns == docs.columns and same.count() == n
    double = mixing.resample(docs, labels, lambda names: mixing.factor_targets(dict.fromkeys(names, 2.0), names))
    assert double.count() == pytest.approx(2 * n, abs=8)


def test_empty_tables(spark, tables):
    docs, labels, _ = tables
    target = lambda names: mixing.share_targets({"clean": 1, "toxic": 1, "low": 1}, names)
    assert mixing.rates(docs.limit(0), labels, target).count() == 0
    rows = mixing.rates(docs.limit(5), labels.limit(0), target).collect()
    assert len(rows) == 5 and all(abs(r.p_low - 1 / 3) < 1e-9 for r in rows)


def test_native_plan(tables):
    docs, labels, _ = tables
    plan = mixing._scored(docs, mixing.fit_classifier(docs, labels), "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def made_up(spark, toxic, low, n=2000):
    """Posteriors of n documents of 100 tokens, of which `toxic` and `low` are of these domains."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        noise = [rng.uniform(0, 2e-4), rng.uniform(0, 2e-4)]
        noise = [0.98, noise[1]] if i < toxic else [noise[0], 0.97] if i < toxic + low else noise
        rows.append((100, 1 - sum(noise), *noise))
    return spark.createDataFrame(rows, "_tokens long, _p0 double, _p1 double, _p2 double")


@pytest.mark.parametrize(("toxic", "low"), [(8, 1), (16, 1), (16, 300), (8, 0)])
def test_tiny_domains_keep_their_targets(spark, toxic, low):
    scored = made_up(spark, toxic, low)
    names = ["clean", "toxic", "low"]
    p = [mixing.F.col(f"_p{k}") for k in range(3)]
    given = [mixing.share_targets({"clean": 0.85, "toxic": 0.05, "low": 0.10}, names)] * bool(low) + [mixing.factor_targets({"clean": 1.1, "toxic": 0.3, "low": 1.1}, names)]
    for targets in given:
        rows = scored.withColumn("rate", mixing.rate_column(p, mixing.fit_rates(scored, targets).steps)).collect()
        post, rate = np.array([r[1:4] for r in rows]), np.array([r.rate for r in rows])
        wanted = targets((100 * post).sum(axis=0).tolist())
        assert (rate >= 0).all() and np.allclose(100 * rate @ post, wanted, rtol=0, atol=1e-6 * sum(wanted))

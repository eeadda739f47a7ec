import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import licences

ROWS = [
    (1, "Plain words of a story.\nReleased under the MIT License.\nMore words here."),
    (2, "Intro\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation.\n\nEnd."),
    (3, "The driver's license was lost. She is a licensed engineer and the library is public."),
    (4, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
    (5, None),
    (6, ""),
    (None, "Licensed under CC BY-SA 4.0."),
    (7, "word " * 100_000 + ".\nThis library is licensed under the GNU Lesser General Public License."),
    (7, "Licensed under CC BY 4.0."),
    (8, "here ends the tale; licensed under the mozilla public license 2.0 since then"),
    *((100 + i, f"Ordinary paragraph number {i} tells about rivers, stones and the long way home.\nNothing to see.") for i in range(40)),
]


_model: list = []


def model_():
    if not _model:
        _model.append(licences.fit())
    return _model[0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as families", "2 as h", "3 as lines")


def test_families_and_spans(docs):
    model = model_()
    got = {(r.doc_id, r.families): r for r in licences.scan(docs, model).collect()}
    assert len(got) == len(ROWS)
    for key in [(1, "mit"), (2, "gpl"), (3, ""), (4, "apache,cc-by-nc"), (5, ""), (6, ""), (None, "cc-by-sa"), (7, "lgpl"), (7, "cc-by"), (8, "mpl"), (120, "")]:
        assert key in got, key
    assert all(r.families == "" for k, r in got.items() if k[0] and k[0] >= 100)
    assert got[1, "mit"].spans == "mit:24:54" and got[2, "gpl"].n_notices == 1


def test_held_out_wordings(docs):
    model = model_()
    for text, family in [("You may use this under the Apache License, Version 2.0", "apache"), ("it is released under the MIT License today", "mit"), ("All rights reserved. No part may be reproduced without prior written permission of the house", "proprietary")]:
        assert (model.classify(text) or ("",))[0] == family
    assert model.classify("The public license office is closed on Monday.") is None


def test_paragraphs_cover_all_words():
    for _, text in ROWS:
        covered = "".join((text or "")[s:e] for s, e in licences.paragraphs(text))
        assert covered.replace("\n", "").split() == (text or "").replace("\n", "").split() or covered.split() == (text or "").split()


def test_empty(docs):
    assert licences.scan(docs.limit(0), licences.fit()).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the MIT License or the Apache License, Version 2.0", {"apache", "mit"}),
        ("some running text " * 40 + "licensed under the Apache License, Version 2.0 and then " + "more words of a tale " * 40 + "released under the MIT License " + "to its end " * 200, {"apache", "mit"}),
        ("Released under the MIT License. \nLicensed under CC BY-NC 4.0.\t\nPlain words", {"mit", "cc-by-nc"}),
        ("Released under the MIT License.\r\nLicensed under CC BY-SA 4.0.\r\nPlain words\r\n", {"mit", "cc-by-sa"}),
        ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", {"mit", "apache"}),
    ],
)
def test_every_family_of_a_paragraph(docs, text, want):
    assert {f for f, *_ in licences.scan_text(text, model_())} == want


def test_one_notice_is_one_family(docs):
    model = model_()
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            assert {f for f, *_ in licences.scan_text(t, model)} <= {family}, t


def test_lines_end_before_trailing_blanks():
    text = "One ends here. \nTwo ends here.\r\nThree goes on\r\nto its end.\r\n"
    assert [text[s:e].split() for s, e in licences.paragraphs(text)] == [["One", "ends", "here."], ["Two", "ends", "here."], ["Three", "goes", "on", "to", "its", "end."]]


def test_spans_are_the_notices():
    text = "a tale of the river " * 30 + "it was licensed under the Apache License, Version 2.0, and later " + "went on its way " * 30 + "released under the MIT License " + "to its end " * 20
    got = {f: text[s:e] for f, s, e, _ in licences.scan_text(text, model_())}
    assert got.keys() == {"apache", "mit"} and got["mit"].lower() == "released under the mit license"
    assert got["apache"].startswith("licensed under") and got["apache"].endswith("Version 2.0")
    odd = "İİ İ. Released under the MIT License. İ"
    assert [odd[s:e] for _, s, e, _ in licences.scan_text(odd, model_())] == ["Released under the MIT License"]


def test_unseen_wordings_by_leaving_templates_out():
    """Fitted without a third of the templates and look-alikes, the classifier knows most damaged copies of those."""
    examples = licences._examples(5)
    right = n = wrong = m = 0
    for fold in range(licences.FOLDS):
        test = examples.sources % licences.FOLDS == fold
        model = licences._untrained(examples, ~test)
        kept = [w for w, t in zip(examples.words, test, strict=True) if not t]
        model.weights = licences._regression(licences._matrix(model, kept), examples.classes[~test], len(model.families), licences.FOLD_STEPS)
        best = (licences._matrix(model, [w for w, t in zip(examples.words, test, strict=True) if t]) @ model.weights).argmax(axis=1)
        y = examples.classes[test]
        known = y < len(licences.TEMPLATES)
        right, n = right + (best[known] == y[known]).sum(), n + known.sum()
        wrong, m = wrong + (best[~known] != y[~known]).sum(), m + (~known).sum()
    assert right / n > 0.7 and wrong / m < 0.1, (right / n, wrong / m)


def brute_paragraphs(text):
    """Joined lines: a paragraph ends at an empty line or a line whose last letter closes a sentence."""
    out, at, run = [], 0, []
    for line in (text or "").split("\n"):
        if not line.strip():
            out, run = out + [run] * bool(run), []
        else:
            run = [*run, line]
            if line.rstrip()[-1] in ".!?:;":
                out, run = [*out, run], []
        at += len(line) + 1
    return ["\n".join(r) for r in out + [run] * bool(run)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B c", ".", "!", ":", ";", "\n", "\n\n", " ", "\t", "\r\n", "é", "(x)"]), max_size=30).map("".join))
def test_paragraphs_match_brute_force(text):
    assert [text[s:e] for s, e in licences.paragraphs(text)] == brute_paragraphs(text)


def test_queries_rows_match_plain_scans(spark):
    """The query over a small table against scan_text() on each row."""
    from strandlake.llm import q_licences

    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path := licences_path(spark))
    got = {r.doc_id: (r.n_notices, r.families, r.spans) for r in q_licences.op6_licences(spark, path.rsplit("/", 1)[0]).collect()}
    for i, t in rows:
        found = licences.scan_text(t, model_())
        assert got[i] == (len(found), ",".join(sorted({f for f, *_ in found})), ",".join(f"{f}:{s}:{e}" for f, s, e, _ in found))


def licences_path(spark):
    from strandlake.llm.common import fresh_path

    return fresh_path(spark, "licences") + "/documents.parquet"

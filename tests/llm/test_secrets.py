import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import secrets

HEX40 = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
COPIED = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
LIVE = "Zx9Q2mLr7TtYw4Kp8sVb3NcA"


def brute_base(text):
    text = text or ""
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    assign = [m for m in re.finditer(r"(" + name + r""")["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 8]
    access = [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    hexes = [m for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    spans = sorted((m.start(), k, m.end()) for k, group in enumerate((assign, access, hexes)) for m in group)
    joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return (len(assign), len(access), len(hexes), hashlib.sha256(joined.encode()).hexdigest()), joined


PIECES = ["token", "API_KEY", "apikey", "paſsword", "Secret", "passwd", "=", ":", " ", '"', "'", "abc12345", HEX40, HEX40[:31], "AKIA", "AKIA" + "A1" * 8, "é", "\n", ".", "f"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_matches_brute_force(text):
    found = [c for c in secrets.find(text) if c[1] < 3]
    (a, b, c, digest), joined = brute_base(text)
    assert ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in found) == joined
    assert [sum(x[1] == k for x in found) for k in range(3)] == [a, b, c]


def rows():
    out = [(i, f'token = "{COPIED}" and {LIVE[::-1]}', "en", f"src{i}") for i in range(6)]
    out += [(10, f"my {LIVE} here é {HEX40}", "en", "src1"), (None, "password: hunter2hunter2", "en", None), (11, None, "en", "src1"), (11, "", None, "src1")]
    return [*out, out[0], (12, "word " * 100_000 + f"secret={HEX40}", "en", "src9")]


def test_report_and_ownership(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").selectExpr("*", "1 as found", "2 as examples", "3 as held").repartition(3)
    got = sorted((tuple(r) for r in secrets.report(secrets.scan(docs)).collect()), key=str)
    want = []
    for doc_id, text, _, _ in rows():
        counts, joined = brute_base(text)
        if doc_id == 10:
            joined = f"live:3:{3 + len(LIVE)},{joined}"
        want.append((doc_id, *counts, joined, 2 if COPIED in (text or "") else 0))
    assert got == sorted(want, key=str)
    assert secrets.report(secrets.scan(docs.limit(0))).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").selectExpr("*", "3 as held")
    got = secrets.redact(docs)
    assert got.columns == docs.columns and got.count() == len(rows())
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[10] == "my [SECRET] here é [SECRET]" and COPIED in texts[3] and texts[None] == "password: [SECRET]"
    assert texts[12].endswith("secret=[SECRET]") and len(texts[12]) == 500_000 + len("secret=[SECRET]")


PARTS = ["password = ", "token:", "abc-", HEX40, HEX40[:33] + "_", LIVE, "AKIA" + "Q7" * 9, " ", "\n", "é", "-", "=", "xoxb-1234567890-abcdefghij", "secret=AKIA" + "B2" * 9]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_masks_are_the_union_of_values(text):
    """Against a mask per character: nested, overlapping, touching and repeated values."""
    spans = [(c["from"], c["end"]) for c in secrets.candidates(text)]
    hidden = [any(s <= i < e for s, e in spans) for i in range(len(text))]
    want = "".join(c if not h else "[SECRET]" if i == 0 or not hidden[i - 1] else "" for i, (c, h) in enumerate(zip(text, hidden, strict=True)))
    assert secrets.masked(text, spans, "[SECRET]") == want


def test_redact_nested_and_repeated(spark):
    nested = "password = abc-0123456789abcdef0123456789abcdef"
    rows = [(1, nested, "en", "a"), (2, f"{nested} {nested}", "en", "a"), (3, "token=" + "k" * 40 + HEX40, "en", "b"), (4, None, "en", "b")]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {1: "password = [SECRET]", 2: "password = [SECRET] password = [SECRET]", 3: "token=[SECRET]", 4: None}

import unicodedata as ud

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import lookalike as L

CORPUS = "\u0435 The old café of the ﬁne house; ½ m² and m2, 0O oо оaа. ｔｈｅ​  　­ Ελένη Осторожный é ガ ガ"


def table():
    counts = {}
    for c in CORPUS * 3 + "aeo fi " * 50:
        counts[c] = counts.get(c, 0) + 1
    return L.representatives(counts)


def test_alike_and_not():
    r = L.Rewriter(table())
    for a, b in [("the", "ｔｈｅ"), ("café", "café"), ("café", "cafе́"), ("fine", "ﬁne"), ("a b", "a b"), ("a b", "a　b"), ("house", "ho​use"), ("house", "ho­use"), ("oo", "oо"), ("ガ", "ガ")]:
        assert r(a) == r(b), (a, b)
    for a, b in [("m²", "m2"), ("½", "1"), ("0", "O"), ("l", "1"), ("a b", "a  b"), ("a b", "a\nb"), ("rn", "m")]:
        assert r(a) != r(b), (a, b)
    assert r(None) is None and r("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=CORPUS + "xyz\n", max_size=12))
def test_rewriting_is_stable(t):
    r = L.Rewriter(table())
    once = r(t)
    assert r(once) == once
    assert r(ud.normalize("NFD", t)) == once


def test_rewriting_goes_on_until_nothing_changes():
    """Rewritten parts that make new ones, more than four times over; forms that lead to each other."""
    assert L.Rewriter({"ba": "ab"})("bbbbbbbba") == "abbbbbbbb"
    r = L.Rewriter({"x": "y", "y": "x"})
    assert r("x") == r("y") == r(r("x"))


def test_letters_of_other_scripts():
    r = L.Rewriter(L.representatives(dict.fromkeys("aɑoοоօOՕngɡ", 1) | dict.fromkeys("aogO", 50)))
    assert r("ɑօɡՕ") == "aogO" and r("ο") == r("о") == "o"


def test_pairs(spark):
    rows = [(1, [("b", "the"), ("a", "ｔｈｅ"), ("c", "tho")]), (1, [("b", "the"), ("a", "ｔｈｅ")]), (2, [("a", "x"), ("b", None), (None, "x")]), (3, None), (4, []), (5, [("a", "m²"), ("b", "m2")]), (6, [("a", "same"), ("b", "same")]), (7, [("a", ""), ("b", "​")])]
    df = spark.createDataFrame([(k, e, "clash", 1) for k, e in rows], "aligned_key long, engine_texts array<struct<engine:string,text:string>>, engine_a string, text int")
    got = sorted((r.aligned_key, r.engine_a, r.engine_b) for r in L.lookalike_pairs(df).collect())
    assert got == [(1, "a", "b"), (1, "a", "b"), (7, "a", "b")]
    assert L.lookalike_pairs(df.limit(0)).count() == 0

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import splitting as S

DOC = "---\ntitle: x\n---\n\n# One\ntext\n\n---\n\n<!-- a\n## no\n -->\n```\n# no\n---\n```\n$$\n# no\n$$\n#3 no\n~~~\n## no\n~~~\n####### no\n## Two\n-----\n###### Six\n"


def test_boundaries():
    got = [(DOC[p : DOC.index("\n", p)], k) for p, k in S.boundaries(DOC)]
    assert got == [("# One", "heading"), ("---", "page"), ("## Two", "heading"), ("###### Six", "heading")]
    assert S.boundaries("---\n\ntext\n---\n") == [(0, "page"), (10, "page")]
    assert S.boundaries("") == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["---\n", "# h\n", "\n", "word word. Next one\n", "x" * 70 + "\n", "```\n", "$$\n"]), max_size=60), st.integers(30, 90), st.integers(0, 20))
def test_pieces_cover_the_text(parts, limit, overlap):
    text = "".join(parts)
    got = S.cut(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in got)
    rebuilt, at = "", 0
    for a, b, _ in got:
        assert a == max(0, at - overlap)
        rebuilt += text[at:b]
        at = b
    assert rebuilt == text


def test_cut_is_the_cheapest():
    text = "".join(f"line number {i} of it\n" + ("\n---\n\n" if i % 7 == 6 else "") for i in range(30))
    kinds = [k for _, _, k in S.cut(text, 200, 20)][:-1]
    assert set(kinds) == {"page"}


def test_queries(spark):
    rows = [(1, "x" * 3000), (2, "# a\n" + "y " * 2000), (2, "# a\n" + "y " * 2000), (3, None), (4, ""), (5, "z" * 9000)]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "result_key long, markdown string, char_pos int")
    assert sorted(map(tuple, S.boundary_positions(df).collect())) == [(2, 0), (2, 0)]
    got = S.pieces(df).toPandas()
    assert got.groupby("result_key").size().to_dict() == {1: 1, 2: 4, 5: 4}
    assert got.piece.str.len().max() <= 3000 and S.pieces(df.limit(0)).count() == 0


def test_boundaries_come_from_the_cutting(spark):
    """Both queries read one operator, which runs the programme."""
    text = "# a\n" + "y " * 2000 + "\n---\n## b\n" + "z " * 900
    df = spark.createDataFrame([(1, text), (2, "# short")], "result_key long, markdown string")
    (row,) = S.split(df.filter("result_key = 1"), "result_key", "markdown", 3000, 200).collect()
    assert [(p.char_start, p.char_end, p.end_kind) for p in row.pieces] == S.cut(text)
    assert row.boundaries == [p for p, _ in S.boundaries(text)] == sorted(r.char_pos for r in S.boundary_positions(df).collect())

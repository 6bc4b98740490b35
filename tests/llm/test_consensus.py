from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import consensus as C


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the ", "old ", "storm ", "overlooked ", "x\n"]), max_size=7).map("".join), min_size=1, max_size=4))
def test_segments_give_back_every_text(texts):
    parts = C.segments(texts)
    for i, t in enumerate(texts):
        assert "".join(x[i] if len(x) > 1 else x[0] for x in parts) == (t if len(set(texts)) > 1 else texts[0])


SENTENCES = ["The principal storm overlooked the quiet contract", "The old farmer discovered the abundant carriage", "The library of the inspector opened the orphanage"]


def frame(spark, rows):
    return spark.createDataFrame([(k, e, "clash") for k, e in rows], "aligned_key long, engine_texts array<struct<engine:string,text:string>>, consensus_reading string")


def test_held_out_errors(spark):
    """Errors put into known texts: a misread word, a dropped word, a repeated word, also two engines at once."""
    rows, wrong = [], set()
    for k in range(120):
        t = SENTENCES[k % 3]
        e = {"docling": t, "paddleocr": t, "pdfplumber": t}
        if k % 4 == 0:
            e["paddleocr"] = t.replace("the", "tbe", 1)
            wrong.add((k, "paddleocr"))
        elif k % 4 == 1:
            e["docling"] = t.replace("The ", "", 1)
            e["paddleocr"] = t.replace("o", "0", 1)
            wrong |= {(k, "docling"), (k, "paddleocr")}
        elif k % 4 == 2:
            e["pdfplumber"] = t.replace("the ", "the the ", 1)
            wrong.add((k, "pdfplumber"))
        rows.append((k, list(e.items())))
    got = {(r.aligned_key, r.engine) for r in C.wrong_readings(frame(spark, rows)).collect()}
    assert len(got ^ wrong) <= 2
    found, model = C.resolve(frame(spark, rows))
    assert all(r.consensus_reading in SENTENCES and 0.5 < r.agreement <= 1 for r in found.collect())
    assert set(model.competence) == {"docling", "paddleocr", "pdfplumber"} and all(0.8 < c < 1 for c in model.competence.values())
    assert C.reliability(model, found).count() == 3


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [("a", None), ("b", "x"), (None, "x")]), (4, [("a", "x"), ("b", "ｘ"), ("c", "x")]), (5, [("a", ""), ("b", ""), ("c", "")]), (6, [("a", "x y"), ("b", "x y"), ("c", "x")]), (6, [("a", "x y"), ("b", "x y"), ("c", "x")])]
    got = sorted((r.aligned_key, r.engine) for r in C.wrong_readings(frame(spark, rows)).collect())
    assert got == [(6, "c"), (6, "c")]
    found = {r.aligned_key: r.consensus_reading for r in C.resolve(frame(spark, rows))[0].collect()}
    assert found[2] is None and found[3] == "x" and found[5] == "" and found[6] == "x y"
    assert C.wrong_readings(frame(spark, rows).limit(0)).count() == 0


def test_small_regions_count_in_the_model(spark):
    """Three engines read a word in three ways; only regions of two entries tell which is a word."""
    rows = [(k, [("a", "the quick storm"), ("b", "the quick storm")]) for k in range(40)] + [(99, [("a", "the qvick storm"), ("b", "the quiok storm"), ("c", "the quick storm")])]
    got = {(r.aligned_key, r.engine) for r in C.wrong_readings(frame(spark, rows)).collect()}
    assert got == {(99, "a"), (99, "b")}


def test_joined_counts_equal_sent_counts(spark, monkeypatch):
    rows = [(k, [("a", "the quick storm"), ("b", "the quick storm")]) for k in range(40)] + [(99, [("a", "the qvick storm"), ("b", "the quiok storm"), ("c", "the quick storm")]), (98, [("a", "the storm the"), ("b", "storm"), ("c", "")])]
    read = lambda: sorted((r.aligned_key, r.consensus_reading, round(r.agreement, 9), r.wrong_engines) for r in C.resolve(frame(spark, rows))[0].collect())
    want = read()
    monkeypatch.setattr(C, "BOUND", 0)
    assert read() == want and len(want) == 42


def test_frequent_words_have_classes_of_their_own():
    assert C.classes(["a", "b"], [2**25, 2**40], ("", "")) == {"a": (0, 8), "b": (0, 13)}

import numpy as np

from palimpsest.llm import scannoise as N


def test_words_and_numbers():
    assert N.skeletons("througb")[1] == N.skeletons("through")[1] and N.skeletons("modem")[0] == N.skeletons("modern")[0]
    assert N.skeletons("westerri")[0] == N.skeletons("western")[0]
    for x in ("12", "— 61 —", "- 9 -", "[15]", "Page 47 of 56", "p. 3", "xliii", "iv"):
        assert N.is_number(x), x
    for x in ("§ 27", "Item 44.", "No. 12.", "Anno 1866.", "word", "", "48. The late", "Schedule 3"):
        assert not N.is_number(x), x
    assert N.header_key("63   Minutes of Stanwick Bay Council") == N.header_key("MINUTES OF STANWICK BAY COUNCIL")
    assert N.header_key("The ledger refused the ferry") is None and N.header_key("A = b") is None


def frames(spark, texts, pages=None):
    regions = spark.createDataFrame([(i, (pages or {}).get(i, (1, i))[0], (pages or {}).get(i, (1, i))[1], t, "clash") for i, t in enumerate(texts)], "region_key long, doc_id long, page_num long, text_content string, noise_kind string")
    aligned = spark.createDataFrame([(7, 1, 1, None)], "aligned_key long, doc_id long, page_num long, consensus_text string")
    return regions, aligned


BODY = ["The curious surveyor governed the through street before the winter session and the modern library.", "The pre- and post-war records of the long-standing arrangement were through with the surveyor."]


def corpus():
    texts = [BODY[i % 2] for i in range(60)]
    texts += [f"Minutes of Stanwick Council\nThe curious surv-\neyor governed page {i} of the record here.\n{i + 10}" for i in range(20)]
    texts += ["The curious surveyor went throuqh the street.", "He saw the long-\nstanding arrangement in the pre-\nand post-war records", None, ""]
    return texts


def test_noise(spark):
    texts = corpus()
    regions, aligned = frames(spark, texts)
    got = {}
    for r in N.noise(regions, aligned).collect():
        got.setdefault(r.row_key, set()).add((r.noise_kind, r.line_no))
    assert all(got[i] == {("running_header", 0), ("hyphen", 1), ("page_number", 3)} for i in range(60, 80))
    assert got[80] == {("misread", 0)} and 81 not in got and not any(i in got for i in range(60))
    paragraphs = {(r.row_key, r.paragraph_no): r.paragraph for r in N.repaired(regions, aligned).collect()}
    assert paragraphs[60, 0] == "The curious surveyor governed page 0 of the record here." and paragraphs[80, 0].endswith("through the street.")
    empty = frames(spark, ["x"])
    assert N.noise(empty[0].limit(0), empty[1].limit(0)).count() == 0


def test_joined_lookup_equals_sent_lookup(spark, monkeypatch):
    regions, aligned = frames(spark, corpus())
    want = sorted(map(tuple, N.noise(regions, aligned).collect()))
    monkeypatch.setattr(N, "BOUND", 0)
    assert sorted(map(tuple, N.noise(regions, aligned).collect())) == want


def test_hidden_markov_model_sums_to_one():
    seq = np.array([[(1, 1, 0, 0, 3, 0), (3, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 2), (2, 0, 1, 0, 0, 0)]])
    post, moves = N.Layout().expect(seq)
    assert np.allclose(post.sum(axis=2), 1) and np.isclose(moves.sum(), 3)
    assert N.Layout().labels(["110030 300000 300002 201000", "000002"]) == {"110030 300000 300002 201000": [N.HEADER, N.BODY, N.BREAK, N.NUMBER], "000002": [N.BREAK]}


def test_near_keys_joined_equal_near_keys_sent(spark, monkeypatch):
    keys, strong = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (["abcd", "abcx", "abxd", "zzz", "bcd", "ac"], ["abc", "abcde", "abed"]))
    want = sorted(map(tuple, N.near_ones(keys, strong).collect()))
    assert want == [("abcd", "abc"), ("abcx", "abc"), ("abxd", "abed"), ("ac", "abc"), ("bcd", "abc")]
    monkeypatch.setattr(N, "BOUND", 0)
    assert sorted(map(tuple, N.near_ones(keys, strong).collect())) == want


def test_lines_of_any_length(spark):
    """A running header of more than 90 characters, one with a year and a volume, and a number in wide decorations."""
    long = "MINUTES OF THE HONOURABLE COUNCIL OF THE BOROUGH OF STANWICK BAY AND OF THE PARISHES ADJOINING TO IT"
    assert len(long) > 90 and N.header_key(long) and N.header_key("Minutes of Stanwick Council 1866 to 1871")
    assert N.is_number("*" * 20 + " Page   112   of   240 " + "*" * 20) and N.is_number("lxxxviii") and not N.is_number("12 of the parishes that are in the borough")
    texts = [f"{long}\nThe curious surveyor governed page {i} of the\nrecord here." for i in range(20)] + [BODY[i % 2] for i in range(60)]
    got = {}
    for r in N.noise(*frames(spark, texts)).collect():
        got.setdefault(r.row_key, set()).add((r.noise_kind, r.line_no))
    assert all(got[i] == {("running_header", 0)} for i in range(20)) and len(got) == 20


def test_paragraphs_end_at_breaks(spark):
    text = "The curious surveyor governed the through street before the winter.\nThe modern library went on and on for a long while, and the ending\nwas near.\nThe curious surveyor governed the through street before the winter"
    got = N.repaired(*frames(spark, [text, BODY[0], None])).filter("row_key = 0").orderBy("paragraph_no").collect()
    assert [r.paragraph[-9:] for r in got] == ["was near.", "he winter"]


def test_header_behind_a_roman_number():
    keys = N.Text("xiv   Register of Kelderby\nxiv   register of the town\nvisit Register Of Kelderby").keys
    assert keys == [N.header_key("Register of Kelderby"), None, None] and keys[0]

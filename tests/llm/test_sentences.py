import pytest

from palimpsest.llm import sentences as S

CASES = [
    ("The widow of J. K. Wexcombe paid £30.1 to Mrs. Stone. The U.S. consul left at 5 p.m. The end.", ["The widow of J. K. Wexcombe paid £30.1 to Mrs. Stone.", "The U.S. consul left at 5 p.m.", "The end."]),
    ("“Will you stay?” asked Winter. Marnock replied: “No. Never.” The apprentice left.", ["“Will you stay?” asked Winter.", "Marnock replied: “No. Never.”", "The apprentice left."]),
    ("„Bleibt hier!“, rief Prof. Winter. Am 3. Mai kam er, z. B. im Juni usw. Der Tag.", ["„Bleibt hier!“, rief Prof. Winter.", "Am 3. Mai kam er, z. B. im Juni usw.", "Der Tag."]),
    ("新しい橋を開いた。「待て！」と叫んだ。だれが来たのか？", ["新しい橋を開いた。", "「待て！」と叫んだ。", "だれが来たのか？"]),
    ("林岸说：“地方报纸发现了地图。”市议会在去年冬天检查了大门。", ["林岸说：“地方报纸发现了地图。”", "市议会在去年冬天检查了大门。"]),
    ("बाज़ार के पास खुल गया। क्या वह आया था?", ["बाज़ार के पास खुल गया।", "क्या वह आया था?"]),
    ("التاجر باع الأرض. هل الكاتب فتح الباب؟ نعم!", ["التاجر باع الأرض.", "هل الكاتب فتح الباب؟", "نعم!"]),
    ("ครูเก่าซ่อมแซมสะพานไม้ 15 ฉบับริมแม่น้ำ สภาเมืองบันทึกแผนที่ ", ["ครูเก่าซ่อมแซมสะพานไม้ 15 ฉบับริมแม่น้ำ", "สภาเมืองบันทึกแผนที่"]),
    ("THE OLD HEADLINE\nThe storm closed the\nquiet mill. The ferry\nopened.\n12", ["THE OLD HEADLINE", "The storm closed the\nquiet mill.", "The ferry\nopened.", "12"]),
    ("* * *\n\n---", []),
    ("no terminator at all", ["no terminator at all"]),
]


def ends(spark, rows):
    df = spark.createDataFrame([(i, t, b, "clash", 1) for i, (t, b) in enumerate(rows)], "doc_id long, text string, line_boxes array<struct<x1:int,y1:int,x2:int,y2:int,conf:double>>, k string, end_pos int")
    out = {}
    for r in S.sentence_ends(df).collect():
        out.setdefault(r.doc_id, []).append(r.end_pos)
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def found(spark):
    return ends(spark, [(t, None) for t, _ in CASES])


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    text, want = CASES[i]
    at, positions = 0, []
    for w in want:
        at = text.index(w, at) + len(w)
        positions.append(at - 1)
    assert found.get(i, []) == positions


def test_layout(spark):
    box = lambda x, y, t: (x, y, x + 24 * len(t), y + 40, 0.9)
    left, right = ["The storm closed the old", "mill near the bridge. The", "ferry opened the quiet", "market."], ["A widow governed the new", "estate of the town. It", "closed the annual fair", "again."]
    lines = [x for p in zip(left, right) for x in p]
    boxes = [box(100 if i % 2 == 0 else 1280, 100 + 52 * (i // 2), t) for i, t in enumerate(lines)]
    mixed = [a.ljust(30) + b for a, b in zip(left, right)]
    advert = ["The storm closed the old", "* * *", "LAMP OIL", "Open daily till 9 p.m.", "mill near the bridge."]
    texts = ["\n".join(lines), "\n".join(mixed), "\n".join(advert), None, "", " \n"]
    got = ends(spark, [(texts[0], boxes), (texts[1], None), (texts[2], None), (None, None), ("", []), (" \n", [])])
    upto = lambda t, w: t.index(w) + len(w) - 1
    assert got[0] == sorted(upto(texts[0], w) for w in ("bridge.", "market.", "town.", "again."))
    assert got[1] == sorted(upto(texts[1], w) for w in ("bridge.", "market.", "town.", "again."))
    assert got[2] == [upto(texts[2], w) for w in ("LAMP OIL", "9 p.m.", "bridge.")]
    assert set(got) == {0, 1, 2}


def test_long_quotation(spark):
    text = "The clerk wrote “" + "The mill was closed again. " * 60 + "It stayed so.” and left the town. Then it ended."
    assert ends(spark, [(text, None)]) == {0: [text.index("town.") + 4, len(text) - 1]}


def test_web_address_over_a_line_end(spark):
    text = "The clerk wrote to https://www.example.\norg/mill?a=1.5 about the mill at 3.75 a day. Then it ended."
    assert ends(spark, [(text, None)]) == {0: [text.index("day.") + 3, len(text) - 1]}


def test_units_have_the_texts(spark):
    df = spark.createDataFrame([(i, t, None, "clash") for i, (t, _) in enumerate(CASES)] + [(90, None, None, ""), (91, " ", None, "")], "doc_id long, text string, line_boxes array<struct<x1:int,y1:int,x2:int,y2:int,conf:double>>, sentence string")
    got = {}
    for r in S.sentence_units(df).orderBy("doc_id", "sentence_no").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want}


def test_unit_goes_on_behind_an_advert(spark):
    t = "The storm closed the\nquiet mill and the\nBEST SOAP IN TOWN\nold ferry.\nThe end."
    got = [(r.sentence, r.char_start, r.char_end) for r in S.sentence_units(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("sentence_no").collect()]
    assert ("The storm closed the\nquiet mill and the\nold ferry.", 0, t.index("ferry.") + 6) in got and ("BEST SOAP IN TOWN", t.index("BEST"), t.index("TOWN") + 4) in got

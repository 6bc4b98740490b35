import json

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import shred

PAGE = {"page_num": 3, "regions": [{"region_id": "r_001", "confidence": "0.5", "engines_ran": ["a", "b"]}, None, {"region_id": "r_002"}], "engine_durations": {"a": 1.5, "b": None}, "specialist_dispatches": {"trocr": 2}}


def records(texts):
    root = shred.processing_log_schema()
    columns = shred.shred(pd.Series(texts), root)
    out = []
    for kind, path, number, child in (("page", "pages", "page_num", None), ("region", "pages.regions", "pages.page_num", "region_id"), ("duration", "pages.engine_durations", "pages.page_num", "engine"), ("dispatch", "pages.specialist_dispatches", "pages.page_num", "specialist")):
        t = columns.table(shred.node_at(root, path))
        out += [(int(r), kind, p, c) for r, p, c in zip(t["record"], t[number], t[child] if child else [""] * len(t["record"]))]
    return sorted(out, key=repr)


WANTED = sorted([(0, "page", 3, ""), (0, "region", 3, "r_001"), (0, "region", 3, "r_002"), (0, "duration", 3, "a"), (0, "dispatch", 3, "trocr")], key=repr)


def test_forms_of_the_same_log():
    camel = {"pageNum": 3, "regions": {"r_001": {"confidence": 1}, "r_002": {}, "r_003": None}, "engineDurations": [{"engine": "a", "seconds": 1.5}, {"engine": "b", "seconds": None}], "specialistDispatches": {"trocr": 2, "dots": None}}
    for log in ({"pages": [PAGE]}, {"pages": PAGE}, {"pages": {"3": {k: v for k, v in PAGE.items() if k != "page_num"}}}, {"pages": json.dumps([PAGE])}, {"result": {"processing_log": {"pages": [PAGE]}}}, {"processingLog": {"pages": [camel]}}, {"pages": {"0": PAGE}}):
        assert records([json.dumps(log)]) == WANTED, log
    assert records([json.dumps(json.dumps({"pages": [PAGE]}))]) == WANTED


def test_wrapped_any_number_of_times():
    text = json.dumps({"pages": [{"page_num": 3}]})
    for _ in range(10):
        text = json.dumps(text)
    assert records([text]) == [(0, "page", 3, "")]
    log = {"pages": [{"page_num": 3}]}
    for k in range(12):
        log = {("data", "result", "payload")[k % 3]: log if k % 2 else json.dumps(log)}
    assert records([json.dumps(log)]) == [(0, "page", 3, "")]


def test_large_whole_numbers_stay_whole():
    assert [shred._whole(x) for x in (2**53 + 1, str(2**62 + 1), "7", " 8 ", 7.9, "7.9", 2**63, True, "x", None, float("inf"))] == [2**53 + 1, 2**62 + 1, 7, 8, 7, 7, None, None, None, None, None]


def test_damaged_null_and_empty_give_no_rows():
    assert records([None, "", "{", '{"pages": [', "[]", "3", "null", '{"pages": null}', '{"other": 1}']) == []


def test_nested_lists_and_parent_links():
    root = shred.processing_log_schema()
    t = shred.shred(pd.Series([json.dumps({"pages": [{"page_num": 0}, PAGE]}), json.dumps({"pages": [PAGE]})]), root).table(shred.node_at(root, "pages.regions"))
    assert t["record"].tolist() == [0, 0, 1, 1] and t["pages_ord"].tolist() == [1, 1, 0, 0] and t["regions_ord"].tolist() == [0, 1, 0, 1]
    assert [list(x) for x in t["engines_ran"]] == [["a", "b"], [], ["a", "b"], []]
    assert t["confidence"].tolist() == [0.5, None, 0.5, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.lists(st.text("abc", min_size=1, max_size=3), max_size=3)), max_size=4), max_size=4))
def test_tables_equal_nested_loops(logs):
    texts = [json.dumps({"pages": [{"page_num": n, "regions": [{"region_id": r} for r in rs]} for n, rs in pages]}) for pages in logs]
    root = shred.processing_log_schema()
    columns = shred.shred(pd.Series(texts, dtype=object), root)
    t = columns.table(shred.node_at(root, "pages.regions"))
    want = [(i, p, k, n, r) for i, pages in enumerate(logs) for p, (n, rs) in enumerate(pages) for k, r in enumerate(rs)]
    assert list(zip(t["record"], t["pages_ord"], t["regions_ord"], t["pages.page_num"], t["region_id"])) == want


def test_query_with_clashing_columns(spark):
    rows = [(1, json.dumps({"pages": [PAGE]}), 9, "x"), (2, None, 9, "x"), (3, json.dumps({"pages": [PAGE]}), 9, "x")]
    df = spark.createDataFrame(rows, "result_key long, processing_log string, page_num int, child_kind string")
    got = shred.log_records(df).toPandas()
    assert got.groupby("result_key").size().to_dict() == {1: 5, 3: 5}
    assert shred.log_records(df.limit(0)).count() == 0
    pages = shred.log_table(df, "pages").toPandas()
    assert pages["page_num"].tolist() == [3, 3] and pages["region_count"].isna().all()
    assert np.allclose(shred.log_table(df, "engine_durations").toPandas()["seconds"], 1.5)

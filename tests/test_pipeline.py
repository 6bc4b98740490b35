"""The whole way on six scenarios of engines that see one page, and on what becomes of budgets and missing pages."""

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import pipeline

W, H = 2550, 3300
REGION = "doc_id long, page_num long, engine string, engine_ord int, region_ord int, region_key long, region_id string, element_type string, x1 double, y1 double, x2 double, y2 double, confidence double, text_content string, hierarchy_level int, table_structure struct<rows:int,cols:int,has_merged_cells:boolean,has_html:boolean>"
TEXTS = ["DECLARATION OF TRUST", "Article I: Definitions", "Article II: Property", "Page 1 of 12", "Beneficiary | Share"]


def shifted(box, by):
    return [b + d for b, d in zip(box, by if isinstance(by, (list, tuple)) else [by] * 4)]


def scenarios():
    """name -> engine -> [(type, box, text)]"""
    filing = [("header", [300, 150, 2250, 210]), ("printed_text", [300, 300, 2250, 360]), ("printed_text", [300, 450, 2250, 510]), ("footer", [300, 3000, 2250, 3060]), ("table", [300, 600, 2250, 1200])]
    other = [("printed_text" if i == 0 else k, shifted(b, [3, 2, -3, -2])) for i, (k, b) in enumerate(filing)]
    third = [(k, [800, 700, 2600, 760] if i == 2 else shifted(b, [2, -2, -2, 2])) for i, (k, b) in enumerate(filing)]
    yield "scanned_legal_filing", {"pdfplumber": filing, "paddleocr": other, "docling": third}
    form = [("printed_text", b) for b in ([300, 100, 2250, 160], [300, 250, 1200, 290], [300, 350, 1200, 390], [300, 3000, 2250, 3040])]
    yield "born_digital_form", {e: [(k, shifted(b, j)) for k, b in form] for e, j in (("pdfplumber", 0), ("paddleocr", 2), ("docling", 1))}
    lines = [[300, 200, 2200, 260], [300, 400, 2200, 460], [300, 600, 1500, 650], [300, 800, 2200, 860]]
    old = [("printed_text", b) for b in lines]
    yield "degraded_historical", {"pdfplumber": old[:2], "paddleocr": [(k, shifted(b, [3, 3, -3, -3])) for k, b in old[:3]] + [("handwriting", [1600, 600, 2400, 680]), old[3]], "docling": [(k, shifted(b, [2, 2, -2, -2])) for k, b in old]}
    mixed = [("printed_text", [300, 100, 2200, 160]), ("handwriting", [300, 300, 1500, 380]), ("table", [300, 500, 2200, 900]), ("formula", [300, 1000, 1500, 1060])]
    yield "mixed_content", {e: [(k, shifted(b, j)) for k, b in mixed] for e, j in (("pdfplumber", 0), ("paddleocr", 3), ("docling", 1))}
    rows = [[300, 100, 2200, 160], [300, 250, 2200, 310], [300, 400, 2200, 460]]
    kinds = {"engine_a": ("header", "header", "printed_text"), "engine_b": ("printed_text", "printed_text", "footer"), "engine_c": ("page_number",) * 3}
    yield "type_disagreement", {e: [(k, shifted(b, j)) for k, b in zip(ks, rows)] for j, (e, ks) in zip((0, 2, 1), kinds.items())}
    known = [[x * 300 / 72 for x in b] for b in ([72, 36, 540, 60], [72, 100, 540, 114], [72, 700, 540, 714])]
    yield "generated_controlled", {"engine_a": [("printed_text", b) for b in known], "engine_b": [("printed_text", shifted(b, [3, -2, 3, -2])) for b in known]}


def frame(spark, only=None, texts=TEXTS):
    rows, names, key = [], {}, 0
    for doc, (name, engines) in enumerate(scenarios()):
        names[name] = doc
        for o, (engine, regions) in enumerate(engines.items()):
            for i, (kind, box) in enumerate(regions):
                key += 1
                rows.append((doc, 0, engine, o, i, key, f"{engine}-{i}", kind, *map(float, box), 0.9 + 0.01 * o, texts[i], 1 if engine == "docling" and kind == "header" else None, (2, 2, False, False) if kind == "table" else None))
    return spark.createDataFrame([r for r in rows if only is None or r[0] in only], REGION), names


def run(spark, regions, pages, options=pipeline.Options(), costs=(), names=()):
    payloads = spark.createDataFrame([(d, p, W, H, 300, e) for d, p, e in pages], "doc_id long, page_num long, width int, height int, dpi int, error string").withColumn("scanned_at", F.lit(None).cast("timestamp"))
    return pipeline.process(regions, payloads, spark.createDataFrame(list(names), "doc_id long, filename string"), spark.createDataFrame(list(costs), "doc_id long, page_num long, cost_nano long"), options)


def test_resolution_of_the_scenarios(spark):
    """Groups that several engines saw, of all: 23 of 25 over the six scenarios."""
    regions, names = frame(spark)
    result = run(spark, regions, [(d, 0, None) for d in names.values()])
    got = {r.doc_id: (r.many, r.n) for r in result.groups.groupBy("doc_id").agg(F.sum((F.col("engine_count") > 1).cast("int")).alias("many"), F.count("*").alias("n")).collect()}
    want = {"scanned_legal_filing": (5, 6), "born_digital_form": (4, 4), "degraded_historical": (4, 5), "mixed_content": (4, 4), "type_disagreement": (3, 3), "generated_controlled": (3, 3)}
    assert {n: got[d] for n, d in names.items()} == want and sum(a for a, _ in got.values()) == 23 and sum(b for _, b in got.values()) == 25
    table = result.regions.filter("element_type = 'table'").collect()
    assert table and all(r.table_structure.rows == 2 for r in table if r.doc_id == 0)
    decisions = {r.aligned_key: r for r in result.decisions.filter("doc_id = 0").collect()}
    assert len(decisions) == 6 and all(r.resolution in ("identical", "single_engine") and not r.llm_invoked for r in decisions.values())
    head = result.documents.filter("doc_id = 0").orderBy("part_no").collect()
    assert head[0].part.startswith("---\npages: 1\n") and "DECLARATION OF TRUST" in head[1].part


def test_types_of_the_anchor_give_headers(spark):
    regions, _ = frame(spark, {0})
    result = run(spark, regions, [(0, 0, None)], pipeline.Options(type_source="anchor"))
    parts = [r.part for r in result.documents.orderBy("part_no").collect()]
    assert "title: DECLARATION OF TRUST" in parts[0] and parts[1].startswith("# DECLARATION OF TRUST")


def test_pages_names_and_budget(spark):
    """A broken page is left out, an image has no text layer, and the page that reaches the budget is the last."""
    regions, _ = frame(spark, {1})
    pages = [regions.withColumn("page_num", F.lit(p).cast("long")).withColumn("region_key", F.col("region_key") + 1000 * p) for p in range(4)]
    every = pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])
    costs = [(1, p, 10) for p in range(4)]
    valid = [(1, 0, None), (1, 1, "render failed"), (1, 2, None), (1, 3, None), (1, 4, None)]
    result = run(spark, every, valid, pipeline.Options(budget_nano=15), costs, [(1, "a.PNG")])
    assert {r.page_num: r.processed for r in result.pages.collect()} == {0: True, 2: True, 3: False, 4: False}
    meta = result.metadata.collect()[0]
    assert (meta.page_count, meta.total_page_count, meta.filename, meta.budget_exceeded) == (2, 4, "a.PNG", True)
    assert {tuple(r.engines_ran) for r in result.decisions.collect()} == {("paddleocr",)}
    free = run(spark, every, valid, pipeline.Options(confidence_floor=2.0), costs, [(1, "a.pdf")])
    assert not free.metadata.collect()[0].budget_exceeded and free.decisions.filter("not hitl_flag").count() == 0
    assert free.documents.filter("part_no = 4").collect()[0].part == "\n\n---\n\n"


def test_disagreement_goes_to_the_arbiter(spark):
    regions, _ = frame(spark, {3})
    other = F.when(F.col("engine") == "paddleocr", F.lit("zzzzzzzzzzz")).when(F.col("engine") == "docling", F.lit("qqqqqqqqqqqqqqq")).otherwise(F.col("text_content"))
    result = run(spark, regions.withColumn("text_content", other), [(3, 0, None)])
    assert {r.source for r in result.regions.filter("element_type = 'text'").collect()} == {"arbitration"}
    failing = pipeline.process(regions.withColumn("text_content", other), spark.createDataFrame([(3, 0, W, H, 300, None)], "doc_id long, page_num long, width int, height int, dpi int, error string").withColumn("scanned_at", F.lit(None).cast("timestamp")), spark.createDataFrame([], "doc_id long, filename string"), spark.createDataFrame([], "doc_id long, page_num long, cost_nano long"), arbiter=F.lit(None).cast("string"))
    assert {(r.source, r.hitl_flag) for r in failing.regions.filter("element_type = 'text'").collect()} == {("hitl_fallback", True)}


def test_nothing(spark):
    regions, _ = frame(spark)
    result = run(spark, regions.limit(0), [])
    assert result.documents.count() == result.metadata.count() == result.decisions.count() == 0
    with pytest.raises(AttributeError):
        pipeline.Options().processed = "x"

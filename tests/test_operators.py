import hmac
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import geometry as g
from palimpsest.functions import strings as s
from palimpsest.operators import audit, clean, consensus, markdown, matching, service
from palimpsest.plans.runtime import ranked
from palimpsest.sources import documents as sources


def test_geometry(spark):
    rows = [(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0), (0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0), (0.0, 0.0, 4.0, 4.0, 1.0, 1.0, 2.0, 2.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a_x1 double, a_y1 double, a_x2 double, a_y2 double, b_x1 double, b_y1 double, b_x2 double, b_y2 double")
    got = df.select(g.iou(g.box("a"), g.box("b")).alias("i"), g.containment(g.box("a"), g.box("b")).alias("c"), g.centre_distance(g.box("a"), g.box("b")).alias("d")).collect()
    assert [round(r.i, 4) for r in got] == [round(1 / 7, 4), 0, round(1 / 16, 4), 0]
    assert [r.c for r in got] == [0.25, 0, 1, 0]
    assert got[0].d == pytest.approx(math.sqrt(2))


def regions(spark, rows):
    """(key, engine, ord, box, confidence, text[, type])"""
    full = [(1, 0, "text", k, e, o, i, (t[0] if t else "printed_text"), *map(float, b), True, float(c), x) for i, (k, e, o, b, c, x, *t) in enumerate(rows)]
    names = "doc_id page_num type_group region_key engine engine_ord region_ord element_type ux1 uy1 ux2 uy2 has_unit confidence text_content".split()
    return pd.DataFrame(full, columns=names)


def kinds(pdf, **over):
    out = matching.match_page(pdf, matching.Thresholds(**over))
    return [(r.match_type, r.engine_count) for r in out.itertuples()]


def test_layers_of_the_matcher(spark):
    line = [0.05, 0.10, 0.95, 0.15]
    a = regions(spark, [(1, "pdfplumber", 0, line, 1.0, "WHEREAS the parties agree"), (2, "paddleocr", 1, [0.055, 0.102, 0.945, 0.148], 0.92, "x"), (3, "docling", 2, [0.05, 0.10, 0.30, 0.15], 0.95, "WHEREAS"), (4, "docling", 2, [0.57, 0.10, 0.95, 0.15], 0.91, "parties agree"), (5, "docling", 2, [0.32, 0.10, 0.55, 0.15], 0.93, "the")])
    out = matching.match_page(a, matching.Thresholds())
    assert out.match_type.tolist() == ["containment"] and out.engine_count.tolist() == [3]
    assert [m["text"] for m in out.members[0] if m["engine"] == "docling"] == ["WHEREAS the parties agree"]
    assert kinds(regions(spark, [(1, "paddleocr", 1, line, 1, "a"), (2, "docling", 2, [0.055, 0.133, 0.945, 0.178], 1, "a")])) == [("center_rescue", 2)]
    assert kinds(regions(spark, [(1, "a", 0, [0.05, 0.10, 0.95, 0.121], 1, "a"), (2, "b", 1, [0.05, 0.124, 0.95, 0.145], 1, "a")])) == [("orphan", 1), ("orphan", 1)]
    assert kinds(regions(spark, [(1, "a", 0, [0, 0, 0.5, 0.2], 0.9, "a"), (2, "b", 1, [0.3, 0.1, 0.8, 0.3], 0.85, "a")])) == [("cluster", 2)]


def test_complete_linkage_never_chains():
    boxes = np.array([[0, 0, 0.5, 0.2], [0.4, 0.1, 0.9, 0.3], [0.8, 0.2, 1, 0.4]])
    assert max(map(len, matching.linkage(boxes, 0.95))) <= 2


def test_fusion_keeps_members():
    boxes = np.array([[0.1, 0.1, 0.5, 0.5], [0.7, 0.7, 0.9, 0.9], [0.12, 0.12, 0.48, 0.48], [0.2, 0.2, 0.2, 0.2]])
    got = matching.fuse(boxes, np.array([0.9, 0.7, 0.8, 0.9]), np.ones(4), 0.3)
    assert sorted(sorted(m) for _, m in got) == [[0, 2], [1]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(0, 0.8), st.floats(0, 0.8), st.floats(0.05, 0.2), st.floats(0.05, 0.2)), min_size=1, max_size=9))
def test_every_region_in_exactly_one_group(rows):
    full = [(1, 0, "text", i, f"e{e}", e, i, "printed_text", x, y, x + w, y + h, True, 0.9, str(i)) for i, (e, x, y, w, h) in enumerate(rows)]
    names = "doc_id page_num type_group region_key engine engine_ord region_ord element_type ux1 uy1 ux2 uy2 has_unit confidence text_content".split()
    out = matching.match_page(pd.DataFrame(full, columns=names), matching.Thresholds())
    seen = sorted(int(t) for ms in out.members for m in ms for t in m["text"].split())
    assert seen == list(range(len(rows)))


def test_candidates_and_matches_equal_loops(spark):
    rng = np.random.default_rng(5)
    n = 60
    xy = rng.random((n, 2)) * 0.5
    pdf = pd.DataFrame({"region_key": range(n), "doc_id": 1, "page_num": rng.integers(0, 2, n), "engine": [f"e{i % 3}" for i in range(n)], "engine_ord": [i % 3 for i in range(n)], "region_ord": range(n), "element_type": "header", "nx1": xy[:, 0], "ny1": xy[:, 1], "nx2": xy[:, 0] + 0.3, "ny2": xy[:, 1] + 0.3, "x1": 0.0, "y1": 0.0, "x2": 0.0, "y2": 0.0})
    got = {(r.a_region_key, r.b_region_key) for r in matching.scored(matching.pairs(spark.createDataFrame(pdf))).filter("iou >= 0.5").collect()}
    box = pdf[["nx1", "ny1", "nx2", "ny2"]].to_numpy()
    over = matching.iou_matrix(box, box)
    want = {(i, j) for i in range(n) for j in range(n) if i % 3 < j % 3 and pdf.page_num[i] == pdf.page_num[j] and over[i, j] >= 0.5}
    assert got == want and want


def test_noise_and_fragments(spark):
    names = "region_key int, doc_id long, page_num long, engine string, region_ord int, region_id string, element_type string, nx1 double, ny1 double, nx2 double, ny2 double, confidence double, text_content string, x1 double, y1 double, x2 double, y2 double, hierarchy_level int, table_structure struct<rows:int,cols:int,has_merged_cells:boolean,has_html:boolean>"
    at = lambda k, b, text, kind="printed_text", conf=0.9: (k, 1, 0, "docling", k, f"r_{k}", kind, *b, conf, text, *b, k if k > 1 else None, (k, 1, False, False) if k > 3 else None)
    noise = [at(1, (0.48, 0.97, 0.52, 0.99), "33"), at(2, (0.09, 0.30, 0.11, 0.32), "15"), at(3, (0.05, 0.93, 0.95, 0.99), "33"), at(4, (0.4, 0.5, 0.45, 0.52), "42"), at(5, (0.09, 0.30, 0.11, 0.32), "Re:"), at(6, (None,) * 4, "7"), at(7, (0.09, 0.10, 0.10, 0.11), "  7. ")]
    assert sorted(r.region_key for r in clean.without_noise(spark.createDataFrame(noise, names)).collect()) == [3, 4, 5, 6]
    y = (0.15, 0.17)
    parts = [at(1, (0.12, y[0], 0.22, y[1]), "WHEREAS"), at(3, (0.28, y[0], 0.36, y[1]), "parties", conf=0.88), at(2, (0.23, y[0], 0.27, y[1]), "the", conf=0.85), at(4, (0.42, y[0], 0.5, y[1]), "far"), at(5, (0.36, y[0], 0.4, y[1]), "head", "header")]
    got = {r.region_key: r for r in clean.merged_fragments(spark.createDataFrame(parts, names)).collect()}
    assert set(got) == {1, 4, 5} and got[1].text_content == "WHEREAS the parties" and got[1].confidence == 0.85 and got[1].nx2 == got[1].x2 == 0.36
    assert got[1].hierarchy_level is None and got[1].table_structure is None and got[4].hierarchy_level == 4 and got[4].table_structure.rows == 4


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_alignment(a, b):
    x, y = s.align(a, b)
    assert len(x) == len(y) and x.replace(s.GAP, "") == a and y.replace(s.GAP, "") == b
    value = lambda x, y: sum(s.SPACE if s.GAP in (c, d) else s.MATCH if c == d else s.MISMATCH for c, d in zip(x, y))
    table = {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        options = [0] if i == j == 0 else []
        options += [table[i - 1, j - 1] + (s.MATCH if a[i - 1] == b[j - 1] else s.MISMATCH)] if i and j else []
        options += [table[i - 1, j] + s.SPACE] if i else []
        options += [table[i, j - 1] + s.SPACE] if j else []
        table[i, j] = max(options)
    assert value(x, y) == table[len(a), len(b)]


def test_alignment_of_long_texts_is_optimal():
    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("abcd"), 1300))
    b = a[:400] + a[430:900] + "x" + a[900:]
    x, y = s.align(a, b)
    assert x.replace(s.GAP, "") == a and y.replace(s.GAP, "") == b
    assert sum(s.SPACE if s.GAP in (c, d) else s.MATCH if c == d else s.MISMATCH for c, d in zip(x, y)) == s._scores(a, b)[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    assert s.common_subsequence(a, b) == t[-1][-1]


def test_entropy_vote_and_resolution(spark):
    assert consensus.entropy(list("aaa")) == 0 and consensus.entropy(list("abc")) == pytest.approx(math.log2(3)) and consensus.entropy(list("aab")) == pytest.approx(0.9183, abs=1e-4)
    assert consensus.vote(["hello", "hel1o", "hello"], [1, 1, 1]) == "hello"
    assert consensus.vote(["a\x00", "\x00b"], [1, 1]) == "ab" and consensus.vote(["ab", "cb"], [1, 1]) == "ab"
    assert consensus.disagreement(["a\x00", "a\x00"]) == 0
    rows = [(1, [("docling", "hello"), ("pdfplumber", "hello")], 0.7), (2, [("docling", "hel1o"), ("pdfplumber", "hello"), ("paddleocr", "hello")], 0.5), (3, [], None), (4, [("trocr", "x")], 0.4), (5, None, None), (6, [("a", None)], 0.1)]
    df = spark.createDataFrame([(k, 1, 0, "r", "printed_text", c, e) for k, e, c in rows], "aligned_key long, doc_id long, page_num long, region_id string, element_type string, confidence double, engine_texts array<struct<engine:string,text:string>>")
    got = {r.aligned_key: r for r in consensus.resolve(df).collect()}
    assert [got[k].source for k in (1, 2, 3, 4, 6)] == ["identical", "voting", "pending", "single_engine", "pending"]
    assert got[2].resolved_text == "hello" and 0 < got[2].ce < 0.4 and got[3].resolved_text is None


def test_verdicts(spark):
    rows = [("$1,234.56", ["$1,234.56", "$1,234.65"]), ("completely different text", ["hello", "world"]), ("hello XYZABC world", ["hello world"]), ("<UNREADABLE>", ["x"]), (None, ["x"]), ("50.6%", ["50.5%"])]
    df = spark.createDataFrame(rows, "o string, c array<string>").select("o", s.verdict(F.col("o"), F.col("c")).alias("v"), s.inserts_run(F.col("o"), F.col("c")).alias("run"))
    got = [(r.v.source, r.v.rejected, list(r.v.warnings)) for r in df.collect()]
    assert got == [("arbitration", False, []), ("rejected_edit_distance", True, []), ("rejected_edit_distance", True, []), ("llm_unreadable", False, []), ("hitl_fallback", True, []), ("arbitration", False, ["percentage: 50.6%"])]
    assert df.collect()[2].run


def test_markdown(spark):
    names = "aligned_key long, doc_id long, page_num long, element_type string, consensus_text string, x1 double, y1 double, x2 double, y2 double, confidence double, hitl_flag boolean, metadata map<string,string>"
    at = lambda k, kind, text, meta=None, box=(300.0, 0.0, 900.0, 10.0), flag=False: (k, 1, 2, kind, text, *box, 0.5, flag, meta)
    rows = [at(1, "header", "Title", {"hierarchy_level": "1"}), at(2, "header", "T"), at(3, "header", "T", {"hierarchy_level": "10"}), at(4, "formula", "E = mc^2"), at(5, "formula", None), at(6, "table", "Name\tAge\nAlice\t30"), at(7, "footer", "x"), at(8, "handwriting", "n", None, (50.0, 500.0, 350.0, 580.0)), at(9, "chart", None), at(10, "printed_text", "a", flag=True), at(11, "printed_text", None, flag=True), at(12, "chart", "x", {"svg_content": '<svg onclick="a()"><script>b</script></svg>'})]
    df = spark.createDataFrame(rows, names)
    got = {r.aligned_key: r.md for r in df.select("aligned_key", markdown.region_markdown().alias("md")).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5, 7)] == ["# Title", "## T", "###### T", "$E = mc^2$", "[Formula: unreadable, see page 3]", ""]
    assert got[6] == "| Name | Age |\n| --- | --- |\n| Alice | 30 |"
    assert got[8] == "*[Margin note: n]* <!-- handwritten-margin [50.0,500.0,350.0,580.0] -->"
    assert got[9] == "[Chart: extraction failed, see page 3]" and got[12] == "<svg></svg>"
    assert got[10] == "a\n<!-- REVIEW NEEDED: [300.0,0.0,900.0,10.0] page=2 confidence=0.50 -->" and got[11].startswith("<!-- REVIEW NEEDED")
    parts = markdown.documents(df, "now").orderBy("part_no").collect()
    assert parts[0].part == "---\npages: 1\nprocessed: 'now'\ntitle: Title\n---\n\n" and parts[1].part.startswith("# Title")
    assert markdown.documents(df.limit(0), "now").count() == 0


def test_audit(spark):
    arbiter = spark.createDataFrame([(1, 0, 0, "llm_arbiter", 1.0)], "result_key long, page_ord int, page_num long, engine string, seconds double")
    assert audit.page_costs(arbiter).collect()[0].cost_nano == 306_000
    d = spark.createDataFrame([(1, 0, 0, "paddleocr", 2.0), (1, 0, 0, "docling", 1.5), (1, 0, 0, "pdfplumber", 0.5), (1, 1, 1, "x", 1.0)], "result_key long, page_ord int, page_num long, engine string, seconds double")
    costs = {r.page_ord: r.cost_nano for r in audit.page_costs(d).collect()}
    assert costs == {0: round((2 * 0.000306 + 1.5 * 0.000164 + 0.5 * 0.000043) * 1e9), 1: 43000}
    assert audit.within_budget(audit.page_costs(d), 1000).count() == 1 and audit.within_budget(audit.page_costs(d), 10**9).count() == 2
    spent = spark.createDataFrame([("j", "a", 0.9, 1.0), ("k", "b", 0.5, 1.0), ("l", "c", 5.0, None)], "job_id string, key_hash string, spent_usd double, budget_usd double")
    assert [r.message for r in audit.alerts(spent).collect()] == ["Job j has used 90.0% of budget ($0.9000/$1.0000)"]
    cer = spark.createDataFrame([("hello", "hello"), ("abc", "xyz"), ("abc", "")], "p string, t string").select(audit.character_errors(F.col("p"), F.col("t")).alias("c"))
    assert [r.c for r in cer.collect()] == [0, 1, 3]
    m = spark.createDataFrame([("a", "cer", 0.05), ("a", "table_teds", 0.96), ("b", "other", 9.0)], "benchmark string, metric string, value double")
    limits = spark.createDataFrame([("a", "cer", 0.01), ("a", "table_teds", 0.95), ("b", "other", 1.0)], "benchmark string, metric string, limit double")
    assert [(r.benchmark, r.metric) for r in audit.regressions(m, limits).collect()] == [("a", "cer")]


def test_service(spark):
    urls = {"https://x.org/": "ok", "https://x.org:443/": "ok", "http://x.org/": "not_https", "https://x.org:8443/": "bad_port", "https://u:p@x.org/": "userinfo", "ftp://x": "not_https", "not a url": "not_https", "https:///x": "no_host"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in df.select("u", service.callback_check(F.col("u"), F.array(F.lit("93.184.216.34"))).alias("c")).collect()} == urls
    found = {"127.0.0.1": "private_address", "10.0.0.1": "private_address", "192.168.1.1": "private_address", "172.16.0.1": "private_address", "172.32.0.1": "ok", "169.254.169.254": "private_address", "::1": "private_address", "fe80::1": "private_address", "93.184.216.34": "ok", "2606:2800:220:1::1": "ok", None: "unresolvable"}
    df = spark.createDataFrame([(a,) for a in found], "a string")
    assert {r.a: r.c for r in df.select("a", service.callback_check(F.lit("https://x.org/"), F.when(F.col("a").isNotNull(), F.array("a"))).alias("c")).collect()} == found
    up = spark.createDataFrame([(1, "a.PDF", "%PDF-"), (1, "a.pdf", "xxxxx"), (service.MAX_UPLOAD, "a.png", ""), (service.MAX_UPLOAD + 1, "a.png", ""), (1, "a.tif", ""), (1, None, None)], "n long, f string, h string")
    assert [r.c for r in up.select(service.upload_check(F.col("n"), F.col("f"), F.col("h")).alias("c")).collect()] == ["ok", "fake_pdf", "ok", "too_large", "bad_format", "bad_format"]
    b = spark.createDataFrame([("2025110100",), ("2025122500",), ("bad",), (None,)], "bucket string")
    assert [r.bucket for r in service.expired_buckets(b, "2026-01-01 00:00:00").collect()] == ["2025110100"]
    t = spark.createDataFrame([(1, [500, 200]), (2, [500, None, 404, 200]), (3, [200]), (4, [])], "id int, statuses array<int>")
    assert [(r.attempts, r.delivered, r.waited_s) for r in service.delivery_attempts(t).orderBy("id").collect()] == [(2, True, 1), (3, False, 5), (1, True, 0), (0, False, 0)]
    bodies = ["body", "", "ключ" * 50, None]
    for key in ("k", "long" * 40):
        sig = spark.createDataFrame([(b,) for b in bodies], "b string").select(service.signature(key, F.col("b")).alias("s")).collect()
        assert [r.s for r in sig] == [b if b is None else hmac.new(key.encode(), b.encode(), "sha256").hexdigest() for b in bodies]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.check for r in sources.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "ok", "b.pdf": "fake_pdf", "c.txt": "bad_format"}
    df = spark.createDataFrame([("list_item", "figure"), ("odd", None)], "a string, b string")
    assert [(r.s, r.l) for r in df.select(sources.structure_type(F.col("a")).alias("s"), sources.layout_type(F.col("b")).alias("l")).collect()] == [("printed_text", "image"), ("printed_text", "printed_text")]
    logs = spark.createDataFrame([([0.0, 0.0],), ([],), ([-50.0],)], "l array<double>").select(sources.line_confidence(F.col("l")).alias("c"))
    assert [round(r.c, 6) for r in logs.collect()] == [1.0, 0.5, 0.0]
    words = spark.createDataFrame([(1, 0, 10.0, 5.0, "b"), (1, 0, 11.5, 1.0, "a"), (1, 0, 12.5, 1.0, "c"), (1, 0, 30.0, 1.0, "d")], "doc_id long, page_num long, top double, x0 double, text string")
    assert [r.text for r in clean.lines_of_words(words).orderBy("line").collect()] == ["a b", "c", "d"]
    folded = spark.createDataFrame([(-89.0,), (3.0,), (20.0,), (0.05,)], "a double").select(clean.folded_angle(F.col("a")).alias("a"))
    assert [r.a for r in folded.collect()] == [1.0, 3.0, 0.0, 0.0]
    cells = spark.createDataFrame([([["a", None], ["c", "d"]],)], "r array<array<string>>").select(sources.table_text(F.col("r")).alias("t")).collect()
    assert cells[0].t == "a | \nc | d"


def test_places_round_as_c_does(spark):
    rng = np.random.default_rng(3)
    values = [*(k / 1000 for k in range(0, 1100)), *rng.random(500), *(rng.random(300) * 2000), 0.125, 0.375, 2.675, 1.005, 99.995, 1234.565, 81.25, 0.05, 1e-9, 0.995, 0.9999999]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for r in df.select("v", s.places(F.col("v"), 1).alias("a"), s.places(F.col("v"), 2).alias("b"), g.two_places(-F.col("v")).alias("c")).collect():
        assert (r.a, r.b) == (f"{r.v:.1f}", f"{r.v:.2f}") and r.c == round(-r.v, 2), r.v


def test_front_matter_is_yaml(spark):
    texts = {"Plain title": "Plain title", "Re: x": "'Re: x'", "it's: so": "'it''s: so'", "- item": "'- item'", "-item": "-item", "yes": "'yes'", "12": "'12'", "2026-01-01": "'2026-01-01'", "a #b": "'a #b'", "a#b": "a#b", "# head": "'# head'", "a\nb": '"a\\nb"', "[x]": "'[x]'", " x": "' x'", "12 monkeys": "12 monkeys", "x:": "'x:'"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.y for r in df.select("t", markdown.yaml_text(F.col("t")).alias("y")).collect()} == texts


def test_pages_without_text_count(spark):
    names = "aligned_key long, doc_id long, page_num long, element_type string, consensus_text string, x1 double, y1 double, x2 double, y2 double, confidence double, hitl_flag boolean, metadata map<string,string>"
    at = lambda k, page, kind, text, y=0.0: (k, 1, page, kind, text, 300.0, y, 900.0, 10.0, 0.5, False, None)
    df = spark.createDataFrame([at(1, 0, "footer", "x"), at(2, 1, "printed_text", "a"), at(3, 2, "header", "Late")], names)
    parts = [r.part for r in markdown.documents(df, "now").orderBy("part_no").collect()]
    assert parts[0].startswith("---\npages: 3\n") and "Untitled Document" in parts[0]
    assert "".join(parts[1:]) == "\n\n---\n\na\n\n---\n\n## Late"
    lost = spark.createDataFrame([(9, None, None, "header", "Head", 300.0, 0.0, 900.0, 10.0, 0.5, False, None)], names)
    assert [r.part for r in markdown.documents(lost, "now").orderBy("part_no").collect()] == ["---\npages: 1\nprocessed: 'now'\ntitle: Untitled Document\n---\n\n", "## Head"]


def test_ranked_equals_a_window(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else int(g), int(o), int(v)) for g, o, v in zip(rng.choice([0, 0, 0, 0, 1, 2, 3], 500), rng.permutation(500), rng.integers(1, 9, 500))]
    df = spark.createDataFrame(rows, "g int, o int, v long")
    want_rank, want_sum = {}, {}
    for k in (None, 0, 1, 2):
        own = sorted((o, v) for a, o, v in rows if a == k)
        for i, (o, _) in enumerate(own):
            want_rank[o], want_sum[o] = i + 1, sum(x for _, x in own[:i])
    assert {r.o: r.n for r in ranked(df, ["g"], ["o"], "n").collect()} == want_rank
    assert {r.o: r.n for r in ranked(df, ["g"], ["o"], "n", "v").collect()} == want_sum
    assert ranked(df.limit(0), ["g"], ["o"], "n").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 6)] * 4), max_size=9), st.sampled_from([0.5, 0.92, 1.0]))
def test_linkage_equals_a_loop(rows, cut):
    boxes = np.array([[x, y, x + 1 + w, y + 1 + h] for x, y, w, h in rows], dtype=float).reshape(-1, 4)
    want = [[i] for i in range(len(boxes))]
    d = 1.0 - matching.iou_matrix(boxes, boxes)
    while len(want) > 1:
        far, x, y = min((max(d[i, j] for i in want[x] for j in want[y]), x, y) for x in range(len(want)) for y in range(x + 1, len(want)))
        if far > cut:
            break
        want[x] += want.pop(y)
    assert matching.linkage(boxes, cut) == want


def test_report_and_errors(spark):
    found = spark.createDataFrame([("b", "cer", 0.05, 0.01), ("a", "cer", 0.5, 0.03)], "benchmark string, metric string, value double, limit double")
    lines = [r.line for r in audit.regression_report(found).orderBy("line_no").collect()]
    assert lines == ["# Regression Report", "", "**2 regression(s) detected.**", "", "| Benchmark | Metric | Expected | Actual |", "|-----------|--------|----------|--------|", "| a | cer | 0.0300 | 0.5000 |", "| b | cer | 0.0100 | 0.0500 |"]
    assert [r.line for r in audit.regression_report(found.limit(0)).orderBy("line_no").collect()] == ["# Regression Report", "", "All benchmarks passing."]
    kinds = spark.createDataFrame([("ValueError",), ("KeyError",), ("PermissionError",), ("OSError",), (None,)], "k string")
    assert [(r.e.status, r.e.detail) for r in kinds.select(service.error_report(F.col("k"), F.lit("own")).alias("e")).collect()] == [(400, "invalid input"), (404, "not found"), (403, "forbidden"), (500, "internal error"), (500, "internal error")]
    assert kinds.select(service.error_report(F.col("k"), F.lit("own"), False).alias("e")).collect()[0].e.detail == "own"
    t = spark.createDataFrame([(None, None, None), ("t", "t", None), ("t", None, "t"), ("t", "x", "t"), ("t", None, None)], "e string, c string, p string")
    assert [r.s for r in t.select(service.token_check(F.col("e"), F.col("c"), F.col("p")).alias("s")).collect()] == [200, 200, 200, 403, 403]


def test_code_points_count_in_error_rates(spark):
    df = spark.createDataFrame([("café ёж", "cafü жё"), ("naïve", "naïve")], "p string, t string")
    assert [round(r.c, 4) for r in df.select(audit.character_errors(F.col("p"), F.col("t")).alias("c")).collect()] == [round(3 / 7, 4), 0]


def test_rendering_details(spark):
    rows = [('<g   onload="x()"\n\tonclick = \'y\' on=1>',), ("<a onclick=z>",), (None,)]
    assert [r.x for r in spark.createDataFrame(rows, "t string").select(s.clean_svg(F.col("t")).alias("x")).collect()] == ["<g on=1>", "<a onclick=z>", None]
    rows = [("\ta\tb\n\nc",), ("  \n ",), ("x",)]
    assert [r.x for r in spark.createDataFrame(rows, "t string").select(s.pipe_table(F.col("t")).alias("x")).collect()] == ["| a | b |\n| --- | --- |\n| c |  |", "", "| x |\n| --- |"]


def test_quality_and_arbitration(spark):
    names = "doc_id long, page_num long, engine string, region_ord int, region_key long, text_content string"
    base = "x" * 9000
    rows = [(1, 0, "pdfplumber", 0, 1, base + "abcdef"), (1, 0, "paddleocr", 0, 2, base), (1, 1, "pdfplumber", 0, 3, " "), (1, 1, "paddleocr", 0, 4, "z"), (1, 2, "pdfplumber", 0, 5, "q" * 10), (1, 3, "pdfplumber", 0, 6, "a" * 90003), (1, 3, "paddleocr", 0, 7, "a" * 90003 + "b" * 19994)]
    got = {r.page_num: (r.is_ground_truth, r.reason) for r in consensus.page_quality(spark.createDataFrame(rows, names)).collect()}
    assert got == {0: (True, "agreement"), 1: (False, "no_pdfplumber_text"), 2: (False, "disagreement"), 3: (True, "agreement")}  # 0.90003 is above 0.9
    cols = "aligned_key long, element_type string, source string, resolved_text string, agreement double, needs_arbitration boolean, candidates array<string>, answer string"
    rows = [(1, "handwriting", "voting_fallback", "r", 0.5, True, ["abcd"], "efgh"), (2, "printed_text", "voting_fallback", "r", 0.5, True, ["abcd"], "efgh"), (3, "printed_text", "voting", "r", 0.5, False, None, None), (4, "printed_text", "voting_fallback", "r", 0.5, True, ["abcd"], None)]
    got = {r.aligned_key: (r.final_text, r.final_source, r.hitl_flag) for r in consensus.arbitrated(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("efgh", "arbitration", False), 2: ("r", "hitl_fallback", True), 3: ("r", "voting", False), 4: ("r", "hitl_fallback", True)}
    medoid = spark.createDataFrame([(["abc", "abd", "xyz"],), ([],), (None,)], "c array<string>").select(consensus.offline_arbiter(F.col("c")).alias("a")).collect()
    assert [r.a for r in medoid] == ["abc", None, None]


def test_review_and_store(spark):
    reviewed = spark.createDataFrame([(1, "j", "r1", "old", None), (2, "j", "r2", "old", "kept"), (3, "k", "r1", "old", None)], "hitl_key long, job_id string, region_id string, consensus_text string, corrected_text string")
    payload = spark.createDataFrame([("j", {"r1": "new", "r9": "x"})], "job_id string, corrections map<string,string>")
    assert {r.hitl_key: r.corrected_text for r in service.with_corrections(reviewed, payload).collect()} == {1: "new", 2: "kept", 3: None}
    assert service.corrections_applied(payload).collect()[0].corrections_applied == 2
    store = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    changes = spark.createDataFrame([("a", 9, "2026-01-02 00:00:00", False), ("a", 8, "2026-01-01 00:00:00", False), ("b", None, "2026-01-01 00:00:00", True), ("d", 4, "2026-01-01 00:00:00", False)], "k string, v int, at string, deleted boolean").withColumn("at", F.to_timestamp("at"))
    assert {r.k: r.v for r in service.upserted(store, changes, ["k"]).collect()} == {"a": 9, "c": 3, "d": 4}
    pages = spark.createDataFrame([(1, "f", True, 2), (1, "f", False, 5), (2, None, True, 0)], "doc_id long, filename string, processed boolean, hitl_flags long")
    assert {r.doc_id: (r.page_count, r.total_page_count, r.hitl_flag_count, r.budget_exceeded) for r in service.result_metadata(pages).collect()} == {1: (1, 2, 2, True), 2: (1, 1, 0, False)}


def test_images_and_specialists(spark):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00crc_" + (9).to_bytes(4, "big") + b"pHYs" + (11811).to_bytes(4, "big") * 2 + b"\x01"
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x01\x00\x96\x00\x96\x00\x00\xff\xc0\x00\x11\x08\x00\x20\x00\x30\x03rest"
    rows = [(1, bytearray(png)), (2, bytearray(jpeg)), (3, bytearray(b"\x89PNGxx")), (4, bytearray(b""))]
    got = {r.k: (r.width, r.height, r.dpi, r.error is None) for r in sources.image_heads(spark.createDataFrame(rows, "k long, image binary"), ["k"], "image").collect()}
    assert got == {1: (640, 480, 300, True), 2: (48, 32, 150, True), 3: (0, 0, 0, False), 4: (0, 0, 0, False)}

    def broken(payloads):
        raise RuntimeError("no model")

    asked = spark.createDataFrame([(1, "r", "dots_chart", "<SVG>"), (2, None, "dots_formula", " "), (3, "r", "trocr", "x"), (4, "r", "other", "x")], "region_key long, region_id string, specialist string, payload string")
    got = {r.region_key: (r.region_id, r.success, r.confidence, r.error) for r in sources.specialists(asked, {"dots_chart": list, "dots_formula": list, "trocr": broken}).collect()}
    assert got == {1: ("r", True, 0.85, None), 2: ("unknown", False, 0.0, None), 3: ("r", False, 0.0, "RuntimeError: no model"), 4: ("r", False, 0.0, "KeyError: 'other'")}


def test_text_layer(spark):
    """Two lines outside a table, one in it; the table comes last."""
    words = spark.createDataFrame([(1, 0, 10.0, 50.0, 80.0, 20.0, "world"), (1, 0, 11.0, 5.0, 40.0, 20.0, "Hello"), (1, 0, 40.0, 5.0, 40.0, 50.0, "inside"), (1, 0, 90.0, 5.0, 40.0, 99.0, "End")], "doc_id long, page_num long, top double, x0 double, x1 double, bottom double, text string")
    tables = spark.createDataFrame([(1, 0, 0.0, 35.0, 100.0, 60.0, [["a", None], ["b", "c"]])], "doc_id long, page_num long, x1 double, y1 double, x2 double, y2 double, cells array<array<string>>")
    characters = spark.createDataFrame([(1, 0, 1, 10.0, 5.5, "Times-BoldItalic"), (1, 0, 0, 11.5, 60.0, "Other")], "doc_id long, page_num long, ord int, top double, x0 double, font string")
    got = [(r.region_id, r.element_type, r.text_content, r.font, r.bold, r.italic, r.confidence) for r in sources.text_layer(words, tables, characters).orderBy("region_id").collect()]
    assert got == [("r_001", "printed_text", "Hello world", "Times-BoldItalic", True, True, 1.0), ("r_002", "printed_text", "End", "", False, False, 1.0), ("r_003", "table", "a | \nb | c", "", False, False, 1.0)]
    assert sources.text_layer(words.limit(0), tables.limit(0), characters).count() == 0


def test_benchmarks_and_pages_of_specialists(spark):
    truth = spark.createDataFrame([("a", "hello"), ("b", "abc"), ("c", "")], "benchmark string, text string")
    made = spark.createDataFrame([("a", "hello"), ("b", "xyz"), ("z", "q")], "benchmark string, markdown string")
    assert {r.benchmark: r.value for r in audit.run_benchmarks(made, truth, lambda d: d).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    pages = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page_num long")
    found = spark.createDataFrame([(1, "1", ["r"]), (1, "x", ["s"])], "doc_id long, key string, regions array<string>")
    assert {r.page_num: r.regions for r in sources.by_page(pages, found, "key").collect()} == {0: [], 1: ["r"]}

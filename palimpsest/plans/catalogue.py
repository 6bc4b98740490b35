"""Queries of the core over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import geometry as g
from palimpsest.functions import strings as s
from palimpsest.operators import audit, clean, consensus, markdown, matching, service, shred
from palimpsest.plans import pipeline
from palimpsest.plans.runtime import table
from palimpsest.sources import documents as sources
from palimpsest.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2026-01-01 00:00:00"
ROUND = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fixed(*names: str) -> list:
    """Doubles rounded for comparison: the last bits depend on the order of operations."""
    return [F.round(n, ROUND).alias(n) for n in names]


# Code points for DuckDB, whose distance counts bytes: the letters of a pair of texts outside ASCII become ASCII characters that neither has.
def _bytes_sql(a: str, b: str) -> str:
    odd = f"list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]'))"
    free = f"list_filter(list_transform(range(1, 127), lambda i: chr(i::int)), lambda c: not contains({a} || {b}, c))"
    to = f"array_to_string(list_slice({free}, 1, len({odd})), '')"
    return f"levenshtein(translate({a}, array_to_string({odd}, ''), {to}), translate({b}, array_to_string({odd}, ''), {to}))"


STRIP_SQL = r"regexp_replace({0}, '^[\s\v\pZ\x85]+|[\s\v\pZ\x85]+$', '', 'g')"
# --- problem 2 --------------------------------------------------------------------------------------------------------


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.log_records(table(spark, d, "job_results"))


for _name in shred.TABLES:
    QUERIES[f"p2_{_name}"] = lambda spark, d, name=_name: shred.log_table(table(spark, d, "job_results"), name)

# --- geometry and cleaning --------------------------------------------------------------------------------------------

PAGES_SQL = "pages as (select * exclude (rn) from (select *, row_number() over (partition by doc_id, page_num order by scanned_at desc nulls last, dpi desc, width desc, height desc) rn from page_payloads where error is null and width > 0 and height > 0) where rn = 1)"
BOXES_SQL = """box as (select region_key, doc_id, page_num, engine, engine_ord, region_ord, element_type, text_content, confidence,
 case when element_type in ('printed_text','header','footer','page_number') then 'text' when element_type = 'table' then 'table' when element_type = 'handwriting' then 'handwriting'
 when element_type in ('formula','chart','image','seal') then 'specialist' else element_type end as type_group,
 coalesce(nx1, x1) x1, coalesce(ny1, y1) y1, coalesce(nx2, x2) x2, coalesce(ny2, y2) y2 from ocr_regions)"""
PAIRS_SQL = BOXES_SQL + """, pair as (select a.region_key ak, b.region_key bk, a.engine_ord ao, b.engine_ord bo, b.engine be, b.region_ord br, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2, b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2
 from box a join box b on a.doc_id = b.doc_id and a.page_num = b.page_num and a.type_group = b.type_group and a.engine_ord < b.engine_ord and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2),
 part as (select *, (least(ax2,bx2)-greatest(ax1,bx1))*(least(ay2,by2)-greatest(ay1,by1)) inter, (ax2-ax1)*(ay2-ay1) aa, (bx2-bx1)*(by2-by1) ba from pair),
 scored as (select *, inter/(aa+ba-inter) iou, case when least(aa,ba) > 0 then inter/least(aa,ba) else 0.0 end cont,
 sqrt(((ax1+ax2)/2-(bx1+bx2)/2)*((ax1+ax2)/2-(bx1+bx2)/2)+((ay1+ay2)/2-(by1+by2)/2)*((ay1+ay2)/2-(by1+by2)/2)) dist from part)"""


@query(f"with {PAGES_SQL} select r.region_key, round(r.x1/p.width,6) ux1, round(r.y1/p.height,6) uy1, round(r.x2/p.width,6) ux2, round(r.y2/p.height,6) uy2 from ocr_regions r join pages p using (doc_id, page_num)")
def q_unit_bbox(spark: SparkSession, d: str) -> DataFrame:
    """P2"""
    pages = clean.valid_pages(table(spark, d, "page_payloads")).select("doc_id", "page_num", "width", "height")
    joined = table(spark, d, "ocr_regions").select("region_key", "doc_id", "page_num", "x1", "y1", "x2", "y2").join(pages, ["doc_id", "page_num"])
    return joined.select("region_key", *g.as_columns(g.to_unit(g.box(), F.col("width"), F.col("height")), "u")).select("region_key", *fixed("ux1", "uy1", "ux2", "uy2"))


@query(f"with {PAGES_SQL} select region_key, round_even(nx1*width,0)::double px1, round_even(ny1*height,0)::double py1, round_even(nx2*width,0)::double px2, round_even(ny2*height,0)::double py2 from ocr_regions r join pages using (doc_id, page_num) where nx1 is not null and ny1 is not null and nx2 is not null and ny2 is not null")
def q_pixel_bbox(spark: SparkSession, d: str) -> DataFrame:
    """P3"""
    pages = clean.valid_pages(table(spark, d, "page_payloads")).select("doc_id", "page_num", "width", "height")
    r = table(spark, d, "ocr_regions").filter("nx1 is not null and ny1 is not null and nx2 is not null and ny2 is not null").join(pages, ["doc_id", "page_num"])
    unit = {c: F.col(f"n{c}") for c in ("x1", "y1", "x2", "y2")}
    return r.select("region_key", *g.as_columns(g.to_pixels(unit, F.col("width"), F.col("height")), "p"))


SYSTEM_SQL = "case region_key % 4 when 0 then 'pdf_points_topleft' when 1 then 'pixel_topleft' when 2 then 'docling_bottomleft' else 'other' end"
_two = lambda x: f"printf('%.2f', {x})::double"


@query(
    f"with {PAGES_SQL}, b as (select region_key, {SYSTEM_SQL} sys, x1, y1, x2, y2, p.dpi/72.0::double s, p.height::double h from ocr_regions r join pages p using (doc_id, page_num)) select region_key, "
    + ", ".join(f"case sys when 'pdf_points_topleft' then {_two(c + '*s')} when 'pixel_topleft' then {_two(c)} when 'docling_bottomleft' then {_two(b)} end as s{c}" for c, b in (("x1", "x1*s"), ("y1", "h-y2*s"), ("x2", "x2*s"), ("y2", "h-y1*s")))
    + " from b"
)
def q_source_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as if they came in each of the systems in turn"""
    pages = clean.valid_pages(table(spark, d, "page_payloads")).select("doc_id", "page_num", "dpi", "height")
    r = table(spark, d, "ocr_regions").join(pages, ["doc_id", "page_num"])
    return r.select("region_key", *g.as_columns(g.from_source(g.box(), F.expr(SYSTEM_SQL), F.col("dpi"), F.col("height").cast("double")), "s"))


@query(f"with {BOXES_SQL} select region_key, type_group from box")
def q_compat_group(spark: SparkSession, d: str) -> DataFrame:
    """P4"""
    return table(spark, d, "ocr_regions").select("region_key", clean.type_group(F.col("element_type")).alias("type_group"))


@query(f"with {BOXES_SQL} select a.element_type a, b.element_type b, min(a.type_group) = min(b.type_group) as compatible from (select distinct element_type, type_group from box where element_type is not null) a, (select distinct element_type, type_group from box where element_type is not null) b group by 1, 2")
def q_type_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """P5, over the fixed set of types"""
    types = table(spark, d, "ocr_regions").select("element_type").filter("element_type is not null").distinct()
    both = types.agg(F.collect_set("element_type").alias("all")).select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    return both.select("a", "b", clean.compatible(F.col("a"), F.col("b")).alias("compatible"))


@query(r"""select region_key, case when ny1 > 0.93 and (nx2-nx1)*(ny2-ny1) < 0.003 then 'bottom' when nx1 < 0.12 and (nx2-nx1)*(ny2-ny1) < 0.001 and regexp_matches(regexp_replace(coalesce(text_content,''), '^\s+|\s+$', '', 'g'), '^\d{1,2}\.?$') then 'margin_number' end as noise_reason from ocr_regions""")
def q_noise_filter(spark: SparkSession, d: str) -> DataFrame:
    """P6, P7, P8"""
    return table(spark, d, "ocr_regions").select("region_key", clean.noise_reason().alias("noise_reason"))


DISPATCH_SQL = "case element_type when 'handwriting' then 'trocr' when 'formula' then 'dots_formula' when 'chart' then 'dots_chart' end"


@query(f"select region_key, {DISPATCH_SQL} as specialist from ocr_regions where element_type in ('handwriting','formula','chart')")
def q_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """P11"""
    return clean.dispatched(table(spark, d, "ocr_regions")).select("region_key", "specialist")


@query(f"select doc_id, page_num, {DISPATCH_SQL} as specialist, count(*) as n from ocr_regions where element_type in ('handwriting','formula','chart') group by all")
def q_dispatch_counts(spark: SparkSession, d: str) -> DataFrame:
    """A17"""
    return clean.dispatched(table(spark, d, "ocr_regions")).groupBy("doc_id", "page_num", "specialist").agg(F.count("*").alias("n"))


@query("select aligned_key, coalesce(hitl_flag, false) or coalesce(confidence < 0.8, false) as flagged from aligned_regions")
def q_confidence_floor(spark: SparkSession, d: str) -> DataFrame:
    """P12"""
    return table(spark, d, "aligned_regions").select("aligned_key", (F.coalesce("hitl_flag", F.lit(False)) | F.coalesce(F.col("confidence") < 0.8, F.lit(False))).alias("flagged"))


@query("select region_key, case when x1 < 2550*0.15 or x2 > 2550*0.85 then 'marginal' else 'inline' end as position from ocr_regions where element_type = 'handwriting'")
def q_handwriting_position(spark: SparkSession, d: str) -> DataFrame:
    """P14"""
    return table(spark, d, "ocr_regions").filter("element_type = 'handwriting'").select("region_key", g.handwriting_position(F.col("x1"), F.col("x2"), F.lit(2550.0)).alias("position"))


@query("select aligned_key, trunc(x1)::int cx1, trunc(y1)::int cy1, trunc(x2)::int cx2, trunc(y2)::int cy2 from aligned_regions")
def q_crop_box(spark: SparkSession, d: str) -> DataFrame:
    """P15"""
    return table(spark, d, "aligned_regions").select("aligned_key", *[F.col(c).cast("int").alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")])


@query(f"with {PAGES_SQL} select doc_id, page_num, (row_number() over (partition by doc_id order by page_num) - 1)::int as page_index, case when dpi < 200 then 300 else dpi end::int as dpi, least(w, h)::int as width, case when w > h then w else h end::int as height, w > h as was_rotated from (select *, floor(width * case when dpi < 200 then 300.0::double/dpi else 1.0 end) w, floor(height * case when dpi < 200 then 300.0::double/dpi else 1.0 end) h from pages)")
def q_pages(spark: SparkSession, d: str) -> DataFrame:
    """S2, S4, S6, P9, W7"""
    return clean.pages_in_order(table(spark, d, "page_payloads")).select("doc_id", "page_num", F.col("page_index").cast("int").alias("page_index"), *clean.normalised_page())


@query("select result_key, case when lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) in ('.pdf','.png','.jpg','.jpeg','.tiff') then true else false end as readable, case when lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) = '.pdf' then true else false end as text_layer from job_results")
def q_format_gate(spark: SparkSession, d: str) -> DataFrame:
    """S1, P10"""
    return table(spark, d, "job_results").select("result_key", sources.readable(F.col("filename")).alias("readable"), sources.has_text_layer(F.col("filename")).alias("text_layer"))


@query("with n as (select doc_id, max(filename) filename from job_results group by doc_id), p as (select doc_id, page_num, octet_length(pdf) size, hex(pdf) head, lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) ext from page_payloads left join n using (doc_id) where pdf is not null) select doc_id, page_num, case when size > 104857600 then 'too_large' when coalesce(ext, '') not in ('.pdf','.png','.jpg','.jpeg','.tiff') then 'bad_format' when ext = '.pdf' and not starts_with(head, '255044462D') then 'fake_pdf' else 'ok' end upload from p")
def q_upload_check(spark: SparkSession, d: str) -> DataFrame:
    """Page documents under the file name of their job"""
    names = table(spark, d, "job_results").groupBy("doc_id").agg(F.max("filename").alias("filename"))
    p = table(spark, d, "page_payloads").filter("pdf is not null").join(names, "doc_id", "left")
    return p.select("doc_id", "page_num", service.upload_check(F.octet_length("pdf"), F.col("filename"), F.decode(F.substring("pdf", 1, 5), "ISO-8859-1")).alias("upload"))


@query(f"with {BOXES_SQL}, w as (select * from box where engine = 'docling') select l.region_key from (select * from w where element_type <> 'table') l where not exists (select 1 from w t where t.element_type = 'table' and t.doc_id = l.doc_id and t.page_num = l.page_num and l.x1 < t.x2 and t.x1 < l.x2 and l.y1 < t.y2 and t.y1 < l.y2)")
def q_table_overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    """S10"""
    r = table(spark, d, "ocr_regions").filter("engine = 'docling'").select("region_key", "doc_id", "page_num", "element_type", *[F.coalesce(f"n{c}", c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return sources.outside_tables(r.filter("element_type <> 'table'"), r.filter("element_type = 'table'")).select("region_key")


@query("select l.region_key, coalesce(s.score, 0.85) as score from (select * from ocr_regions where engine = 'paddleocr') l left join (select doc_id, page_num, round_even(x1,0)::bigint x1, round_even(y1,0)::bigint y1, round_even(x2,0)::bigint x2, round_even(y2,0)::bigint y2, max(confidence) score from ocr_regions where engine = 'docling' group by all) s on s.doc_id = l.doc_id and s.page_num = l.page_num and s.x1 = round_even(l.x1,0)::bigint and s.y1 = round_even(l.y1,0)::bigint and s.x2 = round_even(l.x2,0)::bigint and s.y2 = round_even(l.y2,0)::bigint")
def q_layout_score_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Scores found by rounded box"""
    r = table(spark, d, "ocr_regions").select("region_key", "engine", "doc_id", "page_num", "x1", "y1", "x2", "y2", "confidence")
    scores = r.filter("engine = 'docling'").select("doc_id", "page_num", "x1", "y1", "x2", "y2", F.col("confidence").alias("score"))
    return sources.with_scores(r.filter("engine = 'paddleocr'").drop("confidence"), scores).select("region_key", "score")


@query("select region_key, 'r_' || lpad((row_number() over (partition by doc_id, page_num, engine order by region_ord, region_key))::varchar, 3, '0') as new_id from ocr_regions")
def q_region_ids(spark: SparkSession, d: str) -> DataFrame:
    """W4"""
    return table(spark, d, "ocr_regions").select("region_key", sources.region_ids(["doc_id", "page_num", "engine"], ["region_ord", "region_key"]).alias("new_id"))


@query("select doc_id, page_num, string_agg(text_content, ' ' order by region_ord, region_key) as text, round(avg(confidence), 6) as confidence, avg(confidence) < 0.2 as hitl from ocr_regions where engine = 'trocr' and text_content <> '' group by all")
def q_handwriting_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """S14, S18"""
    r = table(spark, d, "ocr_regions").filter("engine = 'trocr' and text_content <> ''")
    got = r.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("region_ord", "region_key", "text_content"))).alias("t"), F.avg("confidence").alias("c"))
    return got.select("doc_id", "page_num", F.array_join(F.transform("t", lambda x: x["text_content"]), " ").alias("text"), F.round("c", ROUND).alias("confidence"), (F.col("c") < 0.2).alias("hitl"))


@query("select aligned_key, greatest(0.0, least(1.0, exp((ln(greatest(confidence, 0.0001)) + ln(0.9)) / 2))) >= 0.8 as confident from aligned_regions where confidence is not null")
def q_line_confidence(spark: SparkSession, d: str) -> DataFrame:
    """S17, A24"""
    logs = F.array(F.log(F.greatest("confidence", F.lit(0.0001))), F.log(F.lit(0.9)))
    return table(spark, d, "aligned_regions").filter("confidence is not null").select("aligned_key", (sources.line_confidence(logs) >= 0.8).alias("confident"))


@query()
def q_word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a newspaper page to rows across its columns"""
    boxes = F.posexplode(F.arrays_zip(F.split("text", "\n", -1).alias("t"), F.col("line_boxes").alias("b")))
    z = table(spark, d, "documents").filter("text != '' and line_boxes is not null").select("doc_id", F.coalesce("page_no", F.lit(0)).cast("long").alias("page_num"), boxes.alias("i", "z"))
    words = z.filter("z.b is not null and z.t is not null").select("doc_id", "page_num", F.col("z.b.y1").cast("double").alias("top"), F.col("z.b.x1").cast("double").alias("x0"), F.col("z.t").alias("text"))
    return clean.lines_of_words(words, 12.0)


@query("with c as (select region_key, doc_id, page_num, engine, greatest(0.0, least(x1, x2, 2550.0)) px1, greatest(0.0, least(y1, y2, 3300.0)) py1, greatest(0.0, least(greatest(x1, x2), 2550.0)) px2, greatest(0.0, least(greatest(y1, y2), 3300.0)) py2 from ocr_regions) select region_key, px1, py1, px2, py2, (row_number() over (partition by doc_id, page_num, engine order by py1, px1, region_key))::int line_no from c where px2 > px1 and py2 > py1")
def q_line_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of polygons, clamped to the page, empty ones dropped, from top to bottom"""
    points = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    r = table(spark, d, "ocr_regions").select("region_key", "doc_id", "page_num", "engine", points.alias("points"))
    return sources.line_boxes(r, ["doc_id", "page_num", "engine"], "region_key", 2550.0, 3300.0).select("region_key", "px1", "py1", "px2", "py2", "line_no")


KIND_SQL = "case event_type when 'signup' then 'ValueError' when 'click' then 'KeyError' when 'purchase' then 'PermissionError' when 'view' then 'FileNotFoundError' else 'RuntimeError' end"


@query(f"select event_id, case event_type when 'signup' then 400 when 'click' then 404 when 'purchase' then 403 when 'view' then 404 else 500 end::int status, case event_type when 'signup' then 'invalid input' when 'click' then 'not found' when 'purchase' then 'forbidden' when 'view' then 'not found' else 'internal error' end as label, props as detail from events")
def q_error_category(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of event standing for a kind of error, reported in production and outside it"""
    kind = F.expr(KIND_SQL)
    rows = table(spark, d, "events").select("event_id", service.error_report(kind, F.col("props")).alias("p"), service.error_report(kind, F.col("props"), production=False).alias("o"))
    return rows.select("event_id", "p.status", F.col("p.detail").alias("label"), F.col("o.detail").alias("detail"))


OUTCOMES = "ok missing_key inactive budget_exhausted not_found forbidden pending too_large invalid_upload bad_callback other".split()


@query("select event_id, [200, 401, 401, 429, 404, 403, 202, 413, 422, 400, 500][(event_id % 11 + 1)::int]::int as status from events")
def q_outcome_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of each outcome of the job service, in turn"""
    kind = F.get(F.array(*map(F.lit, OUTCOMES)), (F.col("event_id") % len(OUTCOMES)).cast("int"))
    return table(spark, d, "events").select("event_id", service.status_of(kind).alias("status"))


@query("select c_custkey, case when c_custkey % 5 = 0 then 200 when c_custkey % 3 = 0 then 200 when c_custkey % 3 = 1 and c_custkey % 2 = 0 then 200 else 403 end::int as status from customer")
def q_review_token(spark: SparkSession, d: str) -> DataFrame:
    """A token per customer (none for each fifth), given right by cookie, by parameter only, by parameter behind a wrong cookie, or not at all"""
    k, token = F.col("c_custkey"), F.sha2(F.col("c_custkey").cast("string"), 256)
    expected = F.when(k % 5 != 0, token)
    cookie = F.when(k % 3 == 0, token).when(k % 3 == 2, F.lit("wrong"))
    parameter = F.when(k % 2 == 0, token)
    return table(spark, d, "customer").select("c_custkey", service.token_check(expected, cookie, parameter).alias("status"))


@query("with a as (select job_id id, list_slice(list(case when filename is null then 500 else 200 end order by received_at nulls first, case when filename is null then 500 else 200 end), 1, 3) s from job_results group by job_id), b as (select id, s, list_position(list_transform(s, lambda x: x < 400), true) p from a) select id, coalesce(nullif(p, 0), len(s))::int attempts, coalesce(p, 0) > 0 delivered, [0, 1, 5][coalesce(nullif(p, 0), len(s))::int]::int waited_s from b")
def q_delivery_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Tries of a callback per job, its deliveries standing for answers"""
    r = table(spark, d, "job_results").groupBy(F.col("job_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("received_at", F.when(F.col("filename").isNull(), 500).otherwise(200).alias("s")))).alias("a"))
    return service.delivery_attempts(r.select("id", F.transform("a", lambda x: x["s"]).alias("statuses")))


# --- matching ---------------------------------------------------------------------------------------------------------


@query(f"with {PAIRS_SQL} select ak a_region_key, bk b_region_key, round(iou,6) iou from scored where iou >= 0.5")
def q_iou_candidates(spark: SparkSession, d: str) -> DataFrame:
    """J1, J4"""
    return matching.scored(matching.pairs(table(spark, d, "ocr_regions"))).filter("iou >= 0.5").select("a_region_key", "b_region_key", *fixed("iou"))


@query(f"with {PAIRS_SQL} select ak a_region_key, bk b_region_key, round(dist,6) centre_distance from scored where iou > 0.05 and iou < 0.5 and dist <= 0.05")
def q_center_rescue_candidates(spark: SparkSession, d: str) -> DataFrame:
    """J3, J5"""
    return matching.scored(matching.pairs(table(spark, d, "ocr_regions"))).filter("iou > 0.05 and iou < 0.5 and centre_distance <= 0.05").select("a_region_key", "b_region_key", *fixed("centre_distance"))


@query(f"with {PAIRS_SQL} select ak a_region_key, bk b_region_key, round(cont,6) containment from scored where cont >= 0.6")
def q_containment_candidates(spark: SparkSession, d: str) -> DataFrame:
    """J2, J6, J7"""
    return matching.scored(matching.pairs(table(spark, d, "ocr_regions"))).filter("containment >= 0.6").select("a_region_key", "b_region_key", *fixed("containment"))


@query(f"with {PAIRS_SQL} select a_region_key, b_engine, b_region_key, round(iou,6) iou from (select ak a_region_key, be b_engine, bk b_region_key, iou, row_number() over (partition by ak, be order by iou desc, br, bk) rn from scored where iou >= 0.5) where rn = 1")
def q_best_match(spark: SparkSession, d: str) -> DataFrame:
    """W2, T6"""
    return matching.best_matches(table(spark, d, "ocr_regions")).select("a_region_key", "b_engine", "b_region_key", *fixed("iou"))


NOISE_SQL = r"case when ny1 > 0.93 and (nx2-nx1)*(ny2-ny1) < 0.003 then 'bottom' when nx1 < 0.12 and (nx2-nx1)*(ny2-ny1) < 0.001 and regexp_matches(regexp_replace(coalesce(text_content,''), '^\s+|\s+$', '', 'g'), '^\d{1,2}\.?$') then 'margin_number' end"


@query(f"""with recursive n as (select * from ocr_regions where {NOISE_SQL} is null and nx1 is not null and ny1 is not null and nx2 is not null and ny2 is not null),
 e as (select a.region_key a, b.region_key b from n a join n b on a.doc_id = b.doc_id and a.page_num = b.page_num and a.engine = b.engine and a.element_type = b.element_type and greatest(a.nx1, b.nx1) - least(a.nx2, b.nx2) < 0.05 and a.ny1 < b.ny2 and b.ny1 < a.ny2),
 reach as (select region_key a, region_key b from n union select r.a, e.b from reach r join e on r.b = e.a), g as (select a region_key, min(b) root from reach group by a),
 f as (select n.*, root, struct_pack(x := nx1, o := region_ord, k := region_key) as place from n join g using (region_key))
 select min(doc_id) doc_id, min(page_num) page_num, min(engine) engine, arg_min(region_key, place) region_key, arg_min(region_id, place) region_id, min(element_type) element_type, min(nx1) nx1, min(ny1) ny1, max(nx2) nx2, max(ny2) ny2, min(confidence) confidence,
 coalesce(string_agg(text_content, ' ' order by nx1, region_ord, region_key) filter (where text_content <> ''), '') text_content, count(*)::int parts, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 from f group by root""")
def q_fragment_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of every engine, without noise"""
    return clean.merged_fragments(clean.without_noise(table(spark, d, "ocr_regions"))).drop("hierarchy_level", "table_structure")


@query()
def q_match_groups(spark: SparkSession, d: str) -> DataFrame:
    """J4 to J9, J11, A1, A4, A5, Q1"""
    return matching.match_groups(clean.without_noise(table(spark, d, "ocr_regions")))


@query()
def q_wbf(spark: SparkSession, d: str) -> DataFrame:
    """The fusion stage alone"""
    return matching.match_groups(table(spark, d, "ocr_regions"), stages=(matching.by_fusion,))


@query()
def q_cluster(spark: SparkSession, d: str) -> DataFrame:
    """The clustering stage alone"""
    return matching.match_groups(table(spark, d, "ocr_regions"), stages=(matching.by_linkage,))


@query()
def q_resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    """A20"""
    return matching.resolution(matching.match_groups(clean.without_noise(table(spark, d, "ocr_regions"))))


@query("select doc_id, page_num, region_id, round(avg(x1),6) x1, round(avg(y1),6) y1, round(avg(x2),6) x2, round(avg(y2),6) y2, count(*) n from ocr_regions group by doc_id, page_num, region_id")
def q_avg_bbox(spark: SparkSession, d: str) -> DataFrame:
    """A1"""
    return table(spark, d, "ocr_regions").groupBy("doc_id", "page_num", "region_id").agg(*[F.round(F.avg(c), ROUND).alias(c) for c in ("x1", "y1", "x2", "y2")], F.count("*").alias("n"))


WEIGHT_SQL = "case engine when 'pdfplumber' then 3.0 when 'trocr' then 2.0 else 1.0 end::double"


@query("select doc_id, page_num, region_id, " + ", ".join(f"round(sum({c}*{WEIGHT_SQL})/sum({WEIGHT_SQL}),6) {c}" for c in ("x1", "y1", "x2", "y2")) + " from ocr_regions group by doc_id, page_num, region_id")
def q_fused_box(spark: SparkSession, d: str) -> DataFrame:
    """A12, A9"""
    w = F.coalesce(clean.lookup({k: str(v) for k, v in matching.FUSION_WEIGHTS.items()}, F.col("engine")).cast("double"), F.lit(1.0))
    return table(spark, d, "ocr_regions").groupBy("doc_id", "page_num", "region_id").agg(*[F.round(F.sum(F.col(c) * w) / F.sum(w), ROUND).alias(c) for c in ("x1", "y1", "x2", "y2")])


# --- texts and decisions ----------------------------------------------------------------------------------------------

READINGS_SQL = "r as (select aligned_key, list_filter(engine_texts, lambda e: e.engine is not null and e.text is not null) e from aligned_regions where engine_texts is not null)"


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Stored regions with the flag of their page: whether its text layer is trusted."""
    return consensus.with_truth(table(spark, d, "aligned_regions"), consensus.page_quality(table(spark, d, "ocr_regions")))


@query()
def q_resolve_region(spark: SparkSession, d: str) -> DataFrame:
    """Weights by whether the text layer of the page agrees with the layout recogniser"""
    return consensus.resolve(_aligned(spark, d), truth=F.col("truth")).select("aligned_key", "source", "resolved_text", *fixed("ce", "agreement"), "needs_arbitration")


@query(f"with {READINGS_SQL}, s as (select a.aligned_key, a.doc_id, a.page_num, a.confidence, list_transform(r.e, lambda x: x.text) t from aligned_regions a join r using (aligned_key)) select aligned_key, case len(t) when 0 then 'pending' when 1 then 'single_engine' else 'identical' end source, case when len(t) > 0 then list_extract(t, 1) end resolved_text, case when len(t) > 0 then coalesce(confidence, 0.0) else 0.0 end agreement from s where len(list_distinct(t)) < 2")
def q_undisputed(spark: SparkSession, d: str) -> DataFrame:
    """Regions whose readings are all equal, or that have one or none"""
    got = consensus.resolve(table(spark, d, "aligned_regions").filter("engine_texts is not null")).filter(F.col("source").isin("pending", "single_engine", "identical"))
    return got.select("aligned_key", "source", "resolved_text", "agreement")


@query(f"with {READINGS_SQL} select aligned_key, len(e)::int as engines, len(list_distinct(list_transform(e, lambda x: x.text)))::int as texts, len(list_distinct(list_transform(e, lambda x: x.text))) = 1 as identical from r")
def q_distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    """A22, U4"""
    e = F.filter("engine_texts", lambda x: x["engine"].isNotNull() & x["text"].isNotNull())
    n = F.size(F.array_distinct(F.transform(e, lambda x: x["text"])))
    return table(spark, d, "aligned_regions").filter("engine_texts is not null").select("aligned_key", F.size(e).alias("engines"), n.alias("texts"), (n == 1).alias("identical"))


@query("select aligned_key, e.engine, consensus_text as a, e.text as b, true as equal_length from aligned_regions, unnest(engine_texts) u(e) where consensus_text is not null and e.text <> consensus_text")
def q_nw_align(spark: SparkSession, d: str) -> DataFrame:
    """consensus against every reading that differs; without their gaps the aligned texts are the texts, and both are as long"""
    r = table(spark, d, "aligned_regions").filter("consensus_text is not null").select("aligned_key", "consensus_text", F.explode("engine_texts").alias("e")).filter("e.text != consensus_text")
    got = r.select("aligned_key", "e.engine", s.aligned_pair(F.col("consensus_text"), F.col("e.text")).alias("p"))
    plain = lambda c: F.replace(c, F.lit(s.GAP), F.lit(""))
    return got.select("aligned_key", "engine", plain(F.col("p.a")).alias("a"), plain(F.col("p.b")).alias("b"), (F.length("p.a") == F.length("p.b")).alias("equal_length"))


@query()
def q_quality_check(spark: SparkSession, d: str) -> DataFrame:
    """The text layer of a page against the layout recogniser"""
    return consensus.page_quality(table(spark, d, "ocr_regions"))


@query(f"select aligned_key, exists(select 1 from unnest(list_transform(engine_texts, lambda x: x.text)) u(t) where t is not null and {_bytes_sql('consensus_text', 't')} <= 3) as near from aligned_regions where consensus_text is not null and engine_texts is not null")
def q_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """F2"""
    r = table(spark, d, "aligned_regions").filter("consensus_text is not null and engine_texts is not null")
    texts = F.filter(F.transform("engine_texts", lambda e: e["text"]), lambda t: t.isNotNull())
    return r.select("aligned_key", F.coalesce(s.within_edits(F.col("consensus_text"), texts, 3), F.lit(False)).alias("near"))


@query("select aligned_key, len(list_filter(range(1, greatest(length(consensus_text) - 4, 1)), lambda i: length(consensus_text) >= 6 and not list_bool_or(list_transform(list_filter(engine_texts, lambda e: e.text is not null), lambda e: contains(e.text, substring(consensus_text, i, 6)))))) > 0 as inserted from aligned_regions where consensus_text is not null and len(list_filter(engine_texts, lambda e: e.text is not null)) > 0")
def q_consecutive_insertion(spark: SparkSession, d: str) -> DataFrame:
    """F3"""
    texts = F.filter(F.transform("engine_texts", lambda e: e["text"]), lambda t: t.isNotNull())
    r = table(spark, d, "aligned_regions").withColumn("texts", texts).filter("consensus_text is not null and size(texts) > 0")
    return r.select("aligned_key", s.inserts_run(F.col("consensus_text"), F.col("texts")).alias("inserted"))


@query("select region_key, " + ", ".join(f"array_to_string(regexp_extract_all(text_content, '{p}'), '; ') as {k}" for k, p in s.LEGAL_FIELDS.items()) + " from ocr_regions where text_content is not null")
def q_legal_fields(spark: SparkSession, d: str) -> DataFrame:
    """F4"""
    return table(spark, d, "ocr_regions").filter("text_content is not null").select("region_key", *[F.array_join(s.legal_values(F.col("text_content"), f), "; ").alias(f) for f in s.LEGAL_FIELDS])


TEXTS_SQL = "list_filter(list_transform(engine_texts, lambda e: e.text), lambda t: t is not null)"


def _invented_sql(output: str) -> str:
    of = lambda k, p: f"list_transform(list_sort(list_filter(list_distinct(regexp_extract_all({output}, '{p}')), lambda v: not list_contains(flatten(list_transform(texts, lambda t: regexp_extract_all(t, '{p}'))), v))), lambda v: '{k}: ' || v)"
    return "array_to_string(flatten([" + ", ".join(of(k, p) for k, p in s.LEGAL_FIELDS.items()) + "]), '; ')"


@query(f"select * from (select aligned_key, {_invented_sql('consensus_text')} as warnings from (select *, {TEXTS_SQL} texts from aligned_regions where consensus_text is not null and engine_texts is not null)) where warnings <> ''")
def q_novel_fields(spark: SparkSession, d: str) -> DataFrame:
    """Legal values of the consensus that no reading has"""
    texts = F.filter(F.transform("engine_texts", lambda e: e["text"]), lambda t: t.isNotNull())
    r = table(spark, d, "aligned_regions").filter("consensus_text is not null and engine_texts is not null").withColumn("texts", texts)
    return r.select("aligned_key", F.array_join(s.invented_values(F.col("consensus_text"), F.col("texts")), "; ").alias("warnings")).filter("warnings != ''")


NEAR_SQL = f"exists(select 1 from unnest(texts) u(t) where {_bytes_sql('consensus_text', 't')} <= case when element_type = 'handwriting' then 5 else 3 end)"
INSERTED_SQL = "len(list_filter(range(1, greatest(length(consensus_text) - 4, 1)), lambda i: length(consensus_text) >= 6 and not coalesce(list_bool_or(list_transform(texts, lambda t: contains(t, substring(consensus_text, i, 6)))), false))) > 0"


@query(f"""with v as (select aligned_key, consensus_text, {_invented_sql('consensus_text')} w, case when consensus_text is null then 'hitl_fallback' when contains(consensus_text, '<UNREADABLE>') then 'llm_unreadable' when not {NEAR_SQL} then 'rejected_edit_distance' when {INSERTED_SQL} then 'rejected_insertion' else 'arbitration' end source
 from (select *, {TEXTS_SQL} texts from aligned_regions where source = 'arbitration')) select aligned_key, case source when 'arbitration' then consensus_text when 'llm_unreadable' then '' end as text, source, source not in ('arbitration', 'llm_unreadable') as rejected, source <> 'arbitration' as hitl_flag, case when source = 'arbitration' then w else '' end as warnings from v""")
def q_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The stored consensus taken as an arbiter's answer; handwriting allows five edits"""
    texts = F.filter(F.transform("engine_texts", lambda e: e["text"]), lambda t: t.isNotNull())
    r = table(spark, d, "aligned_regions").withColumn("texts", texts).filter("source = 'arbitration'")
    v = F.when(F.col("element_type") == "handwriting", s.verdict(F.col("consensus_text"), F.col("texts"), consensus.HANDWRITING_EDITS)).otherwise(s.verdict(F.col("consensus_text"), F.col("texts"), consensus.EDITS))
    return r.select("aligned_key", v.alias("v")).select("aligned_key", "v.*").withColumn("warnings", F.array_join("warnings", "; "))


@query()
def q_arbitrate(spark: SparkSession, d: str) -> DataFrame:
    """Regions of high disagreement, the stored consensus as the arbiter's answer"""
    return consensus.arbitrated(consensus.resolve(_aligned(spark, d), truth=F.col("truth"), answer=F.col("consensus_text")))


@query()
def q_offline_arbiter(spark: SparkSession, d: str) -> DataFrame:
    """The same with an arbiter that chooses among the candidates"""
    return consensus.arbitrated(consensus.resolve(_aligned(spark, d), truth=F.col("truth")), consensus.offline_arbiter(F.col("candidates")))


@query(f"with {READINGS_SQL} select aligned_key, array_to_string(list_transform(list_sort(e), lambda x, i: 'Candidate ' || chr((64 + i)::int) || ': ' || x.text), chr(10)) as block from r")
def q_anon_candidates(spark: SparkSession, d: str) -> DataFrame:
    """W5, F18"""
    e = F.filter("engine_texts", lambda x: x["engine"].isNotNull() & x["text"].isNotNull())
    return table(spark, d, "aligned_regions").filter("engine_texts is not null").select("aligned_key", s.candidate_block(s.anonymous(e)).alias("block"))


# --- Markdown ---------------------------------------------------------------------------------------------------------

ORDER_SQL = "row_number() over (partition by doc_id, page_num order by coalesce(try_cast(metadata['hierarchy_level'] as double), 'inf'::double), y1 nulls last, x1 nulls last, aligned_key)"
# cells of a table's text {0} by the expression {1} over a row r, and those cells as a pipe table
CELLS_SQL = "list_transform(list_filter(string_split(" + STRIP_SQL.format("{0}") + ", chr(10)), lambda r: " + STRIP_SQL.format("r") + " <> ''), lambda r: list_transform({1}, lambda c: " + STRIP_SQL.format("c") + "))"
TABLE_SQL = "array_to_string(list_transform(cells, lambda r, i: '| ' || array_to_string(list_concat(r, list_transform(range(width - len(r)), lambda x: '')), ' | ') || ' |' || case when i = 1 then chr(10) || '| ' || array_to_string(list_transform(range(width), lambda x: '---'), ' | ') || ' |' else '' end), chr(10))"
# every kind that is printed; tables and unusual metadata are rendered by the same rules
MD_SQL = f"""md as (select *, {ORDER_SQL} as rank, case when element_type in ('footer','page_number','seal','image') then '' when coalesce(hitl_flag, false) then
 case when content = '' then note else content || chr(10) || note end else content end as md from (select *,
 '<!-- REVIEW NEEDED: [' || x1::varchar || ',' || y1::varchar || ',' || x2::varchar || ',' || y2::varchar || '] page=' || page_num || ' confidence=' || printf('%.2f', coalesce(confidence, 0.0)) || ' -->' as note,
 case element_type when 'table' then table_md when 'header' then repeat('#', greatest(1, least(6, coalesce(try_cast(metadata['hierarchy_level'] as int), 2)))) || ' ' || t
 when 'formula' then case when t = '' then '[Formula: unreadable, see page ' || (page_num + 1) || ']' when contains(t, chr(10)) or length(t) > 80 then '$$' || t || '$$' else '$' || t || '$' end
 when 'chart' then case when coalesce(metadata['svg_content'], '') <> '' then metadata['svg_content'] else '[Chart: extraction failed, see page ' || (page_num + 1) || ']' end
 when 'handwriting' then case when x1 < coalesce(try_cast(metadata['page_width'] as double), 2550)*0.15 or x2 > coalesce(try_cast(metadata['page_width'] as double), 2550)*0.85 then '*[Margin note: ' || t || ']* <!-- handwritten-margin [' || x1::varchar || ',' || y1::varchar || ',' || x2::varchar || ',' || y2::varchar || '] -->' else '*' || t || '* <!-- handwritten -->' end
 else t end as content from (select *, coalesce(consensus_text, '') t,
 case when metadata['table_markdown'] is not null then metadata['table_markdown'] when contains(metadata['table_html'], 'colspan') or contains(metadata['table_html'], 'rowspan') then metadata['table_html'] when len(cells) = 0 then '' else {TABLE_SQL} end as table_md
 from (select *, list_max(list_transform(cells, lambda r: len(r))) as width from (select *, {CELLS_SQL.format("coalesce(consensus_text, '')", "string_split(r, chr(9))")} as cells from aligned_regions)))))"""


@query(f"with o as (select aligned_key, {ORDER_SQL}::int as rank from aligned_regions) select * from o")
def q_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """W1, T3"""
    return table(spark, d, "aligned_regions").select("aligned_key", markdown.reading_order().alias("rank"))


@query(f"with {MD_SQL} select aligned_key, md from md")
def q_region_markdown(spark: SparkSession, d: str) -> DataFrame:
    """F8 to F16, P13"""
    return table(spark, d, "aligned_regions").select("aligned_key", markdown.region_markdown().alias("md"))


@query(f"with {MD_SQL} select doc_id, page_num, coalesce(string_agg(md, chr(10) || chr(10) order by rank) filter (where md <> ''), '') as page_markdown from md group by doc_id, page_num")
def q_page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """F17"""
    return markdown.pages(table(spark, d, "aligned_regions"))


@query(f"with h as (select *, {ORDER_SQL} as rank, min(page_num) over (partition by doc_id) as first from aligned_regions), t as (select doc_id, consensus_text, row_number() over (partition by doc_id order by rank) rn from h where element_type = 'header' and page_num = first) select d.doc_id, consensus_text as title from (select distinct doc_id from aligned_regions) d left join t on t.doc_id = d.doc_id and rn = 1")
def q_title(spark: SparkSession, d: str) -> DataFrame:
    """The first header on the first page"""
    return markdown.titles(table(spark, d, "aligned_regions"))


@query(f"""with {MD_SQL}, p as (select doc_id, page_num, coalesce(string_agg(md, chr(10) || chr(10) order by rank) filter (where md <> ''), '') t from md group by doc_id, page_num),
 n as (select *, row_number() over (partition by doc_id order by page_num) part_no from p), c as (select doc_id, count(*) pages from p group by doc_id) select doc_id, part_no, case when part_no > 1 then chr(10) || chr(10) || '---' || chr(10) || chr(10) else '' end || t as part from n""")
def q_document_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The pages of the documents; the front matter is q_front_matter"""
    return markdown.documents(table(spark, d, "aligned_regions"), "2026-01-01T00:00:00Z").filter("part_no > 0")


TITLES_SQL = f"h as (select *, {ORDER_SQL} as rank, min(page_num) over (partition by doc_id) as first from aligned_regions), t as (select doc_id, nullif(consensus_text, '') t from (select doc_id, consensus_text, row_number() over (partition by doc_id order by rank) rn from h where element_type = 'header' and page_num = first) where rn = 1)"


@query(f"""with {TITLES_SQL}, c as (select doc_id, count(distinct page_num) pages from aligned_regions group by doc_id), x as (select c.doc_id, pages, coalesce(t, 'Untitled Document') t from c left join t using (doc_id))
 select doc_id, 0::bigint part_no, '---' || chr(10) || 'pages: ' || pages || chr(10) || 'processed: ' || chr(39) || '2026-01-01T00:00:00Z' || chr(39) || chr(10) || 'title: ' || case when regexp_matches(t, '[\\x00-\\x1f\\x7f-\\x{{9f}}]') then to_json(t)::varchar when regexp_matches(t, '{markdown.YAML_WORDS}') or regexp_matches(t, '{markdown.YAML_NUMBERS}') or regexp_matches(t, '{markdown.YAML_SIGNS.replace(chr(39), chr(39) * 2)}') then chr(39) || replace(t, chr(39), chr(39) || chr(39)) || chr(39) else t end || chr(10) || '---' || chr(10) || chr(10) as part from x""")
def q_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """K1, D5, W6"""
    return markdown.documents(table(spark, d, "aligned_regions"), "2026-01-01T00:00:00Z").filter("part_no = 0")


BARS_SQL = "regexp_split_to_array(r, ' ?[|] ?')"


@query(f"with c as (select region_key, cells, list_max(list_transform(cells, lambda r: len(r))) width from (select region_key, {CELLS_SQL.format('text_content', BARS_SQL)} cells from ocr_regions where element_type = 'table' and text_content is not null)) select region_key, case when len(cells) = 0 then '' else {TABLE_SQL} end as md, greatest(0, case when len(cells) = 0 then 0 else len(cells) end)::int as \"rows\", case when len(cells) = 0 then 0 else width end::int as cols from c")
def q_pipe_table(spark: SparkSession, d: str) -> DataFrame:
    """Tables of bar-separated text; a table's rows are its lines but the rule"""
    r = table(spark, d, "ocr_regions").filter("element_type = 'table' and text_content is not null")
    md = s.pipe_table(F.col("text_content"), r" ?[|] ?")
    return r.select("region_key", md.alias("md")).select("region_key", "md", sources.table_shape(F.col("md")).alias("shape")).select("region_key", "md", "shape.*")


@query("select region_key, '<g></g><a onclick=z>' || text_content as svg from ocr_regions where element_type = 'chart' and text_content is not null")
def q_svg_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """F8: charts with a script and handlers put in, some behind several blanks, one without quotes"""
    r = table(spark, d, "ocr_regions").filter("element_type = 'chart' and text_content is not null")
    return r.select("region_key", s.clean_svg(F.concat(F.lit('<g \n  onclick="x()"   onload = \'y()\'><SCRIPT a="b">y(\n)</script></g><a onclick=z>'), "text_content")).alias("svg"))


@query("select region_key, regexp_replace(text_content, '\\s', '', 'g') <> '' and ((length(text_content) - length(replace(text_content, '$$', ''))) / 2) % 2 = 0 and (length(replace(text_content, '$$', '')) - length(replace(text_content, '$', '')) - (length(text_content) - length(replace(text_content, '$$', ''))) * 0) % 1 = 0 and (length(replace(text_content, '$$', '')) - length(replace(replace(text_content, '$$', ''), '$', ''))) % 2 = 0 as valid from ocr_regions where element_type = 'formula' and text_content is not null")
def q_latex_valid(spark: SparkSession, d: str) -> DataFrame:
    """S19, S20"""
    return table(spark, d, "ocr_regions").filter("element_type = 'formula' and text_content is not null").select("region_key", s.latex_valid(F.col("text_content")).alias("valid"))


# --- audit ------------------------------------------------------------------------------------------------------------

PAGE_LOG_SQL = "page_log as (select doc_id, page_num, count(*) region_count, count(*) filter (source = 'arbitration') llm_count, count(*) filter (coalesce(hitl_flag, false)) hitl_count from aligned_regions group by doc_id, page_num)"


@query(f"with {PAGE_LOG_SQL} select * from page_log")
def q_page_log(spark: SparkSession, d: str) -> DataFrame:
    """A14 without costs, which stored regions don't have; see q_log_pages"""
    return audit.page_log(table(spark, d, "aligned_regions"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name: shred.log_table(table(spark, d, "job_results"), name)
    return audit.log_pages(of("pages"), of("regions"), of("engine_durations"))


@query()
def q_log_pages(spark: SparkSession, d: str) -> DataFrame:
    """Counts and cost of every page of every log"""
    return _logs(spark, d)


@query()
def q_log_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every log"""
    return audit.log_jobs(_logs(spark, d)).select("result_key", "pages", "regions", "llm_count", "hitl_count", "cost_nano", *fixed("llm_rate"))


@query(f"with {PAGE_LOG_SQL} select doc_id, count(*) pages, sum(region_count)::bigint regions, sum(llm_count)::bigint llm_count, sum(hitl_count)::bigint hitl_count, round(sum(llm_count)/greatest(1, sum(region_count)), 6) llm_rate from page_log group by doc_id")
def q_job_log(spark: SparkSession, d: str) -> DataFrame:
    """A15"""
    return audit.job_log(table(spark, d, "aligned_regions")).withColumn("llm_rate", F.round("llm_rate", ROUND))


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return audit.page_costs(shred.log_table(table(spark, d, "job_results"), "engine_durations"))


@query()
def q_page_cost(spark: SparkSession, d: str) -> DataFrame:
    """A16"""
    return _costs(spark, d)


@query()
def q_budget_cut(spark: SparkSession, d: str) -> DataFrame:
    """Pages within a budget of 0.002 dollars a job"""
    return audit.within_budget(_costs(spark, d), 2_000_000)


@query("with t as (select user_id, sum(round(value*100)::bigint)::bigint cents from events group by user_id) select 'job_' || user_id job_id, user_id::varchar key_hash, cents/100 spent_usd, 1000.0::double budget_usd, 0.8::double threshold_pct, cents/100 >= 1000 exceeded, 'Job job_' || user_id || ' has used ' || printf('%.1f', cents/100/1000.0::double*100) || '% of budget ($' || printf('%.4f', cents/100) || '/$' || printf('%.4f', 1000.0::double) || ')' as message from t where cents/100 >= 800")
def q_cost_alerts(spark: SparkSession, d: str) -> DataFrame:
    """A job per key"""
    totals = service.spend_totals(service.spend_buckets(table(spark, d, "events")))
    spent = totals.select(F.concat(F.lit("job_"), F.col("key_id").cast("string")).alias("job_id"), F.col("key_id").cast("string").alias("key_hash"), (F.col("cents") / 100).alias("spent_usd"), F.lit(1000.0).alias("budget_usd"))
    return audit.alerts(spent)


@query(f"select c.aligned_key, round({_bytes_sql('e.text', 'c.consensus_text')} / greatest(length(c.consensus_text), 1), 6) as cer, e.engine from aligned_regions c, unnest(engine_texts) u(e) where c.consensus_text is not null and e.text is not null")
def q_cer(spark: SparkSession, d: str) -> DataFrame:
    """Each reading against the consensus"""
    r = table(spark, d, "aligned_regions").filter("consensus_text is not null").select("aligned_key", "consensus_text", F.explode("engine_texts").alias("e")).filter("e.text is not null")
    return r.select("aligned_key", F.round(audit.character_errors(F.col("e.text"), F.col("consensus_text")), ROUND).alias("cer"), F.col("e.engine").alias("engine"))


@query(f"with {MD_SQL}, m as (select doc_id || '/' || page_num benchmark, coalesce(string_agg(md, chr(10) || chr(10) order by rank) filter (where md <> ''), '') p, coalesce(string_agg(consensus_text, chr(10) order by aligned_key), '') t from md group by doc_id, page_num) select benchmark, 'cer' as metric, round({_bytes_sql('p', 't')} / greatest(length(t), 1), 6) as value from m")
def q_benchmark_run(spark: SparkSession, d: str) -> DataFrame:
    """The rendering of pages as the pipeline, their plain texts as the truth"""
    aligned = table(spark, d, "aligned_regions")
    name = F.concat_ws("/", "doc_id", "page_num").alias("benchmark")
    texts = F.array_sort(F.collect_list(F.when(F.col("consensus_text").isNotNull(), F.struct("aligned_key", "consensus_text"))))
    truth = aligned.groupBy("doc_id", "page_num").agg(texts.alias("t")).select(name, F.array_join(F.transform("t", lambda x: x["consensus_text"]), "\n").alias("text"))
    got = audit.run_benchmarks(aligned, truth, lambda regions: markdown.pages(regions).select(name, F.col("page_markdown").alias("markdown")))
    return got.select("benchmark", "metric", *fixed("value"))


def _regressions(spark: SparkSession, d: str) -> DataFrame:
    by_engine = q_cer(spark, d).groupBy(F.col("engine").alias("benchmark")).agg(F.avg("cer").alias("value")).withColumn("metric", F.lit("cer"))
    limits = spark.createDataFrame([(e, "cer", 0.002) for e in consensus.ENGINE_ORDER], "benchmark string, metric string, limit double")
    return audit.regressions(by_engine, limits)


REGRESSIONS_SQL = f"m as (select e.engine as benchmark, avg(round({_bytes_sql('e.text', 'c.consensus_text')} / greatest(length(c.consensus_text), 1), 6)) as value from aligned_regions c, unnest(engine_texts) u(e) where c.consensus_text is not null and e.text is not null group by e.engine), r as (select benchmark, 'cer' as metric, round(value, 6) as value, 0.002::double as \"limit\" from m where value > 0.002 and benchmark in ('pdfplumber', 'paddleocr', 'docling', 'trocr', 'dots'))"


@query(f"with {REGRESSIONS_SQL} select * from r")
def q_baseline_check(spark: SparkSession, d: str) -> DataFrame:
    """Engines whose mean error rate is above a limit"""
    return _regressions(spark, d).select("benchmark", "metric", *fixed("value", "limit"))


@query(f"with {REGRESSIONS_SQL}, n as (select count(*) n from r), x as (select 0 line_no, '# Regression Report' line union all select 1, '' union all select 2, case when n = 0 then 'All benchmarks passing.' else '**' || n || ' regression(s) detected.**' end from n union all select 3, '' from n where n > 0 union all select 4, '| Benchmark | Metric | Expected | Actual |' from n where n > 0 union all select 5, '|-----------|--------|----------|--------|' from n where n > 0 union all select (5 + row_number() over (order by benchmark, metric))::int, '| ' || benchmark || ' | ' || metric || ' | ' || printf('%.4f', \"limit\") || ' | ' || printf('%.4f', value) || ' |' from r) select line_no::int line_no, line from x")
def q_regression_report(spark: SparkSession, d: str) -> DataFrame:
    """K6: title, count and table, or that all pass"""
    return audit.regression_report(_regressions(spark, d))


# --- service ----------------------------------------------------------------------------------------------------------

BUCKETS_SQL = "buckets as (select user_id key_id, strftime(ts, '%Y%m%d%H') bucket, sum(round(value*100)::bigint)::bigint cents from events group by all)"


@query(f"with {BUCKETS_SQL} select * from buckets")
def q_spend_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A19, D1"""
    return service.spend_buckets(table(spark, d, "events"))


@query(f"with {BUCKETS_SQL} select key_id, sum(cents)::bigint cents from buckets group by key_id")
def q_spend_total(spark: SparkSession, d: str) -> DataFrame:
    """A18"""
    return service.spend_totals(service.spend_buckets(table(spark, d, "events")))


@query(f"with {BUCKETS_SQL}, t as (select key_id, sum(cents)::bigint cents from buckets group by key_id), k as (select c_custkey key_id, c_acctbal > 0 active, greatest(0, round(c_acctbal)::bigint * 100) budget_cents from customer) select coalesce(t.key_id, k.key_id) key_id, coalesce(cents, 0) cents, case when active is null then 'missing_key' when not active then 'inactive' when coalesce(cents, 0) >= budget_cents then 'budget_exhausted' else 'ok' end status from t full join k on t.key_id = k.key_id")
def q_key_status(spark: SparkSession, d: str) -> DataFrame:
    """Customers as keys"""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key_id"), (F.col("c_acctbal") > 0).alias("active"), F.greatest(F.lit(0), F.round("c_acctbal").cast("long") * 100).alias("budget_cents"))
    return service.key_status(keys, service.spend_totals(service.spend_buckets(table(spark, d, "events"))))


@query("select o_custkey key_id, (arg_max(round(o_totalprice)::bigint, struct_pack(a := o_orderdate, b := o_orderkey))) budget_cents, true active from orders group by o_custkey")
def q_key_registration(spark: SparkSession, d: str) -> DataFrame:
    """P25, K3: the latest order of a customer as the latest registration of a key"""
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("key_id"), F.round("o_totalprice").cast("long").alias("budget_cents"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return service.registered(keys)


@query(f"with {BUCKETS_SQL}, m as (select max(ts) m from events) select b.* from buckets b, m where strptime(bucket, '%Y%m%d%H') < timestamp '2024-01-20 00:00:00' - interval 7 days")
def q_purge_buckets(spark: SparkSession, d: str) -> DataFrame:
    """D2, D4"""
    return service.expired_buckets(service.spend_buckets(table(spark, d, "events")), "2024-01-20 00:00:00", 7)


@query(f"select result_key from job_results where received_at is null or received_at < timestamp '{NOW}' - interval 30 days")
def q_purge_entries(spark: SparkSession, d: str) -> DataFrame:
    """D3"""
    e = table(spark, d, "job_results").select("result_key", F.col("received_at").alias("created_at"), F.lit("dict").alias("entry_kind"))
    return service.expired_entries(e, NOW).select("result_key")


@query("select event_id, user_id, n::int n, (60 - second(ts))::int retry_after_s from (select *, row_number() over (partition by user_id, date_trunc('minute', ts) order by ts, event_id) n from events) where n > 1")
def q_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Second and further requests of a key in a minute"""
    return service.rate_limited(table(spark, d, "events"), 1)


@query("select job_id, deliveries, result_key, doc_id, api_key_hash from (select *, count(*) over (partition by job_id) deliveries, row_number() over (partition by job_id order by received_at desc nulls last, result_key desc) rn from job_results) where rn = 1")
def q_latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """What a read of a job gives"""
    return service.latest_jobs(table(spark, d, "job_results"))


@query("select job_id, case when min(received_at) <= timestamp '2025-07-01 00:00:00' then 'completed' else 'processing' end status from job_results group by job_id having min(submitted_at) <= timestamp '2025-07-01 00:00:00'")
def q_job_status(spark: SparkSession, d: str) -> DataFrame:
    """C7, R4"""
    return service.job_status(table(spark, d, "job_results"), "2025-07-01 00:00:00")


@query("select result_key, job_id, 'completed' status, coalesce(try_cast(metadata['page_count'] as int), 0) page_count, coalesce(try_cast(metadata['total_page_count'] as int), 0) total_page_count, coalesce(filename, '') filename from job_results")
def q_webhook_summary(spark: SparkSession, d: str) -> DataFrame:
    """M5, M8"""
    return service.webhook_summary(table(spark, d, "job_results"))


_INNER, _OUTER = ("".join(rf"\x{b:02X}" for b in p) for p in service.pads(b"secret"))


@query(f"""with b as (select result_key, '{{"result_key":' || result_key || ',"job_id":"' || job_id || '","status":"completed","page_count":' || coalesce(try_cast(metadata['page_count'] as int), 0) || ',"total_page_count":' || coalesce(try_cast(metadata['total_page_count'] as int), 0) || ',"filename":"' || coalesce(filename, '') || '"}}' as body from job_results)
 select result_key, body, sha256('{_OUTER}'::blob || unhex(sha256('{_INNER}'::blob || encode(body)))) as signature from b""")
def q_webhook_signature(spark: SparkSession, d: str) -> DataFrame:
    """K2, K4, M6, M7"""
    body = F.to_json(F.struct("result_key", "job_id", "status", "page_count", "total_page_count", "filename"))
    return service.webhook_summary(table(spark, d, "job_results")).select("result_key", body.alias("body")).withColumn("signature", service.signature("secret", F.col("body")))


@query("select result_key, job_id, case when api_key_hash is null then 404 when api_key_hash <> sha256('key_1') then 403 else 200 end::int as code from job_results")
def q_ownership(spark: SparkSession, d: str) -> DataFrame:
    """P20"""
    return table(spark, d, "job_results").select("result_key", "job_id", service.owned(None, F.sha2(F.lit("key_1"), 256)).alias("code"))


CALLBACKS = (("https://hooks.example.org/", "ok"), ("http://hooks.example.org/", "not_https"), ("https://inside.example.org/", "private_address"), ("https://u:p@hooks.example.org/", "userinfo"), ("https://hooks.example.org:8443/", "bad_port"), ("https://hooks.example.org:443/", "ok"), ("https://nowhere.example.org/", "unresolvable"), ("ftp://hooks.example.org/", "not_https"))


@query(f"select c_custkey, {[u for u, _ in CALLBACKS]}[(c_custkey % {len(CALLBACKS)} + 1)::int] || c_custkey as url, {[c for _, c in CALLBACKS]}[(c_custkey % {len(CALLBACKS)} + 1)::int] as \"check\" from customer")
def q_callback_check(spark: SparkSession, d: str) -> DataFrame:
    """An address per customer, in turn good and bad in every way, with what its host resolves to"""
    url = F.concat(F.get(F.array(*[F.lit(u) for u, _ in CALLBACKS]), (F.col("c_custkey") % len(CALLBACKS)).cast("int")), F.col("c_custkey").cast("string"))
    found = F.when(F.contains(url, F.lit("inside.")), F.array(F.lit("93.184.216.34"), F.lit("10.0.0.7"))).when(~F.contains(url, F.lit("nowhere.")), F.array(F.lit("93.184.216.34"), F.lit("2606:2800:220:1::1")))
    return table(spark, d, "customer").select("c_custkey", url.alias("url"), service.callback_check(url, found).alias("check"))


@query("select job_id, count(*) regions, count(*) filter (status = 'pending') pending, count(*) filter (status = 'reviewed') reviewed, count(*) filter (status = 'partial') as \"partial\" from hitl_regions group by job_id")
def q_hitl_queue(spark: SparkSession, d: str) -> DataFrame:
    """C6"""
    return service.review_queue(table(spark, d, "hitl_regions"))


@query("select hitl_key, job_id, coalesce(corrected_text, consensus_text) as text, corrected_text is not null as was_corrected from hitl_regions")
def q_hitl_corrections(spark: SparkSession, d: str) -> DataFrame:
    """J14"""
    return service.corrected(table(spark, d, "hitl_regions"))


@query(f"with {BUCKETS_SQL} select * from buckets")
def q_stream_spend_hourly(spark: SparkSession, d: str) -> DataFrame:
    """The state of the stream after all events"""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.run_complete(windows.hourly_spend(events), "stream_spend_hourly")


@query("select minute, user_id, requests from (select user_id, date_trunc('minute', ts) as minute, count(*) requests from events group by all) where requests > 1")
def q_stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """R3 as a stream: minutes of more than one request of a key"""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = windows.run_complete(windows.requests_per_minute(events, 1), "stream_rate_limit")
    return got.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("select distinct job_id from job_results where received_at is not null")
def q_stream_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each job from a stream that remembers a job for 30 days of event time"""
    results = spark.readStream.schema(table(spark, d, "job_results").schema).parquet(f"{d}/job_result[s].parquet")
    results = results.select("job_id", F.col("received_at").cast("timestamp").alias("received_at")).filter("received_at is not null")
    return windows.run_append(windows.latest_per_job(results).select("job_id"), "stream_deliveries")


@query()
def q_arriving_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of a folder as they arrive, their length in bytes"""
    got = windows.run_append(windows.arriving_files(spark, f"{d}/*[nr].parquet"), "arriving_files")
    return got.select(F.substring_index("path", "/", -1).alias("file"), "length")


@query()
def q_file_gate(spark: SparkSession, d: str) -> DataFrame:
    """The files of a folder through the format and size gate"""
    return sources.documents(spark, f"{d}/region.parquet").select(F.substring_index("path", "/", -1).alias("file"), "length", "check")


# --- pages, fonts, specialists ----------------------------------------------------------------------------------------


@query()
def q_text_layer(spark: SparkSession, d: str) -> DataFrame:
    """Regions of newspaper pages from their lines as words, every tenth line as a table"""
    z = table(spark, d, "documents").filter("text != '' and line_boxes is not null").select("doc_id", F.coalesce("page_no", F.lit(0)).cast("long").alias("page_num"), F.posexplode(F.arrays_zip(F.split("text", "\n", -1).alias("t"), F.col("line_boxes").alias("b"))).alias("i", "z"))
    z = z.filter("z.b is not null and z.t is not null").select("doc_id", "page_num", "i", *[F.col(f"z.b.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.col("z.t").alias("text"))
    words = z.select("doc_id", "page_num", F.col("y1").alias("top"), F.col("x1").alias("x0"), F.col("x2").alias("x1"), F.col("y2").alias("bottom"), "text")
    tables = z.filter("i % 10 = 9").select("doc_id", "page_num", "x1", "y1", "x2", "y2", F.array(F.split("text", " ")).alias("cells"))
    characters = z.select("doc_id", "page_num", F.col("i").alias("ord"), F.col("y1").alias("top"), F.col("x1").alias("x0"), F.when(F.col("text") == F.upper("text"), "Serif-Bold").otherwise("Serif").alias("font"))
    return sources.text_layer(words, tables, characters, 12.0)


@query(f"with {PAGES_SQL}, t as (select doc_id, page_num, count(*) n from ocr_regions where engine = 'trocr' group by all) select doc_id, page_num, coalesce(n, 0)::int as regions from pages left join t using (doc_id, page_num)")
def q_specialist_pages(spark: SparkSession, d: str) -> DataFrame:
    """What the handwriting reader gave for each page, its page numbers as text"""
    found = table(spark, d, "ocr_regions").filter("engine = 'trocr'").groupBy("doc_id", F.col("page_num").cast("string").alias("key")).agg(F.collect_list("region_key").alias("regions"))
    pages = clean.valid_pages(table(spark, d, "page_payloads")).select("doc_id", "page_num")
    return sources.by_page(pages, found, "key").select("doc_id", "page_num", F.size("regions").alias("regions"))


@query()
def q_image_scan(spark: SparkSession, d: str) -> DataFrame:
    """S3: size and resolution from the head of each page image, or why there is none"""
    images = table(spark, d, "page_payloads").filter("image is not null").select("doc_id", "page_num", "image")
    return sources.image_heads(images, ["doc_id", "page_num"], "image")


@query("with a as (select event_id, value - 180 * floor(value / 180) - 90 as angle from events), f as (select event_id, case when angle < -45 then angle + 90 when angle > 45 then angle - 90 else angle end as a from a) select event_id, round(case when abs(a) >= 0.1 and abs(a) <= 15 then a else 0.0 end, 6) as undo from f")
def q_deskew_angle(spark: SparkSession, d: str) -> DataFrame:
    """Angles folded and limited; the values of events as angles"""
    angle = F.col("value") - 180 * F.floor(F.col("value") / 180) - 90
    return table(spark, d, "events").select("event_id", F.round(clean.folded_angle(angle), ROUND).alias("undo"))


LINES_SQL = "l as (select doc_id, i as line, line_boxes[i].y1::double as top, line_boxes[i].x1::double as x0, lang from (select doc_id, lang, line_boxes, unnest(range(1, len(line_boxes) + 1)) i from documents where line_boxes is not null))"


@query(f"with {LINES_SQL}, c as (select doc_id, line as ord, top + line % 4 as top, x0 + line % 3 * 2 as x0, case line % 3 when 0 then 'Serif-Bold' when 1 then 'Serif-Oblique' else 'Serif' end as font from l), m as (select l.doc_id, l.line, arg_min(font, struct_pack(a := case when abs(c.x0 - l.x0) <= 2 then 0 else 1 end, o := c.ord)) as font from l join c on c.doc_id = l.doc_id and abs(c.top - l.top) <= 2 group by l.doc_id, l.line) select l.doc_id, l.line, coalesce(font, '') as font, coalesce(contains(lower(font), 'bold'), false) as bold, coalesce(contains(lower(font), 'italic') or contains(lower(font), 'oblique'), false) as italic from l left join m using (doc_id, line)")
def q_line_fonts(spark: SparkSession, d: str) -> DataFrame:
    """The font of each line of a page, with a character near each line's corner"""
    boxes = table(spark, d, "documents").filter("line_boxes is not null").select("doc_id", F.posexplode("line_boxes").alias("i", "b"))
    lines = boxes.select("doc_id", F.lit(0).cast("long").alias("page_num"), (F.col("i") + 1).alias("line"), F.col("b.y1").cast("double").alias("top"), F.col("b.x1").cast("double").alias("x0"))
    font = F.get(F.array(F.lit("Serif-Bold"), F.lit("Serif-Oblique"), F.lit("Serif")), F.col("line") % 3)
    characters = lines.select("doc_id", "page_num", F.col("line").alias("ord"), (F.col("top") + F.col("line") % 4).alias("top"), (F.col("x0") + F.col("line") % 3 * 2).alias("x0"), font.alias("font"))
    return sources.font_of_line(lines, characters).select("doc_id", F.col("line").cast("long").alias("line"), "font", "bold", "italic")


@query("select region_key, case element_type when 'printed_text' then 'printed_text' when 'header' then 'printed_text' when 'table' then 'table' when 'formula' then 'formula' when 'image' then 'printed_text' else 'printed_text' end as structure, case element_type when 'printed_text' then 'printed_text' when 'header' then 'header' when 'footer' then 'footer' when 'page_number' then 'page_number' when 'table' then 'table' when 'formula' then 'formula' when 'image' then 'image' when 'chart' then 'chart' when 'seal' then 'seal' else 'printed_text' end as layout, 0.95::double as confidence from ocr_regions where element_type is not null")
def q_label_maps(spark: SparkSession, d: str) -> DataFrame:
    """Types taken as labels of the layout recogniser and of the structure extractor"""
    kind = F.col("element_type")
    return table(spark, d, "ocr_regions").filter("element_type is not null").select("region_key", sources.structure_type(kind).alias("structure"), sources.layout_type(kind).alias("layout"), F.lit(sources.STRUCTURE_SCORE).alias("confidence"))


@query("select region_key, specialist, case when specialist = 'dots_formula' then regexp_replace(t, '\\s', '', 'g') <> '' when specialist = 'dots_chart' then contains(lower(t), '<svg') else t <> '' end as success, case when case when specialist = 'dots_formula' then regexp_replace(t, '\\s', '', 'g') <> '' when specialist = 'dots_chart' then contains(lower(t), '<svg') else t <> '' end then 0.85 else 0.0 end::double as confidence, coalesce(region_id, 'unknown') as region_id from (select region_key, region_id, coalesce(text_content, '') t, " + DISPATCH_SQL + " as specialist from ocr_regions where element_type in ('handwriting','formula','chart'))")
def q_specialist_batch(spark: SparkSession, d: str) -> DataFrame:
    """Regions of specialists in batches, each by the reader of its task; here readers that give the stored text"""
    asked = clean.dispatched(table(spark, d, "ocr_regions")).select("region_key", "region_id", "specialist", F.coalesce("text_content", F.lit("")).alias("payload"))
    same = lambda payloads: list(payloads)
    return sources.specialists(asked, {"trocr": same, "dots_formula": same, "dots_chart": same}).select("region_key", "specialist", "success", "confidence", "region_id")


@query("select doc_id, page_num, base64(image) as encoded, scanned_at from page_payloads where image is not null")
def q_image_base64(spark: SparkSession, d: str) -> DataFrame:
    """images as they are put into a request"""
    return table(spark, d, "page_payloads").filter("image is not null").select("doc_id", "page_num", F.base64("image").alias("encoded"), "scanned_at")


# --- review and store -------------------------------------------------------------------------------------------------


def _payload(spark: SparkSession, d: str) -> DataFrame:
    """A correction of every pending region, and of one that no job has."""
    pending = table(spark, d, "hitl_regions").filter("status = 'pending' and region_id is not null").select("job_id", "region_id").distinct()
    entries = F.collect_list(F.struct(F.col("region_id").alias("key"), F.concat(F.lit("corrected "), "region_id").alias("value")))
    return pending.groupBy("job_id").agg(F.map_from_entries(F.concat(entries, F.array(F.struct(F.lit("none").alias("key"), F.lit("x").alias("value"))))).alias("corrections"))


@query("select h.* exclude (engine_texts) replace (case when h.region_id in (select region_id from hitl_regions p where p.job_id = h.job_id and p.status = 'pending') then 'corrected ' || h.region_id else h.corrected_text end as corrected_text) from hitl_regions h")
def q_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The review table as it is written back after a payload of corrections"""
    return service.with_corrections(table(spark, d, "hitl_regions"), _payload(spark, d)).drop("engine_texts")


@query("select job_id, 'updated' as status, (count(distinct region_id) + 1)::int as corrections_applied from hitl_regions where status = 'pending' and region_id is not null group by job_id")
def q_corrections_applied(spark: SparkSession, d: str) -> DataFrame:
    """The size of each payload, the id that isn't known included"""
    return service.corrections_applied(_payload(spark, d))


@query("with o as (select o_custkey, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) price, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) last from orders group by o_custkey) select c_custkey, coalesce(price, c_acctbal) c_acctbal from customer left join o on o_custkey = c_custkey where last is null or last % 7 <> 0")
def q_store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K3: put and delete; the last order of a customer puts a value, each seventh takes the customer away"""
    store = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_totalprice", "o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    changes = last.select("c_custkey", F.col("o.o_totalprice").alias("c_acctbal"), F.col("o.o_orderdate").cast("timestamp").alias("at"), (F.col("o.o_orderkey") % 7 == 0).alias("deleted"))
    return service.upserted(store, changes.join(store.select("c_custkey"), "c_custkey"), ["c_custkey"])


# --- the whole way ----------------------------------------------------------------------------------------------------


def _process(spark: SparkSession, d: str, options: pipeline.Options) -> pipeline.Result:
    jobs = table(spark, d, "job_results")
    names = jobs.groupBy("doc_id").agg(F.max("filename").alias("filename"))
    per_page = _costs(spark, d).join(jobs.select("result_key", "doc_id"), "result_key").groupBy("doc_id", "page_num").agg(F.max("cost_nano").alias("cost_nano"))
    return pipeline.process(table(spark, d, "ocr_regions"), table(spark, d, "page_payloads"), names, per_page, options)


@query()
def q_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Documents from the regions of their engines to Markdown, in parts"""
    return _process(spark, d, pipeline.Options()).documents


@query()
def q_pipeline_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision log of the same way, regions below a confidence of 0.6 to be reviewed"""
    return _process(spark, d, pipeline.Options(confidence_floor=0.6)).decisions


@query()
def q_pipeline_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each document within a budget of 0.02 dollars"""
    return _process(spark, d, pipeline.Options(budget_nano=20_000_000)).metadata


@query()
def q_resolution_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """K5: resolution counts as a line of JSON each"""
    return q_resolution_rate(spark, d).select(F.to_json(F.struct("type_group", "multi", "groups", "rate")).alias("value"))

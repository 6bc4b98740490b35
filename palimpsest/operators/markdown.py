"""Rendering of resolved regions as Markdown: column expressions per region, ordered aggregation per page and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import geometry as g
from palimpsest.functions import strings as s
from palimpsest.plans.runtime import ranked

SKIPPED = ("footer", "page_number", "seal", "image")
PAGE_WIDTH = 2550.0


def meta(key: str) -> Column:
    return F.col("metadata")[key]


def number_text(c: Column) -> Column:
    return c.cast("string")


# Fixed value: what a comment that asks for a review begins with.
REVIEW = "<!-- REVIEW NEEDED: ["


def review_comment() -> Column:
    numbers = F.array(*[number_text(F.col(c)) for c in ("x1", "y1", "x2", "y2")])
    return F.concat(F.lit(REVIEW), F.array_join(numbers, ","), F.lit("] page="), F.col("page_num").cast("string"), F.lit(" confidence="), s.places(F.coalesce("confidence", F.lit(0.0)), 2), F.lit(" -->"))


def region_markdown() -> Column:
    """Markdown of one region from its type, text, metadata and box; empty for types that aren't printed."""
    text = F.coalesce("consensus_text", F.lit(""))
    page = (F.col("page_num") + 1).cast("string")
    html = meta("table_html")
    table = F.when(meta("table_markdown").isNotNull(), meta("table_markdown")).when(F.contains(html, F.lit("colspan")) | F.contains(html, F.lit("rowspan")), html).when(text != "", s.pipe_table(text)).otherwise("")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.expr("try_cast(metadata['hierarchy_level'] as int)"), F.lit(2))))
    formula = F.when(text == "", F.concat(F.lit("[Formula: unreadable, see page "), page, F.lit("]"))).when(F.contains(text, F.lit("\n")) | (F.length(text) > 80), F.concat(F.lit("$$"), text, F.lit("$$"))).otherwise(F.concat(F.lit("$"), text, F.lit("$")))
    svg = F.coalesce(meta("svg_content"), F.lit(""))
    chart = F.when(svg != "", s.clean_svg(svg)).otherwise(F.concat(F.lit("[Chart: extraction failed, see page "), page, F.lit("]")))
    box = F.array_join(F.array(*[number_text(F.col(c)) for c in ("x1", "y1", "x2", "y2")]), ",")
    hand = F.when(g.handwriting_position(F.col("x1"), F.col("x2"), F.coalesce(F.expr("try_cast(metadata['page_width'] as double)"), F.lit(PAGE_WIDTH))) == "marginal", F.concat(F.lit("*[Margin note: "), text, F.lit("]* <!-- handwritten-margin ["), box, F.lit("] -->"))).otherwise(F.concat(F.lit("*"), text, F.lit("* <!-- handwritten -->")))
    kind = F.col("element_type")
    content = F.when(kind == "table", table).when(kind == "header", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(kind == "formula", formula).when(kind == "chart", chart).when(kind == "handwriting", hand).otherwise(text)
    flagged = F.when(F.coalesce("hitl_flag", F.lit(False)), F.concat_ws("\n", F.nullif(content, F.lit("")), review_comment())).otherwise(content)
    return F.when(kind.isin(*SKIPPED), "").otherwise(flagged)


def _order() -> list[Column]:
    """What regions of a page are sorted by: hierarchy level where given, from top to bottom, from left to right."""
    level = F.coalesce(F.expr("try_cast(metadata['hierarchy_level'] as double)"), F.lit(float("inf")))
    return [level.alias("level"), F.col("y1").isNull().alias("no_y"), F.col("y1"), F.col("x1").isNull().alias("no_x"), F.col("x1"), F.col("aligned_key")]


def reading_order() -> Column:
    """Position on the page: by hierarchy level where given, from top to bottom, from left to right."""
    return F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(*_order()))


def pages(aligned: DataFrame) -> DataFrame:
    """Markdown per page, empty for a page of which nothing is printed. A page's regions are aggregated together; they are bounded by what fits on a page."""
    parts = aligned.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct(*_order(), region_markdown().alias("md")))).alias("parts"))
    printed = F.filter(F.transform("parts", lambda x: x["md"]), lambda x: x != "")
    return parts.select("doc_id", "page_num", F.array_join(printed, "\n\n").alias("page_markdown"))


def titles(aligned: DataFrame) -> DataFrame:
    """Title per document: the text of the first header in reading order on its first page; null without one."""
    header = F.when(F.col("element_type") == "header", F.struct("page_num", *_order()))
    heads = aligned.groupBy("doc_id").agg(F.min("page_num").alias("first"), F.min_by(F.struct("page_num", "consensus_text"), header).alias("head"))
    return heads.select("doc_id", F.when(F.col("head.page_num") == F.col("first"), F.col("head.consensus_text")).alias("title"))


# Plain words that YAML reads as something else than text.
YAML_WORDS = r"(?i)^(?:y|n|yes|no|true|false|on|off|null|~|)$"
YAML_NUMBERS = r"(?i)^[-+]?(?:\.?\d[\d_,:]*(?:\.[\d_]*)?(?:e[-+]?\d+)?|0[xob][\da-f_]+|\.(?:inf|nan))$|^\d{4}-\d\d?-\d\d?(?:$|[Tt\s])|^[=<]{1,2}$"
YAML_SIGNS = r"^[-?:](?:\s|$)|^[,\[\]{}#&*!|>'\"%@`]|:(?:\s|$)|\s#|^\s|\s$|^(?:---|\.\.\.)"


def yaml_text(c: Column) -> Column:
    """A text as a YAML scalar on one line: plain where that reads as the same text, else in single quotes, or in double quotes where it has line ends or invisible characters."""
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.rlike(r"[\x00-\x1f\x7f-\x9f\u2028\u2029\ufeff]"), F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("t"))), r'^\{"t":', ""), r"\}$", "")).when(c.rlike(YAML_WORDS) | c.rlike(YAML_NUMBERS) | c.rlike(YAML_SIGNS), quoted).otherwise(c)


def documents(aligned: DataFrame, processed: str, of: DataFrame | None = None) -> DataFrame:
    """A document as front matter and pages with breaks between them, in parts (doc_id, part_no, part) to be concatenated in order.

    ``of`` (doc_id, page_num) names all pages, those without regions too. A document of many pages is never put together in
    one row: part 0 is the front matter, part n the n-th page, an empty one included. Pages are numbered over ranges of
    pages, not in one task a document. Rows without a document or page number form a document or page of their own."""
    every = (aligned if of is None else of).select("doc_id", "page_num").distinct()
    named = titles(aligned).withColumnRenamed("doc_id", "d")
    head = every.groupBy("doc_id").agg(F.count("*").alias("pages")).join(named, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    title = yaml_text(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Document")))
    front = head.select("doc_id", F.lit(0).cast("long").alias("part_no"), F.concat(F.lit("---\npages: "), F.col("pages").cast("string"), F.lit(f"\nprocessed: '{processed}'\ntitle: "), title, F.lit("\n---\n\n")).alias("part"))
    # only page numbers are ranked; what the pages hold is joined to them
    numbered = ranked(every, ["doc_id"], ["page_num"], "part_no")
    body = pages(aligned).withColumnsRenamed({"doc_id": "d", "page_num": "p"})
    numbered = numbered.join(body, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("page_num").eqNullSafe(F.col("p")), "left")
    text = F.coalesce("page_markdown", F.lit(""))
    return front.unionByName(numbered.select("doc_id", "part_no", F.concat(F.when(F.col("part_no") > 1, F.lit("\n\n---\n\n")).otherwise(""), text).alias("part")))

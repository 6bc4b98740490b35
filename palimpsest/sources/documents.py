"""Sources: binary documents, region tables, label maps of the extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import clean
from palimpsest.operators.clean import lookup
from palimpsest.operators.service import EXTENSIONS, extension, upload_check

# Labels of the layout recogniser, and of the structure extractor, and the element types they stand for.
LAYOUT_LABELS = {
    "text": "printed_text", "document_title": "header", "paragraph_title": "header", "table": "table", "formula": "formula",
    "formula_number": "formula", "image": "image", "chart": "chart", "seal": "seal", "header": "header", "footer": "footer",
    "page_number": "page_number", "abstract": "printed_text", "references": "printed_text", "footnotes": "footer",
    "algorithm": "printed_text", "sidebar_text": "printed_text", "lists": "printed_text", "figure_title": "printed_text",
    "table_caption": "printed_text", "figure": "image",
}
STRUCTURE_LABELS = {
    "text": "printed_text", "section_header": "header", "title": "header", "table": "table", "picture": "image", "formula": "formula",
    "list_item": "printed_text", "caption": "printed_text", "page_header": "header", "page_footer": "footer", "footnote": "footer",
}
DEFAULT_TYPE, DEFAULT_SCORE, STRUCTURE_SCORE, SPECIALIST_SCORE = "printed_text", 0.85, 0.95, 0.85

def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder that pass the format and size gate; the others with the reason, without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    checked = files.withColumn("check", upload_check(F.col("length"), F.col("path"), head))
    return checked.select("path", "length", "check", F.when(F.col("check") == "ok", F.col("content")).alias("content"))


def readable(filename: Column) -> Column:
    return F.coalesce(extension(filename), F.lit("")).isin(*EXTENSIONS)


def has_text_layer(filename: Column) -> Column:
    """Only PDF documents go to the text layer and structure extractors."""
    return F.coalesce(extension(filename), F.lit("")) == ".pdf"


def layout_type(label: Column) -> Column:
    return F.coalesce(lookup(LAYOUT_LABELS, label), F.lit(DEFAULT_TYPE))


def structure_type(label: Column) -> Column:
    return F.coalesce(lookup(STRUCTURE_LABELS, label), F.lit(DEFAULT_TYPE))


def region_ids(partition: list[str], order: list[str]) -> Column:
    """Ids r_001, r_002, ... by position."""
    return F.format_string("r_%03d", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def with_scores(regions: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (doc_id, page_num, x1..y2, score) looked up by the rounded box; ``DEFAULT_SCORE`` where there is none."""
    box = ("x1", "y1", "x2", "y2")
    rounded = lambda d, p: d.select(*[c for c in d.columns if c not in box or p == ""], *[F.bround(c).cast("long").alias(f"r_{c}") for c in box])
    known = rounded(scores, "s").groupBy("doc_id", "page_num", *[f"r_{c}" for c in box]).agg(F.max("score").alias("score"))
    return rounded(regions, "").join(known, ["doc_id", "page_num", *[f"r_{c}" for c in box]], "left").withColumn("score", F.coalesce("score", F.lit(DEFAULT_SCORE)))


def table_text(rows: Column) -> Column:
    """Extracted table cells as text: cells joined by bars, null as nothing, rows by line ends."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")


def table_shape(markdown: Column) -> Column:
    """Rows and columns of a pipe table: lines but the rule, and bars of the first line less one."""
    lines = F.filter(F.split(markdown, "\n"), lambda l: F.trim(l) != "")
    first = F.get(lines, F.lit(0))
    return F.struct(F.greatest(F.lit(0), F.size(lines) - 1).alias("rows"), F.greatest(F.lit(0), F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1).alias("cols"))


def line_confidence(log_probabilities: Column) -> Column:
    """Geometric mean of token probabilities, 0.5 without any."""
    n = F.size(log_probabilities)
    mean = F.aggregate(log_probabilities, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(mean)))).otherwise(0.5)


def enclosing_box(points: Column) -> Column:
    """Axis-parallel box of a polygon of struct(x, y)."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x1"), of(F.array_min, "y").alias("y1"), of(F.array_max, "x").alias("x2"), of(F.array_max, "y").alias("y2"))


def line_boxes(lines: DataFrame, page: list[str], key: str, width: float, height: float) -> DataFrame:
    """Boxes (px1, py1, px2, py2) of lines given as polygons (points: array of struct(x, y)), clamped to the page, empty ones dropped, with their number (line_no) from top to bottom. Numbered inside a page."""
    box = enclosing_box(F.col("points"))
    clamp = lambda c, most: F.greatest(F.lit(0.0), F.least(c, F.lit(most)))
    clamped = lines.withColumns({f"p{c}": clamp(box[c], width if c[0] == "x" else height) for c in ("x1", "y1", "x2", "y2")}).filter("px2 > px1 and py2 > py1")
    return clamped.withColumn("line_no", F.row_number().over(Window.partitionBy(*page).orderBy("py1", "px1", key)).cast("int"))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines whose box doesn't meet a table's on the same page (open overlap in both axes)."""
    t = tables.select("doc_id", "page_num", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    meets = (lines["doc_id"] == t["doc_id"]) & (lines["page_num"] == t["page_num"]) & (lines["x1"] < t["t_x2"]) & (t["t_x1"] < lines["x2"]) & (lines["y1"] < t["t_y2"]) & (t["t_y1"] < lines["y2"])
    return lines.join(t, meets, "left_anti")


def font_of_line(lines: DataFrame, characters: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Font of each line's first character within the tolerance of its corner, else of its top, else none, and whether its name says bold or italic; characters: doc_id, page_num, ord, top, x0, font.

    Characters are looked up by cells of their top as wide as the tolerance, so a line meets those near it only."""
    cell = lambda c: F.floor(c / tolerance).cast("long")
    c = characters.select("doc_id", "page_num", F.col("ord").alias("c_ord"), F.col("top").alias("c_top"), F.col("x0").alias("c_x0"), "font").withColumn("cell", F.explode(F.array(*[cell(F.col("c_top")) + k for k in (-1, 0, 1)])))
    at = lines.select("doc_id", "page_num", "line", "top", "x0", cell(F.col("top")).alias("cell"))
    near = at.join(c, ["doc_id", "page_num", "cell"]).filter(F.abs(F.col("c_top") - F.col("top")) <= tolerance)
    corner = F.abs(F.col("c_x0") - F.col("x0")) <= tolerance
    got = near.groupBy("doc_id", "page_num", "line").agg(F.min_by("font", F.struct((~corner).alias("a"), "c_ord")).alias("font"))
    name = F.lower(F.coalesce("font", F.lit("")))
    says = lambda *words: F.greatest(*[F.contains(name, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(name, F.lit(words[0]))
    return lines.join(got, ["doc_id", "page_num", "line"], "left").select(*lines.columns, F.coalesce("font", F.lit("")).alias("font"), says("bold").alias("bold"), says("italic", "oblique").alias("italic"))


def text_layer(words: DataFrame, tables: DataFrame, characters: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Regions of a page's text layer: lines of words outside its tables with their fonts, then the tables; all with full confidence and ids by position.

    words: doc_id, page_num, top, x0, x1, bottom, text; tables: doc_id, page_num, x1, y1, x2, y2, cells (rows of cells);
    characters: as for ``font_of_line``."""
    lines = clean.lines_of_words(words, tolerance)
    boxed = lines.select("doc_id", "page_num", "line", "text", F.col("x0").alias("x1"), F.col("top").alias("y1"), F.col("x1").alias("x2"), F.col("bottom").alias("y2"))
    kept = outside_tables(boxed, tables)
    styled = font_of_line(kept.withColumns({"top": F.col("y1"), "x0": F.col("x1")}), characters, tolerance)
    none = F.lit(None)
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    text = styled.select("doc_id", "page_num", F.lit(0).alias("after"), F.col("line").cast("double").alias("at"), F.lit(DEFAULT_TYPE).alias("element_type"), *box, F.col("text").alias("text_content"), "font", "bold", "italic", none.cast("int").alias("rows"))
    grid = tables.select("doc_id", "page_num", F.lit(1).alias("after"), F.col("y1").cast("double").alias("at"), F.lit("table").alias("element_type"), *box, table_text(F.col("cells")).alias("text_content"), F.lit("").alias("font"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.size("cells").alias("rows"))
    both = text.unionByName(grid)
    return both.withColumns({"region_id": region_ids(["doc_id", "page_num"], ["after", "at", "x1", "text_content"]), "confidence": F.lit(1.0)}).drop("after", "at")


def by_page(pages: DataFrame, found: DataFrame, page: str) -> DataFrame:
    """What a specialist gave for pages (doc_id, ``page``, regions array), whose numbers may have come as text; an empty array for a page it gave nothing for."""
    given = found.select("doc_id", F.expr(f"try_cast({page} as bigint)").alias("page_num"), "regions")
    return pages.join(given, ["doc_id", "page_num"], "left").withColumn("regions", F.coalesce("regions", F.array().cast(given.schema["regions"].dataType)))


def _head(image: bytes) -> tuple[int, int, int]:
    """Width, height and dots per inch (72 where the file says none) from the head of a PNG or JPEG file."""
    if image[:8] == b"\x89PNG\r\n\x1a\n" and image[12:16] == b"IHDR" and len(image) >= 24:
        dpi, at = 72, image.find(b"pHYs")
        if at > 0 and len(image) >= at + 13 and image[at + 12] == 1:
            dpi = round(int.from_bytes(image[at + 4 : at + 8], "big") * 0.0254)
        return int.from_bytes(image[16:20], "big"), int.from_bytes(image[20:24], "big"), dpi
    if image[:2] == b"\xff\xd8":
        at, dpi = 2, 72
        while at + 9 < len(image) and image[at] == 0xFF:
            mark, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
            if mark == 0xE0 and image[at + 4 : at + 8] == b"JFIF" and image[at + 11] == 1:
                dpi = int.from_bytes(image[at + 12 : at + 14], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(image[at + 7 : at + 9], "big"), int.from_bytes(image[at + 5 : at + 7], "big"), dpi
            at += 2 + size
    raise ValueError("no image that can be read")


def image_heads(images: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Size and resolution of images, or an error and zero sizes for one that can't be read. Only the head is looked at."""
    schema = ", ".join([*(f"{k} long" for k in keys), "width int, height int, dpi int, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for image, *key in zip(pdf[column], *(pdf[k] for k in keys)):
                try:
                    out.append((*key, *_head(bytes(image)), None))
                except (ValueError, IndexError) as e:
                    out.append((*key, 0, 0, 0, str(e)))
            yield pd.DataFrame(out, columns=[*keys, "width", "height", "dpi", "error"])

    return images.select(*keys, column).mapInPandas(run, schema)


Reader = Callable[[list], list]


def specialists(asked: DataFrame, readers: dict[str, Reader]) -> DataFrame:
    """Regions (region_key, region_id, specialist, payload) read by the specialist each is for, a batch at a time: text, whether it succeeded, and its confidence.

    ``readers`` are set up once per Python worker; one that fails, or a specialist without a reader, gives no text. Formulas
    succeed if they aren't blank, charts if they hold a graphic, handwriting if there is any text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            error = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for name, own in pdf.groupby("specialist"):
                try:
                    text[own.index] = pd.Series(readers[str(name)]([*own["payload"]]), index=own.index, dtype=object)
                except Exception as e:  # noqa: BLE001  # a reader may fail in any way
                    error[own.index] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"region_key": pdf["region_key"], "region_id": pdf["region_id"], "specialist": pdf["specialist"], "text": text, "error": error})

    got = asked.mapInPandas(run, "region_key long, region_id string, specialist string, text string, error string")
    text = F.coalesce("text", F.lit(""))
    good = F.when(F.col("specialist") == "dots_formula", F.regexp_replace(text, r"\s", "") != "").when(F.col("specialist") == "dots_chart", F.contains(F.lower(text), F.lit("<svg"))).otherwise(text != "")
    return got.select("region_key", F.coalesce("region_id", F.lit("unknown")).alias("region_id"), "specialist", "text", "error", good.alias("success"), F.when(good, SPECIALIST_SCORE).otherwise(0.0).alias("confidence"))

"""Region cleaning before the engines are compared: types, noise, fragments, specialists, pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.runtime import grouped, ranked

# Groups of element types that may stand for each other.
TYPE_GROUPS = {
    "printed_text": "text", "header": "text", "footer": "text", "page_number": "text", "table": "table",
    "handwriting": "handwriting", "formula": "specialist", "chart": "specialist", "image": "specialist", "seal": "specialist",
}
# Specialist engines by element type.
SPECIALISTS = {"handwriting": "trocr", "formula": "dots_formula", "chart": "dots_chart"}
#: Horizontal gap, as a fraction of the page, from which fragments of one line are no longer joined.
FRAGMENT_GAP = 0.05


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def type_group(element_type: Column) -> Column:
    """The group of a type; an unknown type is its own group."""
    return F.coalesce(lookup(TYPE_GROUPS, element_type), element_type)


def compatible(a: Column, b: Column) -> Column:
    """Two known types are compatible within a group, any others only if equal."""
    ga, gb = lookup(TYPE_GROUPS, a), lookup(TYPE_GROUPS, b)
    return F.when(ga.isNotNull() & gb.isNotNull(), ga == gb).otherwise(a == b)


def noise_reason() -> Column:
    """Why a region is layout noise, null if it isn't: tiny boxes at the foot of the page, line numbers in the left margin."""
    size = (F.col("nx2") - F.col("nx1")) * (F.col("ny2") - F.col("ny1"))
    line_number = F.regexp_replace(F.coalesce("text_content", F.lit("")), r"(?U)^\s+|\s+$", "").rlike(r"^\d{1,2}\.?$")
    return F.when((F.col("ny1") > 0.93) & (size < 0.003), F.lit("bottom")).when((F.col("nx1") < 0.12) & (size < 0.001) & line_number, F.lit("margin_number"))


def without_noise(regions: DataFrame) -> DataFrame:
    return regions.filter(F.coalesce(noise_reason(), F.lit("")) == "")


def dispatched(regions: DataFrame) -> DataFrame:
    """Regions a specialist engine has to read, with its name."""
    return regions.withColumn("specialist", lookup(SPECIALISTS, F.col("element_type"))).filter("specialist is not null")


def valid_pages(payloads: DataFrame) -> DataFrame:
    """Valid pages, one row each. Repeated deliveries count once (the last scan)."""
    valid = payloads.filter("error is null and width > 0 and height > 0").select("doc_id", "page_num", "scanned_at", "dpi", "width", "height")
    return valid.groupBy("doc_id", "page_num").agg(F.max(F.struct("scanned_at", "dpi", "width", "height")).alias("p")).select("doc_id", "page_num", "p.*")


def pages_in_order(payloads: DataFrame) -> DataFrame:
    """Valid pages with their position in the document."""
    last = valid_pages(payloads)
    return ranked(last, ["doc_id"], ["page_num"], "rank").withColumn("page_index", F.col("rank") - 1).drop("rank")


def normalised_page() -> list[Column]:
    """Size and resolution after scaling scans below 200 DPI to 300 and turning landscape pages."""
    scale = F.when(F.col("dpi") < 200, F.lit(300.0) / F.col("dpi")).otherwise(F.lit(1.0))
    w, h = (F.floor(F.col(c) * scale).cast("int") for c in ("width", "height"))
    turned = w > h
    return [F.when(F.col("dpi") < 200, 300).otherwise(F.col("dpi")).cast("int").alias("dpi"), F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"), turned.alias("was_rotated")]


def folded_angle(angle: Column) -> Column:
    """Skew to undo: an angle folded to -45..45 degrees, 0 where it is below 0.1 or above 15."""
    a = F.when(angle < -45, angle + 90).when(angle > 45, angle - 90).otherwise(angle)
    return F.when(F.abs(a).between(0.1, 15), a).otherwise(F.lit(0.0))


def _merge(c: dict[str, np.ndarray]) -> list[tuple]:
    """Fragments of one engine and page: join those of one type that share a line and are near each other, transitively."""
    n = len(c["region_key"])
    box = np.stack([c[k].astype(float) for k in ("nx1", "ny1", "nx2", "ny2")], axis=1)
    pixels = np.stack([c[k].astype(float) for k in ("x1", "y1", "x2", "y2")], axis=1)
    label = np.arange(n)
    if n > 1:
        near = (np.maximum(box[:, None, 0], box[None, :, 0]) - np.minimum(box[:, None, 2], box[None, :, 2])) < FRAGMENT_GAP
        line = (box[:, None, 1] < box[None, :, 3]) & (box[None, :, 1] < box[:, None, 3])
        link = near & line & (c["element_type"][:, None] == c["element_type"][None, :])
        np.fill_diagonal(link, True)
        if int(link.sum()) > n:
            while True:  # smallest label over the links, until nothing changes
                low = np.where(link, label[None, :], n).min(axis=1)
                if (low == label).all():
                    break
                label = low
    rows = []
    for group in np.unique(label):
        at = np.flatnonzero(label == group)
        at = at[np.argsort(box[at, 0], kind="stable")]
        lead = at[0]
        texts = [t for t in c["text_content"][at] if isinstance(t, str) and t]
        score = c["confidence"][at].astype(float)
        union = lambda b: map(float, (b[at, 0].min(), b[at, 1].min(), b[at, 2].max(), b[at, 3].max()))
        level, shape = c["hierarchy_level"][lead], c["table_structure"][lead]
        rows.append((c["doc_id"][lead], c["page_num"][lead], c["engine"][lead], c["region_key"][lead], c["region_id"][lead], c["element_type"][lead], *union(box), float(score.min()), " ".join(texts), len(at), *union(pixels), None if pd.isna(level) else int(level), None if shape is None else dict(shape)))
    return rows


FRAGMENTS = "doc_id long, page_num long, engine string, region_key long, region_id string, element_type string, nx1 double, ny1 double, nx2 double, ny2 double, confidence double, text_content string, parts int, x1 double, y1 double, x2 double, y2 double, hierarchy_level int, table_structure struct<rows:int,cols:int,has_merged_cells:boolean,has_html:boolean>"


def merged_fragments(regions: DataFrame) -> DataFrame:
    """Fragments joined per document, page and engine; a region without unit box is left as it is.

    The leftmost fragment gives ids, header level and table structure, texts are joined from left to right, boxes are united, the least confidence counts.
    A group is what one engine saw on one page, which doesn't grow with the data."""
    boxed = regions.filter("nx1 is not null and ny1 is not null and nx2 is not null and ny2 is not null").select("doc_id", "page_num", "engine", "region_key", "region_ord", "region_id", "element_type", "nx1", "ny1", "nx2", "ny2", "confidence", "text_content", "x1", "y1", "x2", "y2", "hierarchy_level", "table_structure")
    return grouped(boxed, ["doc_id", "page_num", "engine"], ["region_ord", "region_key"], _merge, FRAGMENTS)


LINES = "doc_id long, page_num long, line int, text string, x0 double, top double, x1 double, bottom double"


def lines_of_words(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Words (doc_id, page_num, top, x0, text, and x1, bottom if known) to lines with their boxes: a new line starts where the top differs by more than ``tolerance`` from that of the line's first word."""
    full = words.select("doc_id", "page_num", "top", "x0", "text", *[F.col(c) if c in words.columns else F.lit(None).cast("double").alias(c) for c in ("x1", "bottom")])

    def rows(c: dict[str, np.ndarray]) -> list[tuple]:
        lines: list[list[int]] = []
        first = None
        for i, top in enumerate(c["top"]):
            if first is None or abs(top - first) > tolerance:
                lines.append([])
                first = top
            lines[-1].append(i)
        end = lambda k, at: None if pd.isna(c[k][at]).any() else float(c[k][at].max())
        return [(c["doc_id"][0], c["page_num"][0], n, " ".join(str(c["text"][i]) for i in sorted(at, key=lambda i: c["x0"][i])), float(c["x0"][at].min()), float(c["top"][at].min()), end("x1", at), end("bottom", at)) for n, at in enumerate(lines)]

    return grouped(full, ["doc_id", "page_num"], ["top", "x0"], rows, LINES)

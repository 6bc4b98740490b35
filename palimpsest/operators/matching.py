"""Entity resolution of regions across engines on one page.

Two forms. The candidate joins are plain equi-joins on document, page and type group with a range test, for analysis and
for pages too dense to hold. The layered matcher is exact and depends on the order of engines and regions, so it runs as
a grouped map over one page and type group, which is bounded by what fits on a page.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import geometry as g
from palimpsest.operators.clean import type_group
from palimpsest.plans.runtime import grouped

# Weights of engines in the fusion of boxes; others count 1.
FUSION_WEIGHTS = {"pdfplumber": 3.0, "paddleocr": 1.0, "docling": 1.0, "trocr": 2.0}


#: The engine whose header levels are carried into groups.
LEVEL_ENGINE = "docling"


@dataclass(frozen=True)
class Thresholds:
    iou: float = 0.5
    centre: float = 0.05
    centre_iou: float = 0.05
    containment: float = 0.6
    fusion: float = 0.3
    cluster: float = 0.92


def _side(regions: DataFrame, prefix: str) -> DataFrame:
    return regions.select("doc_id", "page_num", type_group(F.col("element_type")).alias("type_group"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("region_key", "engine", "engine_ord", "region_ord")], *[F.coalesce(f"n{c}", c).alias(f"{prefix}_{c}") for c in ("x1", "y1", "x2", "y2")])


def pairs(regions: DataFrame, condition: Column | None = None) -> DataFrame:
    """Regions of different engines on one page and of one type group whose boxes meet, each pair once, lower engine first."""
    a, b = _side(regions, "a"), _side(regions, "b")
    joined = a.join(b, ["doc_id", "page_num", "type_group"]).filter(F.col("a_engine_ord") < F.col("b_engine_ord")).filter(g.meets(g.box("a"), g.box("b")))
    return joined if condition is None else joined.filter(condition)


def scored(joined: DataFrame) -> DataFrame:
    a, b = g.box("a"), g.box("b")
    return joined.withColumns({"iou": g.iou(a, b), "containment": g.containment(a, b), "centre_distance": g.centre_distance(a, b)})


def best_matches(regions: DataFrame, least: float = 0.5) -> DataFrame:
    """For each region and other engine, the region of that engine with the largest overlap; ties go to the earlier one."""
    best = scored(pairs(regions)).filter(F.col("iou") >= least)
    return best.groupBy("a_region_key", "b_engine").agg(F.max_by(F.struct("b_region_key", "iou"), F.struct("iou", -F.col("b_region_ord"), -F.col("b_region_key"))).alias("m")).select("a_region_key", "b_engine", F.col("m.b_region_key").alias("b_region_key"), F.col("m.iou").alias("iou"))


# --- the exact matcher ------------------------------------------------------------------------------------------------


def iou_matrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    shared = _shared(p, q)
    union = _areas(p)[:, None] + _areas(q)[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def _areas(p: np.ndarray) -> np.ndarray:
    return (p[:, 2] - p[:, 0]) * (p[:, 3] - p[:, 1])


def _shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    w = np.minimum(p[:, None, 2], q[None, :, 2]) - np.maximum(p[:, None, 0], q[None, :, 0])
    h = np.minimum(p[:, None, 3], q[None, :, 3]) - np.maximum(p[:, None, 1], q[None, :, 1])
    return np.where((w > 0) & (h > 0), w * h, 0.0)


def fuse(boxes: np.ndarray, scores: np.ndarray, weights: np.ndarray, least: float) -> list[tuple[np.ndarray, list[int]]]:
    """Weighted boxes fusion that keeps provenance: boxes in descending order of weighted score join the cluster whose
    fused box they overlap most, by at least ``least``, or open one. A fused box is the mean by engine weight.
    Boxes are clamped to the page; those without area are left out. Returns (fused box, members)."""
    clamped = np.clip(boxes, 0.0, 1.0)
    order = [i for i in np.lexsort((np.arange(len(boxes)), -(scores * weights))) if _areas(clamped[i : i + 1])[0] > 0]
    found: list[tuple[np.ndarray, list[int]]] = []
    for i in order:
        at = -1
        if found:
            over = iou_matrix(clamped[i : i + 1], np.array([b for b, _ in found]))[0]
            best = int(over.argmax())
            at = best if over[best] > least or (over[best] == least and least > 0) else -1
        if at < 0:
            found.append((clamped[i], [i]))
        else:
            members = [*found[at][1], i]
            w = weights[members]
            found[at] = ((clamped[members] * w[:, None]).sum(axis=0) / w.sum(), members)
    return found


def linkage(boxes: np.ndarray, cut: float) -> list[list[int]]:
    """Complete-linkage clusters under the distance 1 - IoU, merged while the largest distance in a union is at most ``cut``.

    The nearest pair is merged into its first cluster, whose distances become the larger ones of both; of equal pairs the
    first is taken."""
    n = len(boxes)
    clusters = [[i] for i in range(n)]
    if n < 2:
        return clusters
    d = 1.0 - iou_matrix(boxes, boxes)
    d[np.tril_indices(n)] = np.inf
    near = d.min(axis=1)
    while True:
        x = int(near.argmin())
        if not near[x] <= cut:
            break
        y = int(d[x].argmin())
        clusters[x] += clusters[y]
        clusters[y] = []
        # distances to y and x, whichever side of the diagonal they stand on
        far = np.maximum(np.minimum(d[x], d[:, x]), np.minimum(d[y], d[:, y]))
        d[y], d[:, y] = np.inf, np.inf
        far[[x, y]] = np.inf
        d[x, x + 1 :], d[:x, x] = far[x + 1 :], far[:x]
        near = d.min(axis=1)
    return [c for c in clusters if c]


GROUPS = "doc_id long, page_num long, type_group string, group_no int, match_type string, anchor_type string, x1 double, y1 double, x2 double, y2 double, engine_count int, members array<struct<engine:string,region_key:bigint,text:string,confidence:double>>, region_id string, px1 double, py1 double, px2 double, py2 double, hierarchy_level int, table_structure struct<rows:int,cols:int,has_merged_cells:boolean,has_html:boolean>"

GROUP_COLUMNS = "doc_id page_num type_group group_no match_type anchor_type x1 y1 x2 y2 engine_count members region_id px1 py1 px2 py2 hierarchy_level table_structure".split()


class Page:
    """The regions of one page and type group; ``take`` moves regions from the open ones into a group."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.c = columns
        self.box = np.stack([columns[k].astype(float) for k in ("ux1", "uy1", "ux2", "uy2")], axis=1)
        self.pixels = np.stack([columns[k].astype(float) for k in ("x1", "y1", "x2", "y2")], axis=1) if "x1" in columns else self.box
        self.engine = columns["engine"].astype(object)
        self.open = np.ones(len(self.box), dtype=bool)
        self.engines = list(dict.fromkeys(self.engine))
        self.groups: list[dict] = []

    def of(self, engine: str) -> np.ndarray:
        return np.flatnonzero((self.engine == engine) & self.open)

    def take(self, kind: str, members: dict[str, list[int]], box: np.ndarray | None = None, pixels: np.ndarray | None = None) -> None:
        """A group's boxes are the means of its engines' first members' if none are given."""
        for at in members.values():
            self.open[at] = False
        lead = np.array([at[0] for at in members.values()])
        self.groups.append({"kind": kind, "members": members, "box": self.box[lead].mean(axis=0) if box is None else box, "pixels": self.pixels[lead].mean(axis=0) if pixels is None else pixels})

    def value(self, column: str, i: int) -> object:
        """A value of a region, None where it has none."""
        v = self.c[column][i] if column in self.c else None
        return None if v is None or (isinstance(v, (float, np.floating)) and np.isnan(v)) else v


def by_overlap(page: Page, t: Thresholds) -> None:
    """Greedy by the first engine's regions: each takes, from every other engine, the open region it overlaps most."""
    if not page.engines:
        return
    for i in page.of(page.engines[0]):
        members = {page.engines[0]: [int(i)]}
        for other in page.engines[1:]:
            at = page.of(other)
            if len(at):
                over = iou_matrix(page.box[i : i + 1], page.box[at])[0]
                if over.max() >= t.iou:
                    members[other] = [int(at[over.argmax()])]
        if len(members) > 1:
            page.take("iou", members)


def by_centre(page: Page, t: Thresholds) -> None:
    """Regions of the first engine left over take the nearest open region of the first other engine that has one near."""
    if not page.engines:
        return
    centre = (page.box[:, :2] + page.box[:, 2:]) / 2
    for i in page.of(page.engines[0]):
        for other in page.engines[1:]:
            at = page.of(other)
            if not len(at):
                continue
            far = np.hypot(*(centre[at] - centre[i]).T)
            far = np.where((far <= t.centre) & (iou_matrix(page.box[i : i + 1], page.box[at])[0] > t.centre_iou), far, np.inf)
            if np.isfinite(far.min()):
                page.take("center_rescue", {page.engines[0]: [int(i)], other: [int(at[far.argmin()])]})
                break


def by_containment(page: Page, t: Thresholds) -> None:
    """Open regions that lie in a group's first box join it for engines it lacks; then open regions gather what they contain."""

    def inside(i: int, at: np.ndarray) -> np.ndarray:
        shared = _shared(page.box[i : i + 1], page.box[at])[0]
        least = np.minimum(_areas(page.box[i : i + 1])[0], _areas(page.box[at]))
        return at[np.divide(shared, least, out=np.zeros_like(shared), where=least > 0) >= t.containment]

    for group in page.groups:
        first = next(iter(group["members"].values()))[0]
        for engine in page.engines:
            if engine not in group["members"] and len(at := page.of(engine)) and len(found := inside(first, at)):
                group["members"][engine] = [int(x) for x in found]
                group["kind"] = "containment"
                page.open[found] = False
    for i in np.flatnonzero(page.open):
        if not page.open[i]:
            continue
        at = np.flatnonzero(page.open & (page.engine != page.engine[i]))
        found = inside(int(i), at) if len(at) else at
        if len(found):
            members: dict[str, list[int]] = {page.engine[i]: [int(i)]}
            for x in found:
                members.setdefault(page.engine[x], []).append(int(x))
            page.take("containment", members)


def by_fusion(page: Page, t: Thresholds) -> None:
    """Fusion of what is left; boxes without area disappear here, as they can match nothing. Kept: clusters of two engines and more."""
    at = np.flatnonzero(page.open)
    if not len(at):
        return
    weights = np.array([FUSION_WEIGHTS.get(e, 1.0) for e in page.engine[at]])
    scores = page.c["confidence"].astype(float)[at]
    flat = _areas(np.clip(page.box[at], 0.0, 1.0)) <= 0
    has_unit = page.c["has_unit"].astype(bool)[at]
    page.open[at[flat & has_unit]] = False
    use = has_unit & ~flat
    for box, found in fuse(page.box[at[use]], scores[use], weights[use], t.fusion):
        rows = at[use][found]
        if len(set(page.engine[rows])) > 1:
            members: dict[str, list[int]] = {}
            for x in rows:
                members.setdefault(page.engine[x], []).append(int(x))
            page.take("wbf", members, box, np.average(page.pixels[rows], axis=0, weights=weights[use][found]))


def by_linkage(page: Page, t: Thresholds) -> None:
    at = np.flatnonzero(page.open)
    for found in linkage(page.box[at], t.cluster) if len(at) > 1 else []:
        rows = at[found]
        if len(set(page.engine[rows])) > 1:
            members: dict[str, list[int]] = {}
            for x in sorted(rows):
                members.setdefault(page.engine[x], []).append(int(x))
            page.take("cluster", members)


STAGES = (by_overlap, by_centre, by_containment, by_fusion, by_linkage)


def match_rows(columns: dict[str, np.ndarray], t: Thresholds, stages: tuple = STAGES) -> list[tuple]:
    """Groups of one page and type group; rows in order of engine and region."""
    page = Page(columns)
    for stage in stages:
        stage(page, t)
    for i in np.flatnonzero(page.open):
        page.take("orphan", {page.engine[i]: [int(i)]})
    c, rows = page.c, []
    for n, group in enumerate(page.groups):
        members = []
        for engine, at in group["members"].items():
            at = sorted(at, key=lambda i: (page.box[i, 1], page.box[i, 0]))
            texts = [x for x in c["text_content"][at] if isinstance(x, str) and x]
            members.append({"engine": engine, "region_key": int(c["region_key"][at[0]]), "text": " ".join(texts), "confidence": float(max(c["confidence"][at]))})
        lead = next(iter(group["members"].values()))[0]
        # carried along: the level that the structure extractor gives, and the last table structure any engine gives
        level = next((v for v in (page.value("hierarchy_level", at[0]) for engine, at in group["members"].items() if engine == LEVEL_ENGINE) if v is not None), None)
        shapes = [v for v in (page.value("table_structure", at[0]) for at in group["members"].values()) if v is not None]
        carried = (page.value("region_id", lead), *map(float, group["pixels"]), None if level is None else int(level), dict(shapes[-1]) if shapes else None)
        rows.append((c["doc_id"][0], c["page_num"][0], c["type_group"][0], n, group["kind"], c["element_type"][lead], *map(float, group["box"]), len(members), members, *carried))
    return rows


def match_page(pdf: pd.DataFrame, t: Thresholds, stages: tuple = STAGES) -> pd.DataFrame:
    """``match_rows`` of a data frame in any order."""
    pdf = pdf.sort_values(["engine_ord", "region_ord", "region_key"], kind="stable")
    return pd.DataFrame(match_rows({k: pdf[k].to_numpy() for k in pdf.columns}, t, stages), columns=GROUP_COLUMNS)


def match_groups(regions: DataFrame, t: Thresholds = Thresholds(), stages: tuple = STAGES) -> DataFrame:  # noqa: B008
    """Groups of regions that show the same thing, by the layered matcher."""
    cols = regions.select("doc_id", "page_num", type_group(F.col("element_type")).alias("type_group"), "region_key", "engine", "engine_ord", "region_ord", "element_type", *g.unit_or_own(), (F.col("nx1").isNotNull()).alias("has_unit"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "text_content", *[c for c in ("region_id", "x1", "y1", "x2", "y2", "hierarchy_level", "table_structure") if c in regions.columns])
    usable = cols.filter("ux1 is not null and uy1 is not null and ux2 is not null and uy2 is not null and engine is not null")
    return grouped(usable, ["doc_id", "page_num", "type_group"], ["engine_ord", "region_ord", "region_key"], lambda c: match_rows(c, t, stages), GROUPS)


def resolution(groups: DataFrame) -> DataFrame:
    """Share of groups that more than one engine saw, per type group and in all."""
    many = F.sum((F.col("engine_count") > 1).cast("long"))
    return groups.rollup("type_group").agg(many.alias("multi"), F.count("*").alias("groups")).select(F.coalesce("type_group", F.lit("all")).alias("type_group"), "multi", "groups", F.round(F.col("multi") / F.col("groups"), 4).alias("rate"))

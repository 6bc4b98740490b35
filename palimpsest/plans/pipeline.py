"""The whole way of documents: from what the engines saw on their pages to Markdown, decisions and totals, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import geometry as g
from palimpsest.operators import clean, consensus, markdown, matching, service
from palimpsest.plans.runtime import materialise, ranked
from palimpsest.sources import documents as sources

#: Engines that only read documents with a text layer, and the one that sees fragments.
PDF_ENGINES, FRAGMENT_ENGINE = ("pdfplumber", "docling"), "docling"


@dataclass(frozen=True)
class Options:
    """What a run may be tuned by. ``budget_nano``: nano-dollars a document may cost, None for no limit. ``type_source``:
    "group" names a group that several engines saw by its group of types, "anchor" by the type its first engine gave."""

    disagreement: float = consensus.THRESHOLD
    confidence_floor: float = 0.0
    budget_nano: int | None = None
    thresholds: matching.Thresholds = field(default_factory=matching.Thresholds)
    type_source: str = "group"
    processed: str = "2026-01-01T00:00:00Z"


@dataclass(frozen=True)
class Result:
    """``regions``: every resolved region with its final text; ``pages``: valid pages with what became of them;
    ``decisions``: the log, one row per region of a processed page; ``documents``: Markdown in parts; ``metadata``: totals."""

    groups: DataFrame
    quality: DataFrame
    regions: DataFrame
    pages: DataFrame
    decisions: DataFrame
    documents: DataFrame
    metadata: DataFrame


def cleaned(regions: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """Regions of valid pages with unit boxes, without noise, the fragments of the structure extractor joined."""
    on_pages = regions.join(pages.select("doc_id", "page_num", "width", "height"), ["doc_id", "page_num"]).join(names, "doc_id", "left")
    # a document without a name counts as one that may have a text layer
    layered = F.col("filename").isNull() | sources.has_text_layer(F.col("filename"))
    read = on_pages.filter(layered | ~F.col("engine").isin(*PDF_ENGINES))
    unit = g.to_unit(g.box(), F.col("width"), F.col("height"))
    boxed = clean.without_noise(read.withColumns({f"n{c}": v for c, v in unit.items()}))
    keep = ["doc_id", "page_num", "engine", "engine_ord", "region_ord", "region_key", "region_id", "element_type", "x1", "y1", "x2", "y2", "nx1", "ny1", "nx2", "ny2", "confidence", "text_content", "hierarchy_level", "table_structure"]
    whole = boxed.filter(F.col("engine") != FRAGMENT_ENGINE).select(*keep)
    parts = boxed.filter(F.col("engine") == FRAGMENT_ENGINE)
    order = parts.groupBy("doc_id", "page_num", "engine").agg(F.min("engine_ord").alias("engine_ord"))
    merged = clean.merged_fragments(parts).join(order, ["doc_id", "page_num", "engine"]).withColumn("region_ord", F.col("region_key"))
    return whole.unionByName(merged.select(*keep))


def aligned_rows(groups: DataFrame, type_source: str) -> DataFrame:
    """Groups as regions to be resolved, under the key of their first member."""
    many = F.col("match_type").isin("iou", "center_rescue", "containment")
    kind = F.when(many, F.col("type_group")).otherwise(F.col("anchor_type")) if type_source == "group" else F.col("anchor_type")
    texts = F.transform("members", lambda m: F.struct(m["engine"].alias("engine"), m["text"].alias("text")))
    level = F.col("hierarchy_level").cast("string")
    return groups.select(
        F.col("members")[0]["region_key"].alias("aligned_key"), "doc_id", "page_num", "region_id", kind.alias("element_type"),
        *[F.col(f"p{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], F.array_max(F.transform("members", lambda m: m["confidence"])).alias("confidence"),
        texts.alias("engine_texts"), F.when(level.isNotNull(), F.create_map(F.lit("hierarchy_level"), level)).alias("metadata"), "table_structure",
    )


def process(regions: DataFrame, payloads: DataFrame, names: DataFrame, costs: DataFrame, options: Options = Options(), arbiter: Column | None = None) -> Result:  # noqa: B008
    """``names``: doc_id, filename; ``costs``: doc_id, page_num, cost_nano; ``arbiter``: answer to ``candidates``, by default the offline one.

    Pages are processed in order until the budget of their document is reached; the page that reaches it is the last."""
    valid = clean.valid_pages(payloads)
    stored = materialise(cleaned(regions, valid, names), "pipeline-cleaned")
    groups = materialise(matching.match_groups(stored, options.thresholds), "pipeline-groups")
    quality = consensus.page_quality(stored)
    aligned = consensus.with_truth(aligned_rows(groups, options.type_source), quality)
    resolved = consensus.resolve(aligned, options.disagreement, truth=F.col("truth"))
    final = consensus.arbitrated(resolved, consensus.offline_arbiter(F.col("candidates")) if arbiter is None else arbiter)
    low = F.coalesce(F.col("final_agreement") < options.confidence_floor, F.lit(False)) if options.confidence_floor > 0 else F.lit(False)
    carried = aligned.select("aligned_key", "doc_id", "page_num", "region_id", "element_type", "x1", "y1", "x2", "y2", "engine_texts", "metadata", "table_structure")
    settled = carried.join(final, "aligned_key").select("*", (F.col("hitl_flag") | low).alias("flagged")).drop("hitl_flag")
    settled = settled.withColumnsRenamed({"final_text": "consensus_text", "final_source": "source", "final_agreement": "confidence", "flagged": "hitl_flag"})
    known = valid.select("doc_id", "page_num").join(costs, ["doc_id", "page_num"], "left").withColumn("cost_nano", F.coalesce("cost_nano", F.lit(0)))
    spent = ranked(known, ["doc_id"], ["page_num"], "spent_before", "cost_nano")
    pages = spent.withColumn("processed", F.lit(True) if options.budget_nano is None else F.col("spent_before") < options.budget_nano)
    done = materialise(settled.join(pages.filter("processed").select("doc_id", "page_num"), ["doc_id", "page_num"]), "pipeline-regions")
    decisions = done.select(
        "doc_id", "page_num", "aligned_key", "region_id", "element_type", F.array(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("bounding_box"),
        F.transform("engine_texts", lambda e: e["engine"]).alias("engines_ran"), F.col("source").alias("resolution"), "confidence", (F.col("source") == "arbitration").alias("llm_invoked"), "hitl_flag",
    )
    flags = done.groupBy("doc_id", "page_num").agg(F.sum(F.col("hitl_flag").cast("long")).alias("hitl_flags"))
    full = pages.join(flags, ["doc_id", "page_num"], "left").join(names, "doc_id", "left").withColumn("hitl_flags", F.coalesce("hitl_flags", F.lit(0)))
    body = pages.filter("processed").select("doc_id", "page_num")
    return Result(groups, quality, done, pages, decisions, markdown.documents(done, options.processed, body), service.result_metadata(full))

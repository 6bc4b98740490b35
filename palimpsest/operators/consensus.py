"""Agreement of aligned texts: entropy per position, weighted vote, resolution, arbitration.

Texts of one group are aligned pairwise with the first engine's; positions are compared up to the shortest alignment.
Groups whose texts are all equal, or that have one text, never reach the alignment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import strings as s
from palimpsest.functions.strings import GAP, align

# Engine -> weight of its vote, generally, on pages with a text layer of its own, and for handwriting.
WEIGHTS: dict[str, float] = {}
TRUTH_WEIGHTS = {"pdfplumber": 2.0}
HANDWRITING_WEIGHTS = {"trocr": 2.0, "paddleocr": 1.0}
ENGINE_ORDER = ("pdfplumber", "paddleocr", "docling", "trocr", "dots")
THRESHOLD = 0.4


def entropy(column: list[str]) -> float:
    """Bits of disagreement in one column; a gap counts as a character."""
    n = len(column)
    counts = [column.count(c) for c in dict.fromkeys(column)]
    return -sum(k / n * math.log2(k / n) for k in counts) if len(counts) > 1 else 0.0


def disagreement(aligned: list[str]) -> float:
    """Mean entropy over the columns that aren't all gaps, up to the shortest text; 0 if there are none."""
    columns = [c for c in map(list, zip(*aligned)) if any(x != GAP for x in c)]
    return sum(map(entropy, columns)) / len(columns) if columns else 0.0


def vote(aligned: list[str], weights: list[float]) -> str:
    """The heaviest character of every column; gaps don't vote; ties go to the engine given first."""
    out = []
    for column in zip(*aligned):
        heard: dict[str, float] = {}
        for c, w in zip(column, weights):
            if c != GAP:
                heard[c] = heard.get(c, 0.0) + w
        if heard:
            out.append(max(heard, key=heard.__getitem__))
    return "".join(out)


def align_all(texts: list[str]) -> list[str]:
    """Every text aligned with the first; the first as aligned with the second."""
    pairs = [align(texts[0], t) for t in texts[1:]]
    return [pairs[0][0], *(b for _, b in pairs)] if pairs else texts


RESOLVED = "aligned_key long, doc_id long, page_num long, region_id string, element_type string, source string, resolved_text string, ce double, agreement double, needs_arbitration boolean, candidates array<string>, answer string"


def ordered_texts() -> Column:
    """Non-null readings in the fixed order of engines."""
    rank = F.array(*[F.lit(e) for e in ENGINE_ORDER])
    usable = F.filter("engine_texts", lambda e: e["engine"].isNotNull() & e["text"].isNotNull())
    keyed = F.array_sort(F.transform(usable, lambda e: F.struct(F.coalesce(F.nullif(F.array_position(rank, e["engine"]), F.lit(0)), F.lit(99)).alias("o"), e["engine"].alias("engine"), e["text"].alias("text"))))
    return F.transform(keyed, lambda e: F.struct(e["engine"].alias("engine"), e["text"].alias("text")))


def resolve(aligned: DataFrame, threshold: float = THRESHOLD, truth: Column | None = None, answer: Column | None = None) -> DataFrame:
    """Resolved text per region: single_engine, identical, voting, or voting_fallback where the disagreement is above the threshold.

    ``truth``: whether the text layer of the page is trusted, which then weighs more. A region without texts is pending.
    Only regions that need arbitration carry their candidates, and the text that ``answer`` names for them."""
    rows = aligned.select("aligned_key", "doc_id", "page_num", "region_id", "element_type", "confidence", (F.lit(None).cast("string") if answer is None else answer).alias("answer"), ordered_texts().alias("e"), F.coalesce(truth if truth is not None else F.lit(False), F.lit(False)).alias("truth"))
    distinct = F.size(F.array_distinct(F.transform("e", lambda x: x["text"])))
    easy = rows.filter((F.size("e") < 2) | (distinct < 2))
    kind = F.when(F.size("e") == 0, "pending").when(F.size("e") == 1, "single_engine").otherwise("identical")
    done = easy.select("aligned_key", "doc_id", "page_num", "region_id", "element_type", kind.alias("source"), F.get("e", F.lit(0))["text"].alias("resolved_text"), F.lit(0.0).alias("ce"), F.when(F.size("e") > 0, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0).alias("agreement"), F.lit(False).alias("needs_arbitration"), F.lit(None).cast("array<string>").alias("candidates"), F.lit(None).cast("string").alias("answer"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                engines, texts = [x["engine"] for x in r.e], [x["text"] for x in r.e]
                table = HANDWRITING_WEIGHTS if r.element_type == "handwriting" else TRUTH_WEIGHTS if r.truth else WEIGHTS
                lined = align_all(texts)
                ce = disagreement(lined)
                high = ce > threshold
                out.append((r.aligned_key, r.doc_id, r.page_num, r.region_id, r.element_type, "voting_fallback" if high else "voting", vote(lined, [table.get(e, 1.0) for e in engines]), ce, min(1.0, max(0.0, 1 - ce / (math.log2(len(texts)) or 1.0))), high, texts if high else None, r.answer if high else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESOLVED.split(", ")])

    return done.unionByName(rows.filter((F.size("e") > 1) & (distinct > 1)).mapInPandas(run, RESOLVED))


def page_quality(regions: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per page with a text layer or a layout reading: whether the two agree so well that the text layer is trusted, how similar they are, and why not. Similarity is compared unrounded."""
    r = regions.filter(F.col("engine").isin("pdfplumber", "paddleocr") & (s.strip(F.col("text_content")) != ""))
    both = r.groupBy("doc_id", "page_num", "engine").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_ord", "region_key", "text_content"))), lambda x: x["text_content"]), " ").alias("t"))
    page = both.groupBy("doc_id", "page_num").agg(F.max(F.when(F.col("engine") == "pdfplumber", F.col("t"))).alias("layer"), F.coalesce(F.max(F.when(F.col("engine") == "paddleocr", F.col("t"))), F.lit("")).alias("read"))
    got = page.withColumn("ratio", s.indel_similarity("layer", "read"))
    good = F.coalesce(F.col("ratio") > threshold, F.lit(False))
    return got.select("doc_id", "page_num", good.alias("is_ground_truth"), F.round(F.coalesce("ratio", F.lit(0.0)), 4).alias("similarity"), F.when(F.col("layer").isNull(), "no_pdfplumber_text").when(good, "agreement").otherwise("disagreement").alias("reason"))


def with_truth(aligned: DataFrame, quality: DataFrame) -> DataFrame:
    """Regions with ``truth``: whether the text layer of their page is trusted; not, where nothing is known of the page."""
    flags = quality.select("doc_id", "page_num", F.col("is_ground_truth").alias("truth"))
    return aligned.join(flags, ["doc_id", "page_num"], "left").withColumn("truth", F.coalesce("truth", F.lit(False)))


def offline_arbiter(candidates: Column) -> Column:
    """An arbiter that needs no model: the candidate with the fewest edits to all others, the first of equals."""
    cost = lambda c: F.aggregate(candidates, F.lit(0), lambda acc, o: acc + F.levenshtein(c, o))
    return F.array_min(F.transform(candidates, lambda c, i: F.struct(cost(c).alias("cost"), i.alias("i"), c.alias("c"))))["c"]


#: Edits an arbiter's text may be away from the candidates, for handwriting and otherwise.
HANDWRITING_EDITS, EDITS = 5, 3


def arbitrated(resolved: DataFrame, answer: Column | None = None) -> DataFrame:
    """Outcome of all regions; those that need arbitration get the verdict on ``answer`` (by default the one they carry). No answer counts as a failed call. Nothing is judged for the others."""
    if answer is not None:
        resolved = resolved.withColumn("answer", F.when(F.col("needs_arbitration"), answer))
    answer = F.col("answer")
    candidates, need = F.col("candidates"), F.col("needs_arbitration")
    verdict = F.when(need & (F.col("element_type") == "handwriting"), s.verdict(answer, candidates, HANDWRITING_EDITS)).when(need, s.verdict(answer, candidates, EDITS))
    judged = resolved.withColumn("verdict", verdict)
    failed = F.col("verdict").isNull() | F.col("verdict.rejected")
    return judged.select(
        "aligned_key",
        F.when(need & ~failed, F.col("verdict.text")).otherwise(F.col("resolved_text")).alias("final_text"),
        F.when(need & failed, "hitl_fallback").when(need, "arbitration").otherwise(F.col("source")).alias("final_source"),
        F.when(need & ~failed, 0.95).otherwise(F.col("agreement")).alias("final_agreement"),
        F.when(need, failed | F.col("verdict.hitl_flag")).otherwise(F.lit(False)).alias("hitl_flag"),
    )

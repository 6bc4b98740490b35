"""Queries of the problems tagged llm, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import consensus, lookalike, mixing, packing, pii, scannoise, sentences, splitting
from palimpsest.plans.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "aligned_regions"))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every reading and every region text whose consistent form differs from what is stored."""
    stored = lookalike.readings(table(spark, d, "aligned_regions")).select(F.lit("engine_texts").alias("field"), F.col("aligned_key").alias("row_key"), "engine", "text")
    own = table(spark, d, "ocr_regions").select(F.lit("text_content").alias("field"), F.col("region_key").alias("row_key"), "engine", F.col("text_content").alias("text")).filter("text is not null")
    texts = stored.unionByName(own)
    forms = lookalike.lookalike_table(texts, "text")
    return texts.withColumn("form", lookalike.canonical(F.col("text"), forms)).filter("form != text").drop("text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.wrong_readings(table(spark, d, "aligned_regions"))


def p3_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.resolve(table(spark, d, "aligned_regions"))[0].drop("wrong_engines")


def p3_reliability(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "aligned_regions")
    return consensus.reliability(consensus.resolve(regions)[1], regions)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.boundary_positions(table(spark, d, "job_results"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "job_results"))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return pii.texts(table(spark, d, "ocr_regions"), table(spark, d, "job_results"), table(spark, d, "hitl_regions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(_personal(spark, d), table(spark, d, "name_parts"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = _personal(spark, d)
    return pii.redacted(rows, pii.find(rows, table(spark, d, "name_parts")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.noise(table(spark, d, "ocr_regions"), table(spark, d, "aligned_regions"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.repaired(table(spark, d, "ocr_regions"), table(spark, d, "aligned_regions"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.measured(table(spark, d, "documents")), table(spark, d, "pack_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), table(spark, d, "pack_sizes"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "documents"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


# --- what must hold of whole results, with SQL ------------------------------------------------------------------------


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text without their overlaps, put together again."""
    of = p4_pieces(spark, d).groupBy("result_key").agg(F.array_sort(F.collect_list(F.struct("piece_no", "char_start", "char_end", "piece"))).alias("p"))
    own = F.transform("p", lambda x, i: F.substr(x["piece"], F.when(i == 0, 1).otherwise(F.get("p", i - 1)["char_end"] - x["char_start"] + 1).cast("int")))
    overlaps = F.transform("p", lambda x, i: (i == 0) | (F.get("p", i - 1)["char_end"] - x["char_start"] == splitting.OVERLAP))
    longest = F.array_max(F.transform("p", lambda x: F.length(x["piece"])))
    return of.select("result_key", F.md5(F.array_join(own, "")).alias("text"), F.forall(overlaps, lambda x: x).alias("overlapping"), (longest <= splitting.MAX_CHARS).alias("within"))


def p5_outside(spark: SparkSession, d: str) -> DataFrame:
    """Every text with what is redacted in it cut out is its redacted form without the placeholders."""
    rows = _personal(spark, d)
    spans = pii.find(rows, table(spark, d, "name_parts"))
    holes = spans.withColumn("pii_type", F.lit("\x00"))
    placeholders = "|".join(rf"\[{k.upper()}\]" for k in pii.TYPES)
    a = pii.redacted(rows, spans).select("field", "row_key", F.regexp_replace("redacted", placeholders, "").alias("a"))
    b = pii.redacted(rows, holes).select("field", "row_key", F.regexp_replace(F.replace("redacted", F.lit("[\x00]"), F.lit("")), placeholders, "").alias("b"))
    return a.join(b, ["field", "row_key"]).select("field", "row_key", (F.col("a") == F.col("b")).alias("kept"))


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every document is packed once for every size, its pieces without a gap, none split without need."""
    got = p7_containers(spark, d).groupBy("size_id", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max(F.col("token_start") + F.col("tokens")).alias("end"), F.countDistinct("token_start").alias("starts"))
    sizes = table(spark, d, "pack_sizes").select("size_id", "capacity_tokens").distinct()
    return got.join(sizes, "size_id").select("size_id", "doc_id", ((F.col("t") == F.col("end")) & (F.col("starts") == F.col("n")) & ((F.col("n") == 1) | (F.col("t") > F.col("capacity_tokens")))).alias("whole"))


def p7_within(spark: SparkSession, d: str) -> DataFrame:
    """No container holds more than its capacity."""
    full = p7_containers(spark, d).groupBy("size_id", "container_id").agg(F.sum("tokens").alias("t")).groupBy("size_id").agg(F.max("t").alias("t"))
    return full.join(table(spark, d, "pack_sizes").select("size_id", "capacity_tokens").distinct(), "size_id").select("size_id", "capacity_tokens", (F.col("t") <= F.col("capacity_tokens")).alias("within"))


def p8_within(spark: SparkSession, d: str) -> DataFrame:
    """No document of a source is used more often than allowed, none twice under one number, and no source is more than the largest document away from its share."""
    mixed = p8_mixture(spark, d)
    use = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat_no").alias("r"), F.max("tokens").alias("t")).groupBy("source").agg(F.max("n").alias("n"), F.max("t").alias("t"), F.max((F.col("n") != F.col("r")).cast("int")).alias("twice"))
    got = mixing.shares(mixed, table(spark, d, "mix_targets")).filter("rows > 0")
    few = Window.partitionBy(F.lit(0))  # as few rows as the targets
    off = F.abs(F.col("tokens") - F.col("target_share") / F.sum("target_share").over(few) * F.sum("tokens").over(few))
    return got.join(use, "source").withColumn("near", off <= F.max("t").over(few)).select("source", ((F.col("n") <= F.col("max_repeats")) & (F.col("twice") == 0)).alias("repeats"), F.col("near").alias("share"))


def p9_ends(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document end where p9_found says, at a character that isn't blank."""
    units = p9_sentences(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list("char_end")).alias("a"))
    ends = p9_found(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("end_pos") + 1)).alias("b"))
    return units.join(ends, "doc_id", "full_outer").select("doc_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_forms, p3_found, p3_consensus, p3_reliability, p4_found, p4_pieces, p4_rejoined, p5_found, p5_redacted, p5_outside, p6_found, p6_paragraphs,
        p7_containers, p7_fill, p7_whole, p7_within, p8_mixture, p8_shares, p8_within, p9_found, p9_sentences, p9_ends,
    )
}
SQL: dict[str, str] = {
    "p4_rejoined": "select result_key, md5(markdown) as text, true as overlapping, true as within from job_results where markdown <> ''",
    "p5_outside": "select 'text_content' as field, region_key as row_key, true as kept from ocr_regions where text_content <> '' union all select 'markdown', result_key, true from job_results where markdown <> '' union all select 'corrected_text', hitl_key, true from hitl_regions where corrected_text <> ''",
    "p7_whole": "select size_id, doc_id, true as whole from documents, (select distinct size_id from pack_sizes where capacity_tokens > 0)",
    "p7_within": "select distinct size_id, capacity_tokens, true as within from pack_sizes where capacity_tokens > 0",
    "p8_within": "select source, true as repeats, true as share from mix_targets where target_share > 0 and max_repeats > 0 and source in (select source from documents where text <> '')",
    "p9_ends": r"select doc_id, true as same from documents where regexp_matches(text, '[\pL\pN]')",
}

"""Audit roll-ups, costs, budgets and accuracy regression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.strings import places
from palimpsest.operators.clean import lookup

# Dollars per second of an engine's run; others as a CPU.
RATES = {"pdfplumber": 0.000043, "paddleocr": 0.000306, "docling": 0.000164, "trocr": 0.000164, "dots": 0.000306, "llm_arbiter": 0.000306}
CPU_RATE = 0.000043
ALERT_SHARE = 0.8
def rate(engine: Column) -> Column:
    return F.coalesce(lookup({k: str(v) for k, v in RATES.items()}, engine).cast("double"), F.lit(CPU_RATE))


def page_log(aligned: DataFrame) -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return aligned.groupBy("doc_id", "page_num").agg(F.count("*").alias("region_count"), one(F.col("source") == "arbitration").alias("llm_count"), one(F.coalesce("hitl_flag", F.lit(False))).alias("hitl_count"))


def job_log(aligned: DataFrame) -> DataFrame:
    """Roll-up of the page log over documents; the share of regions that were arbitrated."""
    pages = page_log(aligned)
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("region_count").alias("regions"), F.sum("llm_count").alias("llm_count"), F.sum("hitl_count").alias("hitl_count")).withColumn("llm_rate", F.col("llm_count") / F.greatest(F.lit(1), F.col("regions")))


def page_costs(durations: DataFrame) -> DataFrame:
    """Dollars per page of a job result, from its engines' durations, in whole nano-dollars."""
    nano = F.round(F.col("seconds") * rate(F.col("engine")) * 1e9).cast("long")
    return durations.groupBy("result_key", "page_ord", "page_num").agg(F.sum(nano).alias("cost_nano"))


def within_budget(costs: DataFrame, budget_nano: int) -> DataFrame:
    """Pages processed until the budget is reached; the page that reaches it is the last."""
    w = Window.partitionBy("result_key").orderBy("page_ord")
    spent = costs.withColumn("spent_nano", F.sum("cost_nano").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return spent.filter(F.col("spent_nano") - F.col("cost_nano") < budget_nano)


def alerts(spent: DataFrame) -> DataFrame:
    """Rows (job_id, key_hash, spent_usd, budget_usd) at or above the alert share, with a message; a null budget never alerts."""
    hit = spent.filter(F.col("spent_usd") >= F.col("budget_usd") * ALERT_SHARE)
    share = F.col("spent_usd") / F.col("budget_usd") * 100
    money = lambda c: F.format_string("%.4f", c)
    message = F.concat(F.lit("Job "), F.col("job_id").cast("string"), F.lit(" has used "), places(share, 1), F.lit("% of budget ($"), money("spent_usd"), F.lit("/$"), money("budget_usd"), F.lit(")"))
    return hit.select("job_id", "key_hash", "spent_usd", "budget_usd", F.lit(ALERT_SHARE).alias("threshold_pct"), (F.col("spent_usd") >= F.col("budget_usd")).alias("exceeded"), message.alias("message"))


def character_errors(predicted: Column, truth: Column) -> Column:
    """Edits per character of the truth, in code points."""
    return F.when(predicted == truth, 0.0).otherwise(F.levenshtein(predicted, truth) / F.greatest(F.length(truth), F.lit(1)))


def run_benchmarks(inputs: DataFrame, truth: DataFrame, pipeline: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Character error rate of what ``pipeline`` makes of each input (benchmark, markdown) against its truth (benchmark, text): benchmark, metric, value. An input without Markdown counts as an empty text, one without a truth isn't measured."""
    made = truth.join(pipeline(inputs), "benchmark", "left")
    return made.select("benchmark", F.lit("cer").alias("metric"), character_errors(F.coalesce("markdown", F.lit("")), F.col("text")).alias("value"))


def regressions(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured values worse than their limits; metrics that aren't known or measured are never worse."""
    worse = F.when(F.col("metric") == "cer", F.col("value") > F.col("limit")).when(F.col("metric") == "table_teds", F.col("value") < F.col("limit")).otherwise(False)
    return measured.join(limits, ["benchmark", "metric"]).filter(worse)


def regression_report(found: DataFrame) -> DataFrame:
    """The report as lines (line_no, line): title, how many, and a table of benchmarks in order, or that all pass. As many rows as benchmarks."""
    rows = found.select("benchmark", "metric", F.format_string("| %s | %s | %.4f | %.4f |", "benchmark", "metric", "limit", "value").alias("line"))
    all_rows = rows.agg(F.array_sort(F.collect_list(F.struct("benchmark", "metric", "line"))).alias("r"))
    text = lambda *xs: F.array(*map(F.lit, xs))
    count = F.concat(F.lit("**"), F.size("r").cast("string"), F.lit(" regression(s) detected.**"))
    table = F.concat(F.array(count), text("", "| Benchmark | Metric | Expected | Actual |", "|-----------|--------|----------|--------|"), F.transform("r", lambda x: x["line"]))
    lines = F.concat(text("# Regression Report", ""), F.when(F.size("r") > 0, table).otherwise(text("All benchmarks passing.")))
    return all_rows.select(F.posexplode(lines).alias("line_no", "line"))


def log_pages(pages: DataFrame, regions: DataFrame, durations: DataFrame) -> DataFrame:
    """Per page of each log, from its flat tables: regions, arbitrated ones, ones to review, and the cost of its engines in nano-dollars."""
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).cast("long")
    counts = regions.groupBy("result_key", "page_ord").agg(F.count("*").alias("region_count"), one("llm_invoked").alias("llm_count"), one("hitl_flag").alias("hitl_count"))
    costs = page_costs(durations).select("result_key", "page_ord", "cost_nano")
    own = pages.select("result_key", "page_ord", "page_num", "is_ground_truth").join(counts, ["result_key", "page_ord"], "left").join(costs, ["result_key", "page_ord"], "left")
    return own.select("result_key", "page_ord", "page_num", "is_ground_truth", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("region_count", "llm_count", "hitl_count", "cost_nano")])


def log_jobs(pages: DataFrame) -> DataFrame:
    """Totals of each log over its pages, and the share of regions that were arbitrated."""
    total = pages.groupBy("result_key").agg(F.count("*").alias("pages"), *[F.sum(a).cast("long").alias(b) for a, b in (("region_count", "regions"), ("llm_count", "llm_count"), ("hitl_count", "hitl_count"), ("cost_nano", "cost_nano"))])
    return total.withColumn("llm_rate", F.col("llm_count") / F.greatest(F.lit(1), F.col("regions")))

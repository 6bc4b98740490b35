"""Problem 8: mixing sources to target shares of the tokens.

The mixture is as large as the shares allow: the total is the least, over the sources that have documents, of what a
source can give at most (its tokens times its ``max_repeats``) by its share. Each source is put in an order by a hash and
cut into blocks of consecutive documents. It gives all of its blocks as often as they go into its quota and then blocks,
and documents of the last one, up to the quota, so a source misses it by less than half a document.

Blocks go to output shards by a splitting tree: the vector of the sources' block counts is split in two by a multivariate
hypergeometric draw, again and again, until each shard has its exact count of every source; the blocks of a source, in
permuted order, then go to the shards by those counts, so no block goes to two. Documents are shuffled inside their shard.

The driver holds the tree down to at most ``2 * LEAVES`` nodes; the trees below them grow in tasks, so there may be any
number of shards, each of about ``SHARD_TOKENS``. Running sums and ranks of blocks are taken over ranges of blocks: no
source is summed, sorted or held in one task, so one that holds most rows does no harm.

Defined results: documents of null or unlisted sources aren't used; a listed source without tokens gives nothing and the
others keep their proportions; shares that are null or not positive give nothing; a repeated row counts as a document of
its own; null and empty texts have no tokens and are not drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.tokens import FOLDER, VOCABULARY, token_count
from palimpsest.plans.runtime import materialise, ranked

BLOCK_DOCUMENTS, SHARD_TOKENS, LEAVES, SEED = 256, 4_000_000, 4096, 20240501


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts per shard (rows) and source (columns): recursive multivariate hypergeometric splits of the vector of counts; sizes of the shards differ by one block at most."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    draw = rng.multivariate_hypergeometric(counts, total * left // shards, method="marginals") if total else np.zeros_like(counts)
    return np.concatenate([split_tree(draw, left, rng), split_tree(counts - draw, shards - left, rng)])


def leaves(counts: np.ndarray, shards: int, rng: np.random.Generator, size: int) -> list[tuple[np.ndarray, int]]:
    """The upper part of the tree, down to nodes of at most ``size`` shards: their counts and shards."""
    if shards <= size:
        return [(counts, shards)]
    left = shards // 2
    total = int(counts.sum())
    draw = rng.multivariate_hypergeometric(counts, total * left // shards, method="marginals") if total else np.zeros_like(counts)
    return leaves(draw, left, rng, size) + leaves(counts - draw, shards - left, rng, size)


def quotas(available: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, tuple[float, int]]:
    """source -> (tokens to give, tokens it has); targets: source, share, max_repeats."""
    able = [(s, share, repeats) for s, share, repeats in targets if share and share > 0 and repeats and repeats > 0 and available.get(s, 0) > 0]
    if not able:
        return {}
    total = min(available[s] * repeats / share for s, share, repeats in able)
    return {s: (total * share, available[s]) for s, share, _ in able}


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = FOLDER, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(shard, pos, source, key, repeat_no, tokens): the chosen documents, one row per use. ``targets`` is a fixed table of a few rows."""
    spark = documents.sparkSession
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]
    schema = f"shard int, pos long, source string, {key} long, repeat_no int, tokens long"
    listed = documents.filter(F.col(source).isin([s for s, *_ in wanted]))
    sized = listed.select(F.col(key).alias("k"), F.col(source).alias("src"), token_count(F.col(text), folder, vocabulary).alias("tokens")).filter("tokens > 0").withColumn("rid", F.monotonically_increasing_id())
    sized = materialise(sized.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k", "rid"), 11) / F.lit(float(2**53))), "p8-sized")
    have = {r["src"]: (r["n"], r["t"]) for r in sized.groupBy("src").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    plan = quotas({s: t for s, (_, t) in have.items()}, wanted)
    if not plan:
        return spark.createDataFrame([], schema)
    rows = [(s, float(q), int(t), int(q // t), max(1, -(-have[s][0] // BLOCK_DOCUMENTS))) for s, (q, t) in plan.items()]
    each = spark.createDataFrame(rows, "src string, quota double, total long, passes int, blocks int")  # as few as the targets
    docs = sized.join(F.broadcast(each), "src").withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("int"))
    # running tokens: over the blocks of a source, then inside a block
    sums = docs.groupBy("src", "block", "quota", "total", "passes").agg(F.sum("tokens").alias("in_block"))
    before = materialise(ranked(sums, ["src"], ["block"], "before", "in_block").withColumn("rest", F.col("quota") - F.col("passes") * F.col("total")), "p8-blocks")
    # uses of blocks: every full pass, and the last one as far as the quota goes
    last = F.col("before") < F.col("rest")
    uses = before.select("src", "block", "before", "rest", "passes", F.explode(F.when(F.col("passes") + last.cast("int") > 0, F.sequence(F.lit(1), F.col("passes") + last.cast("int"))).otherwise(F.array().cast("array<int>"))).alias("repeat_no"))
    counts = {r["src"]: r["n"] for r in uses.groupBy("src").agg(F.count("*").alias("n")).collect()}
    sources = sorted(counts)
    tokens = sum(q for q, _ in plan.values())
    shards = int(min(max(1, round(tokens / SHARD_TOKENS)), max(1, sum(counts.values()))))
    nodes = leaves(np.array([counts[s] for s in sources], dtype=np.int64), shards, np.random.default_rng(seed), max(1, -(-shards // LEAVES)))
    first, begun = np.cumsum([0, *(n for _, n in nodes)]), np.cumsum([np.zeros(len(sources), dtype=np.int64), *(c for c, _ in nodes)], axis=0)
    # the ranks at which each node's part of a source ends, and below it those of its shards
    tops = spark.createDataFrame([(s, [int(x) for x in begun[1:, i]]) for i, s in enumerate(sources)], "src string, tops array<long>")
    table = spark.createDataFrame([(k, int(first[k]), n, [int(x) for x in begun[k]], [int(x) for x in c]) for k, (c, n) in enumerate(nodes)], "node int, first int, n int, begun array<long>, counts array<long>")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, at, n, begun, counts in zip(pdf["node"], pdf["first"], pdf["n"], pdf["begun"], pdf["counts"]):
                share = split_tree(np.asarray(counts, dtype=np.int64), int(n), np.random.default_rng([seed, int(k)]))
                out += [(s, k, at, (begun[i] + np.cumsum(share[:, i])).tolist()) for i, s in enumerate(sources)]
            yield pd.DataFrame(out, columns=["src", "node", "first", "ends"])

    ends = table.mapInPandas(grow, "src string, node int, first int, ends array<long>")
    order = uses.withColumn("draw", F.xxhash64(F.lit(seed + 1), "block", "repeat_no"))
    drawn = ranked(order, ["src"], ["draw", "block", "repeat_no"], "rank").join(F.broadcast(tops), "src")
    # the first end at or behind this rank
    behind = lambda ends: F.size(F.filter(ends, lambda e: e < F.col("rank")))
    placed = drawn.withColumn("node", behind("tops")).join(ends, ["src", "node"]).select("src", "block", "before", "rest", "passes", "repeat_no", (F.col("first") + behind("ends")).alias("shard"))
    inside = Window.partitionBy("src", "block").orderBy("u", "rid").rowsBetween(Window.unboundedPreceding, -1)
    ordered = docs.select("src", "block", "k", "rid", "u", "tokens").withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    # of the last pass, documents whose middle lies before the quota
    chosen = ordered.join(placed, ["src", "block"]).filter((F.col("repeat_no") <= F.col("passes")) | (F.col("before") + F.col("ahead") + F.col("tokens") / 2 <= F.col("rest")))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "rid", "repeat_no"), "rid", "repeat_no")
    return chosen.withColumn("pos", F.row_number().over(local).cast("long")).select("shard", "pos", F.col("src").alias("source"), F.col("k").alias(key), "repeat_no", "tokens")


def shares(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per listed source: target and reached share of the tokens, rows, documents and the most often one is used."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("repeat_no").alias("most_repeats"))
    full = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # as few rows as the targets
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return full.select("source", "target_share", "max_repeats", zero("tokens"), zero("rows"), zero("most_repeats", "int"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))

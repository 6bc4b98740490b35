"""Problem 7: filling containers of fixed capacity, balanced by cost.

The cost of a document of n tokens is estimated as ``LINEAR * n + QUADRATIC * n ** 2`` (dense layers and attention inside
the document). In descending order, each goes to the container of the lowest cost so far that has room; a new one is
opened only where none has. The containers open from the start are as many as the tokens need.

A text larger than the capacity is split into full containers of its own and a rest that is packed like a document; no
other text is split. Packing is done in shards of about ``SHARD_ITEMS`` documents drawn by a hash, so no group grows with
the data; a shard leaves about one container half empty, which is ``1 / 2`` container in thousands.

Defined results: null and empty texts have no tokens and fit anywhere; a repeated row is packed as often as it stands
there; an empty table gives no rows; sizes that are null or not positive are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import FOLDER, VOCABULARY, token_count
from palimpsest.plans.runtime import materialise

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SHARD_ITEMS = 10_000


def cost(n: np.ndarray | float) -> np.ndarray | float:
    return LINEAR * n + QUADRATIC * n * n


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (none larger than the capacity), numbered from 0. ``sizes`` must be in descending order."""
    n = len(sizes)
    count = max(1, int(-(-int(sizes.sum()) // capacity)))
    room, spent = np.full(n + count, capacity, dtype=np.int64), np.zeros(n + count)
    costs = cost(sizes.astype(float))
    out = np.empty(n, dtype=np.int64)
    at = 0
    while at < n:
        size = int(sizes[at])
        # items of one size and cost: as many as there are containers with room go to distinct ones at once, cheapest first
        same = int(np.searchsorted(-sizes[at:], -size, side="right"))
        fits = np.flatnonzero(room[:count] >= size)
        if not len(fits):
            count += 1
            continue
        take = min(same, max(1, _safe(spent[fits], float(costs[at]))))
        best = fits[np.argpartition(spent[fits], take - 1)[:take]] if take < len(fits) else fits[:take]
        best = best[np.argsort(spent[best], kind="stable")]
        out[at : at + take] = best
        room[best] -= size
        spent[best] += costs[at]
        at += take
    return out


def _safe(spent: np.ndarray, step: float) -> int:
    """How many of the cheapest containers would each be chosen before any is chosen twice: those within ``step`` of the cheapest."""
    return int((spent <= spent.min() + step).sum())


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    return documents.select(key, token_count(F.col(text), folder, vocabulary).alias("tokens"))


def pack(sized: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(size_id, container_id, key, piece_no, token_start, tokens). ``sizes`` is a fixed table of a few rows."""
    wanted = [(r["size_id"], r["capacity_tokens"]) for r in sizes.select("size_id", "capacity_tokens").distinct().collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    spark = sized.sparkSession
    if not wanted:
        return spark.createDataFrame([], f"size_id int, container_id string, {key} long, piece_no int, token_start long, tokens long")
    stored = materialise(sized, "p7-sized")
    shards = max(1, -(-stored.count() // SHARD_ITEMS))
    each = stored.withColumn("rid", F.monotonically_increasing_id()).withColumn("c", F.explode(F.array(*[F.struct(F.lit(a).cast("int").alias("size_id"), F.lit(b).cast("long").alias("cap")) for a, b in sorted(wanted)]))).select(key, "rid", "tokens", "c.*")
    full = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / F.col("cap")).cast("int")  # containers an oversized text fills by itself
    alone = each.filter(F.col("tokens") > F.col("cap")).withColumn("piece_no", F.explode(F.sequence(F.lit(0), full - 1)))
    alone = alone.select("size_id", F.concat_ws("-", F.lit("own"), "rid", "piece_no").alias("container_id"), key, "piece_no", (F.col("piece_no") * F.col("cap")).alias("token_start"), F.col("cap").alias("tokens"))
    items = each.select(key, "rid", "size_id", "cap", full.alias("piece_no"), (full * F.col("cap")).alias("token_start"), (F.col("tokens") - full * F.col("cap")).alias("tokens"), F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", key, "rid"], ascending=[False, True, True], kind="stable")
        boxes = assign(pdf["tokens"].to_numpy(), int(pdf["cap"].iloc[0]))
        return pd.DataFrame({"size_id": pdf["size_id"], "container_id": [f"{s}-{b}" for s, b in zip(pdf["shard"], boxes)], key: pdf[key], "piece_no": pdf["piece_no"], "token_start": pdf["token_start"], "tokens": pdf["tokens"]})

    schema = f"size_id int, container_id string, {key} long, piece_no int, token_start long, tokens long"
    return items.groupBy("size_id", "shard").applyInPandas(run, schema).unionByName(alone)


def fill_report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per size: containers, tokens, share of space that stays unused, largest and mean cost of a container."""
    one = F.col("tokens").cast("double")
    boxes = packed.groupBy("size_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.sum(LINEAR * one + QUADRATIC * one * one).alias("cost"))
    total = boxes.groupBy("size_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("cost").alias("max_cost"), F.avg("cost").alias("mean_cost"))
    return total.join(sizes.select("size_id", "capacity_tokens").distinct(), "size_id").select("size_id", "capacity_tokens", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"), "max_cost", "mean_cost")

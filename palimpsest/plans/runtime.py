"""Session-wide helpers: shared folder, materialised tables, bounded collections, table loading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset, a session on one machine gets a temporary folder; on a cluster it is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


_written: list[str] = []


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True) if now else files.deleteOnExit(target)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives a lost executor. Removed by ``release``, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, now=False)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all that was materialised so far; for callers who have written the results that were built on it."""
    while _written:
        _delete(spark, _written.pop(), now=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_rows(df: DataFrame, bound: int) -> list | None:
    """All rows of ``df`` if there are at most ``bound``, else None: callers must then go another way."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, value: str | None = None) -> DataFrame:
    """``df`` with ``name``: the place (from 1) of a row among those of its group in ``order``, or with ``value`` the sum of that column over the rows before it.

    Rows are sorted over ranges of (group, order), so a group that holds most rows is spread over many tasks; what a range
    has of a group is counted and summed up over the ranges, of which there are as many as shuffle partitions. Rows equal in
    ``order`` are placed in any order."""
    cells = df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).sortWithinPartitions(*group, *order).withColumn("__range", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    stored = materialise(cells, "ranked")
    same = reduce(lambda a, b: a & b, [F.col(f"__k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(group)])
    amount = F.col(value) if value else F.lit(1)
    per = stored.groupBy("__range", *group).agg(F.sum(amount).alias("__n"), F.min("__row").alias("__first"))
    over = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(group)], "__first", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    if value is None:
        joined = stored.join(per, (F.col("__range") == F.col("__r")) & same)
        return joined.select(*df.columns, (F.col("__before") + F.col("__row") - F.col("__first") + 1).alias(name))
    within = Window.partitionBy("__range", *group).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    joined = stored.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(per, (F.col("__range") == F.col("__r")) & same)
    return joined.select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))


def grouped(df: DataFrame, keys: list[str], order: list[str], rows_of: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``rows_of`` to the columns of every group, its rows in ``order``.

    A grouped map for many small groups: groups are cut from sorted partitions batch by batch, so a group costs a slice
    of arrays and not a data frame and an Arrow batch of its own. Groups must fit in memory one at a time."""
    columns = [c.split()[0] for c in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def cut(pdf: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
            arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
            out: list[tuple] = []
            for a, b in zip(np.append(0, ends[:-1]), ends):
                out += rows_of({c: v[a:b] for c, v in arrays.items()})
            return pd.DataFrame(out, columns=columns, dtype=object)

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            changed = np.zeros(max(0, len(pdf) - 1), dtype=bool)
            for k in keys:
                v = pdf[k].to_numpy(dtype=object)
                null = pd.isna(v)
                changed |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
            ends = np.flatnonzero(changed) + 1
            held = pdf.iloc[ends[-1] :] if len(ends) else pdf
            if len(ends):
                yield cut(pdf, ends)
        if held is not None and len(held):
            yield cut(held, np.array([len(held)]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """The fields of a schema, without cutting inside nested types."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]

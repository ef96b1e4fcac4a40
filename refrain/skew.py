"""Joins and numbering that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which every key of the large side is split.
SALTS = 16


#: Share of all rows from which a key is hot; so there are never more than ``1 / HOT_SHARE`` of them.
HOT_SHARE = 1e-3


def hot_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold at least ``HOT_SHARE`` of all rows, at most ``1 / HOT_SHARE``; counted before the shuffle."""
    counts = frame.groupBy(*keys).agg(F.count("*").alias("_c"))
    total = counts.agg((F.sum("_c") * HOT_SHARE).alias("_least"))
    return counts.join(F.broadcast(total), F.col("_c") >= F.greatest("_least", F.lit(2.0))).select(*keys)  # one row


def spread_join(large: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS, hot: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """Join ``large`` to ``small`` on ``keys`` with each key of ``large`` split into ``salts`` parts.

    ``small`` has few rows a key (a dictionary); it is repeated once a part, so a hot key of
    ``large`` is shared by ``salts`` tasks. ``spread_by``: columns of ``large`` whose hash picks the part.
    With ``hot`` (hot_keys() of ``large``) only those keys are split. ``distinct``: repeated rows of ``large`` count
    once; they are dropped in the shuffle of the join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the split side must be the left one")
    part = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is None:
        a, b = large.withColumn("_part", part), small.withColumn("_part", F.explode(every))
    else:
        marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # at most 1 / HOT_SHARE rows
        a = large.join(marked, keys, "left").withColumn("_part", F.when(F.col("_hot"), part).otherwise(0)).drop("_hot")
        b = small.join(marked, keys, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    if distinct:
        a = a.repartition(*keys, "_part").distinct()
    # the repeats of ``small`` shrink to nothing in a shuffle, so its size there must not call for a broadcast
    return a.join(b.hint("merge"), [*keys, "_part"], how).drop("_part")


def distinct_counts(frame: DataFrame, value: str | Column, name: str = "value") -> DataFrame:
    """Distinct non-null values with their row counts; summed before the shuffle, so hot values are harmless."""
    return frame.select((F.col(value) if isinstance(value, str) else value).alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n_rows"))


def spread_out(frame: DataFrame, *columns: str) -> DataFrame:
    """``frame`` in enough parts for slow work on each row: few small rows would else be merged into one or two tasks."""
    spark = frame.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * spark.sparkContext.defaultParallelism)
    return frame.repartition(parts, *columns)

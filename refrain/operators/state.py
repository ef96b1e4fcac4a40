"""Incremental state, caches and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_writer(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K1, K2: the last row of each key by ``order``; summed up before the shuffle, so a hot key does no harm."""
    kept = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *kept)).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in kept])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K1: ``new`` replaces rows of ``old`` with its keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """K3: all children of the parents in ``new`` give way to the new ones."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def pending(listing: DataFrame, known: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """Rows of ``listing`` that are new or whose marks changed. Null marks equal null marks."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) if c in marks else F.col(f"l.{c}") == F.col(f"k.{c}") for c in [*keys, *marks]]
    return listing.alias("l").join(known.select(*keys, *marks).alias("k"), on, "left_anti")


def stale(known: DataFrame, listing: DataFrame, keys: list[str], clean: bool = True) -> DataFrame:
    """Known rows that are no longer listed; none after a listing with errors."""
    gone = known.join(listing.select(*keys).distinct(), keys, "left_anti")
    return gone if clean else gone.limit(0)


def expired(expires_at: Column, now: Column) -> Column:
    """I4: whether a life has ended at ``now``."""
    return expires_at <= now


def expired_as_text(expires_at: Column, now: Column) -> Column:
    """The same by comparing ``...T...`` with ``... ...`` as text: what ends on the same day counts as alive."""
    return F.date_format(expires_at, "yyyy-MM-dd'T'HH:mm:ss") < F.date_format(now, "yyyy-MM-dd HH:mm:ss")


def evicted(entries: DataFrame, limit: Column) -> DataFrame:
    """Entries (kind, path, bytes, cached_at) that go, oldest first, until the rest keeps the limit.

    ``limit``: bytes, may refer to ``total``. The running sum is taken in two steps, over minutes and within a minute, so no task orders
    all entries. Ties go by kind and path; null bytes count 0.
    """
    e = entries.withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long")).withColumn("_m", F.date_trunc("minute", "cached_at"))
    minutes = e.groupBy("_m").agg(F.sum("bytes").alias("_b"))
    before = minutes.withColumn("_d", F.to_date("_m"))
    days = before.groupBy("_d").agg(F.sum("_b").alias("_db"))
    days = days.withColumn("_day_before", F.coalesce(F.sum("_db").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a day
    before = before.join(days.drop("_db"), "_d").withColumn("_before", F.col("_day_before") + F.coalesce(F.sum("_b").over(Window.partitionBy("_d").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = minutes.agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("total"))
    inner = F.coalesce(F.sum("bytes").over(Window.partitionBy("_m").orderBy("cached_at", "kind", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = e.withColumn("_inner", inner).join(before.select("_m", "_before"), "_m").crossJoin(F.broadcast(total))  # one row
    return placed.where(F.col("total") - (F.col("_before") + F.col("_inner")) > limit).select("kind", "path", "bytes", "cached_at")


def adjacent_distinct(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in the group; null equals null."""
    w = Window.partitionBy(group).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn("_keep", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("_keep").drop("_keep")

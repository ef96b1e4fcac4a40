"""Known duplicates, duplicates within a batch, leaders and collision-free names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refrain.functions import text as T
from refrain.io import cut

#: Seconds by which two lengths of one recording may differ.
BAND = 3.0


def known_duplicates(inputs: DataFrame, reference: DataFrame) -> DataFrame:
    """(track_id, path, reason) of inputs that the reference already has.

    ``inputs``: track_id, fingerprint, duration, file_size, file_hash; ``reference``: path and the same. First by equal fingerprint
    and near length, then, for the rest, by equal size and hash; an input with a fingerprint is then only held
    against references without one. Of several the first path counts. Nulls equal nothing.
    """
    r = reference.select("path", F.col("fingerprint").alias("r_fingerprint"), F.col("duration").alias("r_duration"), F.col("file_size").alias("r_size"), F.col("file_hash").alias("r_hash")).distinct()
    by_print = inputs.where(F.col("fingerprint") != "").join(r, (F.col("fingerprint") == F.col("r_fingerprint")) & (F.abs(F.col("duration") - F.col("r_duration")) <= BAND))
    first = by_print.groupBy("track_id").agg(F.min("path").alias("path")).withColumn("reason", F.lit("audio fingerprint"))
    rest = inputs.join(first.select("track_id"), "track_id", "left_anti")
    by_hash = rest.join(r, (F.col("file_size") == F.col("r_size")) & (F.col("file_hash") == F.col("r_hash")) & (F.col("fingerprint").isNull() | (F.col("fingerprint") == "") | F.col("r_fingerprint").isNull()))
    second = by_hash.groupBy("track_id").agg(F.min("path").alias("path")).withColumn("reason", F.lit("exact file hash"))
    return first.unionByName(second)


KEYS = ("isrc", "title_artist", "duration", "fingerprint", "file_hash")


def _signatures(signatures: DataFrame) -> DataFrame:
    """Each signature once, with its keys in one form; blank ones are null."""
    return signatures.dropDuplicates(["track_id"]).select("track_id", F.nullif(T.code_key(F.col("isrc")), F.lit("")).alias("isrc"), "title_artist", "duration", F.nullif("fingerprint", F.lit("")).alias("fingerprint"), F.nullif("file_hash", F.lit("")).alias("file_hash"))


def _classes(s: DataFrame) -> DataFrame:
    """(keys, id, n, same) of the classes of equal signatures; ``same``: whether its copies are duplicates of each other."""
    same = F.col("isrc").isNotNull() | F.col("fingerprint").isNotNull() | (F.col("file_hash").isNotNull() & F.col("title_artist").isNotNull())
    return s.groupBy(*KEYS).agg(F.min("track_id").alias("id"), F.count("*").alias("n")).withColumn("same", same)


def _of_class(s: DataFrame, classes: DataFrame) -> DataFrame:
    """``s`` joined to its classes as ``s`` and ``c``."""
    on = None
    for k in KEYS:
        c = F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}"))
        on = c if on is None else on & c
    return s.alias("s").join(classes.alias("c"), on)


def batch_links(signatures: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of classes of equal signatures that are duplicates; a class stands for its exact copies.

    ``signatures``: track_id, isrc, title_artist, duration, fingerprint, file_hash. Three equality joins, each with the
    length as a band, make up the alternatives of the rule, so rows of one key meet only if they differ.
    """
    classes = _classes(_signatures(signatures)).drop("same")
    other = classes.select(*[F.col(c).alias(f"o_{c}") for c in classes.columns])
    near = F.coalesce(F.abs(F.col("duration") - F.col("o_duration")) <= BAND, F.lit(True))
    both = F.coalesce(F.col("title_artist") == F.col("o_title_artist"), F.lit(False)) | (F.col("fingerprint").isNotNull() & F.col("o_fingerprint").isNotNull())
    parts = [classes.join(other, (F.col(k) == F.col(f"o_{k}")) & (F.col("id") < F.col("o_id")) & near & (both if k != "isrc" else F.lit(True))) for k in ("isrc", "fingerprint", "file_hash")]
    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return pairs.select(F.col("id").alias("a"), F.col("o_id").alias("b"), F.col("n").alias("n_a"), F.col("o_n").alias("n_b")).distinct()


def batch_duplicates(signatures: DataFrame) -> DataFrame:
    """(track_id, class_id, n_links): each signature, the class of its exact copies and how many others it duplicates.

    Copies of a signature that has a code, a fingerprint or a hash with a title are duplicates of each other.
    """
    s = _signatures(signatures)
    links = batch_links(signatures)
    sums = links.select(F.col("a").alias("id"), F.col("n_b").alias("k")).unionByName(links.select(F.col("b").alias("id"), F.col("n_a").alias("k"))).groupBy("id").agg(F.sum("k").alias("k"))
    counted = _classes(s).join(sums, "id", "left").select(*KEYS, F.col("id").alias("class_id"), (F.coalesce("k", F.lit(0)) + F.when(F.col("same"), F.col("n") - 1).otherwise(0)).alias("n_links"))
    return _of_class(s, counted).select("s.track_id", "c.class_id", F.col("c.n_links").cast("long").alias("n_links"))


def leader_of_each(signatures: DataFrame) -> DataFrame:
    """(track_id, class_id, leader) of every signature, in the order of track_id.

    A class of exact copies is one node, as what its first row joins its copies join too; so the rounds run over
    classes only. Copies that are no duplicates even of each other (no code, no fingerprint, no hash with a
    title) link to nothing by the rule or only by a hash and a title they lack: each leads itself.
    """
    s = _signatures(signatures)
    classes = _classes(s)
    led = leaders(classes.select("id"), batch_links(signatures).select("a", "b"))
    known = classes.join(led, "id").select(*KEYS, F.col("id").alias("class_id"), "leader", "same")
    return _of_class(s, known).select("s.track_id", "c.class_id", F.when(F.col("c.same"), F.col("c.leader")).otherwise(F.col("s.track_id")).alias("leader"))


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, leader): each row in order of id joins the first leader it matches, else it becomes one.

    ``nodes``: id; ``edges``: a, b with a < b. The ordered scan is run in rounds: a row is a leader once all
    its smaller neighbours are known to be none, and is led once one of them is a leader. Rounds
    end when all are known; no component is gathered in one task.
    """
    state = cut(nodes.select("id").distinct().withColumn("lead", F.lit(None).cast("boolean")))
    e = cut(edges.select("a", "b").distinct())
    while True:
        small = e.join(state.select(F.col("id").alias("a"), F.col("lead").alias("a_lead")), "a").groupBy("b").agg(F.max(F.coalesce("a_lead", F.lit(False))).alias("led"), F.max(F.col("a_lead").isNull()).alias("open"))
        new = state.join(small.withColumnRenamed("b", "id"), "id", "left").select("id", F.when(F.col("lead").isNotNull(), F.col("lead")).when(F.coalesce("led", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True)).alias("lead"))
        state = cut(new)
        if state.where(F.col("lead").isNull()).isEmpty():
            break
    first = e.join(state.where("lead").select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader"))
    return state.join(first.withColumnRenamed("b", "id"), "id", "left").select("id", F.when(F.col("lead"), F.col("id")).otherwise(F.col("leader")).alias("leader"))


def numbered(rows: DataFrame, key: str, order: str, width: int = 10_000, name: str = "n") -> DataFrame:
    """``rows`` with their number within ``key`` in the order of the whole number ``order``.

    Numbers are given within ranges of ``width`` and raised by the counts of the ranges before, so no task holds
    more than ``width`` rows of a key, however hot it is. ``order`` must be unique within a key.
    """
    r = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = r.groupBy(key, "_range").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inner = r.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    return inner.join(before, [key, "_range"]).withColumn(name, F.col("_n") + F.col("_before")).drop("_range", "_n", "_before")

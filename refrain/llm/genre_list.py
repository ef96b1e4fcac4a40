"""Mapping freely typed values to a reference list (problem 1).

Token-level repair: every distinct token is joined to the vocabulary of the list by edit
distance, through deletion keys and so by equality alone; the repaired tokens are then weighed by
soft TF-IDF to rank whole entries. A value whose best entry scores under the threshold means
no entry and is reported with id -1.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.io import cut, load
from refrain.skew import distinct_counts, spread_join

# Other names of the entries that no edit of tokens leads to: translations, other scripts and clippings.
ALIASES = {
    "Desert Blues": ["Wüstenblues"],
    "Chamber Jazz": ["Kammerjazz"],
    "Math Rock": ["mathematical rock"],
    "Gospel": ["Gospelmusik"],
    "Field Recording": ["Feldaufnahme"],
    "Film Music": ["movie score"],
    "Video Game Music": ["Videospielmusik"],
    "Choral": ["choir music", "Chormusik"],
    "String Quartet": ["Streichquartett", "quatuor à cordes", "cuarteto de cuerda"],
    "Baroque": ["Barock", "barroco"],
    "Minimalism": ["Minimal Music"],
    "Psychedelic Rock": ["psych rock", "rock psychédélique", "psychedelischer Rock"],
    "Grindcore": ["Grind"],
    "Lullaby": ["Lullabies", "Wiegenlied", "berceuse", "canción de cuna"],
    "Sea Shanty": ["Seemannslied"],
    "Brass Band": ["Blaskapelle"],
    "Steelpan": ["steel drum band"],
    "Qawwali": ["قوالی"],
    "Rebetiko": ["Ρεμπέτικο"],
    "Enka": ["演歌"],
    "Persian Classical": ["klassisch persisch", "موسیقی سنتی ایرانی", "musique classique persane"],
}
#: Words that say nothing about the entry, and words that say little.
DECORATION = {"and", "n", "a", "de", "del", "du", "vol", "volume", "live", "set", "various", "mostly", "genre", "style"}
GENERIC = {"music", "musik", "musique", "música", "musica", "muzik"}
GENERIC_WEIGHT = 0.35
#: What people type for want of an entry; these compete with the entries.
NON_ENTRIES = ["Other", "Unknown", "Untagged", "Misc", "None", "Podcast", "Audiobook", "Hörbuch"]
#: The least score of an entry that is meant, and the length from which a token may have one or two edits.
THRESHOLD, ONE_EDIT, TWO_EDITS = 0.45, 3, 5

_PATH = re.compile(r"^\W*(?:music|genre|style)\s*[:>/]\s*", re.I)
_CODE = re.compile(r"^\W*\(\d+\)")


def fold(text: str) -> str:
    """Compatibility forms, case and accents removed."""
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold()) if not unicodedata.combining(c))


def tokens_of(value: str | None) -> list[str]:
    """The telling tokens of a value in order: without path, code, number, year and decoration."""
    if value is None:
        return []
    text = _CODE.sub("", _PATH.sub("", fold(value)))
    if ">" in text:
        text = text.rsplit(">", 1)[1]
    words = re.findall(r"[^\W_]+", text)
    kept = [w for w in words if w not in DECORATION and not re.fullmatch(r"\d+s?", w)]
    return kept


def _deletions(token: F.Column, most: int) -> F.Column:
    """``token`` and all strings left after deleting one (for long tokens up to ``most``) characters."""

    def once(x: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1 << 20))))

    one = F.when(F.length(token) >= ONE_EDIT, once(token)).otherwise(F.array().cast("array<string>"))
    if most == 1:
        return F.array_distinct(F.concat(F.array(token), one))
    two = F.when(F.length(token) >= TWO_EDITS - 1, F.flatten(F.transform(once(token), once))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(token), one, two))


def reference_forms(entries: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(genre_id, form_id, tokens) of every entry's name and other names, also run together."""
    known = ALIASES if aliases is None else aliases
    spark = entries.sparkSession
    names = entries.where(F.col("name").isNotNull()).select("genre_id", "name").dropDuplicates(["genre_id"])
    rows = [(n, a) for n, each in known.items() for a in each] or [("", "")]
    other = names.join(spark.createDataFrame(rows, "name string, form string"), "name").select("genre_id", F.col("form"))
    none = spark.createDataFrame([(-1, x) for x in NON_ENTRIES], "genre_id long, form string")
    forms = names.select("genre_id", F.col("name").alias("form")).unionByName(other).unionByName(none)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def spellings(form: pd.Series) -> pd.Series:
        def each(x: str) -> list[list[str]]:
            t = tokens_of(x)
            both = re.findall(r"[^\W_]+", fold(x).replace("&", " and "))
            joined = {"".join(t), "".join(both), "".join("n" if w == "and" else w for w in both)}
            if len(both) > 2:  # initials, with the joining word said or shortened
                joined |= {"".join(w[0] for w in both), *("".join(j if w == "and" else w[0] for w in both) for j in ("and", "n", "") if "and" in both)}
            return [t, *([j] for j in sorted(joined) if j and [j] != t)] if t else []

        return form.map(each)

    return (
        forms.withColumn("tokens", F.explode(spellings("form")))
        .select("genre_id", "tokens").distinct()
        .withColumn("form_id", F.xxhash64("genre_id", F.array_join("tokens", " ")))
    )


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _readings(value: pd.Series) -> pd.Series:
    """Two readings of a value: its tokens, and all of them run together."""

    def each(x: str | None) -> list[list[str]]:
        t = tokens_of(x)
        return ([t] if len(t) < 2 else [t, ["".join(t)]]) if t else []

    return value.map(each)


def map_values(values: DataFrame, entries: DataFrame, aliases: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(value, genre_id, score) for each distinct ``value``; genre_id -1 where no entry is meant.

    Null values are left out; values without a telling token get -1 and score 0; equal scores
    are settled by the lesser genre_id. An empty list maps every value to -1. Further columns
    of either input are ignored.
    """
    values = cut(values.select("value").where(F.col("value").isNotNull()).distinct())
    forms = reference_forms(entries, aliases)
    # the tables of the list are used many times each, so they are written once
    form_tokens = cut(forms.select("genre_id", "form_id", F.explode("tokens").alias("word")).groupBy("genre_id", "form_id", "word").agg(F.count("*").alias("tf")).coalesce(1))
    n_forms = float(form_tokens.select(F.countDistinct("form_id")).first()[0])
    generic = F.when(F.col("word").isin(*sorted(GENERIC)), GENERIC_WEIGHT).otherwise(1.0)
    vocabulary = cut((
        form_tokens.groupBy("word").agg(F.countDistinct("genre_id").alias("df"))
        .select("word", (generic * F.log(1 + F.lit(n_forms) / F.col("df"))).alias("idf"))
    ).coalesce(1))
    weighed = form_tokens.join(vocabulary, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("form_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighed = cut(weighed.join(norm, "form_id").select("genre_id", "form_id", "word", (F.col("w") / F.col("norm")).alias("w_form")).coalesce(1))

    readings = values.select("value", F.explode(_readings("value")).alias("t")).withColumn("reading", F.xxhash64("value", F.array_join("t", " ")))
    value_tokens = cut(readings.select("value", "reading", F.explode("t").alias("token")))
    # a token that is two longer than every word is within two edits of none
    longest = vocabulary.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("n")).first()["n"]
    tokens = value_tokens.select("token").where(F.length("token") <= longest + 2).distinct()
    keyed = tokens.select("token", F.explode(_deletions(F.col("token"), 2)).alias("key"))
    words = vocabulary.select("word", "idf", F.explode(_deletions(F.col("word"), 2)).alias("key"))
    d = F.levenshtein("token", "word")
    swapped = (F.array_sort(F.split("token", "")) == F.array_sort(F.split("word", ""))) & (d == 2)
    longer = F.greatest(F.length("token"), F.length("word"))
    allowed = F.when(longer >= TWO_EDITS, 2).when(longer >= ONE_EDIT, 1).otherwise(0)
    repaired = cut(
        keyed.join(words, "key").select("token", "word", "idf").distinct()
        .withColumn("d", F.when(swapped, 1).otherwise(d)).where(F.col("d") <= allowed)
        .select("token", "word", "idf", (1 - F.col("d") / longer).alias("sim"))
    )
    best = repaired.groupBy("token").agg(F.max_by("idf", "sim").alias("idf"))
    value_weights = (
        value_tokens.groupBy("value", "reading", "token").agg(F.count("*").alias("tf"))
        .join(best.hint("merge"), "token", "left")  # tokens grow with the values
        .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(math.log(1 + n_forms))))
    )
    value_norm = value_weights.groupBy("reading").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    value_weights = value_weights.join(value_norm.hint("merge"), "reading").select("value", "reading", "token", (F.col("w") / F.col("norm")).alias("w_value"))
    scores = (
        value_weights.join(repaired.select("token", "word", "sim").hint("merge"), "token").join(F.broadcast(weighed), "word")  # the list
        .groupBy("value", "reading", "genre_id", "form_id", "word").agg(F.max(F.col("sim") * F.col("w_value") * F.col("w_form")).alias("part"))
        .groupBy("value", "reading", "genre_id", "form_id").agg(F.sum("part").alias("score"))
        .groupBy("value").agg(F.max(F.struct(F.round("score", 6).alias("score"), (-F.col("genre_id")).alias("low"))).alias("best"))
    )
    score = F.coalesce(F.col("best.score"), F.lit(0.0))
    return values.join(scores.hint("merge"), "value", "left").select("value", F.when(score >= threshold, -F.col("best.low")).otherwise(F.lit(-1)).cast("long").alias("genre_id"), score.alias("score"))


def cases(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (candidate_id, value) whose genre is neither null, blank nor exactly a name of the list."""
    blank = F.regexp_replace("genre", r"[\s\p{Z}]+", "") == ""
    typed = candidates.where(F.col("genre").isNotNull() & ~blank).select("candidate_id", F.col("genre").alias("value"))
    names = entries.select(F.col("name").alias("value")).where(F.col("value").isNotNull()).distinct()
    return spread_join(typed, names, ["value"], ["candidate_id"], "left_anti").distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p1_found: every candidate with a freely typed genre and the entry meant."""
    entries = load(spark, folder, "genres")
    rows = cases(load(spark, folder, "candidates").select("candidate_id", "genre"), entries)
    mapping = map_values(rows.select("value"), entries)
    return spread_join(rows, mapping.select("value", "genre_id"), ["value"], ["candidate_id"]).select("candidate_id", "genre_id")


def mapping_report(spark: SparkSession, folder: str) -> DataFrame:
    """p1_values: each distinct typed value with its rows, entry and score; unmatched values have -1."""
    entries = load(spark, folder, "genres")
    rows = cases(load(spark, folder, "candidates").select("candidate_id", "genre"), entries)
    return map_values(rows.select("value"), entries).join(distinct_counts(rows, "value"), "value").select("value", "n_rows", "genre_id", F.round("score", 3).alias("score"))

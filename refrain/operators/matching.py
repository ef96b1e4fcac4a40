"""Scoring, agreement, votes and survivorship over candidates of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refrain.functions import numbers as N
from refrain.functions import text as T
from refrain.skew import spread_out

# Points of trust by provider, of which those of 5 points are credible catalogues, and the priority up to which O1 trusts a provider.
TRUST = {
    5.0: ("spotify", "itunes", "deezer", "musicbrainz", "radiojavan", "audiomack", "navahang", "shazam", "genius"),
    4.0: ("audd", "acoustid", "songrec"),
    2.0: ("discogs", "theaudiodb", "soundcloud"),
    1.0: ("lastfm", "wikidata", "youtube"),
}
TRUSTED = 6


def fingerprint_score(acoustid: Column, delta: Column, title: Column, artist: Column, album: Column, compilation: Column) -> Column:
    """Points from 0 to 100; similarities that are null count 0, a missing distance half."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    total = 0.45 * N.clamp(z(acoustid), 0.0, 1.0) + 0.20 * N.duration_step(delta, 0.5) + 0.15 * z(title) + 0.10 * z(artist) + 0.10 * z(album) - F.when(compilation, 0.08).otherwise(0.0)
    return N.clamp(total, 0.0, 1.0) * 100


def text_score(title: Column, artist: Column, album: Column, has_album: Column, has_artist: Column, delta: Column, cap: Column) -> Column:
    """Points by text alone in one of three regimes, at most ``cap``."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    d = N.duration_step(delta, 0.0)
    total = F.when(has_album, 0.35 * z(title) + 0.25 * z(artist) + 0.25 * z(album) + 0.15 * d).when(has_artist, 0.45 * z(title) + 0.35 * z(artist) + 0.20 * d).otherwise(0.75 * z(title) + 0.25 * d)
    return F.least(N.clamp(total, 0.0, 1.0) * 100, cap)


def agreement(rows: DataFrame) -> DataFrame:
    """(block, ord, score, n_agree, n_conflict) after each row was held against the rows of other sources in its block.

    ``rows``: block, ord, provider, title, artist, album, code, score, audio. A source that agrees
    gives 6 points once, up to 98 (99 with audio); one that conflicts takes 4 once, down to 0, in
    the order of ``ord``. The block is a small unit such as a track; null blocks meet nothing. Both
    directions are kept, as the rule is not symmetric. Texts are held against each other once a block,
    however many rows have them, and a text's first row of a source stands for all of them.
    """
    filled = lambda c: F.when(T.ws_trim(F.col(c)) != "", T.ascii_lower(F.col(c)))
    texts = ["_title", "_artist", "_album", "_code"]
    said = rows.where(F.col("block").isNotNull() & F.col("provider").isNotNull()).select("block", "ord", "provider", filled("title").alias("_title"), filled("artist").alias("_artist"), filled("album").alias("_album"), F.upper("code").alias("_code"))
    first = said.groupBy("block", *texts, "provider").agg(F.min("ord").alias("o_ord"))
    kinds = spread_out(first.groupBy("block", *texts).agg(F.collect_list(F.struct(F.col("provider").alias("o_provider"), "o_ord")).alias("by")), "block")  # a source is one row
    o = kinds.select(F.col("block").alias("o_block"), *[F.col(c).alias(f"o{c}") for c in texts], F.col("by").alias("o_by"))
    met = kinds.drop("by").join(o, F.col("block") == F.col("o_block"))
    alike = lambda c: F.coalesce(T.similarity(F.col(c), F.col(f"o{c}")), F.lit(0.0))
    coded, albums = F.coalesce(F.col("_code") == F.col("o_code"), F.lit(False)), F.coalesce(T.similarity(F.col("_album"), F.col("o_album")) >= 0.65, F.lit(True))
    t, a = alike("_title"), alike("_artist")
    sign = F.when(coded, 1).when(t < 0.55, 0).when((a >= 0.75) & albums & (t >= 0.82), 1).when(a < 0.55, -1).otherwise(0)  # most pairs end at their titles
    signed = met.select("block", *texts, "o_by", sign.alias("s")).where("s <> 0").select("block", *texts, "s", F.inline("o_by"))
    held = signed.groupBy("block", *texts, "o_provider", "s").agg(F.min("o_ord").alias("o_ord")).groupBy("block", *texts).agg(F.collect_list(F.struct("o_provider", "s", "o_ord")).alias("held"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in texts]
    mine = said.alias("r").join(held.alias("h"), [F.col("r.block") == F.col("h.block"), *same]).select("r.block", "r.ord", F.filter("held", lambda x: x["o_provider"] != F.col("provider")).alias("held")).repartition("block", "ord")  # as short as they are for the shuffle
    once = mine.select("block", "ord", F.inline("held")).groupBy("block", "ord", "o_provider", "s").agg(F.min("o_ord").alias("at"))
    steps = once.groupBy("block", "ord").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("steps"))
    cap = F.when(F.col("audio"), 99.0).otherwise(98.0)
    fold = F.aggregate("steps", F.col("score").cast("double"), lambda acc, x: F.when(x["s"] > 0, F.least(acc + 6.0, cap)).otherwise(F.greatest(acc - 4.0, F.lit(0.0))))
    count = lambda v: F.coalesce(F.size(F.filter("steps", lambda x: x["s"] == v)), F.lit(0))
    return rows.join(steps, ["block", "ord"], "left").select("block", "ord", F.coalesce(fold, F.col("score")).alias("score"), F.when(F.col("steps").isNull(), 0).otherwise(count(1)).alias("n_agree"), F.when(F.col("steps").isNull(), 0).otherwise(count(-1)).alias("n_conflict"))


def keep_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, found by aggregation before the shuffle, so a hot key does no harm."""
    kept = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *kept)
    return rows.groupBy(*keys).agg(F.min(ranked).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in kept])


def descending(c: Column) -> Column:
    """A number as a sort key for descending order, nulls last."""
    return F.when(c.isNull(), F.lit(float("inf"))).otherwise(-c.cast("double"))


def trust_tier(acoustid: Column, audio: Column, priority: Column, sources: Column) -> Column:
    """O1: 3 with audio evidence, 2 for a trusted source, 1 if two sources agree, else 0."""
    return F.when(acoustid.isNotNull() | F.coalesce(audio, F.lit(False)), 3).when(priority <= TRUSTED, 2).when(F.size(F.array_distinct(sources)) >= 2, 1).otherwise(0)


def top_k(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def vote(evidence: DataFrame) -> DataFrame:
    """A4: (item, class, total, confidence, alternatives) of the class with the most weight.

    ``evidence``: item, source, class, weight. A source counts once for a class, with its greatest weight; ties go
    to the greater single weight, then to the lesser name. Nulls don't vote.
    """
    valid = evidence.where(F.col("item").isNotNull() & F.col("class").isNotNull() & F.col("weight").isNotNull())
    per_source = valid.groupBy("item", "source", "class").agg(F.max("weight").alias("weight"))
    per_class = per_source.groupBy("item", "class").agg(F.round(F.sum("weight"), 9).alias("total"), F.max("weight").alias("top"), F.count("*").alias("n"))
    ranked = per_class.groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("a"), (-F.col("top")).alias("b"), F.col("class").alias("c"), "n"))).alias("r"))  # a class is one row
    first = F.col("r")[0]
    return ranked.select("item", first["c"].alias("class"), F.round(-first["a"], 6).alias("total"), F.round(F.least(-first["b"] + 0.08 * (first["n"] - 1), F.lit(0.98)), 6).alias("confidence"), F.array_join(F.transform(F.slice("r", 2, 3), lambda x: x["c"]), "|").alias("alternatives"))


def survivors(rows: DataFrame, item: str, rank: list[Column], fields: list[str]) -> DataFrame:
    """For each field the first value that is not null, in the order of the item's donors."""
    key = F.struct(*[r.alias(f"_{i}") for i, r in enumerate(rank)])
    return rows.groupBy(item).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), key)).alias(f) for f in fields])


def completeness(weights: dict[str, int], present: dict[str, Column]) -> tuple[Column, Column]:
    """(score, names of what is missing) of weighted presence flags."""
    score = sum((F.when(present[k], w).otherwise(0) for k, w in weights.items()), F.lit(0))
    missing = F.array_join(F.filter(F.array(*[F.when(~present[k], F.lit(k)) for k in weights]), lambda x: x.isNotNull()), ",")
    return score, missing


def _column(frame: DataFrame, name: str, kind: str) -> Column:
    """Column ``name``, or nulls where ``frame`` lacks it."""
    return F.col(name) if name in frame.columns else F.lit(None).cast(kind)


def agreeing(rows: DataFrame) -> DataFrame:
    """(candidate_id, n_agree, first_year): other providers that name the same recording, and the earliest year of its album releases.

    ``rows``: track_id, candidate_id, provider, c_title, c_artist, cv, c_year, is_album. Rows of one track
    agree on takes, title (.90) and artist (.82); a row agrees with itself, which counts for the year only.
    """
    r = rows.select("track_id", "candidate_id", "provider", "cv", "c_year", "is_album", T.words_text(F.col("c_title"), True).alias("x"), T.telling_words(F.col("c_title")).alias("told"), T.words_text(F.col("c_artist"), True).alias("y"))  # once a row, not once a pair
    o = r.select(*[F.col(c).alias(f"o_{c}") for c in r.columns])
    met = r.join(o, (F.col("track_id") == F.col("o_track_id")) & (F.col("cv") == F.col("o_cv")))
    met = met.where(T.strict_titles(F.col("x"), F.col("o_x"), F.col("told"), F.col("o_told"), 0.90) & T.strict_artists(F.col("y"), F.col("o_y"), 0.82))
    other = (F.col("candidate_id") != F.col("o_candidate_id")) & (F.col("provider") != F.col("o_provider"))
    return met.groupBy("candidate_id").agg(F.size(F.collect_set(F.when(other, F.col("o_provider")))).alias("n_agree"), F.min(F.when(F.col("o_is_album"), F.col("o_c_year"))).alias("first_year"))


def decide(tracks: DataFrame, candidates: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """(track_id, candidate_id, total, confidence, margin) of tracks whose best supported candidate is clear.

    C6 gives points for title, artist, length, album, presence of fields, agreeing sources, the provider's trust
    and audio. C7 then leaves only candidates that are recognised, corroborated or exact in a credible catalogue,
    without a weak raw score on one source alone and with the takes that the file's name and title tell; the others
    neither win nor stand in the way. Of these the best must reach 68 points and lead any different recording by 12.
    Trust goes by the names of ``TRUST``; a provider of ``providers`` (provider, priority) that it lacks is credible
    up to the priority that O1 trusts. Repeated rows count once; tracks without supported candidates give no row.
    """
    t = tracks.dropDuplicates(["track_id"]).select("track_id", _column(tracks, "filename", "string").alias("filename"), F.col("current_title").alias("t_title"), F.col("current_artist").alias("t_artist"), F.col("current_album").alias("t_album"), "duration")
    c = candidates.dropDuplicates(["candidate_id"])
    kind, secondary = _column(c, "release_type", "string"), F.lower(_column(c, "release_secondary_types", "string"))
    c = (
        c.withColumn("provider", _column(c, "provider", "string")).withColumn("c_title", F.coalesce("title", F.lit(""))).withColumn("c_artist", F.coalesce("artist", F.lit(""))).withColumn("cv", T.version_tags(F.col("title")))
        .withColumn("is_album", F.coalesce(F.lower(kind) == "album", F.lit(False)) & ~F.coalesce("is_compilation", F.lit(False)) & ~F.coalesce(secondary.contains("compilation") | secondary.contains("live"), F.lit(False)))
        .withColumn("dated", F.col("release_date").isNotNull() | _column(c, "year", "string").isNotNull()).withColumn("c_year", N.date_prefix_year(F.col("release_date"), _column(c, "year", "string")))
    )
    agree = agreeing(c.select("track_id", "candidate_id", "provider", "c_title", "c_artist", "cv", "c_year", "is_album"))
    trust, credible = F.coalesce(*[F.when(F.col("provider").isin(*names), F.lit(points)) for points, names in TRUST.items()]), F.col("provider").isin(*TRUST[5.0])
    if providers is not None:
        c = c.join(F.broadcast(providers.select("provider", "priority").dropDuplicates(["provider"])), "provider", "left")
        trust = F.coalesce(trust, F.when(F.col("priority") <= TRUSTED, max(TRUST)))
        credible = credible | (F.coalesce(F.col("priority") <= TRUSTED, F.lit(False)) & ~F.col("provider").isin(*[n for names in TRUST.values() for n in names]))
    c = c.withColumn("trust", F.coalesce(trust, F.lit(0.0))).withColumn("credible", F.coalesce(credible, F.lit(False)))
    usable = c.where(T.nonempty(F.col("title")).isNotNull() & T.nonempty(F.col("artist")).isNotNull())
    j = t.join(usable, "track_id").join(agree, "candidate_id")  # a usable row at least agrees with itself
    meaningful = lambda f: F.coalesce((T.ws_trim(F.col(f)) != "") & ~T.ws_trim(F.col(f)).startswith("@"), F.lit(False))
    title = F.when(T.nonempty(F.col("t_title")).isNull(), F.lit(None)).otherwise(T.title_similarity_strict(F.col("t_title"), F.col("title")))
    artist = F.when(T.nonempty(F.col("t_artist")).isNull(), F.lit(None)).otherwise(T.artist_similarity_strict(F.col("t_artist"), F.col("artist")))
    album = F.when(~meaningful("t_album") | T.nonempty(F.col("album")).isNull(), F.lit(None)).otherwise(T.similarity(T.words_text(F.col("t_album"), True), T.words_text(F.col("album"), True)))
    audio = F.coalesce(F.col("acoustid") > 0, F.lit(False)) | F.coalesce(F.col("audio_recognition"), F.lit(False))
    delta = F.when(F.col("duration_s").isNotNull(), F.abs(F.col("duration") - F.col("duration_s"))).when(F.col("duration_delta") <= 60, F.col("duration_delta"))
    n_sources = F.greatest(F.size(F.array_distinct(F.array_compact("sources"))), F.col("n_agree") + 1, F.lit(1))
    original = ~meaningful("t_album") & F.col("is_album") & F.coalesce(F.col("c_year") == F.col("first_year"), F.lit(False))
    j = j.select("track_id", "candidate_id", "ord", "c_title", "c_artist", F.col("isrc"), title.alias("ts"), artist.alias("as"), album.alias("ls"), audio.alias("audio"), delta.alias("delta"), T.version_tags(F.concat_ws(" ", "filename", "t_title")).alias("tv"), "cv", n_sources.alias("n_sources"), F.coalesce("score", F.lit(0.0)).alias("score"), meaningful("album").alias("has_album"), "cover_url", "dated", "track_number", "genre", "album_artist", F.coalesce("is_compilation", F.lit(False)).alias("is_compilation"), "is_album", original.alias("original"), "trust", "credible")
    has = lambda f, y, n=0.0: F.when(F.col(f).isNotNull(), y).otherwise(n)
    holds = lambda f, y, n=0.0: F.when(F.col(f), y).otherwise(n)
    total = (
        F.coalesce(F.col("ts") * 28, F.lit(21.0)) + F.coalesce(F.col("as") * 18, F.lit(15.0)) + N.duration_points(F.col("delta"), F.col("audio"))
        + F.when(F.col("ls") < 0.40, -8.0).when(F.col("ls").isNotNull(), F.col("ls") * 18).when(F.col("is_album"), 6.0).when(F.col("is_compilation"), -7.0).otherwise(0.0)
        + holds("has_album", 3.0, -4.0) + has("cover_url", 3.0, -2.0) + holds("dated", 2.0) + has("track_number", 1.5) + has("genre", 1.5) + has("album_artist", 1.0) + has("isrc", 1.0)
        + 5.0 * F.least(F.col("n_sources") - 1, F.lit(3)) + F.col("trust") + 0.08 * N.clamp(F.col("score"), 0.0, 100.0) + holds("audio", 15.0) + holds("original", 4.0)
        - 22.0 * F.size(F.array_except("cv", "tv")) - 16.0 * F.size(F.array_except("tv", "cv")) - holds("is_compilation", 7.0)
    )
    at_least = lambda x, y: (F.coalesce(F.col("ts"), F.lit(1.0)) >= x) & (F.coalesce(F.col("as"), F.lit(1.0)) >= y)
    exact = F.col("ts").isNotNull() & F.col("as").isNotNull() & at_least(0.90, 0.82) & F.coalesce(F.col("delta") <= 8, F.lit(False))
    supported = (F.col("audio") & at_least(0.72, 0.65)) | ((F.col("n_sources") >= 2) & at_least(0.82, 0.72)) | (F.col("credible") & exact)
    weak = (F.col("score") < 55) & ~F.col("audio") & (F.col("n_sources") < 2)
    scored = j.withColumn("total", F.round(total, 6)).where(supported & ~weak & (F.col("cv") == F.col("tv")))
    by_rank = Window.partitionBy("track_id").orderBy(F.col("total").desc(), "ord", "candidate_id")  # a track has few candidates
    ranked = scored.withColumn("rank", F.row_number().over(by_rank)).withColumn("next", F.lead(F.struct("total", "c_title", "c_artist", "isrc", "cv")).over(by_rank)).where("rank = 1")
    n = F.col("next")
    same = F.coalesce(T.code_key(F.col("isrc")) == T.code_key(n["isrc"]), F.lit(False)) | ((F.col("cv") == n["cv"]) & (T.title_similarity_strict(F.col("c_title"), n["c_title"]) >= 0.90) & (T.artist_similarity_strict(F.col("c_artist"), n["c_artist"]) >= 0.82))
    margin = F.when(n.isNotNull(), F.round(F.col("total") - n["total"], 6))
    clear = n.isNull() | F.coalesce(same, F.lit(False)) | (margin >= 12)
    return ranked.where((F.col("total") >= 68) & clear).select("track_id", "candidate_id", "total", N.clamp(F.col("total"), 0.0, 99.0).alias("confidence"), margin.alias("margin"))

"""Queries of the core, by name, and SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions import numbers as N
from refrain.functions import text as T
from refrain.io import load
from refrain.operators import dates, duplicates, matching, packed_fields, state
from refrain.sources import payloads

Query = Callable[[SparkSession, str], DataFrame]


def _candidates(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each candidate once: repeats are exact copies."""
    c = load(s, d, "candidates")
    return c.select("candidate_id", *columns).dropDuplicates(["candidate_id"])


def _tracks(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return load(s, d, "tracks").select("track_id", *columns).dropDuplicates(["track_id"])


def _r(c: Column) -> Column:
    return F.round(c, 6)


def norm_keys(s: SparkSession, d: str) -> DataFrame:
    """T3b, T4a, T5 over all candidates."""
    return _candidates(s, d, "title", "isrc").select("candidate_id", T.words_text(F.col("title")).alias("title_words"), T.compact_key(F.col("title")).alias("title_key"), T.code_key(F.col("isrc")).alias("isrc_key"))


def _named(s: SparkSession, d: str) -> DataFrame:
    """Each part with the most frequent name of its brand, as a current and a proposed title."""
    p = load(s, d, "part")
    top = p.groupBy("p_brand", "p_name").count().groupBy("p_brand").agg(F.min(F.struct((-F.col("count")).alias("c"), F.col("p_name").alias("n"))).alias("t")).select("p_brand", F.col("t.n").alias("top"))
    return p.join(top, "p_brand")


def edit_similarity(s: SparkSession, d: str) -> DataFrame:
    """T1, T2a, T10."""
    a, b = F.col("top"), F.col("p_name")
    return _named(s, d).select("p_partkey", _r(T.similarity(a, b)).alias("plain"), _r(T.similarity_lower(F.upper(a), b)).alias("lowered"), T.text_close(a, b, 0.5).alias("close"))


def title_artist_similarity(s: SparkSession, d: str) -> DataFrame:
    """T8a, T8b, T9a, T9b."""
    a, b = F.concat(F.lit("The "), F.col("top")), F.concat_ws(" ", "p_name", "p_type")
    return _named(s, d).select("p_partkey", *[_r(f(a, b)).alias(n) for n, f in (("title_scan", T.title_similarity), ("title_strict", T.title_similarity_strict), ("artist_scan", T.artist_similarity), ("artist_strict", T.artist_similarity_strict))])


def version_tags(s: SparkSession, d: str) -> DataFrame:
    """T12a, T12b."""
    return _candidates(s, d, "title").select("candidate_id", F.array_join(T.version_tags(F.col("title")), ",").alias("tags"), F.array_join(T.version_tags(F.concat(F.col("title"), F.lit(" Symphonic Mix")), False), ",").alias("tags_b"))


def duration_bands(s: SparkSession, d: str) -> DataFrame:
    """N1, N2."""
    x, audio = F.col("duration_delta"), F.coalesce("audio_recognition", F.lit(False))
    return _candidates(s, d, "duration_delta", "audio_recognition").select("candidate_id", N.duration_step(x, 0.5).alias("step_half"), N.duration_step(x, 0.0).alias("step_none"), N.duration_points(x, audio).alias("points"))


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return _named(s, d).withColumn("ts", T.similarity_lower(F.col("top"), F.col("p_name"))).withColumn("ac", (F.col("p_partkey") % 11) / 10.0).withColumn("delta", F.when(F.col("p_size") % 7 != 0, F.abs(F.col("p_size") - 25).cast("double")))


def fingerprint_score(s: SparkSession, d: str) -> DataFrame:
    """C1."""
    e = _evidence(s, d)
    return e.select("p_partkey", _r(matching.fingerprint_score(F.col("ac"), F.col("delta"), F.col("ts"), F.col("ts"), F.lit(None).cast("double"), F.col("p_type") == "PROMO")).alias("score"))


def text_score(s: SparkSession, d: str) -> DataFrame:
    """C2 in its three regimes."""
    e = _evidence(s, d)
    k = F.col("p_partkey") % 3
    return e.select("p_partkey", _r(matching.text_score(F.col("ts"), F.col("ac"), F.col("ts"), k == 0, k == 1, F.col("delta"), F.when(F.col("p_size") % 2 == 0, 90.0).otherwise(78.0))).alias("score"))


def agreement_fold(s: SparkSession, d: str) -> DataFrame:
    """Parts of a brand and size as proposals of their types."""
    p = load(s, d, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("block"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("provider"), F.col("p_name").alias("title"), F.substring("p_name", 1, 4).alias("artist"), F.lit(None).cast("string").alias("album"), F.when(F.col("p_partkey") % 5 == 0, F.substring("p_name", 1, 2)).alias("code"), (80.0 + F.col("p_partkey") % 20).alias("score"), (F.col("p_partkey") % 4 == 0).alias("audio"))
    return matching.agreement(p).select("block", "ord", _r(F.col("score")).alias("score"), F.col("n_agree").cast("long").alias("n_agree"), F.col("n_conflict").cast("long").alias("n_conflict"))


def dedupe_best(s: SparkSession, d: str) -> DataFrame:
    """The best candidate of a track for each key of title and artist."""
    c = _candidates(s, d, "track_id", "title", "artist", "score", "ord").withColumn("key", F.concat_ws("|", T.compact_key(F.col("title")), T.compact_key(F.col("artist"))))
    best = matching.keep_best(c.select("track_id", "key", "candidate_id", "score", "ord"), ["track_id", "key"], [matching.descending(F.col("score")), F.col("ord"), F.col("candidate_id")])
    return best.select("track_id", "candidate_id", "score")


def tier_topk(s: SparkSession, d: str) -> DataFrame:
    """Five candidates a track by tier and score."""
    c = _candidates(s, d, "track_id", "provider", "acoustid", "audio_recognition", "sources", "score", "ord").join(F.broadcast(load(s, d, "providers").select("provider", "priority")), "provider", "left")
    c = c.withColumn("tier", matching.trust_tier(F.col("acoustid"), F.col("audio_recognition"), F.col("priority"), F.col("sources")))
    return matching.top_k(c, "track_id", [F.col("tier").desc(), F.col("score").desc_nulls_last(), F.col("ord"), F.col("candidate_id")], 5).select("track_id", "candidate_id", F.col("tier").cast("long").alias("tier"), F.col("rank").cast("long").alias("rank"))


def vote_genre(s: SparkSession, d: str) -> DataFrame:
    """A4: each track's genre by weighted vote of its candidates' providers."""
    c = _candidates(s, d, "track_id", "provider", "genre").join(F.broadcast(load(s, d, "providers").select("provider", "priority")), "provider")
    e = c.select(F.col("track_id").alias("item"), F.col("provider").alias("source"), F.nullif(F.trim(F.lower("genre")), F.lit("")).alias("class"), (0.9 - 0.02 * F.col("priority")).alias("weight"))
    return matching.vote(e).withColumnRenamed("item", "track_id").withColumnRenamed("class", "genre")


def vote_language(s: SparkSession, d: str) -> DataFrame:
    """Each track's language by its longest text, the first of equals."""
    t = load(s, d, "documents").where(F.col("lang").isNotNull() & F.col("track_id").isNotNull()).select("track_id", F.lower("lang").alias("lang"), F.col("n_chars"), "doc_id")
    return matching.keep_best(t, ["track_id"], [-F.col("n_chars"), F.col("doc_id")]).select("track_id", "lang")


def golden_record(s: SparkSession, d: str) -> DataFrame:
    """Fields of a track from all its candidates in the order of their score; donors are not gated by recording."""
    c = _candidates(s, d, "track_id", "score", "ord", "album", "composer", "label", "isrc", "release_country")
    fields = ["album", "composer", "label", "isrc", "release_country"]
    for f in fields:
        c = c.withColumn(f, F.nullif(F.col(f), F.lit("")))
    return matching.survivors(c, "track_id", [matching.descending(F.col("score")), F.col("ord"), F.col("candidate_id")], fields)


def cover_choice(s: SparkSession, d: str) -> DataFrame:
    """The cover of the provider of most priority, then of most points; the last of equals."""
    c = _candidates(s, d, "track_id", "provider", "score", "ord", "cover_url").where(F.col("cover_url").isNotNull()).join(F.broadcast(load(s, d, "providers").select("provider", "priority")), "provider")
    return matching.keep_best(c.select("track_id", "cover_url", "candidate_id", "priority", "score", "ord"), ["track_id"], [F.col("priority"), matching.descending(F.col("score")), -F.col("ord"), -F.col("candidate_id")]).select("track_id", "cover_url")


AUDIT = {"current_title": 20, "current_artist": 20, "current_album": 15, "current_album_artist": 5, "current_track_number": 10, "genre": 10, "duration": 10, "format": 5, "bitrate": 5}


def audit(s: SparkSession, d: str) -> DataFrame:
    """Completeness of tracks."""
    t = _tracks(s, d, *AUDIT)
    texts = {"current_title", "current_artist", "current_album", "current_album_artist", "genre", "format"}
    score, missing = matching.completeness(AUDIT, {k: F.col(k).isNotNull() & (F.trim(F.col(k)) != "" if k in texts else F.lit(True)) for k in AUDIT})
    return t.select("track_id", score.cast("long").alias("score"), missing.alias("missing"))


def known_duplicate(s: SparkSession, d: str) -> DataFrame:
    """Tracks that the reference files already have."""
    i = load(s, d, "signatures").dropDuplicates(["track_id"]).join(_tracks(s, d, "file_size"), "track_id", "left")
    return duplicates.known_duplicates(i, load(s, d, "reference_files").where(F.col("error").isNull()))


def batch_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Duplicates within the batch, a row a track."""
    return duplicates.batch_duplicates(load(s, d, "signatures")).select("track_id", "n_links")


def leader_clusters(s: SparkSession, d: str) -> DataFrame:
    """The leader that each signature joins, with the class of its exact copies."""
    return duplicates.leader_of_each(load(s, d, "signatures"))


def incremental_pending(s: SparkSession, d: str) -> DataFrame:
    """Users whose last event changed since the snapshot, or who are new."""
    e = load(s, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    last = lambda x: state.last_writer(x, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")
    return state.pending(last(e), last(e.where(F.col("ts") < F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"))), ["user_id"], ["event_type", "value"])


def cache_ttl(s: SparkSession, d: str) -> DataFrame:
    """Live and ended entries by provider, and those that the comparison as text keeps."""
    now = F.lit("2024-03-20 00:00:00").cast("timestamp_ntz")
    c = state.last_writer(load(s, d, "provider_cache"), ["provider", "cache_key"], ["expires_at"])
    return c.groupBy("provider").agg(F.count_if(~state.expired(F.col("expires_at"), now)).alias("n_live"), F.count_if(state.expired(F.col("expires_at"), now)).alias("n_ended"), F.count_if(~state.expired_as_text(F.col("expires_at"), now)).alias("n_kept_as_text"))


def cache_evict(s: SparkSession, d: str) -> DataFrame:
    """What three caches together give up, oldest first, to keep half of their bytes."""
    p = load(s, d, "provider_cache").groupBy("provider", "cache_key", "expires_at").agg(F.max(F.octet_length("response")).alias("b"))
    entries = (
        p.select(F.lit("answers").alias("kind"), F.concat_ws("/", "provider", "cache_key").alias("path"), F.col("b").cast("long").alias("bytes"), F.col("expires_at").alias("cached_at"))
        .unionByName(load(s, d, "documents").where(F.col("published_at").isNotNull()).select(F.lit("texts").alias("kind"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").cast("long").alias("bytes"), F.col("published_at").alias("cached_at")))
        .unionByName(_tracks(s, d, "file_size", "updated_at").select(F.lit("files").alias("kind"), F.col("track_id").cast("string").alias("path"), (F.col("file_size") / 1000).cast("long").alias("bytes"), F.col("updated_at").alias("cached_at")))
    )
    return state.evicted(entries, F.col("total") * 0.5).select("kind", "path", "bytes")


def upsert_last(s: SparkSession, d: str) -> DataFrame:
    """K1: the last event of each user."""
    return state.last_writer(load(s, d, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def status_counts(s: SparkSession, d: str) -> DataFrame:
    """A1, A2: counts of tracks in one pass."""
    t = _tracks(s, d, "status", "is_missing", "current_title", "format")
    return t.groupBy("format").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "matched").alias("n_matched"), F.count_if(F.col("is_missing")).alias("n_missing"), F.count_if(F.col("current_title").isNull()).alias("n_untitled"))


def nested_workspace(s: SparkSession, d: str) -> DataFrame:
    """Tracks with their candidates, best first, nested."""
    c = _candidates(s, d, "track_id", "score", "ord").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(matching.descending(F.col("score")).alias("s"), "ord", "candidate_id"))).alias("cs"))
    return _tracks(s, d).join(c, "track_id", "left").select("track_id", F.coalesce(F.size("cs"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("cs", lambda x: x["candidate_id"].cast("string")), ","), F.lit("")).alias("ids"))


def html_text(s: SparkSession, d: str) -> DataFrame:
    """Texts without mark-up and entities."""
    return load(s, d, "documents").select("doc_id", F.md5(T.decode_entities(T.strip_tags(F.col("text")))).alias("digest"))


def url_parts(s: SparkSession, d: str) -> DataFrame:
    """Scheme, host and path of covers, and whether the host is a listed provider."""
    c = _candidates(s, d, "cover_url").where(F.col("cover_url").isNotNull())
    p = r"^([a-z]+)://([^/]+)/(.*)$"
    rows = c.select("candidate_id", *[F.regexp_extract("cover_url", p, i).alias(n) for i, n in ((1, "scheme"), (2, "host"), (3, "path"))])
    listed = F.broadcast(load(s, d, "providers").select(F.col("provider").alias("host"), F.lit(True).alias("listed")))
    return rows.join(listed, "host", "left").select("candidate_id", "scheme", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))


def json_payload(s: SparkSession, d: str) -> DataFrame:
    """Fields of raw answers; broken ones give nulls."""
    c = _candidates(s, d, "raw_json").where(F.col("raw_json").isNotNull()).withColumn("v", payloads.parsed(F.col("raw_json")))
    tags = F.try_variant_get("v", "$.tags", "array<string>")
    return c.select("candidate_id", F.try_variant_get("v", "$.id", "long").alias("id"), F.try_variant_get("v", "$.src", "string").alias("src"), payloads.at(F.col("v"), ["$.popularity", "$.pop"], "double").alias("pop"), F.try_element_at(tags, F.lit(1)).alias("first_tag"))


def payload_candidates(s: SparkSession, d: str) -> DataFrame:
    """S-mappers: cached answers as candidates."""
    c = load(s, d, "provider_cache").select("provider", "cache_key", "response").distinct().withColumn("v", payloads.parsed(F.col("response")))
    return c.select("provider", "cache_key", F.try_variant_get("v", "$.q", "string").alias("title"), F.try_variant_get("v", "$.hits", "long").alias("hits"))


def union_gate(s: SparkSession, d: str) -> DataFrame:
    """Second sources only for tracks that the first ones left without a strong candidate."""
    c = _candidates(s, d, "track_id", "provider", "score", "acoustid").join(F.broadcast(load(s, d, "providers").select("provider", "priority")), "provider")
    first, second = c.where("priority <= 7"), c.where("priority > 7")
    strong = first.where((F.col("score") >= 90) | F.col("acoustid").isNotNull()).select("track_id").distinct()
    both = first.unionByName(second.join(strong, "track_id", "left_anti"))
    return both.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(F.col("priority") > 7).alias("n_second"))


def output_names(s: SparkSession, d: str) -> DataFrame:
    """Names of outputs without collisions."""
    t = _tracks(s, d, "current_title", "current_artist", "format")
    base = F.concat(T.safe_name(F.col("current_artist"), "Unknown Artist"), F.lit(" - "), T.safe_name(F.col("current_title"), "Unknown Title"))
    n = duplicates.numbered(t.select("track_id", base.alias("base"), F.coalesce("format", F.lit("bin")).alias("ext")).withColumn("dest", F.concat_ws(".", "base", "ext")), "dest", "track_id")
    return n.select("track_id", F.when(F.col("n") == 1, F.col("dest")).otherwise(F.concat(F.col("base"), F.lit(" ("), F.col("n").cast("string"), F.lit(")."), F.col("ext"))).alias("name"))


def adjacent_dedup(s: SparkSession, d: str) -> DataFrame:
    """Events of a user that differ from the one before."""
    return state.adjacent_distinct(load(s, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def filename_tags(s: SparkSession, d: str) -> DataFrame:
    """Artist and title from file names, and whether the tag is a placeholder."""
    p = T.filename_parts(T.stem(F.col("filename")))
    return _tracks(s, d, "filename", "current_artist").select("track_id", p["artist"].alias("artist"), p["title"].alias("title"), T.is_placeholder(F.col("current_artist")).alias("placeholder"))


def featured_credits(s: SparkSession, d: str) -> DataFrame:
    """Credits with guests in one form, Latin part of bilingual albums."""
    f = T.featured(F.col("artist"), F.col("title"))
    return _candidates(s, d, "artist", "title", "album").select("candidate_id", f["artist"].alias("artist"), f["title"].alias("title"), T.prefer_latin(F.col("album")).alias("album"))


def lengths(s: SparkSession, d: str) -> DataFrame:
    """Lengths of delivery lists in seconds."""
    return load(s, d, "label_sheet").select("sheet_id", "length").distinct().select("sheet_id", N.iso_seconds(F.col("length")).alias("iso"), N.clock_seconds(F.col("length")).alias("clock"), N.number_of(F.col("length")).alias("number"))


def approve(s: SparkSession, d: str) -> DataFrame:
    """Tracks whose best supported candidate is clear."""
    return matching.decide(load(s, d, "tracks"), load(s, d, "candidates"), load(s, d, "providers"))


_QUERIES: dict[str, Query] = {f.__name__: f for f in (
    norm_keys, edit_similarity, title_artist_similarity, version_tags, duration_bands, fingerprint_score, text_score, agreement_fold, dedupe_best, tier_topk, vote_genre, vote_language, golden_record,
    cover_choice, audit, known_duplicate, batch_duplicates, leader_clusters, incremental_pending, cache_ttl, cache_evict, upsert_last, status_counts, nested_workspace, html_text, url_parts, json_payload,
    payload_candidates, union_gate, output_names, adjacent_dedup, filename_tags, featured_credits, lengths, approve,
)}


def queries() -> dict[str, Query]:
    """Each takes (session, folder of tables)."""
    return _QUERIES | {"p4_found": packed_fields.found, "p4_dialects": packed_fields.report, "p5_found": dates.found, "p5_values": dates.report, "p5_zones": dates.zones}


_C = "c AS (SELECT DISTINCT ON (candidate_id) * FROM candidates)"
_T = "t AS (SELECT DISTINCT ON (track_id) * FROM tracks)"
_NAMED = "named AS (SELECT p.*, n.top FROM part p JOIN (SELECT p_brand, p_name AS top FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) r FROM part GROUP BY p_brand, p_name) WHERE r = 1) n USING (p_brand))"


def _sim(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def _step(x: str, missing: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN {missing}::DOUBLE WHEN {x} <= 3 THEN 1.0::DOUBLE WHEN {x} <= 8 THEN 0.65::DOUBLE WHEN {x} <= 15 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"


def _tags(x: str, symphony: bool) -> str:
    w = f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda q: q <> '')"
    parts = [f"CASE WHEN list_has_any(w, [{', '.join(repr(n) for n in names)}]) THEN '{tag}' END" for tag, names in sorted(T.VERSION_TAGS.items()) if symphony or tag != "symphony"]
    return f"(SELECT array_to_string(list_filter([{', '.join(parts)}], lambda q: q IS NOT NULL), ',') FROM (SELECT coalesce({w}, []) AS w))"


_WORDS = "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda q: q <> '')"
_KEY = "regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
_FLAT = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _titles() -> str:
    f = lambda p, x: p.format(x=x)
    wa, wb = f(_WORDS, "a"), f(_WORDS, "b")
    telling = lambda w: f"list_filter({w}, lambda q: q NOT IN ('a', 'an', 'the', 'such'))"
    pre = lambda x, y, n: f"(least(length({x}), length({y})) >= {n} AND (starts_with({x}, {y}) OR starts_with({y}, {x})))"
    same = f"(len({telling(wa)}) > 0 AND {telling(wa)} = {telling(wb)})"
    held = f"(CASE WHEN len({wa}) <= len({wb}) THEN len({wa}) >= 3 AND list_has_all({wb}, {wa}) ELSE len({wb}) >= 3 AND list_has_all({wa}, {wb}) END)"
    ka, kb, fa, fb = f(_KEY, "a"), f(_KEY, "b"), f(_FLAT, "a"), f(_FLAT, "b")
    scan, strict = _sim("lower(a)", "lower(b)"), _sim(fa, fb)
    return f"""WITH {_NAMED}, x AS (SELECT p_partkey, 'The ' || top AS a, p_name || ' ' || p_type AS b FROM named)
SELECT p_partkey, round(CASE WHEN {same} OR {pre(ka, kb, 4)} OR {held} THEN 0.96::DOUBLE ELSE {scan} END, 6) AS title_scan,
round(CASE WHEN {same} OR {pre(ka, kb, 4)} THEN greatest({strict}, 0.94::DOUBLE) ELSE {strict} END, 6) AS title_strict,
round(CASE WHEN {pre(ka, kb, 5)} THEN greatest({scan}, 0.92::DOUBLE) ELSE {scan} END, 6) AS artist_scan,
round(CASE WHEN {pre(ka, kb, 5)} THEN greatest({strict}, 0.92::DOUBLE) ELSE {strict} END, 6) AS artist_strict FROM x"""


def _missing() -> str:
    texts = {"current_title", "current_artist", "current_album", "current_album_artist", "genre", "format"}
    ok = {k: f"({k} IS NOT NULL AND trim({k}) <> '')" if k in texts else f"({k} IS NOT NULL)" for k in AUDIT}
    score = " + ".join(f"CASE WHEN {ok[k]} THEN {w} ELSE 0 END" for k, w in AUDIT.items())
    names = ", ".join(f"CASE WHEN NOT {ok[k]} THEN '{k}' END" for k in AUDIT)
    return f"WITH {_T} SELECT track_id, ({score})::BIGINT AS score, array_to_string(list_filter([{names}], lambda q: q IS NOT NULL), ',') AS missing FROM t"


def _decoded(x: str) -> str:
    for entity, char in T.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _safe(x: str, other: str) -> str:
    clean = f"regexp_replace(regexp_replace({x}, '[\\\\/:*?\"<>|\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g')"
    return f"coalesce(nullif(regexp_replace({clean}, '^[. ]+|[. ]+$', '', 'g'), ''), '{other}')"


def _cut(part: int) -> str:
    cases = " ".join(f"WHEN position('{d}' IN n) > 0 THEN CASE WHEN trim(substr(n, 1, position('{d}' IN n) - 1)) <> '' AND trim(substr(n, position('{d}' IN n) + length('{d}'))) <> '' THEN {'trim(substr(n, 1, position(' + repr(d) + ' IN n) - 1))' if part == 0 else 'trim(substr(n, position(' + repr(d) + ' IN n) + length(' + repr(d) + ')))'} END" for d in T.DASHES)
    return f"CASE {cases} END"


def oracle_sql() -> dict[str, str]:
    """SQL by query. None where SQL can't express it on whole tables: leaders and decisions (edit distances over code points)."""
    first = lambda f: f"arg_min(nullif({f}, ''), r) FILTER (WHERE nullif({f}, '') IS NOT NULL) AS {f}"
    return {
        "norm_keys": f"WITH {_C} SELECT candidate_id, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title_words, lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS title_key, upper(regexp_replace(isrc, '[^A-Za-z0-9]', '', 'g')) AS isrc_key FROM c",
        "edit_similarity": f"WITH {_NAMED} SELECT p_partkey, round({_sim('top', 'p_name')}, 6) AS plain, round({_sim('lower(upper(top))', 'lower(p_name)')}, 6) AS lowered, coalesce(trim(top) <> '' AND trim(p_name) <> '' AND {_sim('lower(top)', 'lower(p_name)')} >= 0.5, false) AS close FROM named",
        "title_artist_similarity": _titles(),
        "version_tags": f"WITH {_C} SELECT candidate_id, {_tags('title', True)} AS tags, {_tags(chr(40) + 'title || ' + repr(' Symphonic Mix') + chr(41), False)} AS tags_b FROM c",
        "duration_bands": f"WITH {_C} SELECT candidate_id, {_step('duration_delta', '0.5')} AS step_half, {_step('duration_delta', '0.0')} AS step_none, (CASE WHEN duration_delta IS NULL THEN CASE WHEN coalesce(audio_recognition, false) THEN 6 ELSE 0 END WHEN duration_delta <= 3 THEN 16 WHEN duration_delta <= 8 THEN 13 WHEN duration_delta <= 15 THEN 7 WHEN duration_delta <= 30 THEN 1 ELSE -14 END)::DOUBLE AS points FROM c",
        "fingerprint_score": f"WITH {_NAMED}, e AS (SELECT *, {_sim('lower(top)', 'lower(p_name)')} AS ts, (p_partkey % 11) / 10.0::DOUBLE AS ac, CASE WHEN p_size % 7 <> 0 THEN abs(p_size - 25)::DOUBLE END AS delta FROM named) SELECT p_partkey, round(greatest(least(0.45::DOUBLE * ac + 0.20::DOUBLE * {_step('delta', '0.5')} + 0.15::DOUBLE * ts + 0.10::DOUBLE * ts - CASE WHEN p_type = 'PROMO' THEN 0.08::DOUBLE ELSE 0 END, 1), 0) * 100, 6) AS score FROM e",
        "text_score": f"WITH {_NAMED}, e AS (SELECT *, {_sim('lower(top)', 'lower(p_name)')} AS ts, (p_partkey % 11) / 10.0::DOUBLE AS ac, CASE WHEN p_size % 7 <> 0 THEN abs(p_size - 25)::DOUBLE END AS delta FROM named), f AS (SELECT *, {_step('delta', '0.0')} AS ds FROM e) SELECT p_partkey, round(least(greatest(least(CASE p_partkey % 3 WHEN 0 THEN 0.35::DOUBLE * ts + 0.25::DOUBLE * ac + 0.25::DOUBLE * ts + 0.15::DOUBLE * ds WHEN 1 THEN 0.45::DOUBLE * ts + 0.35::DOUBLE * ac + 0.20::DOUBLE * ds ELSE 0.75::DOUBLE * ts + 0.25::DOUBLE * ds END, 1), 0) * 100, CASE WHEN p_size % 2 = 0 THEN 90 ELSE 78 END), 6) AS score FROM f",
        "agreement_fold": f"""WITH p AS (SELECT p_brand || '/' || p_size AS block, p_partkey AS ord, p_type AS provider, p_name AS title, substr(p_name, 1, 4) AS artist, CASE WHEN p_partkey % 5 = 0 THEN substr(p_name, 1, 2) END AS code, 80.0::DOUBLE + p_partkey % 20 AS score, CASE WHEN p_partkey % 4 = 0 THEN 99.0::DOUBLE ELSE 98.0::DOUBLE END AS cap FROM part),
m AS (SELECT a.block, a.ord, b.provider AS op, b.ord AS oo, {_sim('a.title', 'b.title')} AS t, {_sim('a.artist', 'b.artist')} AS ar, coalesce(upper(a.code) = upper(b.code), false) AS same FROM p a JOIN p b ON a.block = b.block AND a.provider <> b.provider),
s AS (SELECT block, ord, op, oo, CASE WHEN same OR (t >= 0.82 AND ar >= 0.75) THEN 1 WHEN t >= 0.55 AND NOT (ar >= 0.55) THEN -1 ELSE 0 END AS v FROM m),
o AS (SELECT block, ord, op, v, min(oo) AS pos FROM s WHERE v <> 0 GROUP BY ALL),
l AS (SELECT block, ord, list(v::DOUBLE ORDER BY pos, v) AS vs FROM o GROUP BY ALL)
SELECT p.block, p.ord, round(CASE WHEN l.vs IS NULL THEN score ELSE list_reduce(list_prepend(score, l.vs), lambda x, y: CASE WHEN y > 0 THEN least(x + 6, cap) ELSE greatest(x - 4, 0) END) END, 6) AS score, coalesce(len(list_filter(l.vs, lambda q: q > 0)), 0)::BIGINT AS n_agree, coalesce(len(list_filter(l.vs, lambda q: q < 0)), 0)::BIGINT AS n_conflict FROM p LEFT JOIN l ON p.block = l.block AND p.ord = l.ord""",
        "dedupe_best": f"WITH {_C} SELECT track_id, candidate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY track_id, concat_ws('|', lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lower(regexp_replace(artist, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) ORDER BY score DESC NULLS LAST, ord, candidate_id) r FROM c) WHERE r = 1",
        "tier_topk": f"WITH {_C}, x AS (SELECT c.*, CASE WHEN acoustid IS NOT NULL OR coalesce(audio_recognition, false) THEN 3 WHEN priority <= 6 THEN 2 WHEN len(list_distinct(sources)) >= 2 THEN 1 ELSE 0 END AS tier FROM c LEFT JOIN providers USING (provider)) SELECT track_id, candidate_id, tier::BIGINT AS tier, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY tier DESC, score DESC NULLS LAST, ord, candidate_id) r FROM x) WHERE r <= 5",
        "vote_genre": f"WITH {_C}, e AS (SELECT track_id, provider, nullif(trim(lower(genre)), '') AS g, max(0.9::DOUBLE - 0.02::DOUBLE * priority) AS w FROM c JOIN providers USING (provider) GROUP BY ALL), k AS (SELECT track_id, g, round(sum(w), 9) AS total, max(w) AS top, count(*) AS n FROM e WHERE g IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY total DESC, top DESC, g) AS i FROM k) SELECT track_id, max(g) FILTER (WHERE i = 1) AS genre, round(max(total) FILTER (WHERE i = 1), 6) AS total, round(max(least(top + 0.08::DOUBLE * (n - 1), 0.98)) FILTER (WHERE i = 1), 6) AS confidence, coalesce(string_agg(g, '|' ORDER BY i) FILTER (WHERE i BETWEEN 2 AND 4), '') AS alternatives FROM r GROUP BY track_id",
        "vote_language": "SELECT track_id, lower(lang) AS lang FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n_chars DESC NULLS LAST, doc_id) r FROM documents WHERE lang IS NOT NULL AND track_id IS NOT NULL) WHERE r = 1",
        "golden_record": f"WITH {_C}, x AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC NULLS LAST, ord, candidate_id) AS r FROM c) SELECT track_id, {', '.join(first(f) for f in ('album', 'composer', 'label', 'isrc', 'release_country'))} FROM x GROUP BY track_id",
        "cover_choice": f"WITH {_C} SELECT track_id, cover_url FROM (SELECT c.*, row_number() OVER (PARTITION BY track_id ORDER BY priority, score DESC NULLS LAST, ord DESC, candidate_id DESC) r FROM c JOIN providers USING (provider) WHERE cover_url IS NOT NULL) WHERE r = 1",
        "audit": _missing(),
        "known_duplicate": f"WITH {_T}, i AS (SELECT s.*, t.file_size FROM (SELECT DISTINCT ON (track_id) * FROM signatures) s LEFT JOIN t USING (track_id)), r AS (SELECT DISTINCT * FROM reference_files WHERE error IS NULL), a AS (SELECT i.track_id, min(r.path) AS path, 'audio fingerprint' AS reason FROM i JOIN r ON i.fingerprint = r.fingerprint AND i.fingerprint <> '' AND abs(i.duration - r.duration) <= 3 GROUP BY ALL), b AS (SELECT i.track_id, min(r.path) AS path, 'exact file hash' AS reason FROM i JOIN r ON i.file_size = r.file_size AND i.file_hash = r.file_hash WHERE (i.fingerprint IS NULL OR i.fingerprint = '' OR r.fingerprint IS NULL) AND i.track_id NOT IN (SELECT track_id FROM a) GROUP BY i.track_id) SELECT * FROM a UNION ALL SELECT * FROM b",
        "batch_duplicates": "WITH s AS (SELECT DISTINCT ON (track_id) track_id, nullif(upper(regexp_replace(isrc, '[^A-Za-z0-9]', '', 'g')), '') AS isrc, title_artist, duration, nullif(fingerprint, '') AS fp, nullif(file_hash, '') AS fh FROM signatures), k AS (SELECT a.track_id, b.track_id AS o FROM s a JOIN s b ON a.isrc = b.isrc UNION SELECT a.track_id, b.track_id FROM s a JOIN s b ON a.fp = b.fp UNION SELECT a.track_id, b.track_id FROM s a JOIN s b ON a.fh = b.fh AND (coalesce(a.title_artist = b.title_artist, false) OR (a.fp IS NOT NULL AND b.fp IS NOT NULL))), l AS (SELECT k.track_id, count(*) AS n FROM k JOIN s a ON a.track_id = k.track_id JOIN s b ON b.track_id = k.o WHERE k.track_id <> k.o AND coalesce(abs(a.duration - b.duration) <= 3, true) GROUP BY ALL) SELECT s.track_id, coalesce(l.n, 0)::BIGINT AS n_links FROM s LEFT JOIN l USING (track_id)",
        "incremental_pending": "WITH n AS (SELECT DISTINCT ON (user_id) user_id, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC), k AS (SELECT DISTINCT ON (user_id) user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-29 12:00:00' ORDER BY user_id, ts DESC, event_id DESC) SELECT n.* FROM n LEFT JOIN k USING (user_id) WHERE k.user_id IS NULL OR k.event_type IS DISTINCT FROM n.event_type OR k.value IS DISTINCT FROM n.value",
        "cache_ttl": "WITH x AS (SELECT provider, cache_key, max(expires_at) AS e FROM provider_cache GROUP BY ALL) SELECT provider, count(*) FILTER (WHERE e > TIMESTAMP '2024-03-20') AS n_live, count(*) FILTER (WHERE e <= TIMESTAMP '2024-03-20') AS n_ended, count(*) FILTER (WHERE NOT (strftime(e, '%Y-%m-%dT%H:%M:%S') < '2024-03-20 00:00:00')) AS n_kept_as_text FROM x GROUP BY provider",
        "cache_evict": f"WITH {_T}, e AS (SELECT 'answers' AS kind, provider || '/' || cache_key AS path, max(strlen(response))::BIGINT AS bytes, expires_at AS cached FROM provider_cache GROUP BY provider, cache_key, expires_at UNION ALL SELECT 'texts', doc_id::VARCHAR, n_chars::BIGINT, published_at FROM documents WHERE published_at IS NOT NULL UNION ALL SELECT 'files', track_id::VARCHAR, (file_size // 1000)::BIGINT, updated_at FROM t), w AS (SELECT *, coalesce(sum(coalesce(bytes, 0)) OVER (ORDER BY cached, kind, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(coalesce(bytes, 0)) OVER () AS total FROM e) SELECT kind, path, coalesce(bytes, 0) AS bytes FROM w WHERE total - before > total * 0.5",
        "upsert_last": "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC",
        "status_counts": f"WITH {_T} SELECT format, count(*) AS n, count(*) FILTER (WHERE status = 'matched') AS n_matched, count(*) FILTER (WHERE is_missing) AS n_missing, count(*) FILTER (WHERE current_title IS NULL) AS n_untitled FROM t GROUP BY format",
        "nested_workspace": f"WITH {_C}, {_T} SELECT t.track_id, count(c.candidate_id) AS n, coalesce(string_agg(c.candidate_id::VARCHAR, ',' ORDER BY c.score DESC NULLS LAST, c.ord, c.candidate_id), '') AS ids FROM t LEFT JOIN c USING (track_id) GROUP BY t.track_id",
        "html_text": f"SELECT doc_id, md5({_decoded(chr(114) + 'egexp_replace(text, ' + repr('<[^>]*>') + ', ' + repr('') + ', ' + repr('g') + ')')}) AS digest FROM documents",
        "url_parts": f"WITH {_C} SELECT candidate_id, regexp_extract(cover_url, '^([a-z]+)://([^/]+)/(.*)$', 1) AS scheme, regexp_extract(cover_url, '^([a-z]+)://([^/]+)/(.*)$', 2) AS host, regexp_extract(cover_url, '^([a-z]+)://([^/]+)/(.*)$', 3) AS path, regexp_extract(cover_url, '^([a-z]+)://([^/]+)/(.*)$', 2) IN (SELECT provider FROM providers) AS listed FROM c WHERE cover_url IS NOT NULL",
        "json_payload": f"WITH {_C}, x AS (SELECT candidate_id, CASE WHEN json_valid(raw_json) THEN raw_json END AS j FROM c WHERE raw_json IS NOT NULL) SELECT candidate_id, json_extract_string(j, '$.id')::BIGINT AS id, json_extract_string(j, '$.src') AS src, coalesce(json_extract_string(j, '$.popularity'), json_extract_string(j, '$.pop'))::DOUBLE AS pop, json_extract_string(j, '$.tags[0]') AS first_tag FROM x",
        "payload_candidates": "WITH x AS (SELECT DISTINCT provider, cache_key, response, CASE WHEN json_valid(response) THEN response END AS j FROM provider_cache) SELECT provider, cache_key, json_extract_string(j, '$.q') AS title, json_extract_string(j, '$.hits')::BIGINT AS hits FROM x",
        "union_gate": f"WITH {_C}, x AS (SELECT c.*, priority FROM c JOIN providers USING (provider)), g AS (SELECT DISTINCT track_id FROM x WHERE priority <= 7 AND (score >= 90 OR acoustid IS NOT NULL)) SELECT track_id, count(*) AS n, count(*) FILTER (WHERE priority > 7) AS n_second FROM x WHERE priority <= 7 OR track_id NOT IN (SELECT track_id FROM g) GROUP BY track_id",
        "output_names": f"WITH {_T}, b AS (SELECT track_id, {_safe('current_artist', 'Unknown Artist')} || ' - ' || {_safe('current_title', 'Unknown Title')} AS base, coalesce(format, 'bin') AS ext FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY base, ext ORDER BY track_id) AS n FROM b) SELECT track_id, CASE WHEN n = 1 THEN base || '.' || ext ELSE base || ' (' || n || ').' || ext END AS name FROM n",
        "adjacent_dedup": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR p IS DISTINCT FROM event_type",
        "filename_tags": f"WITH {_T}, x AS (SELECT track_id, regexp_replace(filename, '(.)\\.[^./]*$', '\\1') AS n, current_artist FROM t) SELECT track_id, {_cut(0)} AS artist, {_cut(1)} AS title, coalesce(trim(current_artist), '') = '' OR lower(trim(current_artist)) IN ('unknown', 'unknown artist', 'unknown album', 'unknown title', 'untitled') OR regexp_matches(lower(trim(coalesce(current_artist, ''))), '^track [0-9]+$') AS placeholder FROM x",
        "lengths": r"SELECT sheet_id, CASE WHEN regexp_matches(length, '^PT(\d+H)?(\d+M)?(\d+S)?$') AND length <> 'PT' THEN coalesce(try_cast(regexp_extract(length, '(\d+)H', 1) AS BIGINT), 0) * 3600 + coalesce(try_cast(regexp_extract(length, '(\d+)M', 1) AS BIGINT), 0) * 60 + coalesce(try_cast(regexp_extract(length, '(\d+)S', 1) AS BIGINT), 0) END AS iso, CASE WHEN regexp_matches(length, '^(\d+:)?\d+:\d{2}$') THEN coalesce(try_cast(regexp_extract(length, '^(\d+):\d+:\d{2}$', 1) AS BIGINT), 0) * 3600 + try_cast(regexp_extract(length, '(\d+):\d{2}$', 1) AS BIGINT) * 60 + try_cast(regexp_extract(length, ':(\d{2})$', 1) AS BIGINT) END AS clock, try_cast(trim(length) AS DOUBLE) AS number FROM (SELECT DISTINCT sheet_id, length FROM label_sheet)",
    }

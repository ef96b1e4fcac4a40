"""JSON payloads of catalogue sources onto one candidate schema.

A source is a row of data: where its results lie, how many count, what a result must have, and an
expression for each field. The mapping parses once, explodes and projects; broken payloads give no
row, missing paths null. Pages are in ``refrain.sources.pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions import numbers as N
from refrain.functions import text as T

KINDS = {
    "title": "string", "artist": "string", "album": "string", "album_artist": "string", "track_number": "long", "track_total": "long", "disc_number": "long", "disc_total": "long", "year": "string",
    "release_date": "string", "release_type": "string", "release_secondary_types": "string", "release_country": "string", "is_compilation": "boolean", "genre": "string", "composer": "string", "label": "string",
    "isrc": "string", "cover_url": "string", "recording_id": "string", "release_id": "string", "artist_id": "string", "duration_s": "double", "score": "double", "acoustid": "double",
}
FIELDS = tuple(KINDS)
Make = Callable[[Column], Column]


def parsed(payload: Column) -> Column:
    """G1: a payload as a variant; null if it's broken."""
    return F.try_parse_json(payload)


def tolerant(payload: Column) -> Column:
    """The JSON from the first brace to the last of a noisy output."""
    return F.try_parse_json(F.nullif(F.regexp_extract(payload, r"(?s)\{.*\}", 0), F.lit("")))


def at(value: Column, paths: list[str], kind: str) -> Column:
    """The first path that is there, as ``kind``; numbers may be given as text."""
    text = F.coalesce(*[F.try_variant_get(value, p, "string") for p in paths])
    return text if kind == "string" else F.trim(text).try_cast(kind)


def _list(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def path(*paths: str) -> Make:
    """The text at the first path that is there."""
    return lambda v: at(v, list(paths), "string")


def filled(*paths: str) -> Make:
    """As ``path``, trimmed; null if blank."""
    return lambda v: T.nonempty(at(v, list(paths), "string"))


def number(p: str, per: int = 1) -> Make:
    return lambda v: at(v, [p], "double") / per


def whole(p: str) -> Make:
    return lambda v: at(v, [p], "long")


def cut(make: Make, size: int) -> Make:
    """The first ``size`` characters; null for shorter texts."""
    return lambda v: F.when(F.char_length(make(v)) >= size, F.substring(make(v), 1, size))


def otherwise(make: Make, text: str) -> Make:
    return lambda v: F.coalesce(make(v), F.lit(text))


def constant(value: float | str) -> Make:
    return lambda v: F.lit(value)


def prefixed(text: str, make: Make) -> Make:
    return lambda v: F.concat(F.lit(text), make(v))


def joined(p: str) -> Make:
    """A list of texts as one."""
    return lambda v: F.array_join(F.try_variant_get(v, p, "array<string>"), ", ")


def _compilation(p: str) -> Make:
    return lambda v: F.coalesce(F.lower(joined(p)(v)).contains("compilation"), F.lit(False))


def _described(*keys: str) -> Make:
    """The value of the first line ``key: value`` of the description."""
    return lambda v: T.description_field(at(v, ["$.description"], "string"), *keys)


def _partial_date(v: Column) -> Column:
    parts = [at(v, [f"$.release_date_components.{p}"], "int") for p in ("year", "month", "day")]
    return F.coalesce(T.nonempty(at(v, ["$.release_date"], "string")), F.when(parts[0].isNotNull(), N.partial_date(*parts)))


def _soundcloud_date(v: Column) -> Column:
    year, month, day = (at(v, [f"$.release_{p}"], "int") for p in ("year", "month", "day"))
    return F.when(year.isNotNull(), N.partial_date(year, month, day))


def _created(v: Column) -> Column:
    """The day of ``created_at``, else ``date`` as it is written in English."""
    day = F.substring(at(v, ["$.created_at"], "string"), 1, 10)
    return F.coalesce(F.when(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), day), N.english_date(at(v, ["$.date"], "string")))


def _epoch_or_date(v: Column) -> Column:
    return F.coalesce(T.nonempty(at(v, ["$.original_release_date"], "string")), N.epoch_date(at(v, ["$.released"], "double")))


def _song_fact(name: str) -> Make:
    """The text of the first fact of that name in the song's sections."""

    def make(v: Column) -> Column:
        songs = F.filter(_list(v, "$._raw.track.sections"), lambda s: F.lower(F.try_variant_get(s, "$.type", "string")) == "song")
        facts = F.flatten(F.transform(songs, lambda s: F.coalesce(_list(s, "$.metadata"), F.array().cast("array<variant>"))))
        named = F.filter(facts, lambda x: F.lower(F.try_variant_get(x, "$.title", "string")) == name)
        return T.nonempty(F.try_variant_get(F.get(named, F.lit(0)), "$.text", "string"))

    return make


def _first_of(*makes: Make) -> Make:
    return lambda v: F.coalesce(*[m(v) for m in makes])


def _last_text(p: str, inner: str) -> Make:
    """The last text of a list that is there; null if it's empty."""
    return lambda v: F.nullif(F.try_element_at(F.filter(F.transform(_list(v, p), lambda x: F.try_variant_get(x, inner, "string")), lambda t: t.isNotNull()), F.lit(-1)), F.lit(""))


def _size(make: Make, old: str, new: str) -> Make:
    return lambda v: F.replace(make(v), F.lit(old), F.lit(new))


_TYPES = "$.releases[0]['release-group']['secondary-types']"
_DATE = path("$.releases[0].date")
_ALBUM_DATE = path("$.album.release_date")
_AUDD_DATE = path("$.result.release_date", "$.result.spotify.album.release_date")
_VIDEO = "$.snippet.publishedAt"
_RELEASED = _first_of(_song_fact("released"), path("$.release_year"))

# The public shapes of the sources' answers, their fallbacks and fixed scores. ``each``: path of the results (none: the payload is
# one); ``most``: results taken; ``need``: what a result must have, ``there`` at all or ``filled``; ``only``: the kind that counts.
SOURCES: dict[str, dict] = {
    "acoustid": {"each": "$.results", "inner": "$.recordings", "most": 3, "need": "", "recording_id": path("$.id"), "title": path("$.title"), "artist": path("$.artists[0].name"), "duration_s": number("$.duration")},
    "musicbrainz": {
        "each": "$.recordings", "need": "", "title": otherwise(path("$.title"), "Unknown Title"), "artist": otherwise(path("$['artist-credit'][0].name"), "Unknown Artist"), "album": path("$.releases[0].title"),
        "duration_s": number("$.length", 1000), "year": _DATE, "release_date": _DATE, "release_country": path("$.releases[0].country"), "release_type": path("$.releases[0]['release-group']['primary-type']"),
        "release_secondary_types": joined(_TYPES), "is_compilation": _compilation(_TYPES), "recording_id": path("$.id"), "release_id": path("$.releases[0].id"), "artist_id": path("$['artist-credit'][0].artist.id"),
        "cover_url": lambda v: F.concat(F.lit("https://coverartarchive.org/release/"), path("$.releases[0].id")(v), F.lit("/front-500")),
    },
    "itunes": {
        "each": "$.results", "need": "there", "title": path("$.trackName"), "artist": path("$.artistName"), "album": path("$.collectionName"), "album_artist": path("$.collectionArtistName"), "track_number": whole("$.trackNumber"), "track_total": whole("$.trackCount"),
        "disc_number": whole("$.discNumber"), "disc_total": whole("$.discCount"), "year": cut(path("$.releaseDate"), 4), "release_date": cut(path("$.releaseDate"), 10), "genre": path("$.primaryGenreName"), "cover_url": _size(path("$.artworkUrl100"), "100x100bb", "1200x1200bb"),
        "duration_s": number("$.trackTimeMillis", 1000), "recording_id": path("$.trackId"), "release_id": path("$.collectionId"),
    },
    "deezer": {"each": "$.data", "need": "there", "title": path("$.title"), "artist": path("$.artist.name"), "album": path("$.album.title"), "isrc": path("$.isrc"), "cover_url": path("$.album.cover_xl", "$.album.cover_big"), "recording_id": path("$.id"), "duration_s": number("$.duration")},
    "lastfm": {"each": "$.results.trackmatches.track", "most": 5, "need": "", "title": otherwise(path("$.name"), "Unknown Title"), "artist": otherwise(path("$.artist"), "Unknown Artist"), "cover_url": _last_text("$.image", "$['#text']"), "recording_id": lambda v: F.nullif(path("$.mbid")(v), F.lit(""))},
    "theaudiodb": {"each": "$.track", "most": 5, "need": "", "title": otherwise(path("$.strTrack"), "Unknown Title"), "artist": otherwise(path("$.strArtist"), "Unknown Artist"), "album": path("$.strAlbum"), "genre": path("$.strGenre"), "year": path("$.intYear"), "cover_url": path("$.strTrackThumb", "$.strAlbumThumb"), "recording_id": lambda v: F.nullif(path("$.strMusicBrainzID")(v), F.lit(""))},
    "wikidata": {"each": "$.search", "most": 5, "need": "", "title": otherwise(path("$.label"), "Unknown Title"), "artist": otherwise(path("$.description"), "Unknown Artist"), "release_id": prefixed("wikidata:", path("$.id"))},
    "genius": {
        "each": ("$.response.hits", "$.response.sections"), "only": ("$.type", "song"), "at": "$.result", "need": "filled", "title": filled("$.title"), "artist": filled("$.artist_names", "$.primary_artist.name"), "album": filled("$.album.name"), "album_artist": filled("$.primary_artist.name"),
        "release_date": _partial_date, "year": cut(_partial_date, 4), "genre": filled("$.primary_tag.name"), "cover_url": filled("$.album.cover_art_url", "$.song_art_image_url", "$.header_image_url"),
    },
    "radiojavan": {
        "each": "$.mp3s", "last": "$.top", "most": 10, "once": True, "need": "filled", "title": filled("$.song"), "artist": filled("$.artist"), "album": lambda v: T.nonempty(F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.album", "variant")) == "STRING", path("$.album")(v)), path("$.album.album")(v), path("$.album.title")(v))),
        "release_date": _created, "year": cut(_created, 4), "cover_url": filled("$.photo", "$.thumbnail"), "duration_s": number("$.duration"),
    },
    "audiomack": {
        "each": "$.results", "only": ("$.type", "song"), "most": 10, "need": "filled", "title": filled("$.title"), "artist": filled("$.artist"), "album": lambda v: T.without_site(filled("$.album")(v)), "album_artist": filled("$.artist"), "track_number": lambda v: at(v, ["$.ord"], "double").cast("long"),
        "release_date": _epoch_or_date, "year": cut(_epoch_or_date, 4), "genre": lambda v: T.first_upper(F.coalesce(filled("$.genre")(v), filled("$.tagdisplay")(v))), "composer": _described("Music", "Composer"), "label": _described("Label"), "isrc": filled("$.isrc"),
        "cover_url": lambda v: T.wide_image(filled("$.images.original.filename", "$.image_base", "$.image")(v)), "duration_s": number("$.duration"),
    },
    "audiomack_page": {
        "each": None, "need": "filled", "title": filled("$.name"), "artist": lambda v: F.coalesce(_described("Artist")(v), filled("$.byArtist.name")(v)), "album_artist": lambda v: F.coalesce(_described("Artist")(v), filled("$.byArtist.name")(v)), "release_date": filled("$.datePublished"), "year": cut(filled("$.datePublished"), 4),
        "genre": lambda v: T.first_upper(filled("$.genre")(v)), "composer": _described("Music", "Composer"), "label": _described("Label"), "cover_url": lambda v: T.wide_image(filled("$.image")(v)), "duration_s": lambda v: N.iso_minutes(path("$.duration")(v)),
    },
    "navahang": {"each": "$.songs", "need": "filled", "title": filled("$.song_name"), "artist": filled("$.artist_name"), "album_artist": filled("$.artist_name"), "cover_url": filled("$.main_image")},
    "songrec": {
        "each": None, "need": "filled", "never": "unknown", "title": filled("$._raw.track.title", "$._raw.matches[0].track.title", "$.song_name"), "artist": filled("$._raw.track.subtitle", "$._raw.matches[0].track.subtitle", "$.artist_name"), "album": _first_of(_song_fact("album"), path("$.album_name")), "release_date": _RELEASED,
        "year": lambda v: N.year_run(_RELEASED(v)), "genre": path("$._raw.track.genres.primary", "$._raw.matches[0].track.genres.primary", "$.genre"), "label": _song_fact("label"), "isrc": lambda v: F.upper(T.nonempty(F.coalesce(path("$._raw.track.isrc", "$._raw.matches[0].track.isrc", "$._raw.isrc")(v), _song_fact("isrc")(v)))),
        "cover_url": path("$._raw.track.images.coverarthq", "$._raw.matches[0].track.images.coverarthq", "$._raw.track.images.coverart", "$._raw.matches[0].track.images.coverart", "$._raw.track.share.image"), "score": constant(96.0),
    },
    "audd": {
        "each": None, "need": "there", "title": path("$.result.title", "$.result.spotify.name"), "artist": path("$.result.artist", "$.result.spotify.artists[0].name"), "album": path("$.result.album", "$.result.spotify.album.name"), "album_artist": path("$.result.spotify.album.artists[0].name"),
        "track_number": whole("$.result.spotify.track_number"), "disc_number": whole("$.result.spotify.disc_number"), "release_date": _AUDD_DATE, "year": cut(_AUDD_DATE, 4), "genre": path("$.result.apple_music.genreNames[0]"), "label": path("$.result.label"), "isrc": path("$.result.spotify.external_ids.isrc", "$.result.isrc"),
        "cover_url": lambda v: F.replace(F.replace(path("$.result.spotify.album.images[0].url", "$.result.apple_music.artwork.url")(v), F.lit("{w}"), F.lit("1200")), F.lit("{h}"), F.lit("1200")), "duration_s": number("$.result.spotify.duration_ms", 1000), "score": constant(97.0),
    },
    "youtube": {
        "each": "$.items", "most": 1, "need": "", "credits": True, "title": lambda v: T.split_credit(T.clean_video_title(path("$.snippet.title")(v)))["title"], "artist": lambda v: T.split_credit(T.clean_video_title(path("$.snippet.title")(v)))["artist"], "whole": lambda v: T.clean_video_title(path("$.snippet.title")(v)),
        "by": lambda v: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(path("$.snippet.channelTitle")(v), F.lit("Unknown YouTube Artist")), r"(?: - Topic)+$", ""), r"(?:VEVO)+$", "")), "year": cut(path(_VIDEO), 4), "release_date": cut(path(_VIDEO), 10),
        "cover_url": path(*[f"$.snippet.thumbnails.{s}.url" for s in ("maxres", "standard", "high", "medium", "default")]), "duration_s": lambda v: N.iso_seconds(path("$.contentDetails.duration")(v)).cast("double"),
    },
    "spotify": {
        "each": "$.tracks.items", "only": ("$.type", "track"), "by_id": "$.id", "need": "there", "title": path("$.name"), "artist": path("$.artists[0].name"), "album": path("$.album.name"), "album_artist": path("$.album.artists[0].name"), "track_number": whole("$.track_number"), "track_total": whole("$.album.total_tracks"), "disc_number": whole("$.disc_number"),
        "release_date": _ALBUM_DATE, "year": cut(_ALBUM_DATE, 4), "release_type": path("$.album.album_type"), "is_compilation": lambda v: F.coalesce(path("$.album.album_type")(v) == "compilation", F.lit(False)), "isrc": path("$.external_ids.isrc"), "cover_url": path("$.album.images[0].url"), "duration_s": number("$.duration_ms", 1000),
    },
    "soundcloud": {
        "each": "$.collection", "only": ("$.kind", "track"), "need": "filled", "credits": True, "title": lambda v: T.credited(filled("$.metadata_artist")(v), T.ws_trim(path("$.title")(v)))["title"], "artist": lambda v: F.coalesce(T.credited(filled("$.metadata_artist")(v), T.ws_trim(path("$.title")(v)))["artist"], filled("$.user.username")(v)),
        "album": path("$.release"), "year": lambda v: path("$.release_year")(v), "release_date": _soundcloud_date, "genre": filled("$.genre"), "label": filled("$.label_name"), "isrc": filled("$.isrc"), "cover_url": lambda v: T.larger_soundcloud(path("$.artwork_url")(v)), "duration_s": number("$.duration", 1000), "leads": True,
    },
    "spotify_oembed": {"each": None, "need": "", "title": path("$.title"), "artist": constant(""), "cover_url": lambda v: T.larger_spotify(path("$.thumbnail_url")(v)), "score": constant(94.0), "must": "cover_url"},
    "soundcloud_oembed": {
        "each": None, "need": "", "credits": True, "whole": lambda v: _oembed_title(v), "title": lambda v: T.split_credit(_oembed_title(v))["title"], "artist": lambda v: T.split_credit(_oembed_title(v))["artist"], "by": otherwise(path("$.author_name"), "SoundCloud artist"), "cover_url": lambda v: T.larger_soundcloud(path("$.thumbnail_url")(v)), "score": constant(94.0),
    },
    "youtube_oembed": {
        "each": None, "need": "", "credits": True, "whole": lambda v: T.clean_video_title(path("$.title")(v)), "title": lambda v: T.split_credit(T.clean_video_title(path("$.title")(v)))["title"], "artist": lambda v: T.split_credit(T.clean_video_title(path("$.title")(v)))["artist"], "by": otherwise(path("$.author_name"), "Unknown YouTube Artist"), "cover_url": path("$.thumbnail_url"), "score": constant(92.0),
    },
}


def _oembed_title(v: Column) -> Column:
    """A title without `` by <author>`` and an audio file's extension."""
    title, by = T.ws_trim(path("$.title")(v)), F.concat(F.lit(" by "), F.coalesce(path("$.author_name")(v), F.lit("SoundCloud artist")))
    return T.strip_audio_extension(T.ws_trim(F.when(F.endswith(title, by), F.substring(title, F.lit(1), F.char_length(title) - F.char_length(by))).otherwise(title)))


def _results(spec: dict) -> Column:
    """The results of a payload ``v`` as an array of (score of the outer result, result)."""
    v, none = F.col("v"), F.lit(None).cast("double")
    plain = lambda a: F.transform(a, lambda x: F.struct(none.alias("s"), x.alias("x")))
    if spec["each"] is None:
        return F.array(F.struct(none.alias("s"), v.alias("x")))
    if "inner" in spec:
        nested = F.transform(_list(v, spec["each"]), lambda r: F.transform(F.coalesce(_list(r, spec["inner"]), F.array().cast("array<variant>")), lambda x: F.struct(F.try_variant_get(r, "$.score", "double").alias("s"), x.alias("x"))))
        return F.flatten(nested)
    if isinstance(spec["each"], tuple):
        hits, sections = spec["each"]
        songs = F.filter(_list(v, sections), lambda s: F.try_variant_get(s, "$.type", "string") == "song")
        return plain(F.coalesce(_list(v, hits), _list(F.get(songs, F.lit(0)), "$.hits")))
    found = F.coalesce(_list(v, spec["each"]), F.array().cast("array<variant>"))
    if "last" in spec:  # the best hit stands by itself and comes last
        top = F.try_variant_get(v, spec["last"], "variant")
        kind, inner = F.try_variant_get(top, "$.type", "string"), F.try_variant_get(top, "$.mp3", "variant")
        found = F.concat(found, F.when(kind == "mp3", F.array(top)).when(inner.isNotNull(), F.array(inner)).otherwise(F.array().cast("array<variant>")))
    return plain(found)


def candidates(payloads: DataFrame, source: str) -> DataFrame:
    """(key, ord, provider and the candidate fields) of payloads (key, payload) of one source.

    Results that lack what the source must give are left out before its limit counts, except those of the
    fixed first few; ``ord`` is the place among all results. Broken, null and empty payloads give no row.
    """
    spec = SOURCES[source]
    v = tolerant(F.col("payload")) if source == "songrec" else parsed(F.col("payload"))
    rows = payloads.select("key", v.alias("v")).where(F.col("v").isNotNull())
    if source == "songrec":  # the answer itself may lie one step deeper
        raw = F.coalesce(F.to_json(F.try_variant_get("v", "$.raw_response", "variant")), F.to_json("v"))
        rows = rows.select("key", F.try_parse_json(F.concat(F.lit('{"_raw":'), raw, F.lit(","), F.substring(F.to_json("v"), F.lit(2), F.char_length(F.to_json("v"))))).alias("v"))
    rows = rows.select("key", F.posexplode(_results(spec)).alias("ord", "r")).select("key", "ord", F.col("r.s").alias("_s"), F.col("r.x").alias("v"))
    if "only" in spec:
        p, kind = spec["only"]
        rows = rows.where(F.coalesce(F.try_variant_get("v", p, "string") == kind, F.lit(True)))
    if "at" in spec:
        rows = rows.select("key", "ord", "_s", F.try_variant_get("v", spec["at"], "variant").alias("v")).where(F.col("v").isNotNull())
    if "most" in spec and not spec["need"]:
        rows = rows.where(F.col("ord") < spec["most"])
    made = {f: spec[f](F.col("v")).cast(k) if f in spec else F.lit(None).cast(k) for f, k in KINDS.items()}
    made["acoustid"] = F.col("_s")
    extra = [spec[x](F.col("v")).alias(f"_{x}") for x in ("whole", "by") if x in spec] + ([F.try_variant_get("v", spec["by_id"], "string").alias("_id")] if "by_id" in spec else [])
    rows = rows.select("key", "ord", F.lit(source.split("_")[0]).alias("provider"), *[c.alias(f) for f, c in made.items()], *extra)
    if "whole" in spec:  # a title without a credit is by whoever put it there
        lone = F.col("title").isNull()
        rows = rows.withColumn("artist", F.when(lone, F.col("_by")).otherwise(F.col("artist"))).withColumn("title", F.when(lone, F.col("_whole")).otherwise(F.col("title")))
    if "must" in spec:
        rows = rows.where(F.col(spec["must"]).isNotNull())
    named = F.col("title").isNotNull() & F.col("artist").isNotNull() if spec["need"] == "there" else (T.nonempty(F.col("title")).isNotNull() & T.nonempty(F.col("artist")).isNotNull()) if spec["need"] == "filled" else F.col("title").isNotNull()
    rows = rows.where(named | F.lit(source == "acoustid"))
    if "never" in spec:
        rows = rows.where((F.lower("title") != spec["never"]) & (F.lower("artist") != spec["never"]))
    if spec.get("credits"):
        both = T.featured(F.col("artist"), F.col("title"))
        rows = rows.withColumn("_c", both).withColumn("artist", F.col("_c.artist")).withColumn("title", F.col("_c.title"))
        if spec.get("leads"):
            rows = rows.withColumn("album_artist", F.col("artist"))
    if spec.get("once"):
        rows = first_of(rows, ["key", "_k"], rows.withColumn("_k", F.concat_ws("|", T.ascii_lower(F.col("title")), T.ascii_lower(F.col("artist")))))
    if "by_id" in spec:  # results without a number all stay
        rows = first_of(rows, ["key", "_k"], rows.withColumn("_k", F.coalesce(F.col("_id"), F.concat(F.lit("#"), F.col("ord").cast("string")))))
    if "most" in spec and spec["need"]:
        rows = rows.withColumn("_n", F.row_number().over(_by_place())).where(F.col("_n") <= spec["most"])
    return rows.select("key", "ord", "provider", *FIELDS)


def _by_place():
    from pyspark.sql.window import Window

    return Window.partitionBy("key").orderBy("ord")  # the results of one answer


def first_of(rows: DataFrame, keys: list[str], keyed: DataFrame) -> DataFrame:
    """The first row of each key by ``ord``."""
    kept = [c for c in keyed.columns if c not in keys]
    return keyed.groupBy(*keys).agg(F.min(F.struct("ord", *[c for c in kept if c != "ord"])).alias("_b")).select("key", *[F.col(f"_b.{c}").alias(c) for c in kept])


def recordings(payloads: DataFrame) -> DataFrame:
    """Payloads (key, payload) of single recordings, ``key`` being the recording's number, by the first release that holds it, else the first.

    (key, title, artist, album, release_id, release_date, track_number, track_total, duration_s, isrc). The place is the first run of
    digits of the track's number, else its position.
    """
    rows = payloads.select("key", parsed(F.col("payload")).alias("v")).where(F.col("v").isNotNull())
    empty = F.array().cast("array<variant>")
    tracks_of = lambda r: F.flatten(F.transform(F.coalesce(_list(r, "$.media"), empty), lambda m: F.coalesce(_list(m, "$.tracks"), empty)))
    own = lambda t: F.coalesce(F.try_variant_get(t, "$.recording.id", "string") == F.col("key"), F.lit(False))
    releases = F.coalesce(_list(F.col("v"), "$.releases"), empty)
    holding = F.filter(releases, lambda r: F.exists(tracks_of(r), own))
    rows = rows.withColumn("r", F.coalesce(F.get(holding, F.lit(0)), F.get(releases, F.lit(0))))
    rows = rows.withColumn("t", F.get(F.filter(tracks_of(F.col("r")), own), F.lit(0)))
    place = F.coalesce(F.regexp_extract(F.try_variant_get("t", "$.number", "string"), r"[0-9]+", 0).try_cast("long"), F.when(F.try_variant_get("t", "$.position", "long") > 0, F.try_variant_get("t", "$.position", "long")))
    v, r = F.col("v"), F.col("r")
    return rows.select(
        "key", F.coalesce(at(v, ["$.title"], "string"), F.lit("Unknown Title")).alias("title"), F.coalesce(at(v, ["$['artist-credit'][0].name"], "string"), F.lit("Unknown Artist")).alias("artist"), at(r, ["$.title"], "string").alias("album"), at(r, ["$.id"], "string").alias("release_id"),
        at(r, ["$.date"], "string").alias("release_date"), place.alias("track_number"), at(r, ["$.media[0]['track-count']"], "long").alias("track_total"), (at(v, ["$.length"], "double") / 1000).alias("duration_s"), at(v, ["$.isrcs[0]"], "string").alias("isrc"),
    )


def aliases(payloads: DataFrame) -> DataFrame:
    """(key, pos, alias): the three shortest ASCII aliases of payloads (key, payload), neighbours that differ in case only once."""
    rows = payloads.select("key", parsed(F.col("payload")).alias("v")).where(F.col("v").isNotNull())
    empty = F.array().cast("array<variant>")
    names = F.flatten(F.transform(F.coalesce(_list(F.col("v"), "$.artists"), empty), lambda a: F.transform(F.coalesce(_list(a, "$.aliases"), empty), lambda x: F.try_variant_get(x, "$.name", "string"))))
    kept = F.filter(names, lambda n: n.isNotNull() & ~n.rlike(r"[^\x00-\x7f]") & (T.ws_trim(n) != ""))
    ordered = F.array_sort(F.transform(kept, lambda n, i: F.struct(F.octet_length(n).alias("l"), i.alias("i"), n.alias("n"))))
    once = F.filter(ordered, lambda x, i: (i == 0) | (F.lower(x["n"]) != F.lower(F.get(ordered, i - 1)["n"])))
    return rows.select("key", F.posexplode(F.slice(once, 1, 3)).alias("pos", "x")).select("key", "pos", F.col("x.n").alias("alias"))


def release_tracks(payloads: DataFrame) -> DataFrame:
    """Tracks of releases (key, target, payload, found) that resemble the title ``target`` (all, if it's blank), or one row made of the release where none does.

    (key, ord, title, artist, album, track_number, track_total, year, label, country, cover_url, release_id). ``found`` is the search hit's
    JSON with title ``Artist - Album`` and cover_image, which fill what the release lacks.
    """
    rows = payloads.select("key", F.coalesce("target", F.lit("")).alias("target"), parsed(F.col("payload")).alias("v"), parsed(F.col("found")).alias("f")).where(F.col("v").isNotNull())
    v, named = F.col("v"), F.split(F.try_variant_get("f", "$.title", "string"), " - ")
    tracks = F.coalesce(_list(v, "$.tracklist"), F.array().cast("array<variant>"))
    numbered = F.transform(tracks, lambda t, i: F.struct((i + 1).cast("long").alias("n"), F.coalesce(F.try_variant_get(t, "$.title", "string"), F.lit("")).alias("title")))
    near = F.filter(numbered, lambda t: (F.col("target") == "") | (T.similarity_ascii(t["title"], F.col("target")) >= 0.55))
    alone = F.array(F.struct(F.lit(None).cast("long").alias("n"), F.col("target").alias("title")))
    rows = rows.select("*", F.size(tracks).cast("long").alias("_all"), F.posexplode(F.when(F.size(near) > 0, near).otherwise(alone)).alias("ord", "_t"))
    return rows.select(
        "key", "ord", F.col("_t.title").alias("title"), F.coalesce(at(v, ["$.artists_sort"], "string"), F.get(named, F.lit(0)), F.lit("Unknown Artist")).alias("artist"), F.coalesce(at(v, ["$.title"], "string"), F.get(named, F.lit(1))).alias("album"), F.col("_t.n").alias("track_number"), F.when(F.col("_t.n").isNotNull(), F.col("_all")).alias("track_total"),
        at(v, ["$.year"], "string").alias("year"), at(v, ["$.labels[0].name"], "string").alias("label"), at(v, ["$.country"], "string").alias("country"), F.coalesce(at(v, ["$.images[0].resource_url", "$.images[0].uri"], "string"), F.try_variant_get("f", "$.cover_image", "string")).alias("cover_url"), F.concat(F.lit("discogs:"), at(v, ["$.id"], "string")).alias("release_id"),
    )


def enriched(found: DataFrame, details: DataFrame) -> DataFrame:
    """``found`` (of lastfm) with album and genre of a track's details (key, payload): on the row of the same title and artist, else on the first.

    The genre is the first of eight tags that are not blank. Keys without details stay as they are.
    """
    d = details.select("key", parsed(F.col("payload")).alias("v")).where(F.col("v").isNotNull())
    t = F.try_variant_get("v", "$.track", "variant")
    tags = F.slice(F.filter(F.transform(F.coalesce(_list(t, "$.toptags.tag"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$.name", "string")), lambda n: n.isNotNull() & (T.ws_trim(n) != "")), 1, 8)
    d = d.where(t.isNotNull()).select("key", T.ascii_lower(F.coalesce(F.try_variant_get(t, "$.name", "string"), F.lit(""))).alias("_title"), T.ascii_lower(F.coalesce(F.try_variant_get(t, "$.artist.name", "string"), F.lit(""))).alias("_artist"), F.nullif(F.try_variant_get(t, "$.album.title", "string"), F.lit("")).alias("_album"), F.get(tags, F.lit(0)).alias("_genre"))
    rows = found.join(d, "key", "left")
    same = (T.ascii_lower(F.col("title")) == F.col("_title")) & (T.ascii_lower(F.col("artist")) == F.col("_artist"))
    chosen = rows.groupBy("key").agg(F.coalesce(F.min(F.when(same, F.col("ord"))), F.min("ord")).alias("_ord"))
    rows = rows.join(chosen, "key")
    use = F.col("ord") == F.col("_ord")
    return rows.withColumn("album", F.when(use, F.coalesce("album", "_album")).otherwise(F.col("album"))).withColumn("genre", F.when(use, F.coalesce("_genre", "genre")).otherwise(F.col("genre"))).select(*found.columns)


def detailed(found: DataFrame, details: DataFrame) -> DataFrame:
    """``found`` with the first row of each key replaced by the candidate of its detail answer, where there is one."""
    first = found.groupBy("key").agg(F.min("ord").alias("ord"))
    better = details.drop("ord").join(first, "key").select(*found.columns)
    return found.join(better.select("key", "ord"), ["key", "ord"], "left_anti").unionByName(better)


def search_terms(wanted: DataFrame) -> DataFrame:
    """(key, term): the search terms of key, title, artist and album, once each and none blank."""
    title, artist, album = F.col("title"), F.col("artist"), F.col("album")
    base = F.when(T.nonempty(artist).isNotNull(), F.concat(artist, F.lit(" "), title)).otherwise(title)
    short = F.when(F.instr(artist, " - ") > 0, F.call_function("substring_index", artist, F.lit(" - "), F.lit(1)))
    parts = F.when(T.nonempty(album).isNotNull(), F.filter(F.transform(F.split(album, r"\|"), T.ws_trim), lambda s: s != "")).otherwise(F.array().cast("array<string>"))
    terms = F.concat(F.array(base, title, F.concat(short, F.lit(" "), title), F.when(T.nonempty(album).isNotNull(), F.concat(base, F.lit(" "), album))), parts, F.transform(parts, lambda s: F.concat(short, F.lit(" "), s)))
    kept = F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (T.ws_trim(t) != "")))
    return wanted.select("key", F.explode(kept).alias("term"))


def catalogue_queries(wanted: DataFrame) -> DataFrame:
    """(key, query): queries by code where a key has any, else one by title and artist; the first three in order. ``wanted``: key, title, artist, codes."""
    codes = F.transform(F.filter(F.coalesce("codes", F.array().cast("array<string>")), lambda c: T.nonempty(c).isNotNull()), lambda c: F.concat(F.lit("isrc:"), T.ws_trim(c)))
    text = F.concat(F.lit('track:"'), F.col("title"), F.lit('"'), F.when(T.nonempty(F.col("artist")).isNotNull(), F.concat(F.lit(' artist:"'), F.col("artist"), F.lit('"'))).otherwise(F.lit("")))
    every = F.when(F.size(codes) > 0, F.slice(F.array_sort(F.array_distinct(codes)), 1, 3)).otherwise(F.array(text))
    return wanted.select("key", F.explode(every).alias("query")).where(F.col("query").isNotNull())


def artist_genres(wanted: DataFrame, searches: DataFrame, entities: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, pos, genre) of artists in three steps: search answer to entity (similarity .72), its claims to genre numbers, those to English labels.

    ``wanted``: key, artist; ``searches``: key, payload; ``entities``: entity, payload; ``labels``: genre, payload, an answer for each number.
    """
    hits = wanted.join(searches, "key").select("key", "artist", F.posexplode(_list(parsed(F.col("payload")), "$.search")).alias("ord", "x"))
    label = F.try_variant_get("x", "$.label", "string")
    near = hits.where(T.similarity_lower(label, F.col("artist")) >= 0.72).groupBy("key").agg(F.min_by(F.try_variant_get("x", "$.id", "string"), "ord").alias("entity"))
    claims = near.join(entities, "entity").select("key", "entity", F.posexplode(_list(parsed(F.col("payload")), "$.claims.P136")).alias("pos", "c"))
    numbers = claims.select("key", "pos", F.try_variant_get("c", "$.mainsnak.datavalue.value.id", "string").alias("genre")).where(F.col("genre").isNotNull())
    return numbers.join(labels, "genre").select("key", "pos", F.try_variant_get(parsed(F.col("payload")), "$.labels.en.value", "string").alias("genre")).where(F.col("genre").isNotNull())


def probed(payloads: DataFrame) -> DataFrame:
    """(path, title, artist, album, album_artist, track_number, genre, duration, bitrate, format) of a media prober's JSON (path, payload).

    Tags of the container go before those of the stream; ``3/10`` is track 3; without a duration there is no row.
    """
    rows = payloads.select("path", parsed(F.col("payload")).alias("v")).where(F.col("v").isNotNull())
    v = F.col("v")
    tag = lambda n: at(v, [f"$.format.tags.{n}", f"$.streams[0].tags.{n}"], "string")
    num = lambda n: at(v, [f"$.format.{n}", f"$.streams[0].{n}"], "double")
    out = rows.select("path", *[tag(n).alias(n) for n in ("title", "artist", "album", "album_artist")], F.call_function("substring_index", tag("track"), F.lit("/"), F.lit(1)).try_cast("long").alias("track_number"), tag("genre").alias("genre"), num("duration").alias("duration"), F.round(num("bit_rate") / 1000).cast("long").alias("bitrate"), T.probe_format(at(v, ["$.format.format_name"], "string"), at(v, ["$.streams[0].codec_name"], "string"), F.col("path")).alias("format"))
    return out.where(F.col("duration").isNotNull())


def meta_content(html: Column, name: str) -> Column:
    """The content of a page's first ``meta`` tag of that name or property, entities decoded; null if there is none."""
    tag = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    return F.when(tag != "", T.decode_entities(F.regexp_extract(tag, r"(?is)content\s*=\s*[\"']([^\"']*)[\"']", 1)))

"""Queries of the source mappers: answers are made of the tables' own rows, mapped back, and SQL says what must come out."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.io import load
from refrain.sources import pages, payloads

_C = "c AS (SELECT DISTINCT ON (candidate_id) * FROM candidates)"
_R = f"{_C}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY c.ord, candidate_id) - 1 AS o FROM c)"
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FULL = "nullif(regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"


def _full(x: str) -> str:
    return _FULL.format(x=x)


def _first(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN left({x}, {n}) END"


def _each(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "candidates").dropDuplicates(["candidate_id"])


def _answers(s: SparkSession, d: str, item: Column, wrap: Callable[[Column], Column]) -> DataFrame:
    """(key, payload): an answer a track with its candidates in order."""
    rows = _each(s, d).select("track_id", "ord", "candidate_id", item.alias("item")).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("ord", "candidate_id", "item"))).alias("l"))
    return rows.select(F.col("track_id").alias("key"), F.to_json(wrap(F.transform("l", lambda x: x["item"]))).alias("payload"))


def _n(**fields: Column | str) -> Column:
    """A JSON object; a dash in a name is written as two underscores, # as H_."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k.replace("__", "-").replace("H_", "#")) for k, c in fields.items()])


_MS = F.col("duration_s") * 1000

# source: (result, its place in the answer, fields of the candidate with their SQL, SQL that a result must meet)
_LISTS: dict[str, tuple] = {
    "itunes": (
        lambda: _n(trackName="title", artistName="artist", collectionName="album", collectionArtistName="album_artist", trackNumber="track_number", trackCount="track_total", discNumber="disc_number", discCount="disc_total", releaseDate="release_date", primaryGenreName="genre", artworkUrl100=F.concat("cover_url", F.lit("/100x100bb.jpg")), trackTimeMillis=_MS, trackId="candidate_id", collectionId="track_id"),
        lambda a: _n(results=a),
        {"title": "title", "artist": "artist", "album": "album", "album_artist": "album_artist", "track_number": "track_number", "track_total": "track_total", "disc_number": "disc_number", "disc_total": "disc_total", "year": _first("release_date", 4), "release_date": _first("release_date", 10), "genre": "genre", "cover_url": "cover_url || '/1200x1200bb.jpg'", "recording_id": "candidate_id::VARCHAR", "release_id": "track_id::VARCHAR", "duration_s": "duration_s"},
        "title IS NOT NULL AND artist IS NOT NULL",
    ),
    "deezer": (
        lambda: _n(title="title", artist=_n(name="artist"), album=_n(title="album", cover_xl=F.when(F.col("ord") % 2 == 0, F.col("cover_url")), cover_big="cover_url"), isrc="isrc", duration="duration_s"),
        lambda a: _n(data=a),
        {"title": "title", "artist": "artist", "album": "album", "isrc": "isrc", "cover_url": "cover_url", "duration_s": "duration_s"},
        "title IS NOT NULL AND artist IS NOT NULL",
    ),
    "musicbrainz": (
        lambda: _n(id="recording_id", title="title", artist__credit=F.array(_n(name="artist", artist=_n(id="artist_id"))), releases=F.array(_n(id="release_id", title="album", date="release_date", country="release_country", release__group=_n(primary__type="release_type", secondary__types=F.when(F.col("release_secondary_types").isNotNull(), F.array("release_secondary_types"))))), length=_MS),
        lambda a: _n(recordings=a),
        {"title": "coalesce(title, 'Unknown Title')", "artist": "coalesce(artist, 'Unknown Artist')", "album": "album", "year": "release_date", "release_date": "release_date", "release_country": "release_country", "release_type": "release_type", "release_secondary_types": "release_secondary_types", "is_compilation": "coalesce(contains(lower(release_secondary_types), 'compilation'), false)", "recording_id": "recording_id", "release_id": "release_id", "artist_id": "artist_id", "cover_url": "'https://coverartarchive.org/release/' || release_id || '/front-500'", "duration_s": "duration_s"},
        "true",
    ),
    "acoustid": (
        lambda: _n(score="acoustid", recordings=F.array(_n(id="recording_id", title="title"))),
        lambda a: _n(status=F.lit("ok"), results=a),
        {"title": "title", "recording_id": "recording_id", "acoustid": "acoustid"},
        "o < 3",
    ),
    "lastfm": (
        lambda: _n(name="title", artist="artist", mbid=F.coalesce("recording_id", F.lit("")), image=F.array(_n(H_text=F.lit("small")), _n(H_text="cover_url"))),
        lambda a: _n(results=_n(trackmatches=_n(track=a))),
        {"title": "coalesce(title, 'Unknown Title')", "artist": "coalesce(artist, 'Unknown Artist')", "cover_url": "CASE WHEN cover_url IS NULL THEN 'small' ELSE nullif(cover_url, '') END", "recording_id": "nullif(recording_id, '')"},
        "o < 5",
    ),
    "theaudiodb": (
        lambda: _n(strTrack="title", strArtist="artist", strAlbum="album", strGenre="genre", intYear="year", strTrackThumb=F.when(F.col("ord") % 2 == 0, F.col("cover_url")), strAlbumThumb="cover_url", strMusicBrainzID="recording_id"),
        lambda a: _n(track=a),
        {"title": "coalesce(title, 'Unknown Title')", "artist": "coalesce(artist, 'Unknown Artist')", "album": "album", "genre": "genre", "year": "year", "cover_url": "cover_url", "recording_id": "nullif(recording_id, '')"},
        "o < 5",
    ),
    "wikidata": (
        lambda: _n(id="artist_id", label="title", description="artist"),
        lambda a: _n(search=a),
        {"title": "coalesce(title, 'Unknown Title')", "artist": "coalesce(artist, 'Unknown Artist')", "release_id": "'wikidata:' || artist_id"},
        "o < 5",
    ),
    "genius": (
        lambda: _n(type=F.when(F.col("ord") % 3 > 0, "song"), result=_n(title="title", artist_names="artist", primary_artist=_n(name="album_artist"), album=_n(name="album", cover_art_url="cover_url"), release_date="release_date", primary_tag=_n(name="genre"))),
        lambda a: _n(response=F.when(F.col("track_id") % 2 == 0, _n(hits=a, sections=F.lit(None).cast("array<string>"))).otherwise(_n(hits=F.lit(None).cast(_HITS), sections=F.lit(None).cast("array<string>")))),
        {"title": _full("title"), "artist": _full("artist"), "album": _full("album"), "album_artist": _full("album_artist"), "release_date": _full("release_date"), "year": _first(_full("release_date"), 4), "genre": _full("genre"), "cover_url": _full("cover_url")},
        f"track_id % 2 = 0 AND {_full('title')} IS NOT NULL AND {_full('artist')} IS NOT NULL",
    ),
    "navahang": (
        lambda: _n(song_name="title", artist_name="artist", main_image="cover_url"),
        lambda a: _n(songs=a),
        {"title": _full("title"), "artist": _full("artist"), "album_artist": _full("artist"), "cover_url": _full("cover_url")},
        f"{_full('title')} IS NOT NULL AND {_full('artist')} IS NOT NULL",
    ),
    "spotify": (
        lambda: _n(type=F.lit("track"), id="recording_id", name="title", artists=F.array(_n(name="artist")), album=_n(name="album", artists=F.array(_n(name="album_artist")), release_date="release_date", album_type="release_type", total_tracks="track_total", images=F.array(_n(url="cover_url"))), track_number="track_number", disc_number="disc_number", external_ids=_n(isrc="isrc"), duration_ms=_MS),
        lambda a: _n(tracks=_n(items=a)),
        {"title": "title", "artist": "artist", "album": "album", "album_artist": "album_artist", "track_number": "track_number", "track_total": "track_total", "disc_number": "disc_number", "release_date": "release_date", "year": _first("release_date", 4), "release_type": "release_type", "is_compilation": "coalesce(release_type = 'compilation', false)", "isrc": "isrc", "cover_url": "cover_url", "duration_s": "duration_s"},
        "title IS NOT NULL AND artist IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_id, coalesce(recording_id, '#' || o) ORDER BY o) = 1",
    ),
    "radiojavan": (
        lambda: _n(song="title", artist="artist", album="album", created_at=F.when(F.col("release_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("release_date")), photo="cover_url", duration="duration_s"),
        lambda a: _n(mp3s=a, top=_n(type=F.lit("video"), mp3=F.get(a, F.lit(0)))),
        {"title": _full("title"), "artist": _full("artist"), "album": _full("album"), "release_date": "CASE WHEN regexp_matches(release_date, '^\\d{4}-\\d{2}-\\d{2}') AND try_cast(left(release_date, 10) AS DATE) IS NOT NULL THEN left(release_date, 10) END", "year": "CASE WHEN regexp_matches(release_date, '^\\d{4}-\\d{2}-\\d{2}') AND try_cast(left(release_date, 10) AS DATE) IS NOT NULL THEN left(release_date, 4) END", "cover_url": _full("cover_url"), "duration_s": "duration_s"},
        None,
    ),
    "audiomack": (
        lambda: _n(type=F.when(F.col("ord") % 4 > 0, "song"), title="title", artist="artist", album="album", ord=F.col("track_number").cast("string"), released=(1577836800 + 86400 * F.col("ord")).cast("string"), tagdisplay="genre", description=F.concat(F.lit("Producer: x\nmusic : "), "composer", F.lit("\nLabel:"), "label"), isrc="isrc", image=F.concat("cover_url", F.lit("?a=1")), duration=F.col("duration_s").cast("string")),
        lambda a: _n(results=a),
        {"title": _full("title"), "artist": _full("artist"), "album": _full("album"), "album_artist": _full("artist"), "track_number": "track_number", "release_date": "(DATE '2020-01-01' + c_ord)::VARCHAR", "year": "'2020'", "genre": f"upper(left({_full('genre')}, 1)) || substr({_full('genre')}, 2)", "isrc": _full("isrc"), "cover_url": "cover_url || '?width=1600&format=jpg'", "duration_s": "duration_s"},
        None,
    ),
}
_HITS = "array<struct<type: string, result: struct<title: string, artist_names: string, primary_artist: struct<name: string>, album: struct<name: string, cover_art_url: string>, release_date: string, primary_tag: struct<name: string>>>>"


def _tidy(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select("key", F.col("ord").cast("long").alias("ord"), *[F.round(F.col(f), 6).alias(f) if f in ("duration_s", "acoustid") else F.col(f) for f in fields])


def _listed(s: SparkSession, d: str, source: str) -> DataFrame:
    item, wrap, fields, _ = _LISTS[source]
    return _tidy(payloads.candidates(_answers(s, d, item(), wrap), source), list(fields))


def _listed_sql(source: str) -> str:
    _, _, fields, must = _LISTS[source]
    columns = ", ".join(f"round({x}, 6) AS {f}" if f in ("duration_s", "acoustid") else f"{x} AS {f}" for f, x in fields.items())
    r = _R.replace("SELECT *, row_number", "SELECT c.* EXCLUDE (ord), c.ord AS c_ord, row_number")
    if must is not None:
        return f"WITH {r} SELECT track_id AS key, o AS ord, {columns} FROM r WHERE {must}"
    named = f"{_full('title')} IS NOT NULL AND {_full('artist')} IS NOT NULL"
    once = f"PARTITION BY track_id, {_LOWER.format(x=_full('title'))}, {_LOWER.format(x=_full('artist'))} ORDER BY o" if source == "radiojavan" else "PARTITION BY track_id, o"
    return f"WITH {r}, k AS (SELECT * FROM r WHERE {named} QUALIFY row_number() OVER ({once}) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY o) AS i FROM k) SELECT track_id AS key, o AS ord, {columns} FROM n WHERE i <= 10"


def songrec(s: SparkSession, d: str) -> DataFrame:
    """A recogniser's answers, with noise around the JSON, in two of their shapes."""
    fact = lambda n, c: _n(title=F.lit(n), text=c)
    track = _n(title="title", subtitle="artist", isrc="isrc", genres=_n(primary="genre"), images=_n(coverart="cover_url"), sections=F.array(_n(type=F.lit("Song"), metadata=F.array(fact("Album", "album"), fact("released", "year"), fact("Label", "label")))))
    deep, flat = F.to_json(_n(raw_response=_n(track=track), song_name=F.lit("x"))), F.to_json(_n(track=track))
    rows = _each(s, d).select(F.col("candidate_id").alias("key"), F.concat(F.lit("log 1\n"), F.when(F.col("candidate_id") % 2 == 0, deep).otherwise(flat), F.lit("\n")).alias("payload"))
    return payloads.candidates(rows, "songrec").select("key", "title", "artist", "album", "release_date", "year", "genre", "label", "isrc", "cover_url", "score")


def audd(s: SparkSession, d: str) -> DataFrame:
    """A recogniser's answers that fall back on two nested services; every seventh has no result."""
    spotify = _n(name="title", artists=F.array(_n(name="artist")), album=_n(name="album", release_date="release_date", artists=F.array(_n(name="album_artist")), images=F.array(_n(url=F.concat("cover_url", F.lit("/{w}x{h}"))))), track_number="track_number", disc_number="disc_number", external_ids=_n(isrc="isrc"), duration_ms=_MS)
    own = lambda c: F.when(F.col("candidate_id") % 3 == 0, F.col(c))
    result = _n(title=own("title"), artist=own("artist"), album=own("album"), label="label", spotify=spotify, apple_music=_n(genreNames=F.array("genre")))
    rows = _each(s, d).select(F.col("candidate_id").alias("key"), F.to_json(_n(result=F.when(F.col("candidate_id") % 7 > 0, result))).alias("payload"))
    return payloads.candidates(rows, "audd").select("key", "title", "artist", "album", "album_artist", "track_number", "disc_number", "release_date", "year", "genre", "label", "isrc", "cover_url", F.round("duration_s", 6).alias("duration_s"), "score")


def youtube(s: SparkSession, d: str) -> DataFrame:
    """Dates, lengths and the largest picture of videos."""
    rows = _each(s, d).select(F.col("candidate_id").alias("key"), F.to_json(_n(items=F.array(_n(snippet=_n(title="title", channelTitle=F.lit("X - Topic"), publishedAt="release_date", thumbnails=_n(high=_n(url="cover_url"), default=_n(url=F.lit("d")))), contentDetails=_n(duration=F.concat(F.lit("PT"), "ord", F.lit("M5S"))))))).alias("payload"))
    return payloads.candidates(rows, "youtube").select("key", "year", "release_date", "cover_url", "duration_s")


def recordings(s: SparkSession, d: str) -> DataFrame:
    """Recordings with three releases, of which the last holds the recording."""
    own = _n(id="release_id", title="album", date="release_date", media=F.array(_n(track__count="track_total", tracks=F.array(_n(number=F.lit("B9"), position=F.lit(9), recording=_n(id=F.lit("other"))), _n(number=F.when(F.col("ord") % 2 == 0, F.concat(F.lit("A"), "track_number")), position="track_number", recording=_n(id="candidate_id"))))))
    other = F.from_json(F.lit('{"id": "none", "title": "wrong"}'), "id string, title string, date string, media array<struct<`track-count`: bigint, tracks: array<struct<number: string, position: bigint, recording: struct<id: string>>>>>")
    own = F.from_json(F.to_json(own), "id string, title string, date string, media array<struct<`track-count`: bigint, tracks: array<struct<number: string, position: bigint, recording: struct<id: string>>>>>")
    rows = _each(s, d).select(F.col("candidate_id").cast("string").alias("key"), F.to_json(_n(title="title", artist__credit=F.array(_n(name="artist")), releases=F.array(other, other, own), length=_MS, isrcs=F.array("isrc"))).alias("payload"))
    return payloads.recordings(rows).withColumn("duration_s", F.round("duration_s", 6))


def aliases(s: SparkSession, d: str) -> DataFrame:
    """The three shortest names in ASCII of each supplier's nation, parts and own name."""
    t = load(s, d, "supplier").select("s_nationkey", F.col("s_name").alias("name")).unionByName(load(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))).unionByName(load(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("name")))
    rows = t.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("name"))).alias("l")).select(F.col("s_nationkey").alias("key"), F.to_json(_n(artists=F.array(_n(aliases=F.col("l"))))).alias("payload"))
    return payloads.aliases(rows).select("key", F.col("pos").cast("long").alias("pos"), "alias")


def releases(s: SparkSession, d: str) -> DataFrame:
    """The parts of a brand as tracks of a release, of which those count that resemble its first name."""
    p = load(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("title")))).alias("l"), F.min("p_name").alias("target"))
    tracks = F.transform("l", lambda x: F.struct(x["title"].alias("title")))
    rows = p.select(F.col("p_brand").alias("key"), "target", F.to_json(_n(id=F.lit(7), title=F.lit("Parts"), tracklist=tracks, labels=F.array(_n(name=F.lit("L"))))).alias("payload"), F.to_json(_n(title=F.concat("p_brand", F.lit(" - x")), cover_image=F.lit("c"))).alias("found"))
    return payloads.release_tracks(rows).select("key", "title", "artist", "album", "track_number", "track_total", "label", "cover_url", "release_id")


def probes(s: SparkSession, d: str) -> DataFrame:
    """A prober's answers on tracks, tags in the container or the stream."""
    t = load(s, d, "tracks").dropDuplicates(["track_id"])
    there = lambda c: F.when(F.col("track_id") % 2 == 0, F.col(c))
    tags = _n(title=there("current_title"), album=there("current_album"), track=F.concat(F.col("current_track_number").cast("string"), F.lit("/12")))
    stream = _n(title="current_title", album="current_album", artist="current_artist", genre="genre")
    rows = t.select(F.concat(F.col("track_id").cast("string"), F.lit("/x.WAV")).alias("path"), F.to_json(_n(format=_n(tags=tags, duration=F.col("duration").cast("string"), bit_rate=(F.col("bitrate") * 1000 + 400).cast("string"), format_name=F.when(F.col("format") != "wav", F.when(F.col("format") == "m4a", "mov,mp4").when(F.col("format") == "opus", "ogg").otherwise(F.col("format")))), streams=F.array(_n(tags=stream, codec_name=F.when(F.col("format") == "opus", "opus"))))).alias("payload"))
    return payloads.probed(rows).withColumn("duration", F.round("duration", 6)).select("path", "title", "artist", "album", "track_number", "genre", "duration", "bitrate", "format")


def terms(s: SparkSession, d: str) -> DataFrame:
    """How many search terms each track gives."""
    t = load(s, d, "tracks").dropDuplicates(["track_id"]).select(F.col("track_id").alias("key"), F.col("current_title").alias("title"), F.col("current_artist").alias("artist"), F.col("current_album").alias("album"))
    return payloads.search_terms(t.where(F.col("title").isNotNull())).distinct()


def codes(s: SparkSession, d: str) -> DataFrame:
    """What is asked of a catalogue for each track: its candidates' codes, else its title and artist."""
    c = _each(s, d).groupBy("track_id").agg(F.collect_set("isrc").alias("codes"))
    t = load(s, d, "tracks").dropDuplicates(["track_id"]).join(c, "track_id", "left").select(F.col("track_id").alias("key"), F.col("current_title").alias("title"), F.col("current_artist").alias("artist"), "codes")
    return payloads.catalogue_queries(t)


def pages_found(s: SparkSession, d: str) -> DataFrame:
    """What pages made of the candidates tell: headings or ``og:title``, picture, length, date and credits."""
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    c = _each(s, d).where(~F.coalesce(F.concat_ws("", "title", "artist", "composer", "label").rlike(r"[<>']|&#?\w+;"), F.lit(False)))
    html = F.concat(
        F.lit("<html><head><meta property='og:image' content='"), F.coalesce("cover_url", F.lit("")), F.lit("'><meta name=\"music:duration\" content=\""), F.coalesce(F.col("track_number").cast("string"), F.lit("")), F.lit('"></head><h1 class="big">x</h1><h1 class="text-truncate" data-content="'), esc("title"),
        F.lit('"><h2 class="text-truncate" data-content="'), esc("artist"), F.lit('"><div class="mp3-page a">Date Added: 05/03/2020<br>Music: '), esc("composer"), F.lit("<br>Label: <b>"), esc("label"), F.lit("</b></div><div class='mp3-buttons'>Label: no</div></html>"),
    )
    return pages.song_pages(c.select(F.col("candidate_id").alias("key"), html.alias("html"))).select("key", "title", "artist", "cover_url", "duration_s", "release_date", "composer", "label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The mappers by source, and the steps around them."""
    out = {f"source_{name}": partial(_listed, source=name) for name in _LISTS}
    for q in out.values():
        q.__doc__, q.__name__ = "S10-S29: answers of one source as candidates.", "source"  # type: ignore[attr-defined]
    return out | {"source_songrec": songrec, "source_audd": audd, "source_youtube": youtube, "source_recordings": recordings, "source_aliases": aliases, "source_releases": releases, "source_probes": probes, "source_terms": terms, "source_codes": codes, "source_pages": pages_found}


def oracle_sql() -> dict[str, str]:
    """SQL by query, from the rows that the answers were made of."""
    def sim(a: str, b: str) -> str:
        return f"(1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})))"

    full = f"{_full('title')} IS NOT NULL AND {_full('artist')} IS NOT NULL"
    term = "CASE WHEN " + _full("artist") + " IS NOT NULL THEN artist || ' ' || title ELSE title END"
    short = "CASE WHEN contains(artist, ' - ') THEN split_part(artist, ' - ', 1) END"
    return {f"source_{name}": _listed_sql(name) for name in _LISTS} | {
        "source_songrec": f"WITH {_C} SELECT candidate_id AS key, {_full('title')} AS title, {_full('artist')} AS artist, {_full('album')} AS album, {_full('year')} AS release_date, nullif(regexp_extract({_full('year')}, '(^|[^0-9])([12][0-9]{{3}})($|[^0-9])', 2), '') AS year, genre, {_full('label')} AS label, upper({_full('isrc')}) AS isrc, cover_url, 96.0::DOUBLE AS score FROM c WHERE {full} AND lower({_full('title')}) <> 'unknown' AND lower({_full('artist')}) <> 'unknown'",
        "source_audd": f"WITH {_C} SELECT candidate_id AS key, title, artist, album, album_artist, track_number, disc_number, release_date, {_first('release_date', 4)} AS year, genre, label, isrc, cover_url || '/1200x1200' AS cover_url, round(duration_s, 6) AS duration_s, 97.0::DOUBLE AS score FROM c WHERE candidate_id % 7 > 0 AND title IS NOT NULL AND artist IS NOT NULL",
        "source_youtube": f"WITH {_C} SELECT candidate_id AS key, {_first('release_date', 4)} AS year, {_first('release_date', 10)} AS release_date, coalesce(cover_url, 'd') AS cover_url, (ord * 60 + 5)::DOUBLE AS duration_s FROM c WHERE title IS NOT NULL",
        "source_recordings": f"WITH {_C} SELECT candidate_id::VARCHAR AS key, coalesce(title, 'Unknown Title') AS title, coalesce(artist, 'Unknown Artist') AS artist, album, release_id, release_date, CASE WHEN ord % 2 = 0 OR track_number > 0 THEN track_number END AS track_number, track_total, round(duration_s, 6) AS duration_s, isrc FROM c",
        "source_aliases": "WITH n AS (SELECT s_nationkey AS key, s_name AS a FROM supplier UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, lower(n_name) FROM nation), o AS (SELECT key, a, row_number() OVER w AS i, lag(lower(a)) OVER w AS p FROM n WINDOW w AS (PARTITION BY key ORDER BY length(a), a)), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS pos FROM o WHERE p IS NULL OR p <> lower(a)) SELECT key, pos, a AS alias FROM k WHERE pos < 3",
        "source_releases": f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY p_brand) AS k, min(p_name) OVER (PARTITION BY p_brand) AS t FROM part) SELECT p_brand AS key, p_name AS title, p_brand AS artist, 'Parts' AS album, n AS track_number, k AS track_total, 'L' AS label, 'c' AS cover_url, 'discogs:7' AS release_id FROM p WHERE {sim('lower(p_name)', 'lower(t)')} >= 0.55",
        "source_probes": "WITH t AS (SELECT DISTINCT ON (track_id) * FROM tracks) SELECT track_id || '/x.WAV' AS path, current_title AS title, current_artist AS artist, current_album AS album, current_track_number AS track_number, genre, round(duration, 6) AS duration, bitrate, CASE WHEN format IS NULL OR format NOT IN ('m4a', 'mp3', 'flac', 'ogg', 'opus') THEN 'wav' ELSE format END AS format FROM t WHERE duration IS NOT NULL",
        "source_terms": f"WITH t AS (SELECT DISTINCT ON (track_id) track_id AS key, current_title AS title, current_artist AS artist, current_album AS album FROM tracks WHERE current_title IS NOT NULL), b AS (SELECT *, {term} AS base, {short} AS short, list_filter(list_transform(string_split(CASE WHEN {_full('album')} IS NOT NULL THEN album END, '|'), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS parts FROM t), u AS (SELECT key, unnest([base, title, short || ' ' || title, CASE WHEN parts IS NOT NULL THEN base || ' ' || album END]) AS term FROM b UNION SELECT key, unnest(parts) FROM b UNION SELECT key, short || ' ' || x FROM (SELECT key, short, unnest(parts) AS x FROM b)) SELECT DISTINCT key, term FROM u WHERE {_full('term')} IS NOT NULL",
        "source_codes": f"WITH {_C}, k AS (SELECT DISTINCT track_id, 'isrc:' || {_full('isrc')} AS q FROM c WHERE {_full('isrc')} IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY q) AS i FROM k), t AS (SELECT DISTINCT ON (track_id) track_id, current_title AS title, current_artist AS artist FROM tracks) SELECT t.track_id AS key, q AS query FROM n JOIN t USING (track_id) WHERE i <= 3 UNION ALL SELECT track_id, 'track:\"' || title || '\"' || CASE WHEN {_full('artist')} IS NOT NULL THEN ' artist:\"' || artist || '\"' ELSE '' END FROM t WHERE title IS NOT NULL AND track_id NOT IN (SELECT track_id FROM k)",
        "source_pages": f"WITH {_C} SELECT candidate_id AS key, {_full('title')} AS title, {_full('artist')} AS artist, {_full('cover_url')} AS cover_url, track_number::DOUBLE AS duration_s, '2020-03-05' AS release_date, {_full('composer')} AS composer, {_full('label')} AS label FROM c WHERE {full} AND NOT coalesce(regexp_matches(concat_ws('', title, artist, composer, label), '[<>'']|&#?\\w+;'), false)",
    }

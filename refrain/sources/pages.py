"""HTML pages of catalogue sources: attributes, meta tags, credit fields, embedded JSON and addresses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from refrain.functions import numbers as N
from refrain.functions import text as T
from refrain.sources import payloads

# Hosts whose addresses a user may paste, by source, and the shape of their paths.
HOSTS = {
    "spotify": (("open.spotify.com",), r"^/(?:intl-[a-z]+/)?track/[A-Za-z0-9]+/?$"),
    "soundcloud": (("soundcloud.com", "www.soundcloud.com", "m.soundcloud.com"), r"^/[^/]+/[^/]+/?$"),
    "youtube": (("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be"), r"^/.+$"),
    "radiojavan": (("radiojavan.com", "www.radiojavan.com", "play.radiojavan.com"), r"^/(?:song|mp3s/mp3)/[^/]+/?$"),
    "audiomack": (("audiomack.com", "www.audiomack.com"), r"^/[^/]+/song/[^/]+/?$"),
    "navahang": (("navahang.com", "www.navahang.com"), r"^/.+$"),
    "shazam": (("shazam.com", "www.shazam.com"), r"^/(?:[a-z]{2}-[a-z]{2}/)?(?:song|track)/[0-9]+(?:/.*)?$"),
    "genius": (("genius.com", "www.genius.com"), r"^/.+-lyrics/?$"),
}


def route(url: Column) -> Column:
    """The source that an ``https`` address belongs to by host and path; null for others."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    https = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    return F.coalesce(*[F.when(https & host.isin(*hosts) & path.rlike(shape), F.lit(name)) for name, (hosts, shape) in HOSTS.items()])


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(<{name}[^>]*>)"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, in double quotes or else in single ones, entities decoded; null if there is none."""
    found = [F.when(tag.rlike(rf"{name}={q}[^{q}]*{q}"), F.regexp_extract(tag, rf"{name}={q}([^{q}]*){q}", 1)) for q in ('"', "'")]
    return T.decode_entities(F.coalesce(*found))


def meta_content(html: Column, key: str, wanted: str) -> Column:
    """The content of the first ``meta`` tag whose ``key`` is ``wanted``; null if it's blank or there is none."""
    fits = F.filter(_tags(html, "meta"), lambda t: (attribute(t, key) == wanted) & attribute(t, "content").isNotNull())
    return T.nonempty(attribute(F.get(fits, F.lit(0)), "content"))


def data_content(html: Column, tag: str, css_class: str) -> Column:
    """``data-content`` of the first ``tag`` that holds ``css_class`` and has it."""
    fits = F.filter(_tags(html, tag), lambda t: t.contains(css_class) & attribute(t, "data-content").isNotNull())
    return T.nonempty(attribute(F.get(fits, F.lit(0)), "data-content"))


def credit_field(html: Column, *labels: str) -> Column:
    """What follows the first label, in their order and any case, up to a line break or the block's end, without mark-up."""
    found = []
    for label in labels:
        values = F.regexp_extract_all(html, F.lit(rf"(?is){label}:(\s.*?)(?=<br|</div|$)"), F.lit(1))
        clean = F.transform(values, lambda v: T.ws_trim(T.decode_entities(T.strip_tags(v))))
        found.append(F.get(F.filter(clean, lambda v: v != ""), F.lit(0)))
    return F.coalesce(*found)


def song_pages(pages: DataFrame) -> DataFrame:
    """(key, title, artist, cover_url, duration_s, release_date, composer, label) of song pages (key, html).

    Title and artist come from the headings, else from ``og:title`` (``Artist - 'Title'``); pages without either give no row.
    """
    html = F.col("html")
    region = F.regexp_extract(html, r'(?s)(<div class="mp3-page.*?)(?:mp3-buttons|$)', 1)
    og = meta_content(html, "property", "og:title")
    left, right = T.nonempty(F.when(F.instr(og, " - ") > 0, F.call_function("substring_index", og, F.lit(" - "), F.lit(1)))), F.when(F.instr(og, " - ") > 0, F.substring(og, F.instr(og, " - ") + 3, F.lit(1 << 30)))
    rows = pages.select(
        "key", F.coalesce(data_content(html, "h1", "text-truncate"), T.nonempty(F.regexp_replace(right, "^['\"]+|['\"]+$", ""))).alias("title"), F.coalesce(data_content(html, "h2", "text-truncate"), left).alias("artist"), meta_content(html, "property", "og:image").alias("cover_url"),
        meta_content(html, "name", "music:duration").try_cast("double").alias("duration_s"), N.slash_date(F.nullif(F.regexp_extract(html, r"Date Added:\s*([^<\s]+)", 1), F.lit(""))).alias("release_date"), credit_field(region, "Music", "Composer").alias("composer"), credit_field(region, "Label").alias("label"),
    )
    return rows.where(F.col("title").isNotNull() & F.col("artist").isNotNull())


def _escaped(region: Column, key: str) -> Column:
    """A text in JSON that is itself inside a JSON text."""
    raw = F.regexp_extract(region, rf'\\"{key}\\":\\"(.*?)\\"', 1)
    text = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), raw, F.lit('"'))), "$", "string")
    return T.nonempty(T.decode_entities(text, T.FEW_ENTITIES))


def _bare(region: Column, key: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(region, rf'\\"{key}\\":([^,}}"]*)', 1)), F.lit(""))


def track_pages(pages: DataFrame) -> DataFrame:
    """The track of pages (key, html) that carry their data as escaped JSON, score 97.

    A release is a compilation before it is a single, and that before an album.
    """
    html = F.col("html")
    payload = F.regexp_extract(html, r'(?s)(\\"attributes\\":\{\\"type\\":\\"MUSIC\\".*)$', 1)
    track = F.regexp_extract(payload, r'(?s)^(.*?)(?:\\"relationships\\":|$)', 1)
    album = F.regexp_extract(payload, r'(?s)(\\"album\\":\{\\"id\\".*?)(?:\\"audioAnalysis\\":|$)', 1)
    rows = pages.select("key", payload.alias("_p"), track.alias("_t"), album.alias("_a")).where((F.col("_p") != "") & (F.col("_a") != ""))
    t, a = F.col("_t"), F.col("_a")
    date, name = _escaped(a, "releaseDate"), _escaped(a, "name")
    compilation, single = (F.coalesce(_bare(a, k).try_cast("boolean"), F.lit(False)) for k in ("isCompilation", "isSingle"))
    out = rows.select(
        "key", _escaped(t, "title").alias("title"), _escaped(t, "artist").alias("artist"), name.alias("album"), F.coalesce(_escaped(a, "albumArtistName"), _escaped(a, "artistName")).alias("album_artist"), _bare(a, "trackNumber").try_cast("long").alias("track_number"), _bare(a, "trackCount").try_cast("long").alias("track_total"),
        date.alias("release_date"), F.substring(date, 1, 4).alias("year"), F.when(compilation, "compilation").when(single, "single").when(name.isNotNull(), "album").alias("release_type"), compilation.alias("is_compilation"), _escaped(t, "primary").alias("genre"), F.coalesce(_escaped(t, "isrc"), _escaped(a, "isrc")).alias("isrc"),
        F.coalesce(_escaped(t, "coverArtHq"), _escaped(t, "coverArt")).alias("cover_url"), (_bare(a, "durationInMillis").try_cast("double") / 1000).alias("duration_s"), F.lit(97.0).alias("score"),
    )
    return out.where(F.col("title").isNotNull() & F.col("artist").isNotNull())


def _objects(text: str):
    """Every balanced ``{...}`` of a text with its place, inner ones too; braces inside quoted text don't count. One pass."""
    open_at: list[int] = []
    quoted = escaped = False
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            open_at.append(i)
        elif c == "}" and open_at:
            yield open_at.pop(), i + 1


@F.pandas_udf(K.StringType())
def embedded_object(text: pd.Series, wanted: pd.Series) -> pd.Series:
    """The innermost JSON object of a text that holds ``wanted``, braces balanced outside quotes; null if none parses."""

    def one(t: str | None, w: str | None) -> str | None:
        if not t or not w or w not in t:
            return None
        for start, end in _objects(t):
            if w in t[start:end]:
                try:
                    json.loads(t[start:end])
                except ValueError:
                    continue
                return t[start:end]
        return None

    return pd.Series([one(t, w) for t, w in zip(text, wanted)], dtype=object)


def song_objects(pages: DataFrame) -> DataFrame:
    """Candidates of pages (key, html) that push their data in pieces; ``key`` is the song's slug. Pages without it are read by their JSON-LD."""
    pushed = F.regexp_extract_all(F.col("html"), F.lit(r"(?s)self\.__next_f\.push\((\[.*?\])\)</script>"), F.lit(1))
    texts = F.transform(pushed, lambda p: F.try_variant_get(F.try_parse_json(p), "$[1]", "string"))
    marker = F.concat(F.lit('"url_slug":"'), F.col("key"), F.lit('"'))
    holding = F.get(F.filter(texts, lambda t: t.contains(marker)), F.lit(0))
    rows = pages.select("key", "html", embedded_object(holding, marker).alias("o"))
    is_song = F.col("o").isNotNull() & (F.try_variant_get(F.try_parse_json("o"), "$.type", "string") == "song")
    songs = payloads.candidates(rows.where(is_song).select("key", F.concat(F.lit('{"results":['), "o", F.lit("]}")).alias("payload")), "audiomack")
    plain = rows.where(~F.coalesce(is_song, F.lit(False))).select("key", F.nullif(F.regexp_extract("html", r'(?s)<script type="application/ld\+json">(.*?)</script>', 1), F.lit("")).alias("payload"))
    return songs.unionByName(payloads.candidates(plain, "audiomack_page"))

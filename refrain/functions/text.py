"""Text functions as column expressions (ids T1-T26); all of them null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that titles may lack, separators of file names in order of preference, placeholders of taggers.
FILLERS = ("a", "an", "the", "such")
DASHES = (" - ", " – ", " — ", " − ", " ‐ ")
PLACEHOLDERS = ("unknown", "unknown artist", "unknown album", "unknown title", "untitled")
# Entities of pages, and of another kind of page, decoded in this order; words of takes by tag.
ENTITIES = (("&amp;", "&"), ("&#038;", "&"), ("&#38;", "&"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&#8211;", "–"), ("&#8217;", "’"), ("&nbsp;", " "))
FEW_ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"))
VERSION_TAGS = {"acoustic": ("acoustic", "unplugged"), "demo": ("demo",), "duet": ("duet",), "instrumental": ("instrumental",), "karaoke": ("karaoke",), "live": ("live",), "remix": ("remix", "mix"), "slowed": ("slowed",), "sped": ("sped",), "stripped": ("stripped",), "symphony": ("symphony", "symphonic")}
_SPACE = r"[\s\p{Z}]"
_OTHER = r"[^\p{L}\p{N}]+"


def _before(c: Column, mark: Column) -> Column:
    """What stands before the first ``mark``."""
    return F.call_function("substring_index", c, mark, F.lit(1))


def ws_trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def nonempty(c: Column) -> Column:
    """Trimmed, null where nothing is left."""
    return F.nullif(ws_trim(c), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer text; 1 for two empty ones."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def similarity_lower(a: Column, b: Column) -> Column:
    """T1 on lower case."""
    return similarity(F.lower(a), F.lower(b))


def similarity_ascii(a: Column, b: Column) -> Column:
    """T1 on ASCII lower case."""
    return similarity(ascii_lower(a), ascii_lower(b))


def words_text(c: Column, symbols: bool = False) -> Column:
    """T3b (T3a with ``symbols``): letters and digits in lower case, anything else one space; mathematical signs as words."""
    if symbols:
        for sign, word in (("÷", "divide"), ("×", "multiply"), ("+", "plus"), ("=", "equals"), ("&", "and")):
            c = F.replace(c, F.lit(sign), F.lit(f" {word} "))
    return F.trim(F.regexp_replace(F.lower(c), _OTHER, " "))


def compact_key(c: Column) -> Column:
    """Letters and digits only, then lower case."""
    return F.lower(F.regexp_replace(c, _OTHER, ""))


def identity_key(c: Column) -> Column:
    """Lower case, then letters and digits only."""
    return F.regexp_replace(F.lower(c), _OTHER, "")


def code_key(c: Column) -> Column:
    """T5: ASCII letters and digits in upper case."""
    return F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))


def words(c: Column) -> Column:
    """The words in lower case, empty ones left out."""
    return F.filter(F.split(F.lower(c), _OTHER), lambda w: w != "")


def telling_words(c: Column) -> Column:
    """Words without fillers, repeats kept."""
    return F.filter(words(c), lambda w: ~w.isin(*FILLERS))


def _prefix(a: Column, b: Column, least: int) -> Column:
    return (F.least(F.octet_length(a), F.octet_length(b)) >= least) & (a.startswith(b) | b.startswith(a))


def title_similarity(a: Column, b: Column) -> Column:
    """.96 for titles that are one but for fillers, a prefix or words left out; else T2b."""
    short, long = F.when(F.size(words(a)) <= F.size(words(b)), words(a)).otherwise(words(b)), F.when(F.size(words(a)) <= F.size(words(b)), words(b)).otherwise(words(a))
    held = (F.size(short) >= 3) & F.forall(short, lambda w: F.array_contains(long, w))
    same = (F.size(telling_words(a)) > 0) & (telling_words(a) == telling_words(b))
    return F.when(same | _prefix(compact_key(a), compact_key(b), 4) | held, 0.96).otherwise(similarity_ascii(a, b))


def title_similarity_strict(a: Column, b: Column) -> Column:
    """At least .94 for titles that are one but for fillers or a prefix; T1 on T3a."""
    x, y = words_text(a, True), words_text(b, True)
    same = (F.size(telling_words(a)) > 0) & (telling_words(a) == telling_words(b))
    direct = similarity(x, y)
    return F.when(same | _prefix(F.replace(x, F.lit(" ")), F.replace(y, F.lit(" ")), 4), F.greatest(direct, F.lit(0.94))).otherwise(direct)


def artist_similarity(a: Column, b: Column) -> Column:
    """T2b, at least .92 for a prefix."""
    return F.when(_prefix(compact_key(a), compact_key(b), 5), F.greatest(similarity_ascii(a, b), F.lit(0.92))).otherwise(similarity_ascii(a, b))


def artist_similarity_strict(a: Column, b: Column) -> Column:
    """T1 on T3a, at least .92 for a prefix."""
    x, y = words_text(a, True), words_text(b, True)
    return F.when(_prefix(F.replace(x, F.lit(" ")), F.replace(y, F.lit(" ")), 5), F.greatest(similarity(x, y), F.lit(0.92))).otherwise(similarity(x, y))


def strict_titles(x: Column, y: Column, told_x: Column, told_y: Column, least: float) -> Column:
    """Whether T8b reaches ``least`` (.94 at most), from the texts' T3a and T7 forms."""
    return (x == y) | ((F.size(told_x) > 0) & (told_x == told_y)) | _prefix(F.replace(x, F.lit(" ")), F.replace(y, F.lit(" ")), 4) | (similarity(x, y) >= least)


def strict_artists(x: Column, y: Column, least: float) -> Column:
    """Whether T9b reaches ``least`` (.92 at most), from the texts' T3a forms."""
    return (x == y) | _prefix(F.replace(x, F.lit(" ")), F.replace(y, F.lit(" ")), 5) | (similarity(x, y) >= least)


def text_close(a: Column, b: Column, least: float) -> Column:
    """Whether two texts reach a similarity; blank or null ones never do."""
    return F.coalesce((ws_trim(a) != "") & (ws_trim(b) != "") & (similarity_ascii(a, b) >= least), F.lit(False))


def version_tags(c: Column, symphony: bool = True) -> Column:
    """T12a (T12b without ``symphony``): the takes that a title names, sorted; null gives none."""
    w = F.coalesce(words(c), F.array().cast("array<string>"))
    tags = [F.when(F.arrays_overlap(w, F.array(*[F.lit(x) for x in names])), F.lit(tag)) for tag, names in sorted(VERSION_TAGS.items()) if symphony or tag != "symphony"]
    return F.filter(F.array(*tags), lambda t: t.isNotNull())


_ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"


def prefer_latin(c: Column) -> Column:
    """Of a bilingual name the Latin part; other names trimmed."""
    both = c.rlike("[A-Za-z]") & c.rlike(_ARABIC)
    latin = F.trim(F.regexp_replace(F.regexp_replace(c, _ARABIC, " "), rf"{_SPACE}+", " "))
    return F.when(both, F.regexp_replace(latin, r"^[\s&,;–—-]+|[\s&,;–—-]+$", "")).otherwise(ws_trim(c))


_FEATURE = (r"(?i)\(feat\. ([^)]*)\)", r"(?i)\(feat ([^)]*)\)", r"(?i)\(ft\. ([^)]*)\)", r"(?i)\(ft ([^)]*)\)", r"(?i)\(featuring ([^)]*)\)")


def _names(c: Column) -> Column:
    for marker in (" feat. ", " ft. ", " featuring "):
        c = F.replace(c, F.lit(marker), F.lit(";"))
    return F.filter(F.transform(F.split(c, "[;&,؛،]"), ws_trim), lambda n: n != "")


def featured(artist: Column, title: Column) -> Column:
    """struct(artist, title) with the guests of the title's first feature clause as ``(feat. X)`` and out of the artist.

    The first marker in list order counts, wherever it stands; what follows the clause stays
    unless it only repeats the guests. A title without a clause comes out trimmed, as its artist does.
    """
    pattern = F.coalesce(*[F.when(title.rlike(p), F.lit(p)) for p in _FEATURE])
    guests = F.coalesce(*[F.when(title.rlike(p), F.regexp_extract(title, p, 1)) for p in _FEATURE])
    clause = F.coalesce(*[F.when(title.rlike(p), F.regexp_extract(title, p, 0)) for p in _FEATURE])
    head = F.regexp_replace(_before(title, clause), rf"{_SPACE}+$", "")
    rest = ws_trim(F.substring(title, F.char_length(_before(title, clause)) + F.char_length(clause) + 1, F.lit(1 << 30)))
    names = _names(guests)
    keys = F.transform(names, compact_key)
    told = F.transform(_names(F.regexp_replace(rest, r"(?i)^(?:feat\.? |ft\.? |featuring )", "")), compact_key)
    repeated = rest.rlike(r"(?i)^(?:feat\.? |ft\.? |featuring )") & (F.size(told) == F.size(keys)) & F.forall(keys, lambda k: F.array_contains(told, k))
    new_title = F.concat(head, F.lit(" (feat. "), ws_trim(guests), F.lit(")"), F.when(repeated | (rest == ""), F.lit("")).otherwise(F.concat(F.lit(" "), rest)))
    parts = _names(artist)
    kept = F.filter(parts, lambda p: ~F.array_contains(keys, compact_key(p)))
    new_artist = F.when((F.size(kept) == F.size(parts)) | (F.size(kept) == 0), ws_trim(artist)).otherwise(F.array_join(kept, " & "))
    return F.struct(F.when(pattern.isNull(), ws_trim(artist)).otherwise(new_artist).alias("artist"), F.when(pattern.isNull(), ws_trim(title)).otherwise(new_title).alias("title"))


def is_placeholder(c: Column) -> Column:
    """Whether a tag is null, blank or a placeholder of taggers."""
    t = F.coalesce(ascii_lower(ws_trim(c)), F.lit(""))
    return (t == "") | t.isin(*PLACEHOLDERS) | t.rlike("^track [0-9]+$")


def stem(filename: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(filename, r"(?<=.)\.[^./]*$", "")


def filename_parts(name: Column) -> Column:
    """struct(artist, title) of a file's stem, cut once at the first separator in list order; null if either side is blank."""
    found = F.coalesce(*[F.when(F.instr(name, d) > 0, F.lit(d)) for d in DASHES])
    left = ws_trim(_before(name, found))
    right = ws_trim(F.substring(name, F.char_length(_before(name, found)) + F.char_length(found) + 1, F.lit(1 << 30)))
    return F.when((left != "") & (right != ""), F.struct(left.alias("artist"), right.alias("title")))


def decode_entities(c: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    """T17 (T18 with ``FEW_ENTITIES``): entities decoded one after the other, ``&amp;`` first, so what it yields may decode again."""
    for entity, char in entities:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    """Without mark-up."""
    return F.regexp_replace(c, "<[^>]*>", "")


def first_upper(c: Column) -> Column:
    """The first character in upper case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.char_length(c)))


def safe_name(c: Column, fallback: str) -> Column:
    """A part of a path: forbidden characters as spaces, white space collapsed, no dots or spaces at the ends."""
    clean = F.regexp_replace(F.regexp_replace(c, r"[\\/:*?\"<>|\x00-\x1f]", " "), r"\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit(fallback))


def within_bytes(c: Column, most: int) -> Column:
    """As many whole characters as fit into ``most`` bytes of UTF-8, without spaces at the end if anything was cut."""
    raw = F.encode(c, "utf-8")
    # a character's first byte is no continuation (10......); the cut goes back to one
    back = F.coalesce(*[F.when((F.conv(F.hex(F.substring(raw, most + 1 - k, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0))) != 0x80, F.lit(k)) for k in range(4)])
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(F.decode(F.substring(raw, F.lit(1), F.lit(most) - back), "utf-8"), rf"{_SPACE}+$", ""))


def output_name(artist: Column, title: Column, extension: Column) -> Column:
    """The file name of a record, its base of at most 220 bytes, with its extension in lower case if there is one."""
    base = within_bytes(F.concat(safe_name(artist, "Unknown Artist"), F.lit(" - "), safe_name(title, "Unknown Title")), 220)
    return F.concat(base, F.when(F.coalesce(extension, F.lit("")) != "", F.concat(F.lit("."), ascii_lower(extension))).otherwise(F.lit("")))


def fingerprint_key(c: Column) -> Column:
    """A fingerprint's cache key, by its hash."""
    return F.concat(F.lit("fingerprint:"), F.sha2(ws_trim(c), 256))


def recording_key(c: Column) -> Column:
    return F.concat(F.lit("recording:"), ascii_lower(ws_trim(c)))


def release_key(c: Column) -> Column:
    return F.concat(F.lit("release:"), ascii_lower(ws_trim(c)))


def search_key(c: Column) -> Column:
    """A search's cache key, in ASCII lower case with single spaces."""
    return F.concat(F.lit("search:"), ascii_lower(F.trim(F.regexp_replace(c, rf"{_SPACE}+", " "))))


def _cut_last(c: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the last ``mark``, trimmed; null if there is none or a side is blank."""
    after = F.call_function("substring_index", c, F.lit(mark), F.lit(-1))
    before = F.substring(c, F.lit(1), F.char_length(c) - F.char_length(after) - len(mark))
    ok = (F.instr(c, mark) > 0) & (ws_trim(before) != "") & (ws_trim(after) != "")
    return F.when(ok, ws_trim(before)), F.when(ok, ws_trim(after))


def clean_tags(frame: DataFrame, artist: str, title: str, album: str) -> DataFrame:
    """``frame`` with its three tags cleaned of what scrapers leave; each rule sees what the one before made.

    An album ``... | Artist - Title`` gives both and goes; a title ``Title | Artist`` fills an artist that is blank or a handle; a
    title with three spaces fills an artist that is empty; list signs at the artist's ends go.
    """
    english = ws_trim(F.substring(F.col(album), F.instr(F.col(album), "|") + 1, F.lit(1 << 30)))
    left, right = ws_trim(_before(english, F.lit(" - "))), ws_trim(F.substring(english, F.instr(english, " - ") + 3, F.lit(1 << 30)))
    both = F.coalesce((F.instr(F.col(album), "|") > 0) & (F.instr(english, " - ") > 0) & (left != "") & (right != ""), F.lit(False))
    kept = [c for c in frame.columns if c not in (artist, title, album)]
    one = frame.select(*kept, F.when(both, left).otherwise(F.col(artist)).alias(artist), F.when(both, right).otherwise(F.col(title)).alias(title), F.when(~both, F.col(album)).alias(album))
    t, a = _cut_last(F.col(title), "|")
    odd = (F.coalesce(ws_trim(F.col(artist)), F.lit("")) == "") | F.coalesce(ws_trim(F.col(artist)).startswith("@"), F.lit(False))
    use = odd & t.isNotNull()
    two = one.select(*kept, F.when(use, a).otherwise(F.col(artist)).alias(artist), F.when(use, t).otherwise(F.col(title)).alias(title), album)
    t, a = _cut_last(F.col(title), "   ")
    use = (F.coalesce(F.col(artist), F.lit("")) == "") & t.isNotNull()
    three = two.select(*kept, F.when(use, a).otherwise(F.col(artist)).alias(artist), F.when(use, t).otherwise(F.col(title)).alias(title), album)
    return three.withColumn(artist, ws_trim(F.regexp_replace(ws_trim(F.col(artist)), "^[,،;؛]+|[,،;؛]+$", ""))).select(*frame.columns)


# Separators of credit and title in order of preference, ends that videos have, and extensions of audio files.
CREDIT_MARKS = (" - ", " – ", " — ", " | ")
VIDEO_ENDS = (" (official video)", " [official video]", " (official audio)", " [official audio]", " (lyrics)", " [lyrics]", " (lyric video)", " | official music video", " | official video", " | official audio")
AUDIO_ENDS = (".mp3", ".m4a", ".flac", ".wav", ".ogg", ".opus")
SUPPORTED = ("mp3", "flac", "m4a", "ogg", "opus", "wav", "aiff", "aif")
# Names of containers that a prober reports, and of file types that a tag reader reports, by format.
MP4_NAMES = ("mov", "mp4", "m4a", "3gp", "3g2", "mj2")
FILE_TYPES = {"Aac": "aac", "Aiff": "aiff", "Ape": "ape", "Flac": "flac", "Mpeg": "mp3", "Mp4": "m4a", "Mpc": "mpc", "Opus": "opus", "Vorbis": "ogg", "Speex": "spx", "Wav": "wav", "WavPack": "wv"}
# Artwork sizes and their larger kind.
SOUNDCLOUD_SIZES = ("-large.", "-t300x300.", "-t200x200.", "-t120x120.", "-t67x67.", "-small.", "-tiny.")
SPOTIFY_SIZES = ("ab67616d00001e02", "ab67616d00004851")


def split_credit(c: Column) -> Column:
    """struct(artist, title) at the first separator in list order that leaves something on both sides; null if none does."""
    found = []
    for mark in CREDIT_MARKS:
        left, right = ws_trim(_before(c, F.lit(mark))), ws_trim(F.substring(c, F.instr(c, mark) + len(mark), F.lit(1 << 30)))
        found.append(F.when((F.instr(c, mark) > 0) & (left != "") & (right != ""), F.struct(left.alias("artist"), right.alias("title"))))
    return F.coalesce(*found)


def credited(explicit: Column, title: Column) -> Column:
    """Struct(artist, title): the title's own credit where no artist is given, or the same one; else the title as it is by the artist given."""
    own = split_credit(title)
    use = own.isNotNull() & (explicit.isNull() | (compact_key(own["artist"]) == compact_key(explicit)))
    return F.struct(F.coalesce(explicit, F.when(use, own["artist"])).alias("artist"), F.when(use, own["title"]).otherwise(title).alias("title"))


def _without_end(c: Column, ends: tuple[str, ...]) -> Column:
    """Without the first of ``ends``, in any case, that ``c`` ends with."""
    cut = F.coalesce(*[F.when(F.endswith(ascii_lower(c), F.lit(e)), F.substring(c, F.lit(1), F.char_length(c) - len(e))) for e in ends])
    return F.coalesce(cut, c)


def clean_video_title(c: Column) -> Column:
    """A video's title without the first end that videos have."""
    return ws_trim(_without_end(ws_trim(c), VIDEO_ENDS))


def strip_audio_extension(c: Column) -> Column:
    """Without the extension of an audio file."""
    return _without_end(c, AUDIO_ENDS)


def larger_spotify(c: Column) -> Column:
    """An artwork's address at full size."""
    for size in SPOTIFY_SIZES:
        c = F.replace(c, F.lit(size), F.lit("ab67616d0000b273"))
    return c


def larger_soundcloud(c: Column) -> Column:
    for size in SOUNDCLOUD_SIZES:
        c = F.replace(c, F.lit(size), F.lit("-t500x500."))
    return c


def larger_itunes(c: Column) -> Column:
    return F.replace(c, F.lit("100x100bb"), F.lit("1200x1200bb"))


def wide_image(c: Column) -> Column:
    """An image's address without its query, at a fixed width."""
    return F.concat(_before(c, F.lit("?")), F.lit("?width=1600&format=jpg"))


def without_site(c: Column) -> Column:
    """An album's name without ``| site.com`` and the like."""
    end = ascii_lower(F.substring(c, F.instr(c, "|") + 1, F.lit(1 << 30)))
    return F.when((F.instr(c, "|") > 0) & end.rlike(r"\.(?:com|net|org|ir)"), ws_trim(_before(c, F.lit("|")))).otherwise(ws_trim(c))


def description_field(c: Column, *keys: str) -> Column:
    """The value of the first line ``key: value`` with one of ``keys``, in any case, that has one."""
    lines = F.split(c, r"\r?\n")
    pairs = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 0), lambda x: F.struct(ascii_lower(ws_trim(_before(x, F.lit(":")))).alias("k"), ws_trim(F.substring(x, F.instr(x, ":") + 1, F.lit(1 << 30))).alias("v")))
    return F.get(F.filter(pairs, lambda p: p["k"].isin(*[k.lower() for k in keys]) & (p["v"] != "")), F.lit(0))["v"]


def extension_of(path: Column) -> Column:
    """The extension of a path's file name in ASCII lower case; '' if there is none."""
    return ascii_lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def is_supported(path: Column) -> Column:
    """S3: whether a path's extension is one of an audio file."""
    return extension_of(path).isin(*SUPPORTED)


def probe_format(format_name: Column, codec: Column, path: Column) -> Column:
    """The format of what a prober reports, else the path's extension."""
    name = F.coalesce(format_name, F.lit(""))
    return (
        F.when(F.arrays_overlap(F.split(name, ","), F.array(*[F.lit(n) for n in MP4_NAMES])), "m4a").when(name.contains("mp3"), "mp3").when(name.contains("flac"), "flac")
        .when(name.contains("ogg"), F.when(F.coalesce(codec, F.lit("")) == "opus", "opus").otherwise("ogg")).otherwise(extension_of(path))
    )


def reader_format(file_type: Column, path: Column) -> Column:
    """The format of a tag reader's file type, else the path's extension as written."""
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, file_type), F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def search_tags(frame: DataFrame, stem_of: str, artist: str, title: str, album: str, album_artist: str) -> DataFrame:
    """``frame`` with placeholders filled from the file's stem (underscores are spaces); placeholders of albums become null.

    A stem ``Artist - Title`` gives both tags if either is a placeholder; any other stem gives the title only.
    """
    name = F.replace(F.col(stem_of), F.lit("_"), F.lit(" "))
    both, poor = filename_parts(name), is_placeholder(F.col(artist)) | is_placeholder(F.col(title))
    use, lone = both.isNotNull() & poor, both.isNull() & is_placeholder(F.col(title))
    new = {artist: F.when(use, both["artist"]).otherwise(F.col(artist)), title: F.when(use, both["title"]).when(lone, ws_trim(name)).otherwise(F.col(title)), **{c: F.when(~is_placeholder(F.col(c)), F.col(c)) for c in (album, album_artist)}}
    return frame.select(*[new[c].alias(c) if c in new else F.col(c) for c in frame.columns])


def similar_keys(a: Column, b: Column, least: float) -> Column:
    """Whether two texts are alike by their compact keys: one begins the other, or T1 reaches ``least``; blank texts never are.

    A text of signs alone has an empty key, which begins every other.
    """
    x, y = compact_key(a), compact_key(b)
    return F.coalesce((ws_trim(a) != "") & (ws_trim(b) != "") & (x.startswith(y) | y.startswith(x) | (similarity(x, y) >= least)), F.lit(False))


def release_defaults(album: Column, album_artist: Column, artist: Column) -> Column:
    """struct(album, album_artist): ``Single`` for an album that is blank or has that word, the artist for a blank album artist."""
    single = (F.coalesce(ws_trim(album), F.lit("")) == "") | F.exists(F.split(album, _OTHER), lambda w: ascii_lower(w) == "single")
    return F.struct(F.when(single, F.lit("Single")).otherwise(album).alias("album"), F.when(F.coalesce(ws_trim(album_artist), F.lit("")) == "", artist).otherwise(album_artist).alias("album_artist"))


def image_type(data: Column) -> Column:
    """The media type of an image by its first bytes."""
    begins = lambda text: F.startswith(data, F.lit(text))
    return F.when(begins(b"\x89PNG\r\n\x1a\n"), "image/png").when(begins(b"GIF8"), "image/gif").when(begins(b"RIFF") & (F.substring(data, 9, 4) == F.lit(b"WEBP")), "image/webp").otherwise("image/jpeg")


def overlaps(a: Column, b: Column) -> Column:
    """Whether one of two paths is the other or holds it, part by part."""
    x, y = F.concat(F.rtrim(F.lit("/"), a), F.lit("/")), F.concat(F.rtrim(F.lit("/"), b), F.lit("/"))
    return x.startswith(y) | y.startswith(x)


def holds_text(query: Column, *columns: Column) -> Column:
    """Whether one of ``columns`` holds ``query``, in any case; a blank query is held by all."""
    q = F.lower(ws_trim(query))
    return (q == "") | F.exists(F.array(*columns), lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False)))


def refusal(error: Column) -> Column:
    """Why a source is left out after an error: ``authentication``, ``rate`` or ``timeout``; null for other errors."""
    e = ascii_lower(error)
    return F.when(e.contains("401 unauthorized"), "authentication").when(e.contains("429 too many requests"), "rate").when(e.contains("504 gateway timeout") | e.contains("timed out"), "timeout")

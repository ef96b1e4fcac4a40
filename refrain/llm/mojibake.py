"""Text decoded with the wrong character encoding: finding and restoring it (problem 2).

A best-first graph search: a state is a text, an edge one encode-decode or unescape operation,
and a cost of character plausibility says which state is opened next. States once seen are kept
by hash. The cheapest state reached is the restored text; a text is damaged if that state is
cheaper than the stored one by a margin, or if it holds marks of loss (U+FFFD, C1 controls).

The cost knows words: frequent words of the catalogue's own titles are learned from all candidate
rows. A word enters the lexicon if it makes up at least ``LEXICON_SHARE`` of all words, so the lexicon
never has more than ``1 / LEXICON_SHARE`` entries, whatever the data's size.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.io import load
from refrain.skew import spread_join, spread_out

FIELDS = ("current_title", "current_artist", "current_album")
#: Codecs by which text is wrongly read, and those in which it was written.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp1251", "latin_1")
WRITTEN_AS = ("cp1252", "cp1250", "cp1251", "cp1254", "cp1256", "shift_jis")
#: Share of all words from which a word counts as known.
LEXICON_SHARE = 5e-5
#: Cost of an operation, cost of a word that is not known, the gain from which a text counts as damaged.
STEP, UNKNOWN, MARGIN = 1.5, 4.0, 1.4

# Letters of other alphabets that look like Latin ones (they are not damage in a Latin word).
LOOKALIKE = set("аеорсхуіѕјһԁԛԝАВЕЗКМНОРСТХІЅЈУ" "οανρυικχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "K")
_LATIN_LIKE = set("aceopxyisjhABEKMHOPCTXYISJ")
_RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ")
_QUIET = set("’‘“”–—…½∞«»№ʼ′×¿¡•​‌‍‎‏⁠﻿­    ")
_WORD = re.compile(r"(?:(?![½¼¾²³¹ªº])[^\W\d_])+(?:[’'][^\W\d_]+)*")
_ESCAPED = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,10});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[0-9A-Fa-f]{2}){2,}")


@lru_cache(maxsize=4096)
def _kind(c: str) -> str:
    """Script of a letter; other characters by what they are."""
    o = ord(c)
    if o < 0x80:
        return "LATIN" if c.isalpha() else "plain"
    if 0x80 <= o < 0xA0:
        return "control"
    if c == "�" or 0xE000 <= o < 0xF900:
        return "lost"
    category = unicodedata.category(c)
    if category in ("Mn", "Mc", "Cf"):
        return "mark" if category != "Cf" else "format"
    if category == "Zs":
        return "space"
    if category[0] == "L":
        name = unicodedata.name(c, "?").split(" ", 1)[0]
        if c in "ªºˆ":
            return "symbol"
        return "HAN" if name in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "FULLWIDTH", "HALFWIDTH") else name
    return "symbol"


def _bytes_of(codec: str) -> dict[str, int]:
    """Characters that a codec has for the bytes from 0x80; unused bytes stand for C1 controls."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0x100):  # programs pass unused bytes on as controls
        if b not in table.values():
            table.setdefault(chr(b), b)
    return table


_TABLES = {c: _bytes_of(c) for c in READ_AS}
_TABLES["cp1252"] |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in _TABLES["cp1252"]}


@lru_cache(maxsize=200_000)
def word_cost(word: str, lexicon: frozenset[str]) -> float:
    """How little a run of letters looks like a word; 0 for plain ASCII."""
    if word.lower() in lexicon:
        return 0.5
    kinds = [_kind(c) for c in word]
    scripts = {k for k in kinds if k not in ("plain", "mark", "symbol", "format", "space")}
    cost = UNKNOWN
    if len(scripts) > 1:
        foreign = [c for c, k in zip(word, kinds) if k in ("CYRILLIC", "GREEK")]
        if scripts <= {"LATIN", "CYRILLIC", "GREEK", "KELVIN"} and all(c in LOOKALIKE for c in foreign):
            cost += 0.0
        elif scripts == {"LATIN", "CYRILLIC"} and all(c in _LATIN_LIKE for c, k in zip(word, kinds) if k == "LATIN") and all(c in _RUSSIAN for c in foreign):
            cost += 0.0
        elif "LATIN" in scripts and (scripts & {"HAN", "ARABIC", "CYRILLIC"}) and sum(k == "LATIN" and c.isascii() for c, k in zip(word, kinds)) == 1 and all(c.isascii() for c, k in zip(word, kinds) if k == "LATIN"):
            cost += 0.0  # one mistyped letter
        else:
            cost += 5.0 * (len(scripts) - 1)
    accented = sum(1 for c, k in zip(word, kinds) if k == "LATIN" and not c.isascii())
    cost += 2.5 * max(0, accented - 2)
    if accented == len(word) and accented > 1:
        cost += 3.0
    for a, b in zip(word, word[1:]):
        if a.islower() and b.isupper():
            cost += 4.0
    cost += 3.0 * sum(1 for c, k in zip(word, kinds) if k == "CYRILLIC" and c not in _RUSSIAN and c not in LOOKALIKE)
    cost += 3.0 * sum(1 for k in kinds if k == "GREEK") * (scripts != {"GREEK"} and any(k == "GREEK" and c not in LOOKALIKE for c, k in zip(word, kinds)))
    return cost


def cost_of(text: str, lexicon: frozenset[str]) -> float:
    """Cost of character plausibility: words, and symbols where no symbol belongs."""
    if text.isascii():
        return 5.0 * len(_ESCAPED.findall(text))
    cost = sum(word_cost(w, lexicon) for w in _WORD.findall(text) if not w.isascii())
    for i, c in enumerate(text):
        if c < "\x80":
            continue
        k = _kind(c)
        if k == "control":
            cost += 8.0
        elif k == "lost":
            cost += 9.0
        elif k == "space":
            cost += 0.25
        elif k == "format":
            cost += 0.5 if c == "\u200c" and i and _kind(text[i - 1]) == "ARABIC" else 3.0
        elif k == "mark":
            before = text[i - 1 : i]
            fits = before and (len(unicodedata.normalize("NFC", before + c)) == 1 or _kind(before) in ("ARABIC", "mark") and "\u0600" <= c < "\u0700")
            cost += 0.5 if fits and c < "\u0600" else 2.0 if fits else 8.0
        elif "\uff61" <= c < "\uffa0":
            cost += 4.0
        elif k == "symbol":
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if c in "’´ʼ" and before.isalpha() and after.isalpha():
                continue
            if c == "’" and before.isalpha() and not after.strip():
                cost += 2.0
                continue
            if c in "“«¿¡‘„‹" and not before.strip() and after.isalnum() or c in "”»…’“›" and before.strip() and not after.strip(" .,;:!?)]"):
                cost += 0.75
                continue
            if c == "½" and not before.isalpha() and not after.isalpha():
                continue
            touching = before.isalnum() + after.isalnum() + (before > "\x80" and _kind(before) == "symbol") + (after > "\x80" and _kind(after) == "symbol")
            cost += 0.25 if c in _QUIET and not touching else 3.0 + 2.0 * touching
    if "&" in text or "\\" in text or "%" in text:
        cost += 5.0 * len(_ESCAPED.findall(text))
    return cost


def _utf8_runs(text: str, codec: str) -> str | None:
    """Every run of characters that are bytes of ``codec`` and together valid UTF-8, decoded; the rest stays."""
    table, out, i, changed = _TABLES[codec], [], 0, False
    n = len(text)
    while i < n:
        lead = table.get(text[i])
        size = 0 if lead is None else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if size:
            rest = [table.get(c) for c in text[i + 1 : i + size]]
            if len(rest) == size - 1 and all(b is not None and 0x80 <= b < 0xC0 for b in rest):
                try:
                    out.append(bytes([lead, *rest]).decode("utf-8"))
                    i, changed = i + size, True
                    continue
                except UnicodeDecodeError:
                    pass
        out.append(text[i])
        i += 1
    return "".join(out) if changed else None


def _spoils(new: str, old: str) -> bool:
    """Whether ``new`` has spaces, controls or formats that ``old`` hasn't (a joiner after a Persian letter may come)."""
    for i, c in enumerate(new):
        if c > "\x7f" and (k := _kind(c)) in ("space", "control", "format") and c not in old and not (c == "\u200c" and i and _kind(new[i - 1]) == "ARABIC"):
            return True
    return False


def _words_as(text: str, read_as: str, written_as: str) -> str | None:
    """Every run without spaces that ``read_as`` can have produced, decoded by ``written_as``; the rest stays."""
    table = _TABLES[read_as]
    pieces = re.split(r"(\s+)", text) if "\xa0" not in text and " " not in text else re.split(r"([ \t]+)", text)
    changed = False
    for j, piece in enumerate(pieces):
        if piece.isascii():
            continue
        raw = bytearray()
        for c in piece:
            b = ord(c) if c < "\x80" else table.get(c)
            if b is None:
                break
            raw.append(b)
        else:
            try:
                new = raw.decode(written_as)
            except UnicodeDecodeError:
                continue
            if new != piece and not _spoils(new, piece):
                pieces[j], changed = new, True
    return "".join(pieces) if changed else None


def _unescape(text: str) -> str | None:
    def one(m: re.Match) -> str:
        t = m.group(0)
        if t[0] == "&":
            return html.unescape(t)
        if t[0] == "%":
            try:
                return bytes.fromhex(t.replace("%", "")).decode("utf-8")
            except UnicodeDecodeError:
                return t
        return chr(int(t[2:], 16))

    new = _ESCAPED.sub(one, text)
    return new if new != text else None


def neighbours(text: str) -> Iterator[tuple[str, str]]:
    """(operation, text) for every operation that changes ``text``."""
    if (new := _unescape(text)) is not None:
        yield "unescape", new
    if text.isascii():
        return
    for read in READ_AS:
        if (new := _utf8_runs(text, read)) is not None:
            yield f"{read}>utf-8", new
    for read in READ_AS:
        for written in WRITTEN_AS:
            if read != written and (new := _words_as(text, read, written)) is not None:
                yield f"{read}>{written}", new


def search(text: str, lexicon: frozenset[str]) -> tuple[str, list[str], float]:
    """(cheapest text, operations to it, gain in cost) by best-first search from ``text``.

    An edge leads to a text only if that is cheaper than the one before, as each layer of damage that is taken off makes
    a text more plausible. So paths end by themselves, and the search ends when no state
    that is left can lead to a cheaper one; neither states nor steps are capped.
    """
    first = cost_of(text, lexicon)
    if first <= 0.5:
        return text, [], 0.0
    best = (first, text, [])
    heap, seen = [(first, 0, text, [])], {hash(text)}
    while heap:
        cost, depth, state, path = heapq.heappop(heap)
        raw = cost - STEP * depth
        if raw <= 0.5 or STEP * (depth + 1) >= best[0]:  # no cost is below 0
            continue
        for name, new in neighbours(state):
            if (h := hash(new)) in seen:
                continue
            seen.add(h)
            now = cost_of(new, lexicon)
            c = now + STEP * (depth + 1)
            if c < best[0]:
                best = (c, new, [*path, name])
            if now < raw:
                heapq.heappush(heap, (c, depth + 1, new, [*path, name]))
    return best[1], best[2], first - best[0]


def lost(text: str) -> bool:
    """Marks of loss that no operation undoes."""
    return any(c == "�" or "\x80" <= c < "\xa0" for c in text)


def learn_lexicon(texts: DataFrame, share: float = LEXICON_SHARE) -> frozenset[str]:
    """Non-ASCII words of column ``text`` that make up at least ``share`` of all words: at most 1 / share of them.

    Counted over all rows and summed before the shuffle. An empty table gives an empty lexicon.
    """
    words = texts.where(F.col("text").isNotNull()).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+(?:[’']\p{L}+)*)"), F.lit(1))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where((F.col("n") >= F.lit(max(2, share * total))) & F.col("word").rlike(r"[^\x00-\x7f]"))
    return frozenset(r[0] for r in frequent.select("word").collect())


def restore(values: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """(value, restored, operations, gain, damaged) for each distinct ``value`` that may be damaged.

    Null values and values of ASCII without escapes are left out (nothing can be wrong with
    them); a value that can't be restored keeps its text in ``restored`` and is damaged all the same.
    """
    maybe = F.col("value").rlike(r"[^\x00-\x7f]|&#?\w+;|\\[ux][0-9a-fA-F]{2}|%[0-9A-Fa-f]{2}%")
    shared = values.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = []
            for v in b["value"]:
                new, path, gain = search(v, known)
                rows.append((v, new, ",".join(path), round(gain, 2), bool(path) and gain >= MARGIN or lost(v)))
            yield pd.DataFrame(rows, columns=["value", "restored", "operations", "gain", "damaged"])

    distinct = values.select("value").where(F.col("value").isNotNull() & maybe).distinct()
    return spread_out(distinct, "value").mapInPandas(run, "value string, restored string, operations string, gain double, damaged boolean")


def fields_of(tracks: DataFrame) -> DataFrame:
    """(track_id, field, value), one row a non-null field of a track; repeated rows once."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FIELDS])).alias("f")
    return tracks.select("track_id", stacked).select("track_id", "f.field", "f.value").where(F.col("value").isNotNull())


def damaged_values(spark: SparkSession, folder: str, values: DataFrame | None = None) -> DataFrame:
    """restore() of all fields of ``tracks`` (or of ``values``) with the lexicon of the candidates' titles."""
    lexicon = learn_lexicon(load(spark, folder, "candidates").select(F.col("title").alias("text")))
    return restore(fields_of(load(spark, folder, "tracks")) if values is None else values, lexicon)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p2_found: every field of a track that is wholly or partly damaged."""
    rows = fields_of(load(spark, folder, "tracks"))
    damaged = damaged_values(spark, folder).where("damaged").select("value")
    return spread_join(rows, damaged, ["value"], ["track_id", "field"]).select("track_id", "field").distinct()


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """p2_restored: the damaged fields with the text restored and the operations that restored it."""
    rows = fields_of(load(spark, folder, "tracks"))
    damaged = damaged_values(spark, folder).where("damaged")
    return spread_join(rows, damaged, ["value"], ["track_id", "field"]).select("track_id", "field", "value", "restored", "operations").distinct()

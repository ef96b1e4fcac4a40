"""Matching records of two sources without a common number (problem 3).

A cascade of rules from strong to weak, each an exact join on a weaker combination of attributes: code and
title, title and artist, title and a part of the artist, title without one word and artist, code and
artist. Records that found a partner are resolved, on either side, and are anti-joined out before the next pass: it joins
open candidates to all sheets, and resolved candidates to open sheets only, as a recording can be delivered under
several numbers. Every pair that meets is verified on title, take, artist and length. Sheets that describe
one recording are linked among themselves too, and a candidate that found one of them has found all.

Confidence is each rule's precision on labelled pairs, with add-one smoothing. For it every rule is run by itself, without anti-joins, on
at most about ``LABELLED`` candidates whose code some sheet has, chosen by hash. The labels are what a rule does not
use: agreeing codes for rules without the code, agreeing lengths for the others.

Before the shuffle a Bloom filter of the sheets' keys drops keys that no sheet has. A second one, of the titles and codes
that those keys are made of, is asked first: a candidate none of whose titles and codes any sheet has needs no keys. Their size is
fixed (``BLOOM_BITS``), so what is broadcast does not grow; a full filter only drops less.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.io import cut, load
from refrain.llm.lookalikes import comparable
from refrain.llm.name_variants import _CONNECT, _EXPANDED, _FORMAL, fold, one_apart, read
from refrain.skew import hot_keys, spread_join

#: Bits of each filter of the sheets' keys (2 MB), share of all title words from which a word is frequent, seconds by which lengths may differ.
BLOOM_BITS, FREQUENT_SHARE, SECONDS = 1 << 24, 1e-4, 8.0
#: Labelled candidates on which the precision of the rules is measured, about.
LABELLED = 20_000
#: Edits (a swap is two) beyond which two titles are never one.
MOST_EDITS = 6
RULES = {1: "code and title", 2: "title and artist", 3: "title and part of the artist", 4: "title but for a word and artist", 5: "code and artist"}
# Takes that are recordings of their own, remarks that are none, and words that many artists' names have.
TAKES = {"live": 1, "akustik": 2, "demo": 4, "remiks": 8}
REMARKS = {"hk", "offikial", "audio", "album", "single", "version", "lp", "ep", "remastered", "remaster", "bonus", "trakk", "mono", "stereo", "edit", "eksplikit", "delukse", "edition", "video", "lyrik", "hd"}
COMMON = {"brass", "band", "sound", "system", "orkhestra", "ensemble", "kuartet", "kollektive", "khoir", "trio", "brothers"}
_GIVEN = set(_FORMAL.values())
_FEAT = re.compile(r"[(\[]\s*(?:feat\.?|ft\.?|featuring|with)\s[^)\]]*[)\]]|\s(?:feat\.?|ft\.?|featuring)\s.*$", re.I)
_SIDE = re.compile(r"\s*(?:[–/-]\s*[A-D]\d|\*+)\s*$")
_BRACKET = re.compile(r"[(\[]([^)\]]*)[)\]]")
_TAIL = re.compile(r"\s-\s([^-]+)$")
_NAME = re.compile(r"[^\W\d_]+\.?|\d+")
_WORDS = re.compile(r"[^\W_]+")
#: Text that ``comparable`` leaves as it is: Latin letters, dashes and quotes, without signs that show nothing and odd spaces.
_AS_IT_IS = re.compile("[\x00-\x9f\xa1-\xac\xae-\u024f\u2010-\u201f]*")
_NO_SIGN = re.compile(r"[^A-Z0-9]")


def code_of(code: str | None) -> str:
    """A recording code without signs and prefix, or '' if it isn't one."""
    if not code:
        return ""
    c = _NO_SIGN.sub("", code.upper())
    c = c[4:] if c.startswith("ISRC") and len(c) == 16 else c
    return c if len(c) == 12 else ""


def seconds_of(length: str | None) -> float | None:
    """A hand-typed length in seconds: ``m:ss``, ``h:mm:ss``, ``m'ss"``, ISO, seconds or milliseconds; None if unreadable."""
    t = (length or "").strip()
    if m := re.fullmatch(r"(?:(\d+):)?(\d+):(\d{2})", t):
        return int(m.group(1) or 0) * 3600.0 + int(m.group(2)) * 60 + int(m.group(3))
    if m := re.fullmatch(r"(\d+)\s*['’′]\s*(\d{1,2})\s*(?:[\"”″]|'')?", t):
        return int(m.group(1)) * 60.0 + int(m.group(2))
    if m := re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?", t):
        return int(m.group(1) or 0) * 3600.0 + int(m.group(2) or 0) * 60 + float(m.group(3) or 0)
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*(ms|s|sec)?", t):
        x = float(m.group(1))
        return x / 1000 if m.group(2) == "ms" or x >= 10_000 else x
    return None


@lru_cache(maxsize=20_000)
def _take(remark: str) -> int | None:
    """The take that a remark names, 0 for a remark without one, None if it's no remark."""
    words = [fold(w) for w in _WORDS.findall(remark)]
    takes = [v for w in words for k, v in TAKES.items() if w == k or len(w) > 3 and one_apart(w, k)]
    rest = [w for w in words if not any(w == k or len(w) > 3 and one_apart(w, k) for k in [*TAKES, *REMARKS])]
    if not words or rest and not (takes and len(rest) < len(words) and all(w.isdigit() for w in rest)):
        return None
    return sum(set(takes))


@lru_cache(maxsize=20_000)
def title_of(title: str) -> tuple[tuple[str, ...], int]:
    """(words of the title proper, takes) of a title: without guests, sides, remarks and articles."""
    t = unicodedata.normalize("NFKC", title.replace("½", " half "))
    t = t if _AS_IT_IS.fullmatch(t) else comparable(t)
    t = _FEAT.sub(" ", t)
    t = _SIDE.sub("", t)
    takes = 0
    for m in _BRACKET.findall(t):
        if (k := _take(m)) is not None:
            takes |= k
            t = re.sub(r"[(\[]" + re.escape(m) + r"[)\]]", " ", t)
    if (m := _TAIL.search(t)) and (k := _take(m.group(1))) is not None:
        takes |= k
        t = t[: m.start()]
    words = [fold(w) for w in _WORDS.findall(t.replace("’", "").replace("'", ""))]
    return tuple(w for w in words if w and w != "the"), takes


@lru_cache(maxsize=20_000)
def artist_of(artist: str) -> tuple[str, ...]:
    """The words of an artist credit: folded, short forms as formal words."""
    out: list[str] = []
    for t in _NAME.findall(unicodedata.normalize("NFKC", artist)):
        low = t.rstrip(".").lower()
        if low == "the" or low in _CONNECT and len(low) > 1:
            continue
        f = fold(low)
        out.extend(_EXPANDED[f] if f in _EXPANDED and out else [_FORMAL.get(f, f)])
    return tuple(out)


def _hashes(parts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(p) for p in parts], dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each pair of the hashes ``a`` and ``b``."""
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _flat(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all rows, how many each row has) of the hashes of each row."""
    return np.concatenate(each), np.fromiter(map(len, each), dtype=np.int64, count=len(each))


def _left(each: tuple[np.ndarray, np.ndarray], passes: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``each`` (hashes, how many each row has) without the hashes that don't pass."""
    kept = passes(each[0])
    return each[0][kept], np.bincount(np.repeat(np.arange(len(each[1])), each[1])[kept], minlength=len(each[1]))


def _crossed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, hash in ``a``) of every pair of a row's hashes in ``a`` and in ``b``."""
    (left, na), (right, nb) = a, b
    both = na * nb
    row = np.repeat(np.arange(len(na)), both)
    place = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    one = left[(np.cumsum(na) - na)[row] + place // nb[row]]
    return row, _mixed(one, right[(np.cumsum(nb) - nb)[row] + place % nb[row]]), one


@lru_cache(maxsize=20_000)
def _title_hashes(words: tuple[str, ...], takes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a title for rules 1, 2 and 3, and of the title without one word (without one letter, if it is one word) for rule 4."""
    title = "".join(words)
    if not title:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none, none
    if len(words) > 1:
        rests = {"|".join(words[:i] + words[i + 1 :]) for i in range(len(words))}
    else:
        rests = {title, *(title[:i] + title[i + 1 :] for i in range(len(title)))} if len(title) > 4 else set()
    return _hashes([f"1|{title}|{takes}"]), _hashes([f"2|{title}|{takes}"]), _hashes([f"3|{title}|{takes}"]), _hashes([f"4|{r}|{takes}" for r in sorted(rests)])


@lru_cache(maxsize=20_000)
def _artist_hashes(artist: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the telling words of an artist, and of parts of a name: an initial with the begin or end of a word close to it."""
    telling = [w for w in artist if len(w) > 2 and w not in _GIVEN and w not in COMMON] or [w for w in artist if len(w) > 2]
    parts = {f"{w[0]}|{x}" for i, w in enumerate(artist) for v in artist[max(0, i - 2) : i + 3] if v != w and len(v) > 2 for x in ("<" + v[:2], ">" + v[-2:])}
    return _hashes(list(dict.fromkeys(telling))), _hashes(sorted(parts))


def keys_of(records: list[tuple[str, tuple[str, ...], int, str]], passes: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, rules, keys, parts) of records (code, words, takes, artist) for every rule, by row; ``parts``: the hash of the title or code in each key.

    ``passes``: which parts are wanted. Artists of records without any are not read.
    """
    none = np.zeros(0, dtype=np.uint64)
    if not records:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), none, none
    first, second, third, fourth = map(_flat, zip(*(_title_hashes(words, takes) for _, words, takes, _ in records)))
    codes = _flat([_hashes([c]) if c else none for c, *_ in records])
    if passes:
        codes, second, third, fourth = (_left(x, passes) for x in (codes, second, third, fourth))
    read_on = (codes[1] + second[1] + third[1] + fourth[1] > 0).tolist()
    telling, parts = map(_flat, zip(*(_artist_hashes(artist_of(r[3])) if on else (none, none) for r, on in zip(records, read_on))))
    each = [_crossed(codes, first), _crossed(second, telling), _crossed(third, parts), _crossed(fourth, telling), _crossed(codes, telling)]
    rows, keys, ones = (np.concatenate([x[k] for x in each]) for k in range(3))
    rules = np.repeat(np.arange(1, 6, dtype=np.int32), [len(x[1]) for x in each])
    order = np.argsort(rows, kind="stable")
    return rows[order], rules[order], keys[order], ones[order]


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps, given up beyond ``most``: of what is left without a common begin and end, near the diagonal."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, least = 0, min(len(a), len(b))
    while i < least and a[i] == b[i]:
        i += 1
    a, b, least = a[i:], b[i:], least - i
    i = 0
    while i < least and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return len(a) + len(b)
    far = most + 1
    before, row = [], [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            c = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            new[j] = min(c, far)
        if min(new) > most:
            return far
        before, row = row, new
    return row[-1]


#: The performers of sheets recur in many pairs.
_read = lru_cache(maxsize=20_000)(read)


def same_title(a: tuple[str, ...], b: tuple[str, ...], frequent: frozenset[str]) -> bool:
    """Whether two titles are one but for slips: at most two edits a word, no number and no two frequent words exchanged."""
    if a == b:
        return True
    x, y = "".join(a), "".join(b)
    if not x or not y:
        return False
    if x == y:
        return True
    if re.sub(r"\D", "", x) != re.sub(r"\D", "", y):
        return False
    most = 1 if min(len(x), len(y)) < 8 else 2 if min(len(x), len(y)) < 16 else 3
    if _distance(x, y, most) > most:
        return False
    if len(a) == len(b):
        return not any(p != q and p in frequent and q in frequent for p, q in zip(a, b))
    return True


def same_artist(sheet: str | None, credit: tuple[str, ...]) -> bool:
    """Whether the performer of a sheet is the first artist of a credit; unknown performers agree with none."""
    r = _read(sheet)
    if r is None or not credit:
        return False
    _, full, given = r
    near = list(credit[: len(full) + (1 if given else 0) + 1])
    slips, firm = 0, 0
    for t in [*full, *([given] if given else [])]:
        for c in near:
            if c == t:
                firm += len(t) > 2 and t not in COMMON and t not in _GIVEN
                break
        else:
            for c in near:
                if len(c) <= 4 and len(c) < len(t) and t.startswith(c) or len(t) <= 4 and len(t) < len(c) and c.startswith(t):
                    break
                if one_apart(c, t):
                    slips += 1
                    firm += len(t) > 3 and t not in COMMON and t not in _GIVEN
                    break
            else:
                return False
        near.remove(c)
    return firm > 0 and slips <= 2


def frequent_words(titles: DataFrame) -> frozenset[str]:
    """Words that make up at least ``FREQUENT_SHARE`` of all words of column ``title``: never more than 1 / share of them."""
    words = titles.where(F.col("title").isNotNull()).select(F.explode(F.split(F.lower("title"), r"[^\p{L}]+")).alias("word")).where(F.length("word") > 1)
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(fold(r[0]) for r in counts.where(F.col("n") >= F.lit(max(3.0, FREQUENT_SHARE * total))).collect())


def sheet_keys(sheets: DataFrame) -> DataFrame:
    """(key, part, rule, sheet_id, work_title, performer, code, seconds, work_key) for each key of each distinct sheet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known, records = [], []
            for i, title, performer, code, length in zip(b["sheet_id"], b["work_title"], b["performer"], b["code"], b["length"]):
                c, s = code_of(code), seconds_of(length)
                words, takes = title_of(title) if title else ((), 0)
                records.append((c, words, takes, " ".join(reversed(performer.split(",", 1))) if performer else ""))
                known.append((i, title, performer, c, s, "".join(words)))
            rows, rules, keys, parts = keys_of(records)
            out = [(k, p, r, *known[row]) for row, r, k, p in zip(rows.tolist(), rules.tolist(), keys.view(np.int64).tolist(), parts.view(np.int64).tolist())]
            yield pd.DataFrame(out, columns=["key", "part", "rule", "sheet_id", "work_title", "performer", "code", "seconds", "work_key"])

    distinct = sheets.select("sheet_id", "work_title", "performer", "code", "length").where(F.col("sheet_id").isNotNull()).distinct()
    return distinct.mapInPandas(run, "key long, part long, rule int, sheet_id long, work_title string, performer string, code string, seconds double, work_key string")


def _bits_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter."""
    return (hashes % np.uint64(BLOOM_BITS)).astype(np.int64), ((hashes >> np.uint64(32)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def key_filters(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters of the columns ``key`` and ``part``: ``BLOOM_BITS`` bits each, two hashes; joined from at most eight parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((2, BLOOM_BITS), dtype=bool)
        for b in batches:
            for bits, name in zip(both, ("key", "part")):
                one, other = _bits_of(b[name].to_numpy().view(np.uint64))
                bits[one] = bits[other] = True
        yield pd.DataFrame({"bits": [np.packbits(both).tobytes()]})

    out = np.zeros(2 * BLOOM_BITS // 8, dtype=np.uint8)
    for r in keys.select("key", "part").coalesce(8).mapInPandas(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r[0], dtype=np.uint8)
    return out[: BLOOM_BITS // 8], out[BLOOM_BITS // 8 :]


def candidate_hits(candidates: DataFrame, filters: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(candidate_id, title, artist, isrc, length, title_key, hits) of candidates with keys that the filters let pass; ``hits``: their rules and keys."""
    shared = candidates.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_table, part_table = (np.unpackbits(x).view(bool) for x in shared.value)

        def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            one, other = _bits_of(hashes)
            return table[one] & table[other]

        for b in batches:
            known, records = [], []
            for i, title, artist, code, length in zip(b["candidate_id"], b["title"], b["artist"], b["isrc"], b["duration_s"]):
                if not title or not artist or not title.strip() or not artist.strip():
                    continue
                c = code_of(code)
                words, takes = title_of(title)
                records.append((c, words, takes, artist))
                known.append((i, title, artist, c, length, "".join(words)))
            rows, rules, k, _ = keys_of(records, lambda x: passes(part_table, x))
            kept = np.flatnonzero(passes(key_table, k))
            held: dict[int, list[dict]] = {}
            for row, rule, key in zip(rows[kept].tolist(), rules[kept].tolist(), k[kept].view(np.int64).tolist()):
                held.setdefault(row, []).append({"rule": rule, "key": key})
            yield pd.DataFrame([(*known[row], hits) for row, hits in held.items()], columns=["candidate_id", "title", "artist", "isrc", "length", "title_key", "hits"])

    c = candidates.select("candidate_id", "title", "artist", "isrc", "duration_s").where(F.col("candidate_id").isNotNull() & F.col("title").isNotNull() & F.col("artist").isNotNull())
    return c.mapInPandas(run, "candidate_id long, title string, artist string, isrc string, length double, title_key string, hits array<struct<rule: int, key: long>>")


def likely(met: DataFrame) -> DataFrame:
    """``met`` without pairs that no verification would pass: lengths apart, or titles more than ``MOST_EDITS`` apart."""
    off = F.abs(F.col("length") - F.col("seconds"))
    near = F.coalesce(off <= SECONDS, F.lit(True))
    titles = (F.col("work_key") == "") | (F.expr(f"levenshtein(title_key, work_key, {MOST_EDITS})") >= 0)
    return met.where(near & titles).drop("title_key", "work_key")


def verified(met: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """``met`` with its pairs that agree on title, take, artist and length, and what their codes and lengths say."""
    shared = met.sparkSession.sparkContext.broadcast(frequent)

    @F.pandas_udf("boolean")
    def agree(title: pd.Series, artist: pd.Series, work_title: pd.Series, performer: pd.Series, same_code: pd.Series) -> pd.Series:
        known, out = shared.value, []
        for t, a, w, p, c in zip(title, artist, work_title, performer, same_code):
            (x, m), (y, n) = title_of(t), title_of(w) if w else ((), 0)
            by_title = m == n and same_title(x, y, known) if w else bool(c)
            out.append(by_title and (same_artist(p, artist_of(a)) if p else bool(c) and bool(w)))
        return pd.Series(out)

    off = F.abs(F.col("length") - F.col("seconds"))
    near = F.coalesce(off <= SECONDS, F.lit(True))
    same_code = (F.col("isrc") != "") & (F.col("isrc") == F.col("code"))
    rows = met.withColumn("same_code", same_code).where(near)
    ok = rows.where(agree("title", "artist", "work_title", "performer", "same_code"))
    return ok.select("candidate_id", "sheet_id", *[c for c in ok.columns if c == "rules"], F.when((F.col("isrc") != "") & (F.col("code") != ""), F.col("same_code")).alias("code_says"), (off <= 4.0).alias("length_says"))


def met_by(open_: DataFrame, keys: DataFrame, rule: int, hot: DataFrame) -> DataFrame:
    """The pairs of ``open_`` and sheets that share a key of ``rule``, each once, without those that no verification would pass; ``hot`` keys are split."""
    asked = open_.select("*", F.explode(F.filter("hits", lambda h: h["rule"] == rule)).alias("h")).select(*[c for c in open_.columns if c != "hits"], F.col("h.key").alias("key"))
    met = spread_join(asked, keys.where(F.col("rule") == rule).drop("rule"), ["key"], ["candidate_id"], hot=hot)
    return likely(met.drop("key")).distinct()


def twins(keys: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """(sheet_id, twin) of sheets that describe one recording: one recording can be delivered under two numbers."""
    other = keys.where("rule <> 3").select("key", F.col("sheet_id").alias("candidate_id"), F.col("work_title").alias("title"), F.col("performer").alias("artist"), F.col("code").alias("isrc"), F.col("seconds").alias("length"), F.col("work_key").alias("title_key"))
    other = other.where(F.col("title").isNotNull() & F.col("artist").isNotNull() & ~F.col("artist").contains(","))
    met = spread_join(other, keys.where("rule <> 3").drop("rule"), ["key"], ["candidate_id"], hot=hot_keys(other, ["key"])).where(F.col("sheet_id") != F.col("candidate_id"))
    pairs = verified(likely(met.drop("key")).distinct(), frequent).select("sheet_id", F.col("candidate_id").alias("twin"))
    return pairs.unionByName(pairs.select(F.col("twin").alias("sheet_id"), F.col("sheet_id").alias("twin"))).distinct()


def precision_of(candidates: DataFrame, keys: DataFrame, frequent: frozenset[str], hot: DataFrame) -> dict[int, float]:
    """The precision of each rule on labelled candidates; candidates whose code some sheet has, about ``LABELLED`` of them by hash.

    Rules 1 and 5 use the code, so agreeing lengths are their labels; for the others codes that agree, or
    that differ where both have one. Add-one smoothing, so a rule without labels gets one half.
    """
    known = candidates.where(F.col("isrc") != "").join(keys.where(F.col("code") != "").select(F.col("code").alias("isrc")).distinct(), "isrc", "left_semi")
    every = max(1, known.count() // LABELLED)
    labelled = cut(known.where(F.pmod(F.xxhash64("candidate_id"), F.lit(every)) == 0))
    asked = labelled.select("*", F.explode("hits").alias("h")).select(*[c for c in labelled.columns if c != "hits"], "h.rule", "h.key")
    met = likely(spread_join(asked, keys.withColumnRenamed("rule", "of"), ["key"], ["candidate_id"], hot=hot).where("rule = of").drop("of", "key"))
    pairs = met.groupBy(*[c for c in met.columns if c != "rule"]).agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))  # a pair is verified once, whatever rules it fits
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col("length_says" if r in (1, 5) else "code_says").alias("says"), (F.expr(f"getbit(rules, {r})") == 1).alias("fits")) for r in RULES]))
    parts = verified(pairs, frequent).select(each.alias("r")).select("r.*").where("fits")
    counts = {r[0]: (r[1], r[2]) for r in parts.groupBy("rule").agg(F.count(F.when(F.col("says"), 1)), F.count("says")).collect()}  # a row a rule
    return {rule: (counts.get(rule, (0, 0))[0] + 1) / (counts.get(rule, (0, 0))[1] + 2) for rule in RULES}


def later(records: DataFrame, rule: int) -> DataFrame:
    """``records`` with their keys of the rules after ``rule``; without records that have none."""
    return records.withColumn("hits", F.filter("hits", lambda h: h["rule"] > rule)).where(F.size("hits") > 0)


def links(candidates: DataFrame, sheets: DataFrame) -> DataFrame:
    """(candidate_id, sheet_id, rule, confidence) of all pairs of one recording.

    Candidates without title or artist give no pair; a missing performer, title, code or length on a sheet
    only rules out the rules that need it. Repeated rows give a pair once; empty tables give none.
    """
    frequent = frequent_words(candidates.select("title"))
    keys = cut(sheet_keys(sheets))
    everyone = cut(candidate_hits(candidates, key_filters(keys)).distinct())
    keys = keys.drop("part")
    hot = cut(hot_keys(everyone.select(F.explode("hits.key").alias("key")), ["key"]))
    precision = precision_of(everyone, keys, frequent, hot)
    open_, done, open_keys, pairs = everyone, None, keys, None
    for rule in RULES:
        met = met_by(open_, keys, rule, hot)
        if done is not None:
            met = met.unionByName(met_by(done, open_keys, rule, hot))
        new = cut(verified(met, frequent).select("candidate_id", "sheet_id", F.lit(rule).alias("rule"), F.lit(precision[rule]).alias("confidence")))
        pairs = new if pairs is None else pairs.unionByName(new)
        if rule != max(RULES):
            found_one, found_other = new.select("candidate_id").distinct(), new.select("sheet_id").distinct()
            marked = cut(later(open_, rule).join(found_one.withColumn("resolved", F.lit(True)), "candidate_id", "left"))
            resolved = marked.where("resolved").drop("resolved")
            done = resolved if done is None else later(done, rule).unionByName(resolved)
            open_ = marked.where("resolved is null").drop("resolved")
            open_keys = cut(open_keys.where(F.col("rule") > rule).join(found_other, "sheet_id", "left_anti"))
    more = spread_join(pairs, twins(keys, frequent), ["sheet_id"], ["candidate_id"], hot=hot_keys(pairs, ["sheet_id"])).select("candidate_id", F.col("twin").alias("sheet_id"), "rule", (F.col("confidence") * 0.9).alias("confidence"))
    every = pairs.unionByName(more)
    return every.groupBy("candidate_id", "sheet_id").agg(F.max(F.struct("confidence", "rule")).alias("b")).select("candidate_id", "sheet_id", F.col("b.rule").alias("rule"), F.round("b.confidence", 6).alias("confidence"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p3_found: every pair of a candidate and a sheet of the same recording."""
    return links(load(spark, folder, "candidates"), load(spark, folder, "label_sheet")).select("candidate_id", "sheet_id")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """p3_links: the pairs with the rule that found them and its confidence."""
    return links(load(spark, folder, "candidates"), load(spark, folder, "label_sheet"))

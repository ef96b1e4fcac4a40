"""The approval decision against the rules written out row by row."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from refrain import io
from refrain.functions import text as T
from refrain.operators import matching

TRACK = "track_id long, filename string, current_title string, current_artist string, current_album string, duration double"
COLUMNS = (
    "candidate_id long, track_id long, ord int, provider string, title string, artist string, album string, isrc string, duration_s double, duration_delta double, acoustid double, audio_recognition boolean, "
    "sources array<string>, score double, cover_url string, release_date string, year string, track_number long, genre string, album_artist string, release_type string, release_secondary_types string, is_compilation boolean"
)
NAMES = [c.strip().split(" ")[0] for c in COLUMNS.split(", ")]


def plain(text):
    for sign, word in (("÷", "divide"), ("×", "multiply"), ("+", "plus"), ("=", "equals"), ("&", "and")):
        text = text.replace(sign, f" {word} ")
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def close(a, b):
    a, b = plain(a), plain(b)
    return 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))


def prefix(a, b, least):
    x, y = plain(a).replace(" ", ""), plain(b).replace(" ", "")
    return min(len(x.encode()), len(y.encode())) >= least and (x.startswith(y) or y.startswith(x))


def title_close(a, b):
    told = [[w for w in plain(x).split() if w not in ("a", "an", "the", "such")] for x in (a, b)]
    return max(close(a, b), 0.94) if told[0] and told[0] == told[1] or prefix(a, b, 4) else close(a, b)


def artist_close(a, b):
    return max(close(a, b), 0.92) if prefix(a, b, 5) else close(a, b)


def takes(text):
    words = set(plain(text).split())
    return {tag for tag, names in T.VERSION_TAGS.items() if words & set(names)}


def agree(x, y):
    a, b, c, d = x["title"] or "", y["title"] or "", x["artist"] or "", y["artist"] or ""
    return takes(a) == takes(b) and title_close(a, b) >= 0.90 and artist_close(c, d) >= 0.82


def is_album(c):
    more = (c["release_secondary_types"] or "").lower()
    return (c["release_type"] or "").lower() == "album" and not c["is_compilation"] and "compilation" not in more and "live" not in more


def year(c):
    date = c["release_date"] if c["release_date"] is not None else c["year"]
    return int(date[:4]) if date is not None and re.fullmatch(r"\d{4}", date[:4]) else None


def meaningful(album):
    return album is not None and album.strip() != "" and not album.strip().startswith("@")


def brute(track, rows, priority):
    """(candidate_id, total, margin) or None."""
    own, made = track["current_title"] if (track["current_title"] or "").strip() else None, track["current_artist"] if (track["current_artist"] or "").strip() else None
    expected, left = takes((track["filename"] or "") + " " + (own or "")), []
    for c in rows:
        if not (c["title"] or "").strip() or not (c["artist"] or "").strip():
            continue
        ts, ar = (title_close(own, c["title"]) if own else None), (artist_close(made, c["artist"]) if made else None)
        audio = bool(c["audio_recognition"]) or (c["acoustid"] or 0) > 0
        n = max(1, len({x for x in c["sources"] or [] if x is not None}), 1 + len({o["provider"] for o in rows if o["candidate_id"] != c["candidate_id"] and o["provider"] != c["provider"] and agree(c, o)}))
        delta = abs(track["duration"] - c["duration_s"]) if c["duration_s"] is not None and track["duration"] is not None else None
        if c["duration_s"] is None and c["duration_delta"] is not None and c["duration_delta"] <= 60:
            delta = c["duration_delta"]
        trusted = priority.get(c["provider"], 99) <= 6
        total = (21 if ts is None else ts * 28) + (15 if ar is None else ar * 18) + 5 * min(n - 1, 3) + (5 if trusted else 0) + 0.08 * min(max(c["score"] or 0, 0), 100) + (15 if audio else 0)
        total += (6 if audio else 0) if delta is None else 16 if delta <= 3 else 13 if delta <= 8 else 7 if delta <= 15 else 1 if delta <= 30 else -14
        kept = meaningful(track["current_album"])
        if kept and (c["album"] or "").strip():
            near = close(track["current_album"], c["album"])
            total += -8 if near < 0.40 else near * 18
        else:
            total += 6 if is_album(c) else -7 if c["is_compilation"] else 0
        total += (3 if meaningful(c["album"]) else -4) + (3 if c["cover_url"] is not None else -2) + (2 if c["release_date"] is not None or c["year"] is not None else 0)
        total += 1.5 * (c["track_number"] is not None) + 1.5 * (c["genre"] is not None) + (c["album_artist"] is not None) + (c["isrc"] is not None) - (7 if c["is_compilation"] else 0)
        years = [year(o) for o in rows if is_album(o) and agree(c, o) and year(o) is not None]
        total += 4 if not kept and is_album(c) and years and year(c) == min(years) else 0
        at = lambda x, y: (ts is None or ts >= x) and (ar is None or ar >= y)
        exact = trusted and ts is not None and ar is not None and at(0.90, 0.82) and delta is not None and delta <= 8
        if (audio and at(0.72, 0.65) or n >= 2 and at(0.82, 0.72) or exact) and not ((c["score"] or 0) < 55 and not audio and n < 2) and takes(c["title"]) == expected:
            left.append((-round(total, 6), c["ord"], c["candidate_id"], c))
    left.sort(key=lambda x: x[:3])
    if not left or -left[0][0] < 68:
        return None
    code = lambda c: re.sub("[^A-Za-z0-9]", "", c["isrc"]).upper() if c["isrc"] is not None else None
    margin = round(left[1][0] - left[0][0], 6) if len(left) > 1 else None
    if margin is not None and margin < 12:
        a, b = left[0][3], left[1][3]
        if not (code(a) is not None and code(a) == code(b) or agree(a, b)):
            return None
    return left[0][2], -left[0][0], margin


def made(i, track, title, **other):
    row = dict.fromkeys(NAMES) | {"candidate_id": i, "track_id": track, "ord": i, "title": title, "artist": "The Band", "provider": "deezer", "score": 90.0, "duration_s": 200.0, "sources": ["x"], "album": "Album", "cover_url": "u", "release_date": "2001-01-01", "is_compilation": False} | other
    return tuple(row[n] for n in NAMES)


def test_only_supported_candidates_count(spark):
    t = spark.createDataFrame([(i, "f.mp3", "Long Song", "The Band", None, 200.0) for i in range(1, 8)] + [(8, "Long Song (live).mp3", "Long Song", "The Band", None, 200.0)], TRACK)
    rows = [
        made(1, 1, "Long Song", provider="nowhere"),  # one source of no catalogue: 68 points, no support
        made(2, 2, "Long Song"), made(3, 2, "Long Sigh", provider="nowhere", release_type="Album"),  # the second is near in points, but has no support
        made(4, 3, "Long Song", score=54.0),  # exact, but a weak raw score on one source
        made(5, 4, "Long Song (live)"),  # another take
        made(6, 5, "Long Song", provider="nowhere"), made(7, 5, "Long Song", provider="elsewhere", score=80.0),  # two providers agree
        made(8, 6, "Long Song", provider="nowhere", acoustid=0.0), made(9, 7, "Long Song", provider="nowhere", acoustid=0.4),  # no points for a fingerprint of 0
        made(10, 8, "Long Song"), made(11, 8, "Long Song (live)", score=70.0),  # the file's name tells the take
    ]
    got = {r["track_id"]: r["candidate_id"] for r in matching.decide(t, spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {2: 2, 5: 6, 7: 9, 8: 11}


def test_original_album_and_trust(spark):
    t = spark.createDataFrame([(1, "f.mp3", "Long Song", "The Band", "@uploader", 200.0)], TRACK)
    rows = [made(1, 1, "Long Song", provider="discogs", release_type="Album", release_date="1999"), made(2, 1, "Long Song", release_type="album", release_date=None, year="2005"), made(3, 1, "Long Song", release_type="Album", release_secondary_types="Live", release_date="1990")]
    got = matching.decide(t, spark.createDataFrame(rows, COLUMNS)).first()
    # 28 + 18 + 16 + 6 + (3 + 3 + 2) + 5 + trust 2 + 7.2 + 4 for the earliest album, against trust 5 and no 4
    assert (got["candidate_id"], got["total"], got["margin"]) == (1, 94.2, 1.0)


def test_decisions_equal_brute_force(spark, sf):
    tracks, candidates, providers = (io.load(spark, sf, n) for n in ("tracks", "candidates", "providers"))
    priority, rows = {r["provider"]: r["priority"] for r in providers.collect()}, defaultdict(list)
    for c in candidates.select(*NAMES).dropDuplicates(["candidate_id"]).collect():
        rows[c["track_id"]].append(c)
    want = {t["track_id"]: b for t in tracks.dropDuplicates(["track_id"]).collect() if (b := brute(t, rows[t["track_id"]], priority))}
    got = {r["track_id"]: (r["candidate_id"], r["total"], r["margin"]) for r in matching.decide(tracks, candidates, providers).collect()}
    assert len(want) > 10 and got.keys() == want.keys()
    for k, (i, total, margin) in want.items():
        assert got[k][0] == i and abs(got[k][1] - total) < 1e-5 and (got[k][2] is None) == (margin is None)
        assert margin is None or abs(got[k][2] - margin) < 1e-5
    assert candidates.where(F.col("provider").isin(*[n for names in matching.TRUST.values() for n in names])).isEmpty()  # the test tables' providers go by priority

"""Dates, zones and packed fields."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pytest

from refrain.operators import dates, packed_fields

CASES = [
    ("2014-00-00", "en-GB", "2014"), ("2014-05-00", "en-GB", "2014-05"), ("0000-00-00", "en-GB", None), ("2022-13-01", "en-GB", None), ("1999-02-30", "en-GB", None), ("20120310", "en-GB", "2012-03-10"),
    ("04/12/07", "en-US", "2007-04-12"), ("04/12/07", "en-GB", "2007-12-04"), ("04/12/07", "ja-JP", "2004-12-07"), ("04/12/07", None, None), ("25/12/2007", None, "2007-12-25"), ("05/07/83", "en-US", "1983-05-07"), ("13/13/2001", "en-GB", None),
    ("2.7.2019", "de-DE", "2019-07-02"), ("17-AUG-2011", "en-US", "2011-08-17"), ("1er août 1998", "fr-FR", "1998-08-01"), ("19 de enero de 2009", "es-ES", "2009-01-19"), ("März 2016", "de-DE", "2016-03"), ("Jul 12, 2026", "en-US", "2026-07-12"),
    ("2019年4月19日", "ja-JP", "2019-04-19"), ("2020年2月", "ja-JP", "2020-02"), ("07/2026", "en-GB", "2026-07"), ("2012.5.26", "ja-JP", "2012-05-26"), ("1305003659", "en-GB", "2011-05-10T05:00:59Z"), ("1346976907154", "en-GB", "2012-09-07T00:15:07Z"),
    ("2025-11-15T18:30:07+02:00", "en-GB", "2025-11-15T16:30:07Z"), ("2018-09-21 12:15 (Europe/London)", "en-GB", "2018-09-21T11:15:00Z"), ("2013-08-18 05:00:59 PDT", "en-GB", "2013-08-18T12:00:59Z"), ("Wed, 07 Oct 2020 18:30:07 +0100", "en-GB", "2020-10-07T17:30:07Z"),
    ("20201015T000000Z", "en-GB", "2020-10-15T00:00:00Z"), ("2016-10-30 02:30", "de-DE", "2016-10-30T00:30:00Z"), ("2016-03-27 02:30", "de-DE", "2016-03-27T01:30:00Z"), ("03/13/2016 02:30 AM", "de-US", None), ("03/13/2011 12:15 AM", "en-US", "2011-03-12T23:15:00Z"),
    ("2020-01-01 10:00 Nowhere/Land", "en-GB", None), ("TBA", "en-GB", None), ("", "en-GB", None), (None, "en-GB", None), ("9" * 5000, "en-GB", None),
]


def test_forms(spark):
    rows = spark.createDataFrame([(i, v, loc, "Europe/Berlin") for i, (v, loc, _) in enumerate(CASES)], "i int, v string, loc string, z string")
    got = {r["i"]: r["out"] for r in dates.with_release_date(rows, "v", "loc", "z", "out").collect()}
    assert {i: got[i] for i in got} == {i: w for i, (_, _, w) in enumerate(CASES)}


def test_local_times_against_the_zone_database(spark):
    start, rows = datetime(2016, 3, 26, 20), []
    for h in range(0, 24 * 240, 7):
        for z in ("Europe/Paris", "America/New_York", "Australia/Sydney", "Asia/Kolkata"):
            rows.append(((start + timedelta(hours=h, minutes=h % 60)).strftime("%Y-%m-%d %H:%M"), z))

    def want(v, z):
        t = datetime.strptime(v, "%Y-%m-%d %H:%M").replace(tzinfo=ZoneInfo(z))  # fold 0: the earlier instant, and over a gap the offset before it
        return t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    got = dates.with_release_date(spark.createDataFrame([(v, None, z) for v, z in rows], "v string, loc string, z string"), "v", "loc", "z", "out").collect()
    assert all(r["out"] == want(r["v"], r["z"]) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("v, want", [("'97", "1997"), ("23", "2023"), ("2019 (remastered 2026)", "2019"), ("MCMXCVI", "1996"), ("MMXXIV", "2024"), ("IIII", None), ("20--", None), ("0", None), ("℗ 2016", "2016"), ("02/2023", "2023"), ("2026.0", "2026"), ("unknown", None), (None, None)])
def test_years(spark, v, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(dates.release_year(F.lit(v).cast("string"))).first()[0] == want


def test_zone_estimate(spark):
    rows = []
    for i in range(60):
        utc = datetime(2024, 1, 5) + timedelta(days=3 * i)
        for z in ("Europe/Berlin", "America/New_York", "Asia/Tokyo"):
            local = utc.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(z)).replace(tzinfo=None)
            rows.append((z, local, utc + timedelta(minutes=i % 9)))
    rows += [("Asia/Tokyo", None, datetime(2024, 1, 1)), (None, datetime(2024, 1, 1), None)]
    stamps = spark.createDataFrame(rows, "source string, local timestamp_ntz, ingested timestamp_ntz")
    zones = spark.createDataFrame([("Europe/Berlin",), ("America/New_York",), ("Asia/Tokyo",), ("No/Where",), (None,)], "zone string")
    got = {r["source"]: r["zone"] for r in dates.estimate_zones(stamps, zones).collect()}
    assert got == {z: z for z in ("Europe/Berlin", "America/New_York", "Asia/Tokyo")}


def test_home_zones_withheld_are_estimated(spark, sf):
    """The zones of all providers, told from stamps that came in within minutes; 0.9 of them must be right in their offsets."""
    homes = [r[0] for r in spark.read.parquet(f"{sf}/providers.parquet").select("home_zone").distinct().collect()]
    rng, rows = random.Random(3), []
    for z in homes:
        for _ in range(400):
            utc = datetime(2021, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 730))
            local = utc.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(z)).replace(tzinfo=None)
            rows.append((z, local, utc + timedelta(minutes=rng.randrange(20))))
    stamps = spark.createDataFrame(rows, "source string, local timestamp_ntz, ingested timestamp_ntz")
    names = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "zone string")
    got = {r["source"]: r["zone"] for r in dates.estimate_zones(stamps, names).collect()}
    days = [datetime(2021, 1, 1, 12) + timedelta(days=d) for d in range(0, 730, 7)]
    same = [all(d.replace(tzinfo=ZoneInfo(z)).utcoffset() == d.replace(tzinfo=ZoneInfo(got[z])).utcoffset() for d in days) for z in homes]
    assert sum(same) >= 0.9 * len(homes), {z: got[z] for z, ok in zip(homes, same) if not ok}


def test_zone_by_sequence(spark):
    """Times around a change of the clock that go back in any zone but their own; their ingestion tells nothing."""
    rows, late = [], datetime(2030, 1, 1)
    for i in range(300):
        utc = datetime(2021, 10, 30, 20) + timedelta(minutes=7 * i)
        rows.append(("a", utc.replace(tzinfo=timezone.utc).astimezone(ZoneInfo("Europe/Berlin")).replace(tzinfo=None), late, i))
    stamps = spark.createDataFrame(rows + [(None, None, None, None)], "source string, local timestamp_ntz, ingested timestamp_ntz, seq long")
    zones = spark.createDataFrame([("Europe/Berlin",), ("Asia/Tokyo",), ("no such zone",), (None,), ("America/New_York",)], "zone string")
    got = dates.estimate_zones(stamps, zones).collect()
    assert [(r["source"], r["zone"], r["n"]) for r in got] == [("a", "Europe/Berlin", 300)]
    assert dates.estimate_zones(stamps.limit(0), zones).count() == 0


def test_normalised_once_and_empty(spark):
    cols = "candidate_id long, provider string, release_date string, year string, fetched_at timestamp_ntz, value string, locale string"
    c = spark.createDataFrame([(1, "p", "12/04/2007", "'07", None, "x", "y")] * 2 + [(2, "q", "2007-04-12", "2007", None, "x", "y"), (3, None, None, None, None, None, None)], cols)
    p = spark.createDataFrame([("p", "fr-FR", "Europe/Paris"), ("q", None, None)], "provider string, locale string, home_zone string")
    got = sorted(tuple(r) for r in dates.normalised(c, p).select("candidate_id", "field", "value").collect())
    assert got == [(1, "release_date", "2007-04-12"), (1, "year", "2007")]
    assert dates.normalised(c.limit(0), p.limit(0)).count() == 0


def corpus(spark):
    names = ["Ann Lee", "Bo Fox", "Cy Roe", "Marble & Stone", "Lark + Dove", "The Grey Owls"]
    rows = [(i, n) for i, n in enumerate(names * 3)]
    lists = ["Ann Lee; Marble & Stone", "Bo Fox|Marble & Stone", "Cy Roe; Marble & Stone; Lark + Dove", "Lark + Dove|Ann Lee", "Lark + Dove; Bo Fox", '["Fox, Bo", "Lee, Ann"]', "Roe, Cy|Fox, Bo", "Lee, Ann; Roe, Cy", "Fox, Bo;Roe, Cy"]
    rows += [(100 + i, v) for i, v in enumerate(lists)]
    more = ["Ann Lee & Bo Fox", "Marble & Stone", "Ann Lee feat. Bo Fox & Cy Roe", '"Lee, Ann", "Fox, Bo"', "Lee, Ann", "Ann Lee (with Bo Fox, Cy Roe)", ";Ann Lee;; Bo Fox;", "Grey Owls, The", "Marble & Stone, Bo Fox", "Ann Lee / Bo Fox", " ", None]
    rows += [(200 + i, v) for i, v in enumerate(more)] + [(200, "Ann Lee & Bo Fox")]
    return spark.createDataFrame([(i, v, None, None, "clash") for i, v in rows], "candidate_id long, artist string, composer string, release_secondary_types string, id string")


def test_unpack(spark):
    got: dict[int, list] = {}
    for r in packed_fields.unpack(corpus(spark), "candidate_id").orderBy("candidate_id", "pos").collect():
        got.setdefault(r["candidate_id"], []).append(r["value"])
    assert got[200] == ["Ann Lee", "Bo Fox"] and 201 not in got and 204 not in got and 207 not in got
    assert got[202] == ["Ann Lee", "Bo Fox", "Cy Roe"] == got[205]
    assert got[203] == ["Lee, Ann", "Fox, Bo"] and got[206] == ["Ann Lee", "Bo Fox"] and got[208] == ["Marble & Stone", "Bo Fox"] and got[209] == ["Ann Lee", "Bo Fox"]
    assert got[102] == ["Cy Roe", "Marble & Stone", "Lark + Dove"] and 210 not in got and 211 not in got
    assert packed_fields.unpack(corpus(spark).limit(0), "candidate_id").count() == 0


def test_unpack_takes_whole_long_fields(spark):
    many = "; ".join(f"Name{i} Sur{i}" for i in range(2000))
    rows = spark.createDataFrame([(1, many, None, None)], "candidate_id long, artist string, composer string, release_secondary_types string")
    assert packed_fields.unpack(rows, "candidate_id").count() == 2000


def test_more_joining_signs_than_could_be_tried_one_by_one(spark):
    bits = {packed_fields.code_of("artist", n): 3.0 for n in ("Ann Lee", "Bo Fox", "Cy Roe", "Marble & Stone", "Lark + Dove")}
    names = ["Marble & Stone", "Ann Lee", "Lark + Dove", "Bo Fox", "Cy Roe"] * 40
    assert packed_fields.cheapest("artist", " & ".join(names), bits, {}, 1)[3] == names
    assert packed_fields.cheapest("artist", "", bits, {}, 1)[1] == 0


def test_cuts_against_brute_force():
    import itertools

    rng = random.Random(9)
    for _ in range(150):
        parts = [rng.choice(["a", "b", "c d", "e"]) for _ in range(rng.randint(2, 6))]
        text, most = " & ".join(parts), rng.randint(0, 5)
        spans = {" & ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, min(len(parts), i + 1 + most) + 1)}
        bits = {packed_fields.code_of("artist", x): rng.uniform(1, 30) for x in spans if rng.random() < 0.6}

        def price(x):
            spelled = packed_fields.ESCAPE + packed_fields.RARE_SHAPE + packed_fields.CHARACTER * len(x)
            return min(spelled, bits.get(packed_fields.code_of("artist", x), spelled)) + packed_fields.CUT

        best = min(sum(price(" & ".join(parts[a:b])) for a, b in zip((0, *c), (*c, len(parts)))) for k in range(len(parts)) for c in itertools.combinations(range(1, len(parts)), k))
        got = packed_fields.cheapest("artist", text, bits, {}, most)
        assert abs(got[0] - best) < 1e-3 and " & ".join(got[3]) == text

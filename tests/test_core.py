"""Functions and operators of the core on small cases."""

from __future__ import annotations

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from refrain import io, skew
from refrain.functions import numbers as N
from refrain.functions import text as T
from refrain.operators import duplicates, matching, state
from refrain.sources import payloads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def s(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: T.similarity(s(""), s("")), 1.0),
        (lambda: T.similarity(s("kitten"), s("sitting")), 1 - 3 / 7),
        (lambda: T.title_similarity(s("Such A Lonely Day"), s("Lonely Day")), 0.96),
        (lambda: T.title_similarity_strict(s("Such A Lonely Day"), s("Lonely Day")), 0.94),
        (lambda: T.text_close(s(" "), s("a"), 0.1), False),
        (lambda: T.text_close(s(None), s("a"), 0.1), False),
        (lambda: T.words_text(s("A+B & c"), True), "a plus b and c"),
        (lambda: T.code_key(s("us-rc1 76")), "USRC176"),
        (lambda: T.version_tags(s("Song (Live Mix)")), ["live", "remix"]),
        (lambda: T.version_tags(s("Symphonic"), False), []),
        (lambda: T.version_tags(s(None)), []),
        (lambda: T.prefer_latin(s("شب Night")), "Night"),
        (lambda: T.prefer_latin(s("شب")), "شب"),
        (lambda: T.is_placeholder(s(" Track 12 ")), True),
        (lambda: T.is_placeholder(s(None)), True),
        (lambda: T.is_placeholder(s("Track twelve")), False),
        (lambda: T.ws_trim(s("  x ")), "x"),
        (lambda: T.first_upper(s("ab cd")), "Ab cd"),
        (lambda: T.safe_name(s(" a/b:. "), "none"), "a b"),
        (lambda: T.safe_name(s("..."), "none"), "none"),
        (lambda: T.decode_entities(s("&amp;quot;x&#39;")), "\"x'"),
        (lambda: T.stem(s("a.b.mp3")), "a.b"),
        (lambda: T.filename_parts(s("A - B - C"))["title"], "B - C"),
        (lambda: T.filename_parts(s(" – C")), None),
        (lambda: N.duration_step(F.lit(None).cast("double"), 0.5), 0.5),
        (lambda: N.duration_step(F.lit(8.0), 0.5), 0.65),
        (lambda: N.duration_points(F.lit(31.0), F.lit(True)), -14.0),
        (lambda: N.iso_seconds(s("PT1H2M3S")), 3723),
        (lambda: N.iso_seconds(s("PT")), None),
        (lambda: N.clock_seconds(s("1:02:03")), 3723),
        (lambda: N.date_prefix_year(s("soon"), s("1999")), None),
        (lambda: N.partial_date(F.lit(1999), F.lit(5), F.lit(None).cast("int")), "1999-05"),
        (lambda: N.number_of(s(" 12.5 ")), 12.5),
        (lambda: payloads.meta_content(s('<meta property="og:title" content="A &amp; B">'), "og:title"), "A & B"),
        (lambda: payloads.tolerant(s("log {\"a\": 1} end")).cast("string"), '{"a":1}'),
    ],
)
def test_expressions(spark, make, want):
    got = one(spark, make())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_featured(spark):
    f = lambda a, t: tuple(one(spark, T.featured(s(a), s(t))))
    assert f("A & B", "Song (ft. B)") == ("A", "Song (feat. B)")
    assert f("A", "Song (featuring B) Feat. B") == ("A", "Song (feat. B)")
    assert f(" A ", " Song ") == ("A", "Song")
    assert f("B", "Song (feat. B) live") == ("B", "Song (feat. B) live")


def test_clean_tags(spark):
    rows = [(1, None, "T | A", None), (2, "@x", "T|A", "q"), (3, "", "T   A", None), (4, "z;", "T", "fa | Art - Tit"), (5, ",b،", "T", None)]
    got = {r[0]: tuple(r)[1:] for r in T.clean_tags(spark.createDataFrame(rows, "k int, artist string, title string, album string"), "artist", "title", "album").collect()}
    assert got == {1: ("A", "T", None), 2: ("A", "T", "q"), 3: ("A", "T", None), 4: ("Art", "Tit", None), 5: ("b", "T", None)}


def test_spread_join_is_a_join(spark):
    large = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    got = sorted(tuple(r) for r in skew.spread_join(large, small, ["k"], ["i"]).select("i", "v").collect())
    assert got == sorted(tuple(r) for r in large.join(small, "k").select("i", "v").collect())
    assert skew.spread_join(large, small, ["k"], ["i"], "left_anti").count() == large.join(small, "k", "left_anti").count()
    with pytest.raises(ValueError):
        skew.spread_join(large, small, ["k"], ["i"], "full")


def test_checkpoint_folder_is_the_sessions(spark):
    assert io.checkpoint_folder(spark) == io.checkpoint_folder(spark)
    assert io.cut(spark.range(3)).count() == 3


def test_agreement_folds_in_order(spark):
    cols = "block string, ord long, provider string, title string, artist string, album string, code string, score double, audio boolean"
    rows = [("b", 1, "p", "Song One", "Artist", None, None, 97.0, False), ("b", 2, "q", "Song One", "Artist", None, None, 50.0, False), ("b", 3, "r", "Song One", "Other name", None, None, 1.0, False), (None, 4, "p", "x", "y", None, None, 5.0, False)]
    got = {r["ord"]: r for r in matching.agreement(spark.createDataFrame(rows, cols)).collect()}
    assert got[1]["score"] == 94.0 and (got[1]["n_agree"], got[1]["n_conflict"]) == (1, 1)  # 97 + 6 is capped at 98, then 4 go
    assert got[3]["score"] == 0.0 and got[4]["score"] == 5.0


def test_agreement_of_a_large_block(spark):
    texts = [("Song One", "Artist"), ("Song One", "Other name"), ("Far away", "Artist")]
    cols = "block string, ord long, provider string, title string, artist string, album string, code string, score double, audio boolean"
    rows = [("b", i, "pqrs"[i % 4], *texts[i // 4 % 3], None, None, 97.0, False) for i in range(20000)]  # 300 million pairs of rows, 9 of texts
    limit = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    limit.start()
    try:
        got = matching.agreement(spark.createDataFrame(rows, cols)).select((F.floor(F.col("ord") / 4) % 3).alias("t"), "score", "n_agree", "n_conflict").groupBy("t", "score", "n_agree", "n_conflict").count().collect()
    finally:
        limit.cancel()
    assert sorted(map(tuple, got)) == [(0, 86.0, 3, 3, 6668), (1, 98.0, 3, 3, 6668), (2, 98.0, 3, 0, 6664)]


def test_scores(spark):
    assert one(spark, matching.fingerprint_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(False))) >= 99
    assert one(spark, matching.text_score(F.lit(0.96), F.lit(1.0), F.lit(None).cast("double"), F.lit(False), F.lit(True), F.lit(0.1), F.lit(94.0))) >= 90


def test_vote_and_survivors(spark):
    e = spark.createDataFrame([(1, "a", "x", 0.5), (1, "a", "x", 0.4), (1, "b", "y", 0.3), (1, "c", "y", 0.2), (1, "d", None, 9.0), (2, "a", "z", None)], "item int, source string, class string, weight double")
    assert [tuple(r) for r in matching.vote(e).collect()] == [(1, "x", 0.5, 0.5, "y")]  # 0.5 each, the greater single weight wins
    d = spark.createDataFrame([(1, 2.0, 1, None, "b"), (1, 9.0, 2, None, None), (1, None, 3, "z", "c")], "t int, score double, ord int, f string, g string")
    assert tuple(matching.survivors(d, "t", [matching.descending(F.col("score")), F.col("ord")], ["f", "g"]).first()) == (1, "z", "b")
    best = matching.keep_best(d.select("t", "score", "ord"), ["t"], [matching.descending(F.col("score"))])
    assert best.first()["ord"] == 2


def test_decide(spark):
    t = spark.createDataFrame([(1, "Song", "Band", None, 200.0), (1, "Song", "Band", None, 200.0), (2, None, None, None, 100.0)], "track_id long, current_title string, current_artist string, current_album string, duration double")
    cols = "candidate_id long, track_id long, ord int, title string, artist string, album string, isrc string, duration_s double, duration_delta double, acoustid double, audio_recognition boolean, sources array<string>, score double, cover_url string, release_date string, track_number long, genre string, album_artist string, is_compilation boolean"
    row = lambda i, t, title: (i, t, i, title, "Band", "Album", None, 200.0, None, 0.9, False, ["a", "b"], 90.0, "u", "2001", 1, "g", "Band", False)
    c = spark.createDataFrame([row(1, 1, "Song"), row(1, 1, "Song"), row(2, 1, "Song (live)"), row(3, 2, " ")], cols)
    assert [r["candidate_id"] for r in matching.decide(t, c).collect()] == [1]
    assert matching.decide(t, c.limit(0)).count() == 0


def test_known_duplicates(spark):
    cols = "track_id long, fingerprint string, duration double, file_size long, file_hash string"
    i = spark.createDataFrame([(1, "f", 182.4, 1, "h"), (2, None, 1.0, 7, "k"), (3, "", 1.0, 7, "k"), (4, "g", 9.0, 7, "k"), (5, None, None, None, None)], cols)
    r = spark.createDataFrame([("b", "f", 180.0, 0, None), ("a", "f", 100.0, 0, None), ("p", None, 1.0, 7, "k"), ("o", "x", 1.0, 7, "k")], "path string, fingerprint string, duration double, file_size long, file_hash string")
    got = {x["track_id"]: (x["path"], x["reason"]) for x in duplicates.known_duplicates(i, r).collect()}
    assert got == {1: ("b", "audio fingerprint"), 2: ("o", "exact file hash"), 3: ("o", "exact file hash"), 4: ("p", "exact file hash")}


def test_batch_duplicates_and_leaders(spark):
    rows = [(1, "US1", "t", 148.0, None, None), (2, "us-1", "t", 149.0, None, None), (3, "US1", "t", 240.0, None, None), (4, None, "x", 1.0, "f", None), (5, None, "y", 1.0, "f", None), (6, None, "x", None, None, None), (7, "US1", "t", 148.0, None, None)]
    g = spark.createDataFrame(rows, "track_id long, isrc string, title_artist string, duration double, fingerprint string, file_hash string")
    assert {r["track_id"]: r["n_links"] for r in duplicates.batch_duplicates(g).collect()} == {1: 2, 2: 2, 3: 0, 4: 1, 5: 1, 6: 0, 7: 2}
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 6)], "a long, b long")
    got = {r["id"]: r["leader"] for r in duplicates.leaders(spark.range(1, 7), chain).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    assert duplicates.batch_duplicates(g.limit(0)).count() == 0


def test_numbered(spark):
    rows = spark.range(0, 100).select((F.col("id") % 2).alias("k"), "id")
    got = {r["id"]: r["n"] for r in duplicates.numbered(rows, "k", "id", width=7).collect()}
    assert got == {i: i // 2 + 1 for i in range(100)}


def test_state(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    e = spark.createDataFrame([("a", "old", 100, t(1)), ("b", "new", 100, t(2)), ("a", "none", None, t(3))], "kind string, path string, bytes long, cached_at timestamp_ntz")
    assert [r["path"] for r in state.evicted(e, F.lit(180)).collect()] == ["old"]
    a = spark.createDataFrame([("x", 1, 5), ("y", None, 6), ("z", 2, 7)], "p string, m int, n int")
    b = spark.createDataFrame([("x", 1, 0), ("y", None, 0), ("z", 3, 0), ("w", 1, 0)], "p string, m int, n int")
    assert [r["p"] for r in state.pending(a, b, ["p"], ["m"]).collect()] == ["z"]
    assert [r["p"] for r in state.stale(b, a, ["p"]).collect()] == ["w"]
    assert state.stale(b, a, ["p"], clean=False).count() == 0
    assert sorted(r["n"] for r in state.upsert(a, b.limit(1), ["p"]).collect()) == [0, 6, 7]
    now, day = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")
    assert one(spark, state.expired(day, now)) is True and one(spark, state.expired_as_text(day, now)) is False


def test_payloads(spark):
    deezer = '{"data": [{"id": 1, "title": "T", "artist": {"name": "A"}, "album": {"cover_big": "b"}, "duration": "61"}, {"id": 2, "title": " "}]}'
    acoustid = '{"results": [{"score": 0.9, "recordings": [{"id": "r1", "title": "X"}, {"id": "r2", "title": "Y"}]}, {"recordings": []}]}'
    rows = spark.createDataFrame([(1, deezer), (2, "{broken"), (3, None), (4, "{}")], "key int, payload string")
    got = payloads.candidates(rows, "deezer").collect()
    assert [(r["title"], r["artist"], r["cover_url"], r["duration_s"], r["recording_id"]) for r in got] == [("T", "A", "b", 61.0, "1")]
    assert sorted(r["recording_id"] for r in payloads.candidates(spark.createDataFrame([(1, acoustid)], "key int, payload string"), "acoustid").collect()) == ["r1", "r2"]
    for source in payloads.SOURCES:
        assert payloads.candidates(rows, source).columns == ["key", "ord", "provider", *payloads.FIELDS]


def test_streaming_upserts(spark, tmp_path):
    from refrain.streaming import incremental as inc

    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    like = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, at int, v double")
    for i, rows in enumerate(([("a", 1, 1.0), ("b", 1, 2.0)], [("a", 3, 9.0), ("a", 2, 5.0)])):
        spark.createDataFrame(rows, like.schema).write.parquet(f"{src}/part={i}")
        stream = inc.read_new_files(spark, f"{src}/part=*", like)
        inc.run_batches(stream, inc.upsert_into(table, ["k"], ["at"]), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(tuple(r) for r in inc.current(spark, table).select("k", "v").collect()) == [("a", 9.0), ("b", 2.0)]


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p4_found", "p5_found", "approve"} <= set(e.queries())

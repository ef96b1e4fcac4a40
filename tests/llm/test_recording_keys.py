"""Keys of recordings, and which of them are made at all (problem 3)."""

from __future__ import annotations

import itertools
import random

import numpy as np

from refrain.llm import recording_links as links
from refrain.llm.lookalikes import comparable

CANDIDATE = "candidate_id long, title string, artist string, isrc string, duration_s double"
SHEET = "sheet_id long, work_title string, performer string, code string, length string"


def _record(code, title, artist):
    words, takes = links.title_of(title)
    return links.code_of(code), words, takes, artist


def test_only_wanted_titles_are_keyed_and_no_key_of_a_sheet_is_lost():
    titles = ["Blue Harbour", "Blue Harbour (live)", "Blu Harbour", "Blue", "Harbour Lights at Night", "Nocturne", "Nocturn", "½"]
    records = [_record(c, t, a) for c, t, a in itertools.product(["", "XA1234567890", "XB1234567890"], titles, ["Ann Stonewell", "A. Stonewell & Bo", "Cy Other", ""])]
    sheets = [_record("XA1234567890", "Blue Harbour", "Ann Stonewell"), _record("", "Nocturne", "Cy Other")]
    _, _, sheet_keys, parts = links.keys_of(sheets)
    whole, some = links.keys_of(records), links.keys_of(records, lambda x: np.isin(x, parts))
    held = [set(zip(*(x.tolist() for x in k[:3]))) for k in (whole, some)]
    assert held[1] < held[0]
    assert {k for k in held[0] if k[2] in sheet_keys.tolist()} == {k for k in held[1] if k[2] in sheet_keys.tolist()} != set()


def test_artists_of_unwanted_titles_are_not_read():
    before = links.artist_of.cache_info().currsize
    rows, _, keys, _ = links.keys_of([_record("XC1234567890", f"Nobody's {i}", f"Unheard Artist {i}") for i in range(50)], lambda x: np.zeros(len(x), dtype=bool))
    assert len(rows) == len(keys) == 0 and links.artist_of.cache_info().currsize == before


def test_distance_is_that_of_the_whole_table():
    def whole(a, b):
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 8))) for _ in range(2))
        for most in (1, 2, 3):
            assert min(links._distance(a, b, most), most + 1) == min(whole(a, b), most + 1), (a, b, most)


def test_latin_text_is_comparable_as_it_is():
    chars = [chr(i) for i in [*range(0x20, 0x250), *range(0x2010, 0x2020)]]
    same = [c for c in chars if links._AS_IT_IS.fullmatch(f"a{c}b")]
    assert len(same) > 500 and all(comparable(f"a{c}b") == f"a{c}b" for c in same)


def test_each_row_of_a_repeated_number_is_verified(spark):
    """Two rows under one number meet the same sheet; only one of them is its recording."""
    rows = [[(i, "Blue Harbour", "Bob Stonewell", None, 200.0), (i, "Blue Harbour", "Ann Stonewell", None, 200.0)] for i in range(1, 21)]
    c = spark.createDataFrame([x for i, pair in enumerate(rows) for x in (pair if i % 2 else pair[::-1])], CANDIDATE)
    s = spark.createDataFrame([(10, "Blue Harbour", "Stonewell, Ann", None, "3:20")], SHEET)
    assert sorted(tuple(r)[:2] for r in links.links(c, s).collect()) == [(i, 10) for i in range(1, 21)]

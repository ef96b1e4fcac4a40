"""Leaders of a whole batch against the ordered scan."""

from __future__ import annotations

import random

from refrain.operators import duplicates

COLUMNS = "track_id long, isrc string, title_artist string, duration double, fingerprint string, file_hash string"


def alike(a, b):
    _, i, t, d, f, h = a
    _, j, u, e, g, k = b
    if d is not None and e is not None and abs(d - e) > 3:
        return False
    if i is not None and i == j:
        return True
    return (f is not None and f == g or h is not None and h == k) and (t is not None and t == u or f is not None and g is not None)


def scan(rows):
    led, leaders = {}, []
    for r in sorted(rows):
        first = next((x for x in leaders if alike(x, r)), None)
        led[r[0]] = first[0] if first else r[0]
        leaders += [] if first else [r]
    return led


def test_every_signature_has_a_leader(spark):
    rows = [(1, "US1", "t", 148.0, None, None), (2, "US1", "t", 148.0, None, None), (3, None, "x", None, None, None), (4, None, "x", None, None, None), (5, None, None, 1.0, None, "h"), (6, None, None, 1.0, None, "h"), (7, "US2", "t", 9.0, None, None)]
    got = {r["track_id"]: (r["class_id"], r["leader"]) for r in duplicates.leader_of_each(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 3), 4: (3, 4), 5: (5, 5), 6: (5, 6), 7: (7, 7)}


def test_leaders_equal_the_scan(spark):
    pick = random.Random(5)
    some = lambda *x: pick.choice([None, *x])
    rows = [(i, some("A1", "B2", "C3", "D4"), some("t", "u", "v"), some(100.0, 102.0, 104.0, 150.0), some("f", "g", "h"), some("k", "l", "m")) for i in range(1, 200)]
    rows += [(1000 + r[0], *r[1:]) for r in rows[::3]]  # a third again as exact copies
    got = {r["track_id"]: r["leader"] for r in duplicates.leader_of_each(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == scan(rows)

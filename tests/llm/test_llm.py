"""Operators of the subpackage on small cases, against brute force and round trips."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from refrain.llm import genre_list, leaks, lookalikes, mojibake, name_variants, packing, recording_links, residue


def test_genres(spark):
    entries = spark.createDataFrame([(1, "Bossa Nova", "x"), (2, "Rhythm & Blues", "x"), (3, "Ska", "x"), (4, "Sea Shanty", "x"), (5, None, None)], "genre_id long, name string, value string")
    cases = {"bosa nova": 1, "Nova, Bossa": 1, "BossaNova": 1, "R&B": 2, "Genre: Soul > rhythm and bleus": 2, "(13)Ska": 3, "(13)": -1, "Podcast 3": -1, "Sea Shan": 4, "?": -1, "do not file": -1}
    rows = [(i, v) for i, v in enumerate(cases)] * 2 + [(90, None), (91, " "), (92, "Ska"), (93, "x" * 20000)]
    c = spark.createDataFrame([(i, v, "clash") for i, v in rows], "candidate_id long, genre string, value string")
    found = genre_list.cases(c, entries)
    assert found.count() == len(cases) + 1
    got = {r["value"]: r["genre_id"] for r in genre_list.map_values(found, entries).collect()}
    assert {v: got[v] for v in cases} == cases and got["x" * 20000] == -1
    assert {r["genre_id"] for r in genre_list.map_values(found, entries.limit(0)).collect()} == {-1}
    assert genre_list.map_values(found.limit(0), entries).count() == 0


LEXICON = frozenset("canção última brücke küche straße песня река řeka píseň güneş şarkı estación mañana niñez été".split())


@pytest.mark.parametrize("text", ["Última Canção", "Straße – Küche", "Песня – Река", "Řeka", "Güneş Şarkı", "Mañana", "夜明けの海", "شب روشن"])
@pytest.mark.parametrize("read_as", ["cp1252", "mac_roman", "cp437", "cp1251", "latin_1", "twice"])
def test_wrong_decoding_is_undone(text, read_as):
    raw = text.encode("utf-8")
    if read_as == "twice":
        bad = raw.decode("latin_1").encode("utf-8").decode("latin_1")
    else:
        bad = "".join(bytes([b]).decode(read_as, "ignore") or chr(b) for b in raw)
    new, path, gain = mojibake.search(bad, LEXICON)
    assert path and gain >= mojibake.MARGIN and new == text


@pytest.mark.parametrize("text", ["Última Canção", "Ærø Ørsted", "Čeněk Ďuriš", "ΑΒΓ δέλτα", "Don’t “go”", "½ Garden", "日本", "café", "R&B", "100%", "", "МАМА", "می‌روم", "plain"])
def test_correct_text_is_left(text):
    new, path, gain = mojibake.search(text, LEXICON)
    assert (not path or gain < mojibake.MARGIN) and not mojibake.lost(text)


def test_damaged_rows(spark):
    t = spark.createDataFrame([(1, "KÃ¼che", None, "Caf�", "clash")] * 2 + [(2, None, "", "ok", "x"), (3, "&eacute;t&eacute;", "x" * 50000, None, None)], "track_id long, current_title string, current_artist string, current_album string, value string")
    rows = mojibake.fields_of(t)
    got = {r["value"]: (r["restored"], r["damaged"]) for r in mojibake.restore(rows, LEXICON).collect()}
    assert got["KÃ¼che"] == ("Küche", True) and got["Caf�"][1] and got["&eacute;t&eacute;"] == ("été", True)
    assert mojibake.restore(rows.limit(0), LEXICON).count() == 0


@pytest.mark.parametrize("a, b", [("Ｓｔｉｌｌ", "Still"), ("Lu​mière", "Lumière"), ("Café́".replace("é", "e"), "Café"), ("a\xa0b", "a b"), ("Shadоws", "Shadows"), ("Νight", "Night"), ("ﬁre", "fire"), ("Зимa", "Зима"), ("K", "K"), ("آينه زیبا", "آینه زیبا")])
def test_lookalikes(spark, a, b):
    table = lookalikes.look_alikes(spark)
    assert lookalikes.comparable(a, frozenset({"зима"})) == b
    assert lookalikes.skeleton(a, table) == lookalikes.skeleton(b, table)


def test_the_table_is_unicodes(spark):
    table = lookalikes.look_alikes(spark)
    assert len(table) > 2000 and not any(c.isascii() for c in table)
    assert (table["а"], table["Ν"], table["ԁ"], table["ｅ"]) == ("a", "N", "d", "e")
    assert lookalikes.skeleton(None, table) is None and lookalikes.skeleton("", table) == "" and lookalikes.skeleton("a  b", table) == "a b"


@pytest.mark.parametrize("text", ["می‌روم", "Don’t – “x”", "½", "Зима Night", "Ωmega II".replace("Ω", "O"), "日本", "", None, "Última", "Пристаeь"])
def test_what_a_language_needs_stays(text):
    assert lookalikes.comparable(text) == text


def test_lookalike_rows(spark):
    v = spark.createDataFrame([("Shadоws", 2, "x"), ("plain", 1, "x"), (None, 1, "x"), ("", 1, "x"), ("KÃ¼che\xa0x", 1, "x"), ("Shadows", 1, "x")], "value string, n long, skeleton string")
    assert [(r["value"], r["form"], r["skeleton"]) for r in lookalikes.cases(v, LEXICON).collect()] == [("Shadоws", "Shadows", "Shadows")]
    assert lookalikes.cases(v.limit(0), LEXICON).count() == 0


def test_names(spark):
    same = [["Katherine Stone", "Stone, Katherine", "katherine  stone", "Kate Stone", "Katherine Stoen", "K. Stone", "Katherine M. Stone", "Катхерине Стоне"], ["Robert Stone", "Bob Stone"], ["The Grey Owls", "Grey Owls, The", "Te Grey Owls", "GREY OWLS"], ["Lark + Dove", "Dove and Lark", "Lark&Dove"], ["Fylo Quartet", "Fylo Qrt."]]
    rows = [(n, 1 + (i == 0)) for g in same for i, n in enumerate(g)] + [("Various Artists", 9), ("", 1), (None, 1), ("Katherine Stone", 3)]
    got: dict[str, set] = {}
    for r in name_variants.entities(spark.createDataFrame(rows, "value string, n_rows int")).collect():
        got.setdefault(r["entity"], set()).add(r["value"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, same))
    assert name_variants.entities(spark.createDataFrame([], "value string, n_rows int")).count() == 0


def test_one_apart_against_brute_force():
    rng = random.Random(1)

    def edits(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc"}
        return out | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)} | {w}

    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(2))
        assert name_variants.one_apart(a, b) == (b in edits(a))
        if name_variants.one_apart(a, b):
            assert set(name_variants.deletions(a)) & set(name_variants.deletions(b))
    assert name_variants.assigned(["ann", "stone"], ["stoen", "ann"]) and not name_variants.assigned(["anna", "stone"], ["annb", "stonf"])
    assert name_variants.assigned(["stoen"], ["ann", "stone"], "a") and not name_variants.assigned(["stone"], ["bea", "stone"], "a") and not name_variants.assigned(["stone"], ["stone"], "a")


def test_index_connects_all_that_are_one_apart(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abx") for _ in range(rng.randint(4, 6))) for _ in range(120)})
    names = [f"{w} stone" for w in words] + ["stone Abba", "Aleaxnder Stone", "Alexander Stone"]
    values = spark.createDataFrame([(n, 1) for n in names], "value string, n_rows long")
    nodes = name_variants.nodes_of(values).groupBy("id", "node").agg({"n_rows": "sum"}).withColumnRenamed("sum(n_rows)", "n_rows")
    edges = {tuple(sorted(r)) for r in name_variants.edges_of(nodes).collect()}
    tokens = {r["id"]: r["node"].split("|")[2:] for r in nodes.collect()}
    assert all(name_variants.assigned(tokens[a], tokens[b]) for a, b in edges)
    roots = {i: i for i in tokens}

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a, b in edges:
        roots[root(a)] = root(b)
    for a in tokens:
        for b in tokens:
            if name_variants.assigned(tokens[a], tokens[b]):
                assert root(a) == root(b), (tokens[a], tokens[b])


def test_recordings(spark):
    c = spark.createDataFrame([(1, "Blue Harbour", "Ann Stonewell", "XA1234567890", 200.0, None), (1, "Blue Harbour", "Ann Stonewell", "XA1234567890", 200.0, None), (2, "Blue Harbour [HQ]", "Ann Stonewell feat. Bo", None, None, 199.0), (3, "Blue Harbour (live)", "Ann Stonewell", None, 200.0, None), (4, "Blue Harbour", "Cy Other", None, 200.0, None), (5, "Blue Harbour", "Ann Stonewell", None, 290.0, None), (6, None, "Ann Stonewell", "XA1234567890", None, None), (7, "", "", None, None, None)], "candidate_id long, title string, artist string, isrc string, duration_s double, duration_delta double")
    s = spark.createDataFrame([(10, "BLUE HARBUOR", "Stonewell, A.", None, "3:20", 1), (11, "Blue Harbour", None, "xa-123-45-67890", "200000", 1), (12, "Blue Harbour - Live", "Ann Stonewell", None, None, 1), (13, None, None, None, None, 1), (10, "BLUE HARBUOR", "Stonewell, A.", None, "3:20", 2)], "sheet_id long, work_title string, performer string, code string, length string, delivered_at int")
    got = {(r["candidate_id"], r["sheet_id"]) for r in recording_links.links(c, s).collect()}
    assert got == {(1, 10), (2, 10), (1, 11), (3, 12)}
    assert recording_links.links(c, s.limit(0)).count() == 0 and recording_links.links(c.limit(0), s).count() == 0


@pytest.mark.parametrize("text, want", [("3:20", 200), ("00:03:20", 200), ("3'20\"", 200), ("PT3M20S", 200), ("200", 200), ("200000", 200), ("", None), (None, None), ("soon", None)])
def test_lengths(text, want):
    assert recording_links.seconds_of(text) == want


@pytest.mark.parametrize("capacity, high", [(512, 512), (512, 900), (2048, 700), (100, 60), (10, 10)])
def test_packing(capacity, high):
    rng = np.random.default_rng(capacity + high)
    sizes = np.minimum(capacity, rng.integers(1, high + 1, 3000))
    bins = packing.pack(sizes, capacity)
    load = np.bincount(bins, weights=sizes)
    assert (bins >= 0).all() and load.max() <= capacity and (load > 0).all()
    assert len(load) <= 1.06 * max(sizes.sum() / capacity, (sizes > capacity / 2).sum()) + 1
    assert (packing.pack(sizes, capacity) == bins).all() and len(packing.pack(sizes[:0], capacity)) == 0


def test_nnls():
    rng = np.random.default_rng(3)
    a, x = rng.random((20, 8)), np.maximum(0, rng.normal(size=8))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


def test_windows_hold_everything_once(spark):
    d = spark.createDataFrame([(1, 5), (2, 25), (3, 10), (4, 10)], "doc_id long, n_tokens long")
    rows = packing.windows(d, {7: 10}).collect()
    assert Counter((r["doc_id"], r["start"], r["n_tokens"]) for r in rows) == Counter([(1, 0, 5), (2, 0, 10), (2, 10, 10), (2, 20, 5), (3, 0, 10), (4, 0, 10)])
    assert len({r["bin"] for r in rows}) == 5
    assert packing.windows(d.limit(0), {7: 10}).count() == 0
    t = spark.createDataFrame([(1, "two words"), (1, "two words"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in packing.token_counts(t).collect()] == [1]
    with pytest.raises(ValueError):
        packing.windows(d, {1: 0})


PASSAGE = "According to the ledger of Drizy, 573 copies reached the port before winter. Each pressing from Kreh carries a mark scratched by hand into the groove."


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    index = leaks.Index([(1, PASSAGE), (2, None), (3, "")])
    first = leaks.sentences_of(PASSAGE)
    filler = "the of port mark winter by and copies ledger into a each".split()
    texts, want = [], []
    for _ in range(300):
        s = list(rng.choice(first))
        for _ in range(rng.randint(0, 3)):
            e, kind = rng.randrange(len(s)), rng.randrange(3)
            s[e : e + 1] = [[], ["quite"], [s[e], "quite"]][kind]
        t = [rng.choice(filler) for _ in range(rng.randint(0, 30))] + s + [rng.choice(filler) for _ in range(rng.randint(0, 30))]
        texts.append(t)
        want.append(any(leaks.one_edit(f, t[i : i + n]) for f in first for i in range(len(t)) for n in (len(f) - 1, len(f), len(f) + 1) if len(t[i : i + n]) == n))
    got = [bool(h) for h in index.leaks(texts)]
    assert sum(g and not w for g, w in zip(got, want)) == 0
    assert sum(w and not g for g, w in zip(got, want)) <= 0.01 * sum(want)
    d = spark.createDataFrame([(1, "x <b>According</b> to THE ledger of _Drizy_, 573 copies\n reached the port before winter"), (2, "according to the ledger of Drizy, 574 copies reached the port before winter"), (3, None), (4, ""), (1, "again")], "doc_id long, text string")
    assert [tuple(r) for r in leaks.leaks(d, [[(1, PASSAGE)], [(9, None)]]).collect()] == [(1, 1)]
    assert leaks.leaks(d, []).count() == 0


@pytest.mark.parametrize("text, bad", [
    ("Label: {{ label }}", True), ("Hello ${user.first}, your order has left", True), ("[Insert artist biography here]", True), ("TODO: write something about side B", True), ("Real text.\nYou need to enable JavaScript to run this app.", True),
    ("Lorem ipsum dolor sit amet nunc.", True), ("bla blah xxx xxxx text", True), ("504 Not Found", True), ('{"error": {"code": 429, "message": "x"}}', True), ("[!] Les paroles exige l'activation des scripts", True), ("Die Titelliste wurde entfernt", True), ("Single undefined by undefined", True),
    ("Home | Artists | Charts | Log in", False), ("I got error 500 from the catalogue 14 times, then it worked.", False), ("In the script, {{track}} expands to the track name, so do not type the brackets.", False), ("Check that JavaScript is enabled for the local page.", False), ("The lyric repeats the words page not found as its chorus.", False),
    ("Song [live] and [b]bold[/b] <h1>title</h1>", False), ("© 2009", False), ("", False), (None, False), ("A plain review. " * 5000, False),
])
def test_residue(text, bad):
    assert any(syntax or residue.strength(form) == 2 for form, syntax in residue.messages_of(text)) is bad


def test_residue_groups(spark, tmp_path):
    rows = [(1, "a", "Coming soon", "x"), (2, "b", "Please reload, our captcha broke", "x"), (3, "c", "please reload, our captcha broke!", "x"), (4, None, "Please reload, our captcha broke", "x"), (5, "a", "fine", "x"), (6, "a", None, "x"), (1, "a", "Coming soon", "x")]
    rows += [(7, "a", "Good.\nThe player failed to load - trace 77", "x"), (8, "b", "The lyrics failed to load", "x"), (9, "c", "Label: {{ label }}", "x"), (10, "a", "", "x"), (None, "a", "{{ x }}", "x")]
    rows += [(11, "a", "The liner notes is reserved", "x"), (12, "d", "lorem ipsum dolor sit amet nunc", "x"), (13, "e", "Ipsum amet ligula, mollis dolor quam.", "x")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, form string")
    got = {r["form"]: (r["n_documents"], r["n_sources"]) for r in residue.residue_groups(residue.messages(d)).collect()}
    assert got == {"please reload, our captcha broke": (3, 2), "⟨s⟩ failed to load": (2, 2), "⟨filler⟩": (2, 2)}
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r[0] for r in residue.found(spark, str(tmp_path)).collect()) == [2, 3, 4, 7, 8, 9, 12, 13]
    assert residue.residue_groups(residue.messages(d.limit(0))).count() == 0


def samples(pattern: str) -> list[str]:
    """Texts that a pattern matches, one or more for each of its branches."""
    import re._parser as sre

    def walk(items) -> list[str]:
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                parts = [chr(arg)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, _, inner = arg
                parts = [x * low for x in walk(inner)] if low else ["", *walk(inner)]
            elif name == "SUBPATTERN":
                parts = walk(arg[3])
            elif name == "BRANCH":
                parts = [x for branch in arg[1] for x in walk(branch)]
            elif name == "IN":
                kind, value = arg[0]
                parts = {"LITERAL": lambda: [chr(v) for k, v in arg if str(k) == "LITERAL"], "RANGE": lambda: [chr(value[0])], "CATEGORY": lambda: ["a" if "NOT" not in str(value) and "WORD" in str(value) else " "]}.get(str(kind), lambda: ["a"])()
            elif name in ("ANY", "NOT_LITERAL"):
                parts = ["a"]
            else:
                parts = [""]
            out = [a + b for a in out[:400] for b in dict.fromkeys(parts)]
        return list(dict.fromkeys(out))

    return walk(sre.parse(pattern))


def test_every_branch_of_every_rule_has_a_trigger():
    rules = [*residue._BEGINS, *residue._ANYWHERE, *residue._SYNTAX_BEGINS, *residue._SYNTAX_ANYWHERE, *(said for _, said in residue._NOTICES)]
    forgotten = [x for rule in rules for x in samples(rule) if not residue._may_hold(x.replace("⟨n⟩", "5").lower())]
    assert not forgotten, forgotten[:20]
    weak = [x for x in samples(residue._WEAK.pattern) if not residue._may_hold(x)]
    assert not weak, weak


def test_queries_run_on_small_tables(spark, sf):
    from refrain.llm import queries as q

    want = {"p1_found": ["candidate_id", "genre_id"], "p2_found": ["track_id", "field"], "p3_found": ["candidate_id", "sheet_id"], "p6_found": ["name_a", "name_b"], "p7_found": ["src", "row_id", "field"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    for name, columns in want.items():
        df = q.queries()[name](spark, sf)
        assert df.columns == columns and df.count() == df.distinct().count() > 0, name

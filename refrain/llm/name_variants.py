"""Variant spellings of names typed by people (problem 6).

Every stored value is read as tokens without case, accents, script, order, articles and joining
words; nicknames and trade abbreviations become their formal words. Values with equal tokens are one
node. A symmetric-delete index on the tokens finds nodes that are one edit apart in one token: a token
less one character meets that token itself (an added letter) and, where the same place was left out, other tokens
(a changed letter); two neighbours in either order meet too (a swap). Nodes that meet all under one key are one
edit apart, so each is linked to the key's most frequent node and no link is lost. Names with an initial or a shortened
given name meet full names under the initial and the other tokens less a character.

Every pair that meets is verified by an optimal assignment of its tokens, which permits one edit and one
initial or abbreviation; the connected nodes are one entity.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.io import cut, load
from refrain.llm import mojibake
from refrain.operators.packed_fields import dialects
from refrain.skew import spread_out

# Short forms of given names, by formal name.
NICKNAMES = {
    "Alexander": "Alex Sascha Sasha Sandro Aleksander", "Antonia": "Toni Tonia", "Augustin": "Gus Gustl", "Benjamin": "Ben Benny Benni", "Caroline": "Caro Carrie Lina", "Charlotte": "Charlie Lotte Lottie",
    "Christopher": "Chris Kit Topher Christofer", "Dimitri": "Dima Mitya Mitja", "Eduardo": "Edu Lalo", "Elizabeth": "Liz Betty Beth Lisa Lizzie", "Francesca": "Franka Cesca Fran Franzi", "Frederik": "Fred Rik Freddy Fritz",
    "Gabriela": "Gabi Gabby Ela", "Ingrid": "Inga Inge", "Isabella": "Bella Isa Izzy", "Jonathan": "Jon Johnny Jonny Nathan", "Josephine": "Jo Josie Josefine", "Katherine": "Kate Kathy Katie Kat Kitty", "Leonard": "Leo Len Lenny",
    "Ludmila": "Mila Luda Lyuda", "Margaret": "Peg Maggie Meg Peggy Greta", "Matthias": "Hias Matze Matt Mattias", "Maximilian": "Max Maxi", "Nikolai": "Nick Kolya Nik Niko", "Olga": "Olya Olja", "Oskar": "Ossi Ossie Oscar", "Philippa": "Pippa Pip",
    "Rebecca": "Becky Becca", "Robert": "Bob Rob Bobby Robbie Bert", "Samuel": "Sam Sammy", "Susanna": "Sue Susi Susie Susan", "Theodore": "Theo Ted Teddy", "Valentina": "Tina Valya Val", "Viktor": "Vitya Vic Vik", "Wilhelmina": "Mina Billie Minna Willa",
    "William": "Will Bill Billy Willy Liam", "Yasmin": "Yas Yasi", "Kenji": "Ken",
}
# Abbreviations of the trade, values that name no artist, and letters that do not decompose.
ABBREVIATIONS = {"coll": "collective", "cho": "choir", "ens": "ensemble", "orch": "orchestra", "bros": "brothers", "qrt": "quartet", "qt": "quartet", "bb": "brass band", "3": "trio", "soundsystem": "sound system", "brassband": "brass band"}
PLACEHOLDERS = {"unknown artist", "unknown", "various artists", "various", "va", "n/a", "na", "none", "null", "-", "?", "artist", "no artist", "untitled", "tba", "anonymous", "<unknown>", "[unknown]"}
LETTERS = {"ø": "o", "ł": "l", "ı": "i", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe"}
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщыэ", ["a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "j", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "ch", "sh", "sch", "y", "e"])) | {"ю": "yu", "я": "ya", "ь": "", "ъ": ""}
_NEARLY_THE = {"te", "th", "he", "teh", "hte", "thw", "thr", "tje", "tge", "rhe", "yhe", "thee", "tthe", "thhe", "ths", "thd"}
_CONNECT = {"&", "+", "and", "n", "und", "et", "y"}
#: Tokens shorter than this must be equal; longer ones may differ by one edit.
EDITABLE = 4


@lru_cache(maxsize=100_000)
def fold(token: str) -> str:
    """A token without case, accents and script, and with one letter for each group that scripts mix up."""
    t = "".join(LETTERS.get(c, CYRILLIC.get(c, c)) for c in unicodedata.normalize("NFC", token).lower())
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return t.replace("ph", "f").replace("x", "ks").replace("q", "k").replace("c", "k").replace("w", "v")


_FORMAL = {fold(n): fold(f) for f, names in NICKNAMES.items() for n in names.split()}
_EXPANDED = {fold(a) if a != "3" else a: [fold(x) for x in w.split()] for a, w in ABBREVIATIONS.items()}
_TOKENS = re.compile(r"[^\W\d_]+(?:['’`-][^\W\d_]+)*\.?|[&+]|\d+")


def read(value: str | None) -> tuple[str, list[str], str] | None:
    """(kind, full tokens sorted, given) of a single name: kind F for a full name, I for one whose given name is only ``given``.

    Null, blank and placeholders give None.
    """
    if value is None:
        return None
    text = " ".join(unicodedata.normalize("NFKC", value).split())
    if not text or text.lower().strip(" .") in PLACEHOLDERS:
        return None
    if m := re.fullmatch(r"([^,]+),\s*([^,]+)", text):
        text = f"{m.group(2)} {m.group(1)}"
    full: list[str] = []
    short: list[str] = []
    found = _TOKENS.findall(text)
    for i, t in enumerate(found):
        bare = t.rstrip(".")
        low = bare.lower()
        if low in _CONNECT and (len(bare) > 1 or not bare.isupper()) and 0 < i < len(found) - 1:
            continue
        if low == "the" or i == 0 and len(found) > 2 and low in _NEARLY_THE:
            continue
        f = bare if bare.isdigit() else fold(bare)
        if f in _EXPANDED and full:
            full.extend(_EXPANDED[f])
        elif len(bare) == 1:
            short.append(f)
        elif t.endswith(".") and len(bare) <= 4 and f not in _FORMAL.values():
            short.append(f)
        else:
            full.append(_FORMAL.get(f, f))
    if not full:
        return None
    first = found[0].rstrip(".")
    if short and (len(full) == 1 or fold(first) == short[0] and first.lower() not in _CONNECT):
        return "I", sorted(full), short[0]
    return "F", sorted(full), ""


def deletions(token: str) -> list[str]:
    """The token and all strings left after deleting one character."""
    return [token] if len(token) < EDITABLE else list(dict.fromkeys([token, *(token[:i] + token[i + 1 :] for i in range(len(token)))]))


def one_apart(a: str, b: str) -> bool:
    """Whether two tokens are equal or one edit (or one swap of neighbours) apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < EDITABLE - 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


def _token_cost(a: str, b: str, short_a: bool, short_b: bool) -> tuple[int, int] | None:
    """(edits, shortenings) that make two tokens one; None if nothing does."""
    if a == b:
        return 0, 0
    if short_a and b.startswith(a) or short_b and a.startswith(b):
        return 0, 1
    near = one_apart(a, b) or one_apart(a.replace("ks", "x"), b.replace("ks", "x"))
    return (1, 0) if near and not short_a and not short_b else None


def assigned(a: list[str], b: list[str], given_a: str = "", given_b: str = "") -> bool:
    """Whether the cheapest assignment of all tokens needs at most one edit and one initial or abbreviation.

    ``given_a``, ``given_b``: a shortened given name, which stands for any token that begins with it.
    Equal tokens are assigned to each other first, which never costs more.
    """
    left = [(t, False) for t in a] + ([(given_a, True)] if given_a else [])
    right = [(t, False) for t in b] + ([(given_b, True)] if given_b else [])
    if len(left) != len(right):
        return False
    for t in list(left):
        if t in right:
            left.remove(t)
            right.remove(t)
    if len(left) > 2:  # more than one edit and one shortening
        return False
    for order in itertools.permutations(right):
        costs = [_token_cost(x, y, sx, sy) for (x, sx), (y, sy) in zip(left, order)]
        if None not in costs and sum(c[0] for c in costs) <= 1 and sum(c[1] for c in costs) <= 1:
            return True
    return False


def nodes_of(values: DataFrame) -> DataFrame:
    """(value, n_rows, kind, node, given, id) of each ``value`` that names someone; ``node`` is kind, given and the tokens, ``id`` its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, n, r[0], "|".join([r[0], r[2], *r[1]]), r[2]) for v, n in zip(b["value"], b["n_rows"]) if (r := read(v))]
            yield pd.DataFrame(rows, columns=["value", "n_rows", "kind", "node", "given"])

    out = spread_out(values.groupBy("value").agg(F.sum("n_rows").alias("n_rows")), "value").mapInPandas(run, "value string, n_rows long, kind string, node string, given string")
    return out.withColumn("id", F.xxhash64("node"))


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def _token_keys(rest: str, t: str) -> Iterator[tuple[str, int]]:
    if len(t) >= EDITABLE - 1:
        yield "o", _hash(rest, t)
    if len(t) >= EDITABLE:
        for at in range(len(t)):
            yield "g", _hash(rest, "*", t[:at], t[at + 1 :])
            if not at or t[at] != t[at - 1]:
                yield "d", _hash(rest, t[:at] + t[at + 1 :])
                if at:
                    yield "g", _hash(rest, "x", t[: at - 1], *sorted(t[at - 1 : at + 1]), t[at + 1 :])


def keys_of(tokens: list[str], given: str) -> Iterator[tuple[str, int]]:
    """(kind of key, key) of a node: ``g`` for groups whose members are all one edit apart, ``d`` for a token less a character, ``o`` for a whole token."""
    for i, token in enumerate(tokens):
        rest = "|".join([given, *tokens[:i], *tokens[i + 1 :]])
        for t in {token, token.replace("ks", "x")}:  # as written with one letter or two
            yield from _token_keys(rest, t)


def _index(nodes: DataFrame) -> DataFrame:
    """(kind, key, id, n_rows) of the symmetric-delete index of all nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, key, i, n) for node, i, n in zip(b["node"], b["id"], b["n_rows"]) for k, key in keys_of(node.split("|")[2:], node.split("|")[1])]
            yield pd.DataFrame(rows, columns=["kind", "key", "id", "n_rows"])

    return spread_out(nodes.select("node", "id", "n_rows"), "id").mapInPandas(run, "kind string, key long, id long, n_rows long")


@F.pandas_udf(T.BooleanType())
def _assigned(a: pd.Series, b: pd.Series) -> pd.Series:
    """assigned() of two nodes."""
    out = []
    for x, y in zip(a, b):
        x, y = x.split("|"), y.split("|")
        out.append(assigned(x[2:], y[2:], x[1], y[1]))
    return pd.Series(out, dtype=bool)


def edges_of(nodes: DataFrame) -> DataFrame:
    """(a, b): ids of nodes that are one edit apart in one token, as far as they are needed to connect all that are."""
    index = cut(_index(nodes))
    together = index.where("kind = 'g'")
    hubs = together.groupBy("key").agg(F.max(F.struct("n_rows", "id")).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", F.col("h.id").alias("b"))
    met = together.join(hubs, "key").select(F.col("id").alias("a"), "b")
    less = index.where("kind = 'd'").join(index.where("kind = 'o'").select("key", F.col("id").alias("b")), "key").select(F.col("id").alias("a"), "b")
    pairs = met.unionByName(less).where("a <> b").distinct()
    names = nodes.select("id", "node")
    both = pairs.join(names.select(F.col("id").alias("a"), F.col("node").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("node").alias("y")), "b")
    return both.where(_assigned("x", "y")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all nodes with an edge: least labels spread and pointers jump until nothing changes; lineage is cut each round."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "root", F.least("root", "near").alias("to"))
        jump = cut(step.join(labels.select(F.col("id").alias("to"), F.col("root").alias("then")), "to").select("id", F.col("root").alias("was"), F.least("to", "then").alias("root")))
        labels = jump.select("id", "root")
        if jump.where(F.col("was") != F.col("root")).isEmpty():
            return labels


def attach(shorts: DataFrame, fulls: DataFrame) -> DataFrame:
    """(id, root) of names with a shortened given name: the entity of the one full name they fit, the most frequent if several do.

    Both have node, id, root and n_rows. Other tokens that are equal go before such that are one edit apart.
    """

    def keys(short: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for node, root, i, n in zip(b["node"], b["root"], b["id"], b["n_rows"]):
                    _, given, *tokens = node.split("|")
                    firsts = [(given, tokens)] if short else [(t, tokens[:k] + tokens[k + 1 :]) for k, t in enumerate(tokens)] if len(tokens) > 1 else []
                    for first, rest in firsts:
                        met = {_hash(first[:1], *rest[:k], d, *rest[k + 1 :]) for k, t in enumerate(rest) for d in deletions(t)}
                        rows.extend((k, node, "|".join(rest), root, i, n) for k in met)
                yield pd.DataFrame(rows, columns=["key", "node", "rest", "root", "id", "n_rows"])

        return run

    shape = "key long, node string, rest string, root long, id long, n_rows long"
    full = fulls.select("node", "root", "id", "n_rows").mapInPandas(keys(False), shape).select("key", F.col("node").alias("full"), F.col("rest").alias("full_rest"), F.col("root").alias("full_root"), F.col("id").alias("full_id"), F.col("n_rows").alias("full_rows"))
    short = shorts.select("node", "root", "id", "n_rows").mapInPandas(keys(True), shape)
    met = short.join(full, "key").select("id", "node", "full", "full_root", "full_id", "full_rows", (F.col("rest") == F.col("full_rest")).cast("int").alias("same"))
    each = met.groupBy("id", "node", "full", "full_root", "full_id", "full_rows").agg(F.max("same").alias("same")).where(_assigned("node", "full"))
    by_root = each.groupBy("id", "full_root").agg(F.max("same").alias("same"), F.sum("full_rows").alias("n_rows"))
    return by_root.groupBy("id").agg(F.max(F.struct("same", "n_rows", "full_root")).alias("b")).select("id", F.col("b.full_root").alias("full_root"))


def entities(values: DataFrame) -> DataFrame:
    """(value, entity) of each distinct ``value`` (with its ``n_rows``) that names someone; nulls, blanks and placeholders give no row."""
    named = cut(nodes_of(values))
    nodes = cut(named.groupBy("id", "kind", "node").agg(F.sum("n_rows").alias("n_rows")))
    linked = cut(nodes.join(components(edges_of(nodes)), "id", "left").withColumn("root", F.coalesce("root", "id")))
    fulls, shorts = linked.where("kind = 'F'"), linked.where("kind = 'I'")
    placed = cut(shorts.join(attach(shorts, fulls), "id", "left"))
    # shortened names that are linked to each other go where the first of them goes that fits a full name
    own = placed.groupBy("root").agg(F.min("full_root").alias("group_root"))
    entity = F.coalesce("full_root", "group_root", "root")
    all_nodes = fulls.select("id", F.col("root").alias("entity")).unionByName(placed.join(own, "root").select("id", entity.alias("entity")))
    return named.select("value", "id").join(all_nodes, "id").select("value", "entity")


def stored_names(spark: SparkSession, folder: str) -> DataFrame:
    """(value, n_rows, in_tracks) of all stored values of the three fields."""
    c, t = load(spark, folder, "candidates"), load(spark, folder, "tracks")
    parts = [c.select(F.col("artist").alias("value"), F.lit(0).alias("t")), c.select(F.col("album_artist").alias("value"), F.lit(0).alias("t")), t.select(F.col("current_artist").alias("value"), F.lit(1).alias("t"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("value").isNotNull())
    return rows.groupBy("value").agg(F.count("*").alias("n_rows"), F.max("t").alias("in_tracks"), F.min("t").alias("only_tracks"))


def single_names(spark: SparkSession, folder: str) -> DataFrame:
    """(value, n_rows) of the stored values that hold one name: without values of several artists and damaged ones."""
    names = cut(stored_names(spark, folder))
    several = dialects(names.select(F.lit("artist").alias("field"), "value")).where("n > 1").select("value")
    lexicon = mojibake.learn_lexicon(load(spark, folder, "candidates").select(F.col("title").alias("text")))
    damaged = mojibake.restore(names.where("only_tracks = 1").select("value"), lexicon).where("damaged").select("value")
    return names.join(several.unionByName(damaged).distinct(), "value", "left_anti").select("value", "n_rows")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p6_found: every pair of different stored values that name the same single artist.

    The pairs are asked for as such; they are pairs of distinct spellings within one entity.
    """
    e = cut(entities(single_names(spark, folder)))
    a, b = e.select("entity", F.col("value").alias("name_a")), e.select("entity", F.col("value").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")


def classes(spark: SparkSession, folder: str) -> DataFrame:
    """p6_entities: each stored single name with its entity and the entity's number of spellings."""
    e = cut(entities(single_names(spark, folder)))
    return e.join(e.groupBy("entity").agg(F.count("*").alias("n_spellings")), "entity").select("value", "entity", "n_spellings")

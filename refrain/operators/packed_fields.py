"""Several values packed in one field (problem 4): the cheapest dialect by minimum description length.

A dialect says how a field is cut: by which delimiter, with which quoting, and at which joining
words. Every field is parsed by each dialect that can apply. A parse costs the code lengths of its
values: a value seen alone elsewhere has the code of its frequency, any other is spelled out after
the code of its shape (its pattern of words and signs). Frequencies and shapes are counted over
all distinct field values that can be read in one way only; they stay distributed, and the few
frequent shapes, at most ``1 / SHAPE_SHARE``, are all that is broadcast.

At joining signs a name may or may not be cut. As the cost is a sum over values, the cheapest choice
of cuts is found exactly, by dynamic programming over the signs of each piece, however many there are.
"""

from __future__ import annotations

import csv
import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.io import cut, load
from refrain.skew import hot_keys, spread_join, spread_out

FIELDS = ("artist", "composer", "release_secondary_types")
#: Bits of announcing a value that is spelled out, of a character, of a shape that is not frequent, and of a cut.
ESCAPE, CHARACTER, RARE_SHAPE, CUT = 6.0, 4.5, 16.0, 1.0
#: Share of all values from which a shape is frequent.
SHAPE_SHARE = 5e-4
#: Distinct fields in which a value with a joining sign must stand to be known as one.
RECURS = 3

# Delimiters that only part values, and the signs and words that part values or join a name.
_PLAIN = (("newline", r"\s*\n\s*"), ("semicolon", r"\s*[;؛]+\s*"), ("bar", r"\s*\|+\s*"), ("slashes", r"\s*//\s*"), ("backslashes", r"\s*\\{1,2}\s*"), ("bullet", r"\s*[·•、،]\s*"), ("tab", r"\s*\t\s*"))
# a comma before a last article turns a name around, it parts nothing
_COMMA = r"\s*,(?!\s*(?:[Tt]he|THE|[Dd]ie|[Dd]er|[Dd]as|[Ll]es|[Ll]os|[Ll]as)\s*$)\s*"
_UNSURE = (("spaced slash", r"\s+/\s+"), ("slash", r"\s*/\s*"), ("comma", _COMMA), ("cross", r"\s+[x×]\s+"), ("mixed", r"\s*[;؛|,،]+\s*"))
_GUEST = re.compile(r"\s*[(\[]\s*(?:feat\.?|ft\.?|featuring|with)\s+(?P<inner>[^)\]]+)[)\]]\s*$|\s+(?:feat\.?|ft\.?|featuring)\s+(?P<rest>.+)$", re.I)
_JOIN = re.compile(r"\s+(?:&|\+|and|und|et|y)\s+|\s*[&+]\s*")
_MAYBE = r"[;؛،|/\\·•、\n\t,&+\[{(\"]|\s(?:[x×]|and|und|et|y|feat\.?|ft\.?|featuring)\s"
_MAYBE_PY = re.compile(_MAYBE, re.I)


_QUOTED = re.compile(r'"(?:[^"]|"")*"')
_WHOLLY_QUOTED = re.compile(r'"((?:[^"]|"")*)"')


def _split_outside(text: str, pattern: str) -> list[str]:
    """``text`` cut at ``pattern`` outside double quotes."""
    if '"' not in text:
        return re.split(pattern, text)
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group(0))
        return f"\ue000{len(held) - 1}\ue001"

    return [re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m.group(1))], p) for p in re.split(pattern, _QUOTED.sub(hold, text))]


def _bare(piece: str) -> tuple[str, bool]:
    """A piece without outer spaces and quoting, and whether it was quoted."""
    p = piece.strip()
    if len(p) > 1 and (m := _WHOLLY_QUOTED.fullmatch(p)):
        return m.group(1).replace('""', '"').strip(), True
    return p, False


def _clean(pieces: list[str]) -> list[tuple[str, bool]]:
    return [b for p in pieces if (b := _bare(p))[0]]


def _places(piece: str, quoted: bool) -> list[tuple[int, int]]:
    """Begin and end of each joining sign of an unquoted piece that stands between other text."""
    if quoted:
        return []
    held = [m.span() for m in _QUOTED.finditer(piece)] if '"' in piece else []
    return [m.span() for m in _JOIN.finditer(piece) if m.start() and m.end() < len(piece) and not any(a < m.start() < b for a, b in held)]


def _segments(piece: str, places: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int, str]]:
    """(i, j, value) of what stands from the i-th cut to the j-th, with at most ``most`` joining signs inside."""
    begins, ends = [0, *(b for _, b in places)], [*(a for a, _ in places), len(piece)]
    for i, b in enumerate(begins):
        for j in range(i, min(len(ends), i + most + 1)):
            yield i, j, _bare(piece[b : ends[j]])[0].strip(" ,")


def sure_parse(value: str) -> list[str] | None:
    """The values of a field that can be read in one way only (an array, a list by plain delimiters); None for others."""
    v = value.strip()
    if v[:1] == "[" and v[-1:] == "]":
        try:
            parsed = json.loads(v)
            return [s for x in parsed if (s := str(x).strip())] if isinstance(parsed, list) and all(isinstance(x, str) for x in parsed) else None
        except ValueError:
            return None
    if v[:1] == "{" and v[-1:] == "}":
        return [s for x in next(csv.reader([v[1:-1]], skipinitialspace=True), []) if (s := x.strip())]
    for _, pattern in _PLAIN:
        pieces = _clean(_split_outside(v, pattern))
        if len(pieces) > 1 or len(pieces) == 1 and pieces[0][0] != v and pattern.startswith(r"\s*[;"):
            return [p for p, _ in pieces]
    return None


def layouts(value: str) -> Iterator[tuple[str, list[tuple[str, bool]]]]:
    """(dialect, pieces) of every dialect that can apply to ``value``; the first takes it whole, pieces of others may be cut on at joining signs."""
    v = value.strip()
    yield "whole", [(b, True)] if (b := _bare(v)[0]) else []
    if v[:1] in "[{" and (sure := sure_parse(v)) is not None:
        yield "array", [(p, True) for p in sure]
        return
    for name, pattern in (("none", None), *_PLAIN, *_UNSURE):
        if pattern is None:
            pieces = [(v, False)]
        elif re.search(pattern, v) and (name != "mixed" or len(set(re.findall("[;؛|,،]", v))) > 1):
            pieces = _clean(_split_outside(v, pattern))
        else:
            continue
        if name in ("none", "comma", "cross") and (m := _GUEST.search(v)):
            main, guests = v[: m.start()], m.group("inner") or m.group("rest")
            for on_main, on_guests in ((None, None), (None, r"\s*,\s*"), (r"\s*,\s*", r"\s*,\s*")):
                a = _clean(_split_outside(main, on_main) if on_main else [main])
                b = _clean(_split_outside(guests, on_guests) if on_guests else [guests])
                yield f"guests{on_main is not None:d}{on_guests is not None:d}", a + b
        else:
            yield name, pieces


_SHAPE_TOKEN = re.compile(r"[^\W\d_](?=\.)|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|\S")
_KEPT = {"and", "und", "et", "y", "x", "feat", "ft", "featuring", "with", "n", "the"}


def shape_of(value: str) -> str:
    """The pattern of a value: W for a word, 9 for a number, signs and joining words as they are."""
    out = []
    for m in _SHAPE_TOKEN.finditer(value):
        t = m.group(0)
        out.append("W" if t[0].isalpha() and t.lower() not in _KEPT else "9" if t[0].isdigit() else t.lower())
    return " ".join(out)


def code_of(field: str, value: str) -> int:
    """A 64-bit name of a value of a field."""
    return int.from_bytes(hashlib.blake2b(f"{field}\u0001{value}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _evidence(values: DataFrame) -> DataFrame:
    """(field, code, shape, signs) of all values in fields that can be read in one way only, once for each distinct field value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for field, v in zip(b["field"], b["value"]):
                pieces = [v.strip()] if not _MAYBE_PY.search(v) else sure_parse(v)
                rows.extend((field, code_of(field, p), shape_of(p), len(_places(p, False))) for p in pieces or () if '"' not in p and not re.search(r"\s(?:feat\.?|ft\.?|featuring)\s|\(with ", p))
            yield pd.DataFrame(rows, columns=["field", "code", "shape", "signs"])

    return values.mapInPandas(run, "field string, code long, shape string, signs int")


def _lookups(values: DataFrame, most: int) -> DataFrame:
    """(id, code) of each value that some parse of a field value holds and that has at most ``most`` joining signs, as no known value has more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids: list[bytes] = []
            codes: list[int] = []
            for i, field, v in zip(b["id"], b["field"], b["value"]):
                asked = {x for n, (_, pieces) in enumerate(layouts(v)) for p, quoted in pieces for _, _, x in (_segments(p, _places(p, quoted), most) if n else ((0, 0, p),)) if x}
                if len(asked) > 1:
                    ids.extend([i] * len(asked))
                    codes.extend(code_of(field, x) for x in asked)
                if len(ids) > 50_000:
                    yield pd.DataFrame({"id": ids, "code": codes})
                    ids, codes = [], []
            yield pd.DataFrame({"id": ids, "code": np.array(codes, dtype=np.int64)})

    return values.mapInPandas(run, "id binary, code long")


def cheapest(field: str, value: str, bits: dict[int, float], shapes: dict[tuple[str, str], float], most: int) -> tuple[float, int, str, list[str]]:
    """(cost, number of values, dialect, values) of the cheapest parse; ties go to fewer values, then to the earlier dialect."""

    prices: dict[str, float] = {"": 0.0}

    def price(x: str) -> float:
        if (c := prices.get(x)) is None:
            spelled = ESCAPE + CHARACTER * len(x) + shapes.get((field, shape_of(x)), RARE_SHAPE)
            c = prices[x] = (min(spelled, bits.get(code_of(field, x), spelled)) if bits else spelled) + CUT
        return c

    best = None
    for name, pieces in layouts(value):
        cost, values = 0.0, []
        for p, quoted in pieces:
            places = _places(p, quoted)
            if not places:
                x = p if quoted else _bare(p)[0].strip(" ,")
                cost += price(x)
                values += [x] if x else []
                continue
            n = len(places) + 1
            costs: dict[tuple[int, int], tuple[float, str]] = {(i, j): (price(x), x) for i, j, x in _segments(p, places, most)}
            begins, ends = np.array([0, *(b for _, b in places)]), np.array([*(a for a, _ in places), len(p)])
            upto: list[tuple[float, int, int]] = [(0.0, 0, 0)]
            for j in range(n):
                options = [(round(upto[i][0] + costs[i, j][0], 6), upto[i][1] + bool(costs[i, j][1]), i) for i in range(max(0, j - most), j + 1)]
                if j > most:  # longer values than any known one can only be spelled out
                    far = np.array([u[0] for u in upto[: j - most]]) + CUT + ESCAPE + RARE_SHAPE + CHARACTER * (ends[j] - begins[: j - most])
                    i = int(np.argmin(far))
                    options.append((round(float(far[i]), 6), upto[i][1] + 1, i))
                upto.append(min(options))
            cost += upto[n][0]
            found, j = [], n
            while j:
                i = upto[j][2]
                x = costs[i, j - 1][1] if (i, j - 1) in costs else p[begins[i] : ends[j - 1]].strip(" ,")
                found += [x] if x else []
                j = i
            values += reversed(found)
        if values and (best is None or (round(cost, 4), len(values)) < best[:2]):
            best = (round(cost, 4), len(values), name, values)
    return best or (0.0, 0, "whole", [])


def _identity(field: F.Column, value: F.Column) -> F.Column:
    """A 128-bit name of a field value, for joins without the text."""
    return F.unhex(F.md5(F.concat_ws("\u0001", field, value)))


def fields_of(frame: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, field, value), a row for each non-blank field."""
    f = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])).alias("f")
    return frame.select(key, f).select(key, "f.field", "f.value").where(F.col("value").isNotNull() & (F.trim("value") != ""))


def dialects(rows: DataFrame) -> DataFrame:
    """(id, field, value, n, dialect, pieces) of the cheapest parse of every distinct value in which a delimiter occurs.

    ``rows`` has field and value. Ties go to the parse with fewer values, then to the earlier dialect. Values
    without any delimiter are left out: they are whole. An empty table gives an empty result.
    """
    distinct = rows.select("field", "value").distinct()
    evidence = _evidence(distinct)
    counted = evidence.groupBy("field", "code").agg(F.count("*").alias("c"), F.min("shape").alias("shape"), F.min("signs").alias("signs"))
    # what holds a joining sign is a name only if it recurs: else it may be the tail of a list
    counted = cut(counted.where((F.col("c") >= RECURS) | ~F.col("shape").rlike(r"[&+,]|\b(?:and|und|et|y|x)\b")))
    by_shape = counted.groupBy("field", "shape").agg(F.sum("c").alias("c"), F.max("signs").alias("signs"))
    known = by_shape.groupBy("field").agg(F.sum("c").alias("c"), F.max("signs").alias("signs")).collect()  # a row a field
    totals, most = {r["field"]: r["c"] for r in known}, max((r["signs"] for r in known), default=0)
    total = F.coalesce(*[F.when(F.col("field") == k, F.lit(float(v))) for k, v in totals.items()], F.lit(1.0))
    # a shape is frequent from SHAPE_SHARE on, so at most 1 / SHAPE_SHARE of them a field come to the driver
    frequent = by_shape.where(F.col("c") >= total * SHAPE_SHARE).collect()
    shapes = {(r["field"], r["shape"]): -math.log2(r["c"] / totals[r["field"]]) for r in frequent}
    codes = counted.select("code", (-F.log2(F.col("c") / (total + 1))).cast("float").alias("bits"))

    unsure = distinct.where(F.col("value").rlike("(?i)" + _MAYBE)).withColumn("id", _identity(F.col("field"), F.col("value")))
    asked = _lookups(spread_out(unsure.select("id", "field", "value"), "id"), most)
    told = spread_join(asked, codes, ["code"], ["id"], salts=4).groupBy("id").agg(F.collect_list(F.struct("code", "bits")).alias("codes"))  # the parts of one value
    shared = rows.sparkSession.sparkContext.broadcast(shapes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = shared.value
        for b in batches:
            out = []
            for i, f, v, c, x in zip(b["id"], b["field"], b["value"], b["code"], b["bits"]):
                _, n, dialect, pieces = cheapest(f, v, {} if c is None else dict(zip(c.tolist(), x.tolist())), shape, most)
                out.append((i, f, v, n, dialect, pieces))
            yield pd.DataFrame(out, columns=["id", "field", "value", "n", "dialect", "pieces"])

    parsed = unsure.join(told, "id", "left").select("id", "field", "value", F.col("codes.code").alias("code"), F.col("codes.bits").alias("bits"))
    return parsed.mapInPandas(run, "id binary, field string, value string, n int, dialect string, pieces array<string>")


def unpack(frame: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, field, pos, value): the values of all fields that hold two or more, positions from 1.

    Null and blank fields give no row; a repeated row of ``frame`` gives its rows once. Any
    further columns are ignored.
    """
    rows = fields_of(frame, key, fields)
    pieces = dialects(rows).where("n > 1").select("id", "pieces")
    held = rows.where(F.col("value").rlike("(?i)" + _MAYBE)).select(key, "field", _identity(F.col("field"), F.col("value")).alias("id"))
    hot = hot_keys(held, ["id"])
    return spread_join(held, pieces, ["id"], [key], hot=hot, distinct=True).select(key, "field", F.posexplode("pieces").alias("pos", "value")).select(key, "field", (F.col("pos") + 1).cast("long").alias("pos"), "value")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p4_found: all values of every field that holds two or more."""
    return unpack(load(spark, folder, "candidates"), "candidate_id")


def report(spark: SparkSession, folder: str) -> DataFrame:
    """p4_dialects: how many distinct field values each dialect reads, by field."""
    rows = dialects(fields_of(load(spark, folder, "candidates"), "candidate_id"))
    return rows.groupBy("field", "dialect").agg(F.count("*").alias("n_values"))

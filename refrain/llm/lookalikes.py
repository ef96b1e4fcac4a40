"""Visually identical text made of different characters (problem 7).

The skeleton of a text is its decomposition with every character replaced by its prototype from
the look-alike table and decomposed again; texts that look the same have one skeleton. The table is
Unicode's list of confusable characters, which Spark's own ICU library holds (``look_alikes``). All
originals are grouped by skeleton, and each group has a usual form. An original that the skeleton changes and
that differs from the usual form is a case.

What a language needs is no case: the forms of a group are its originals in the comparable form, in which
letters are only exchanged inside a word whose other letters are of another script, joiners stay inside
Persian words, and typographic quotes, dashes and signs such as ½ stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.io import cut, load
from refrain.llm import mojibake
from refrain.skew import hot_keys, spread_join, spread_out

SOURCES = (("candidates", "candidate_id", "title"), ("tracks", "track_id", "current_title"), ("tracks", "track_id", "filename"))
# Letters that look like Latin ones, and the Latin prototype of each.
CYRILLIC = dict(zip("аеорсхуіѕјһԁԛԝгАВЕЗКМНОРСТХІЅЈУ", "aeopcxyisjhdqwrAB" "E3KMHOPCTXISJY"))
CYRILLIC.pop("г"), CYRILLIC.pop("З")
GREEK = dict(zip("οανρυικχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpuikxABEZHIKMNOPTYX"))
# Arabic letters that look like Persian ones, and the Persian letter of each.
PERSIAN = {"ي": "ی", "ك": "ک", "ى": "ی"}
_PERSIAN_ONLY = set("پچژگکی")
_TO_LATIN = CYRILLIC | GREEK
_TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()} | {"ë": "ё", "Ë": "Ё"}
_WORD = re.compile(r"(?:(?![½¼¾²³¹ªº])[^\W\d_]|[̀-ͯ])+(?:[’'](?:[^\W\d_]|[̀-ͯ])+)*")


@lru_cache(maxsize=8192)
def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "LATIN"
    name = unicodedata.name(c, "?").split(" ", 1)[0]
    return {"CJK": "HAN", "HIRAGANA": "HAN", "KATAKANA": "HAN", "KATAKANA-HIRAGANA": "HAN"}.get(name, name)


@lru_cache(maxsize=8192)
def _plain(c: str) -> str:
    """A character without its presentation: width, ligature, mathematical or positional form; other characters as they are."""
    o = ord(c)
    if 0xFF10 <= o <= 0xFF19 or 0xFF21 <= o <= 0xFF3A or 0xFF41 <= o <= 0xFF5A or 0xFF66 <= o <= 0xFF9D or 0xFB00 <= o <= 0xFB06 or 0x1D400 <= o <= 0x1D7FF or 0x2160 <= o <= 0x217F or 0xFB50 <= o <= 0xFDFB or 0xFE70 <= o <= 0xFEFC or o in (0x2126, 0x212A, 0x212B):
        return unicodedata.normalize("NFKC", c)
    return c


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """The prototype of every character beyond ASCII that looks like others: the ASCII character of its kind, else what Unicode's table has.

    Read from ICU in one call on the driver; a fixed table, whatever the data's size.
    """
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    chars = [c for c in map(chr, (*range(0x20, 0xD800), *range(0xF900, 0x30000))) if unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc")]
    prototypes = dict(zip(chars, checker.getSkeleton("\n".join(chars)).split("\n")))
    ascii_of: dict[str, list[str]] = {}
    for c in map(chr, range(0x20, 0x7F)):
        ascii_of.setdefault(prototypes[c], []).append(c)
    kind = lambda c: (c.isalpha(), c.isupper(), c.isdigit())
    table = {}
    for c, p in prototypes.items():
        if c > "\x7f" and p != unicodedata.normalize("NFD", c):
            table[c] = next((x for x in ascii_of.get(p, ()) if kind(x) == kind(c)), p)
    return table | _TO_LATIN


def skeleton(text: str | None, table: dict[str, str]) -> str | None:
    """Decomposed, each character by its prototype, decomposed again; marks that show nothing are left out. Null gives null."""
    if text is None or text.isascii():
        return text if text is None else " ".join(text.split())
    first = unicodedata.normalize("NFD", text)
    swapped = "".join(table.get(c) or _plain(c) for c in first if unicodedata.category(c) != "Cf")
    return " ".join(unicodedata.normalize("NFD", swapped).split())


def _one_script(word: str, lexicon: frozenset[str]) -> str:
    """``word`` with look-alike letters exchanged for those of the script that the word is in."""
    if word.isascii():
        return word
    scripts = {_script(c) for c in word if c.isalpha()}
    if "ARABIC" in scripts and any(c in PERSIAN for c in word):
        swapped = "".join(PERSIAN.get(c, c) for c in word)
        if swapped in lexicon or any(c in _PERSIAN_ONLY for c in word):
            return swapped
    foreign = scripts & {"CYRILLIC", "GREEK"}
    if not foreign or len(scripts) < 2:
        return word
    if all(c in _TO_LATIN for c in word if _script(c) in foreign):
        latin = "".join(_TO_LATIN.get(c, c) for c in word)
        if scripts - foreign - {"LATIN"} or "CYRILLIC" not in foreign:
            return latin
        cyrillic = "".join(_TO_CYRILLIC.get(c, c) for c in word)
        return cyrillic if cyrillic.lower() in lexicon and latin.lower() not in lexicon else latin
    if foreign == {"CYRILLIC"} and scripts == {"LATIN", "CYRILLIC"} and all(c in _TO_CYRILLIC for c in word if _script(c) == "LATIN"):
        cyrillic = "".join(_TO_CYRILLIC.get(c, c) for c in word)
        mistyped = [c for c in word if _script(c) == "LATIN"]
        if len(mistyped) == 1 and mistyped[0] == "e" and cyrillic.lower() not in lexicon:
            return word  # a slip of the finger, not a look-alike
        return cyrillic
    return word


def comparable(text: str | None, lexicon: frozenset[str] = frozenset()) -> str | None:
    """The one form of ``text`` for comparisons; null gives null, ASCII text is returned as it is."""
    if text is None or text.isascii():
        return text
    out = []
    for i, c in enumerate(text):
        category = unicodedata.category(c)
        if category == "Cf":
            joins = c in "‌‍" and 0 < i < len(text) - 1 and _script(text[i - 1]) == "ARABIC" == _script(text[i + 1])
            if joins:
                out.append(c)
        elif category == "Zs":
            out.append(" " if c != "　" or not (i and _script(text[i - 1]) == "HAN") else c)
        else:
            wide = "\uff01" <= c <= "\uff5e" and not (i and _script(text[i - 1]) == "HAN")
            out.append(unicodedata.normalize("NFKC", c) if wide else _plain(c))
    plain = unicodedata.normalize("NFC", "".join(out))
    persian = any(c in _PERSIAN_ONLY for c in plain)
    if persian and any(c in PERSIAN for c in plain):
        plain = "".join(PERSIAN.get(c, c) for c in plain)
    return _WORD.sub(lambda m: _one_script(m.group(0), lexicon), plain)


def _letters(text: str) -> list[str]:
    """The characters of ``text`` decomposed, each by its Latin prototype if it has one."""
    return [_TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", text)]


def _n_scripts(text: str) -> int:
    """How many of Latin, Cyrillic and Greek ``text`` is written in."""
    return len({_script(c) for c in text if c.isalpha()} & {"LATIN", "CYRILLIC", "GREEK"})


_FOREIGN = r"[^\x00-\x7f]"


def originals(values: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """(value, n, skeleton, form, scripts, changed) of each distinct ``value`` with its rows ``n``; null values are left out.

    ``form``: the comparable form; ``changed``: whether the skeleton differs from the value, or the value is not
    composed as usual. ASCII values are their own form and never changed.
    """
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast((lexicon, look_alikes(spark)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table = shared.value
        for b in batches:
            rows = []
            for v, n in zip(b["value"], b["n"]):
                form, bones = comparable(v, known), skeleton(v, table)
                rows.append((v, n, bones, form, _n_scripts(form), v != unicodedata.normalize("NFC", v) or v != bones))
            yield pd.DataFrame(rows, columns=["value", "n", "skeleton", "form", "scripts", "changed"])

    values = values.where(F.col("value").isNotNull())
    other = spread_out(values.where(F.col("value").rlike(_FOREIGN)).select("value", "n"), "value").mapInPandas(run, "value string, n long, skeleton string, form string, scripts int, changed boolean")
    plain = values.where(~F.col("value").rlike(_FOREIGN))
    plain = plain.select("value", "n", F.trim(F.regexp_replace("value", r"\s+", " ")).alias("skeleton"), F.col("value").alias("form"), F.when(F.col("value").rlike("[A-Za-z]"), 1).otherwise(0).alias("scripts"), F.lit(False).alias("changed"))
    return other.unionByName(plain)


def cases(values: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """(value, form, skeleton) of the originals that their skeleton group tells to be made of other characters.

    ``values``: value, n. The usual form of a group is the comparable form of fewest scripts, then of most rows. An original
    whose skeleton changes it and that is not written in the usual form is a case; from forms that differ by more than look-alike
    letters (joiners, quotes, Persian letters) its own comparable form counts instead. Wrongly decoded text is none.
    """
    shared = values.sparkSession.sparkContext.broadcast(lexicon)
    every = cut(originals(values, lexicon))
    # words made wholly of look-alikes: only groups with a Cyrillic or Greek member have more than one form by letters
    mixed = every.where("changed").where(F.col("form").rlike(r"[\p{IsCyrillic}\p{IsGreek}]")).select("skeleton").distinct()
    counted = every.join(mixed, "skeleton", "left_semi").groupBy("skeleton", "form", "scripts").agg(F.sum("n").alias("n"))
    usual = counted.groupBy("skeleton").agg(F.min(F.struct("scripts", (-F.col("n")).alias("n"), "form")).alias("u"), F.count("*").alias("k")).where("k > 1").select("skeleton", F.col("u.form").alias("usual"))
    held = every.where("changed").join(usual, "skeleton", "left").where((F.col("value") != F.col("form")) | (F.col("form") != F.col("usual")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = []
            for v, form, bones, u in zip(b["value"], b["form"], b["skeleton"], b["usual"]):
                meant = u if u is not None and _letters(form) == _letters(u) else form
                if meant != v:
                    _, path, gain = mojibake.search(v, known)
                    if not (path and gain >= mojibake.MARGIN or mojibake.lost(v)):
                        rows.append((v, meant, bones))
            yield pd.DataFrame(rows, columns=["value", "form", "skeleton"])

    return held.select("value", "form", "skeleton", "usual").mapInPandas(run, "value string, form string, skeleton string")


def fields_of(spark: SparkSession, folder: str) -> DataFrame:
    """(src, row_id, field, value) of the fields that problem 7 names."""
    parts = [load(spark, folder, table).select(F.lit(table).alias("src"), F.col(key).alias("row_id"), F.lit(field).alias("field"), F.col(field).alias("value")) for table, key, field in SOURCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("value").isNotNull())


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def _lexicon(spark: SparkSession, folder: str) -> frozenset[str]:
    return mojibake.learn_lexicon(load(spark, folder, "candidates").select(F.col("title").alias("text")))


def forms(spark: SparkSession, folder: str) -> DataFrame:
    """p7_forms: every case with its stored value, the comparable form and the skeleton."""
    rows = fields_of(spark, folder)
    told = cases(_counts(rows), _lexicon(spark, folder))
    rows = rows.where(F.col("value").rlike(_FOREIGN))  # no ASCII value is a case
    return spread_join(rows, told, ["value"], ["src", "row_id", "field"], hot=hot_keys(rows, ["value"])).distinct().select("src", "row_id", "field", "value", "form", "skeleton")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p7_found: every value that looks usual but is made of other characters."""
    return forms(spark, folder).select("src", "row_id", "field").distinct()


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """p7_groups: skeletons that more than one distinct original of the three fields has, with the number of originals and of rows."""
    every = originals(_counts(fields_of(spark, folder).distinct()), _lexicon(spark, folder))
    return every.groupBy("skeleton").agg(F.count("*").alias("n_originals"), F.sum("n").alias("n_rows")).where("n_originals > 1")

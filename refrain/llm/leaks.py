"""Evaluation texts that leak into training text (problem 9).

Word sequences are embedded by CGK random walks, which turn a small edit distance into a small
Hamming distance: a pointer walks over the words and a random bit, given by step and word, says whether it
moves on. A key samples some coordinates of the walk; windows of a document that share a key with
a sentence of an item are verified exactly: at most one word added, dropped or changed. Walks run
from a window's first word onward and from its last word backward, so an edit spoils only walks
that pass it. A walk has no more steps than the sentences of its class have words, so it never leaves an
item-sized window. Repetitions are added, class by class, until the recall on randomly edited sentences, set between other words of
the items, reaches a target; sentences that ``MOST_PAIRS`` repetitions don't bring there get exact keys of their first and last half, of
which one edit leaves one whole.

The index of the items is built on the driver in blocks of about ``BLOCK`` items, whose size is bounded;
all documents are read once and held against the index of every block.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.io import load

#: Items in one index, coordinates of a key, target recall and pairs of repetitions after which keys are exact.
BLOCK, COORDINATES, RECALL, MOST_PAIRS = 20_000, 5, 0.999, 12
#: Sentences of fewer words are no evidence of a leak by themselves.
LEAST_WORDS = 5
#: Steps of the walks, by class of sentences: those with at least as many words.
STEPS = (LEAST_WORDS, 8, 14)
#: Edited sentences on which recall is measured; words that are walked at once, a bound on memory.
TRIALS, WORDS_AT_ONCE = 2000, 200_000
SEED = 20240917
_TAG = re.compile(r"<[^<>]{0,200}>")
_UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f"  # scripts without spaces: each character is a word
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+")


def words_of(text: str | None) -> list[str]:
    """Words of a text without case, punctuation, mark-up and invisible characters; null gives none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return _TOKEN.findall(text.lower())


def sentences_of(passage: str | None) -> list[list[str]]:
    """The sentences of a passage as words, those of at least ``LEAST_WORDS``."""
    return [w for s in _SENTENCE.split(passage or "") if len(w := words_of(s)) >= LEAST_WORDS]


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether ``a`` becomes ``b`` by at most one word added, dropped or changed (a number changed to another is another statement)."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if i == len(a) == len(b):
        return True
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if len(x) > 1 or len(y) > 1:
        return False
    return not (x and y and x[0].isdigit() and y[0].isdigit())


class Index:
    """Keys of all sentences of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.sentences = [(i, w) for i, p in items for w in sentences_of(p)]
        self.vocabulary: dict[str, int] = {}
        for _, w in self.sentences:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.coded = [np.array([self.vocabulary[x] for x in w], dtype=np.int32) for _, w in self.sentences]
        self.rng = np.random.default_rng(SEED)
        self.walks: list[tuple[bool, np.ndarray, np.ndarray, list[np.ndarray], dict[int, list[int]]]] = []
        for steps, longer in zip(STEPS, (*STEPS[1:], None)):
            members = [s for s, c in enumerate(self.coded) if len(c) >= steps and (longer is None or len(c) < longer)]
            missed: list[int] = []
            for _ in range(MOST_PAIRS if members else 0):
                for backward in (False, True):
                    bits = self.rng.integers(0, 2, (steps, len(self.vocabulary) + 1), dtype=np.int8)
                    at = np.sort(self.rng.choice(np.arange(1, steps), COORDINATES - 1, replace=False))
                    self._add(members, backward, bits, np.concatenate([[0], at]))
                if len(missed := self._missed(members)) <= (1 - RECALL) * TRIALS:
                    missed = []
                    break
            self._add_halves(sorted(set(missed)))

    def _add_halves(self, members: list[int]) -> None:
        """Exact keys: walks that move on at every step and sample all of them, over the first half and over the last."""
        for backward in (False, True):
            by_size: dict[int, list[int]] = {}
            for s in members:
                n = len(self.coded[s])
                by_size.setdefault(n - n // 2 if backward else n // 2, []).append(s)
            for size, group in by_size.items():
                self._add(group, backward, np.ones((size, len(self.vocabulary) + 1), dtype=np.int8), np.arange(size))

    def _add(self, members: list[int], backward: bool, bits: np.ndarray, at: np.ndarray) -> None:
        keys: dict[int, list[int]] = {}
        levels: list[set[int]] = [set() for _ in at]
        for s in members:
            code = self.coded[s]
            partial = list(self._partial(code, np.array([len(code) - 1 if backward else 0]), backward, bits, at))
            for level, key in zip(levels, partial):
                level.add(int(key[0]))
            keys.setdefault(int(partial[-1][0]), []).append(s)
        self.walks.append((backward, bits, at, [np.array(sorted(x), dtype=np.int64) for x in levels], keys))

    @staticmethod
    def _partial(code: np.ndarray, pointer: np.ndarray, backward: bool, bits: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """Keys after each sampled coordinate, for walks that all run to the end."""
        key, k, move = np.zeros(len(pointer), dtype=np.int64), 0, -1 if backward else 1
        for j in range(int(at[-1]) + 1):
            inside = (pointer >= 0) & (pointer < len(code))
            out = np.where(inside, code[np.clip(pointer, 0, len(code) - 1)], 0)
            if j == at[k]:
                key = key * np.int64(1_000_003) + out
                yield key
                k += 1
            pointer = pointer + move * bits[j, out]

    def candidates(self, code: np.ndarray) -> set[tuple[int, int, bool]]:
        """(position, sentence, backward) of windows that share a key with a sentence.

        After each sampled coordinate only walks go on whose key so far some sentence has, which
        changes no result.
        """
        found: set[tuple[int, int, bool]] = set()
        n = len(code)
        for backward, bits, at, levels, keys in self.walks:
            move = -1 if backward else 1
            first = np.zeros(int(self._top) + 2, dtype=bool)
            first[levels[0][levels[0] <= self._top]] = True
            start = np.flatnonzero(first[code])
            pointer, key, k = start.copy(), np.zeros(len(start), dtype=np.int64), 0
            for j in range(int(at[-1]) + 1):
                inside = (pointer >= 0) & (pointer < n)
                out = np.where(inside, code[np.clip(pointer, 0, n - 1)], 0)
                if j == at[k]:
                    key = key * np.int64(1_000_003) + out
                    place = np.searchsorted(levels[k], key)
                    keep = (place < len(levels[k])) & (levels[k][np.minimum(place, len(levels[k]) - 1)] == key)
                    start, pointer, key, out = start[keep], pointer[keep], key[keep], out[keep]
                    k += 1
                    if not len(start):
                        break
                pointer = pointer + move * bits[j, out]
            else:
                for p, h in zip(start.tolist(), key.tolist()):
                    found.update((p, s, backward) for s in keys.get(h, ()))
        return found

    @property
    def _top(self) -> int:
        return len(self.vocabulary)

    def leaks(self, texts: list[list[str]]) -> list[set[int]]:
        """For each text the items of which it holds a whole sentence up to one edit; all texts are walked at once."""
        hits: list[set[int]] = [set() for _ in texts]
        code, starts = self.joined([self.code_of(w) for w in texts])
        for p, s, backward in self.candidates(code):
            t = int(np.searchsorted(starts, p, side="right")) - 1
            item, sentence = self.sentences[s]
            if item in hits[t]:
                continue
            words, at, n = texts[t], p - int(starts[t]), len(sentence)
            for m in (n, n - 1, n + 1):
                window = words[max(0, at - m + 1) : at + 1] if backward else words[at : at + m]
                if len(window) == m and one_edit(sentence, window):
                    hits[t].add(item)
                    break
        return hits

    def code_of(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))

    @staticmethod
    def joined(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All codes in one array, three unknown words after each, and where each begins."""
        gap = np.zeros(3, dtype=np.int32)
        sizes = np.array([len(c) + 3 for c in codes], dtype=np.int64)
        return np.concatenate([x for c in codes for x in (c, gap)] or [gap]), np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(codes) else np.zeros(1, dtype=np.int64)

    def _missed(self, members: list[int]) -> list[int]:
        """The sentences of ``TRIALS`` that, edited at random between random words of the items, are not found again."""
        rng, codes = np.random.default_rng(SEED + len(self.walks)), []
        picks = [members[i] for i in rng.integers(0, len(members), TRIALS)]
        for s in picks:
            code, kind = self.coded[s].tolist(), rng.integers(0, 3)
            e = int(rng.integers(0, len(code)))
            edited = code[:e] + ([] if kind == 0 else [0] if kind == 1 else [0, code[e]]) + code[e + 1 :]
            around = rng.integers(1, len(self.vocabulary) + 1, 2 * STEPS[-1]).tolist()
            codes.append(np.array(around[: STEPS[-1]] + edited + around[STEPS[-1] :], dtype=np.int32))
        joined, starts = self.joined(codes)
        found = set()
        for p, x, backward in self.candidates(joined):
            t = int(np.searchsorted(starts, p, side="right")) - 1
            at = p - int(starts[t]) - STEPS[-1]
            n = len(codes[t]) - 2 * STEPS[-1]
            if picks[t] == x and at == (n - 1 if backward else 0):
                found.add(t)
        return [s for t, s in enumerate(picks) if t not in found]


def leaks(documents: DataFrame, blocks: Iterable[list[tuple[int, str | None]]]) -> DataFrame:
    """(doc_id, item_id) of all documents that hold a whole sentence of a passage up to one word.

    Null and empty texts and passages give no row; a repeated document gives its rows once.
    ``blocks``: lists of (item_id, passage), each of about ``BLOCK`` at most.
    """
    context = documents.sparkSession.sparkContext
    indexes = [context.broadcast(Index(items)) for items in blocks]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, docs, texts, size = [], [], [], 0
            for doc, text in [*zip(b["doc_id"], b["text"]), (None, None)]:
                if words := words_of(text):
                    docs.append(doc), texts.append(words)
                    size += len(words)
                if texts and (text is None or size >= WORDS_AT_ONCE):
                    for index in indexes:
                        rows.extend((d, i) for d, hit in zip(docs, index.value.leaks(texts)) for i in hit)
                    docs, texts, size = [], [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return texts.mapInPandas(run, "doc_id long, item_id long").distinct()


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The evaluation items (item_id, passage) in blocks by hash, of about ``BLOCK`` each; only one block is fetched at a time."""
    items = items.select("item_id", "passage").where(F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    n_blocks = max(1, -(-items.count() // BLOCK))
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        yield sorted(((r[0], r[1]) for r in block.collect()), key=lambda x: x[0])


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p9_found: every document that holds sentences of evaluation items, with the items."""
    return leaks(load(spark, folder, "documents"), blocks_of(load(spark, folder, "eval_items")))


def leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """p9_items: each item that leaked and the number of documents that hold it."""
    return found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))

"""Filling windows of fixed capacity with texts (problem 8), sizes counted in tokens of a public tokenizer.

Lengths are put into classes of about equal numbers of items. Shallow combinations, of at most three different
classes with repeats, that fill a window are enumerated, their repeat counts are solved against the histogram of
classes by non-negative least squares, rounded and carried out; the last item of each window is the longest that
still fits. What is left is packed greedily, each text into the fullest window that has room. No text is
split unless it alone exceeds the capacity: then all its pieces but the last fill windows of their own.

Texts are dealt out to shards of a bounded number of items by hash, and each shard of each window is
packed by itself with its own histogram, so no group grows with the data; a shard leaves at
most one window half empty.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.io import cut, load

#: The tokenizer's vocabulary, by path; items a shard; classes of lengths; share of a window that a combination may leave free; share of all tokens, in the shortest items, kept for gaps.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SHARD_ITEMS, CLASSES, FREE, FILLERS = 50_000, 48, 0.03, 0.03
# Fixed value: the pattern by which byte-level BPE of this family cuts text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("window", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each document once; null and empty texts have nothing to pack and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(encode(t)) for t in b["text"]]})

    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return texts.mapInPandas(run, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * scale:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.zeros(len(x))
            s[p] = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if s[p].min(initial=1.0) > 0:
                break
            bad = p[s[p] <= 0]
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-12))
            x = x + step * (s - x)
            passive &= x > 1e-12
            if not passive.any():
                break
        x = np.maximum(s, 0.0)
    return x


def combinations(lengths: list[float], counts: list[int], capacity: int) -> list[dict[int, int]]:
    """Class counts that fill a window but for ``FREE`` of it: a class some times, a second as often as it fits, and a third in what is left.

    ``lengths``: mean length of each class, ascending; no class stands more often than it has items.
    """
    out: dict[tuple, dict[int, int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        for n in range(1, min(counts[i], int(capacity / lengths[i])) + 1):
            left = capacity - n * lengths[i]
            for j in range(i, -1, -1):
                m = min(counts[j], int(left / lengths[j])) if j < i else 0
                rest = left - m * lengths[j]
                k = bisect_right(lengths, rest) - 1
                if k >= 0 and k not in (i, j):
                    q = min(counts[k], int(rest / lengths[k]))
                    rest -= q * lengths[k]
                else:
                    q = 0
                if rest <= FREE * capacity:
                    c = {x: y for x, y in ((i, n), (j, m), (k, q)) if y}
                    out.setdefault(tuple(sorted(c.items())), c)
    return list(out.values())


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window number of each item; all ``sizes`` are from 1 to ``capacity``."""
    n = len(sizes)
    placed = np.full(n, -1, dtype=np.int64)
    if not n:
        return placed
    rooms: list[int] = []
    order = np.argsort(sizes, kind="stable")
    # the shortest items are kept for the gaps that combinations leave
    order = order[np.searchsorted(np.cumsum(sizes[order]), FILLERS * sizes.sum()) :]
    # fewer classes than windows, so that their repeat counts are worth rounding
    n_classes = int(np.clip(sizes.sum() / capacity / 2, 1, CLASSES))
    bounds = np.unique(sizes[order][np.minimum(len(order) - 1, np.arange(1, n_classes + 1) * len(order) // n_classes)])
    kind = np.searchsorted(bounds, sizes[order])
    lists = [order[kind == k].tolist() for k in range(len(bounds))]
    lists = [x for x in lists if x]
    tops = [int(sizes[x[-1]]) for x in lists]
    lengths, counts = [float(sizes[x].mean()) for x in lists], [len(x) for x in lists]

    def longest(room: int) -> tuple[int, int] | None:
        """Class and place of the longest item left that is no longer than ``room``."""
        k = min(bisect_right(tops, room), len(lists) - 1)
        while k >= 0:
            at = bisect_right(lists[k], room, key=lambda i: int(sizes[i])) - 1
            if at >= 0:
                return k, at
            k -= 1
        return None

    combos = combinations(lengths, counts, capacity)
    if combos:
        matrix = np.zeros((len(lists), len(combos)))
        for j, c in enumerate(combos):
            for k, m in c.items():
                matrix[k, j] = m
        weight = np.array(lengths)  # long items are the hard ones
        solved = nnls(matrix * weight[:, None], np.array(counts) * weight)
        for j in sorted(np.flatnonzero(solved > 1e-6).tolist(), key=lambda j: (-max(combos[j]), -solved[j], j)):
            for _ in range(int(np.floor(solved[j] + 0.5))):
                if any(len(lists[k]) < m for k, m in combos[j].items()):
                    break
                items, room = [], capacity
                for k in sorted(combos[j], reverse=True):
                    for _ in range(combos[j][k] - (k == min(combos[j]))):  # all but the last
                        if int(sizes[lists[k][-1]]) <= room:
                            items.append(lists[k].pop())
                            room -= int(sizes[items[-1]])
                if last := longest(room):
                    items.append(lists[last[0]].pop(last[1]))
                    room -= int(sizes[items[-1]])
                placed[items] = len(rooms)
                rooms.append(room)
    # residuals: longest first, each into the fullest window with room
    by_room: dict[int, list[int]] = {}
    mask = 0
    for w, r in enumerate(rooms):
        if r > 0:
            by_room.setdefault(r, []).append(w)
            mask |= 1 << r
    left = np.flatnonzero(placed < 0)
    for i in left[np.argsort(-sizes[left], kind="stable")].tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            w = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            r, w = capacity, len(rooms)
            rooms.append(capacity)
        placed[i] = w
        rooms[w] = r - s
        if r - s > 0:
            by_room.setdefault(r - s, []).append(w)
            mask |= 1 << (r - s)
    return placed


def windows(sizes: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(window_id, bin, doc_id, piece, start, n_tokens): where each text, or piece of a text that is too long, goes.

    ``sizes``: doc_id and n_tokens; ``capacities``: tokens by window_id, from 1 on. ``bin`` numbers the windows
    of one window_id; ``start`` is the piece's first token in its text. An empty table gives no row.
    """
    spark = sizes.sparkSession
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    kinds = spark.createDataFrame(sorted(capacities.items()), "window_id long, capacity long")
    n_shards = max(1, -(-sizes.count() // SHARD_ITEMS))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("capacity"))), lambda k: F.struct(k.alias("piece"), (k * F.col("capacity")).alias("start"), F.least("capacity", F.col("n_tokens") - k * F.col("capacity")).alias("size")))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards))
    rows = sizes.where("n_tokens > 0").crossJoin(F.broadcast(kinds)).select("window_id", "capacity", "doc_id", shard.alias("shard"), F.explode(pieces).alias("p")).select("window_id", "capacity", "shard", "doc_id", "p.*")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        capacity = int(group["capacity"].iloc[0])
        group = group.sort_values(["doc_id", "piece"], kind="stable")
        bins = pack(group["size"].to_numpy(dtype=np.int64), capacity)
        return pd.DataFrame({"window_id": group["window_id"], "bin": bins + (int(key[1]) << 32), "doc_id": group["doc_id"], "piece": group["piece"], "start": group["start"], "n_tokens": group["size"]})

    return rows.groupBy("window_id", "shard").applyInPandas(run, "window_id long, bin long, doc_id long, piece long, start long, n_tokens long")


def capacities_of(spark: SparkSession, folder: str) -> dict[int, int]:
    """Window sizes by id: a fixed table of a few rows."""
    return {r[0]: r[1] for r in load(spark, folder, "windows").where("capacity_tokens > 0").select("window_id", "capacity_tokens").dropDuplicates(["window_id"]).collect()}


def assignment(spark: SparkSession, folder: str) -> DataFrame:
    """p8_windows: the assignment of all texts to windows of each capacity."""
    return windows(cut(token_counts(load(spark, folder, "documents"))), capacities_of(spark, folder))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """p8_fill: windows used, the least number that could hold all tokens, tokens held and share of room used, by capacity."""
    used = assignment(spark, folder).groupBy("window_id").agg(F.countDistinct("bin").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_documents"))
    kinds = load(spark, folder, "windows").select("window_id", "name", "capacity_tokens").dropDuplicates(["window_id"])
    return used.join(F.broadcast(kinds), "window_id").select("window_id", "name", "n_bins", "n_documents", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_bins"), F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("fill"))

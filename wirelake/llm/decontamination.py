"""Benchmark items in training text, also edited or paraphrased copies: pairs of near words that an item and a document share are counted in
windows of the document; pairs of passage and item with as many as a copy must have are scored by local alignment (Smith-Waterman, on words)."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: items of fewer words match nothing
LEAST_WORDS = 4
#: two words up to so far apart, in the item and in the document, are a pair
REACH = 2
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: share of the score of a perfect copy of the item from which a passage counts as a copy
MIN_SCORE = 0.55
#: a passage also counts, whatever its share of the item, if so many words match, with two more for each word that differs
EXCERPT = 20
#: items of so many characters in total go to the tasks at a time; a larger benchmark takes several passes, each over all documents
BLOCK_CHARS = 8_000_000

_SPLIT = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPLIT).split()


class _Vocabulary(dict):
    def __missing__(self, w: bytes) -> int:
        return 0


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and first word of all pairs of words up to REACH apart; words that are none of the vocabulary (0) make none."""
    key, at = [], []
    for d in range(1, REACH + 1):
        k = np.flatnonzero((ids[:-d] > 0) & (ids[d:] > 0))
        key.append(ids[k] << np.uint64(32) | ids[k + d])
        at.append(k)
    return np.concatenate(key), np.concatenate(at)


def least_pairs(n: int, min_score: float) -> int:
    """In how many words of an item of n words a pair begins that the copy shares, at least. Between two matches that follow each other in an alignment lies
    no pair only if two words or more are skipped on one side, at a cost of 2: M matches and k pairs score 2M - 2(M - 1 - k) at most."""
    whole = max(1, int(np.ceil(min_score * n - 1 - 1e-9)))
    # an excerpt of M matches has M - 1 pairs, less one at most for each word that differs
    return min(whole, EXCERPT - 1) if n >= EXCERPT else whole


def _block_tables(items: list[tuple[int, str]], min_score: float) -> dict | None:
    vocabulary, kept, key, cell, first = {}, [], [], [], 0
    for item, text in items:
        ws = words(text)
        if len(ws) >= LEAST_WORDS:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.uint64)
            k, at = _pairs(ids)
            key.append(k)
            cell.append(at + first)
            first += len(ids)
            kept.append((item, ids))
    if not kept:
        return None
    known, slot = np.unique(np.concatenate(key), return_inverse=True)
    cell = np.concatenate(cell)
    count = np.bincount(slot)
    lengths = np.array([len(ids) for _, ids in kept])
    least = np.array([least_pairs(n, min_score) for n in lengths.tolist()])
    # A copy has pairs in `least` of the n - 1 cells (words where a pair begins) of its item, so all but `some` - 1 of them can miss the commonest
    # least - some cells, whichever they are: the others are looked up, and `some` of them have to be found.
    some = -(-least // 2)
    load = np.zeros(first, np.int64)
    np.add.at(load, cell, count[slot])
    looked_up = np.zeros(first, bool)
    ends = np.cumsum(lengths)
    for lo, n, skipped in zip((ends - lengths).tolist(), lengths.tolist(), (least - some).tolist(), strict=True):
        looked_up[lo + np.argsort(load[lo:lo + n - 1], kind="stable")[:n - 1 - skipped]] = True
    order = np.argsort(slot, kind="stable")
    order = order[looked_up[cell[order]]]
    parts = np.split(slot, np.cumsum([len(k) for k in key])[:-1])
    return {"vocabulary": vocabulary, "known": known, "cells": cell[order], "starts": np.searchsorted(slot[order], np.arange(len(known) + 1)), "some": some, "least": least,
            "item_of": np.repeat(np.arange(len(kept)), lengths), "slots": [np.unique(x) for x in parts], "items": kept}


def _candidates(t: dict, slot: np.ndarray) -> np.ndarray:
    """Items of which a text with these pairs has enough of the cells that are looked up."""
    u = np.unique(slot)
    n = t["starts"][u + 1] - t["starts"][u]
    if n.sum() < t["some"].min():
        return np.zeros(0, np.int64)
    cells = np.unique(t["cells"][np.repeat(t["starts"][u] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())])
    item, n = np.unique(t["item_of"][cells], return_counts=True)
    return item[n >= t["some"][item]]


def _windows(at: np.ndarray, least: int, span: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text of n words that hold every passage of up to `span` words with `least` of the pairs that begin at `at` (ascending)."""
    lo = at[:max(0, len(at) - least + 1)]
    hi = at[least - 1:]
    near = hi - lo <= span
    lo, hi = lo[near] - span, hi[near] + span + REACH
    if len(lo):
        breaks = np.concatenate(([0], np.flatnonzero(lo[1:] > hi[:-1]) + 1, [len(lo)]))
        for a, b in zip(breaks[:-1], breaks[1:], strict=True):
            yield max(0, int(lo[a])), min(n, int(hi[b - 1]))


def align(passage: np.ndarray, item: np.ndarray, mismatch: float = MISMATCH, gap: float = GAP) -> tuple[float, int]:
    """Best local alignment score and the end of it in the passage (exclusive). Row by row over the item; gaps along the passage come from a
    running maximum."""
    if not len(passage) or not len(item):
        return 0.0, 0
    ramp = np.arange(len(passage) + 1) * -gap
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for w in item:
        t = np.maximum(row + gap, 0.0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(passage == w, MATCH, mismatch))
        row = np.maximum.accumulate(t + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
    return best, end


def find(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
         min_score: float = MIN_SCORE) -> DataFrame:
    """One row for each pair of a row of docs and an item with a passage that scores at least `min_score` of a perfect copy, or with an excerpt of the item
    (EXCERPT matching words and two more for each that differs): keys, item_id, score (0 to 1),
    first_word, last_word (exclusive, of the best passage), n_seeds (words around the passage where a pair of the item begins).

    keys are the columns that name a row of docs (copied as they are, null or repeated ones too). Words are lower-cased runs of letters and digits;
    null and empty texts match nothing, and so do
    items of fewer than four words (null and empty ones too). Rows of the benchmark with one item_id count as one item, by the best of them. A document that holds an item twice gives
    one row, with the better passage (ties: the earlier). Extra columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    b = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("t")).dropna().where(F.length("t") > 0)
    chars = b.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        part = b.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k).orderBy("item", "t").collect()  # about BLOCK_CHARS characters
        found = _find_block(docs, _block_tables([(r["item"], r["t"]) for r in part], min_score), keys, text, min_score)
        out = found if out is None else out.unionByName(found)
    best = F.struct("score", (-F.col("first_word")).alias("back"), "last_word", "n_seeds")
    return (out.groupBy(*keys, "item_id").agg(F.max(best).alias("b"))
            .select(*keys, "item_id", "b.score", (-F.col("b.back")).alias("first_word"), "b.last_word", "b.n_seeds"))


def _find_block(docs: DataFrame, tables: dict | None, keys: list[str], text: str, min_score: float) -> DataFrame:
    """One scan of the documents; pairs of passage and item are found and scored where the document is."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    columns = {"item_id": "bigint", "score": "double", "first_word": "bigint", "last_word": "bigint", "n_seeds": "bigint"}
    if tables is None:
        return docs.select(*keys, *[F.lit(0).cast(kind).alias(c) for c, kind in columns.items()]).limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        vocabulary, known, own = _Vocabulary(t["vocabulary"]), t["known"], np.zeros(len(t["known"]), bool)
        for b in batches:
            rows = []
            for i, text_ in enumerate(b["_text"]):
                ws = words(text_)
                ids = np.fromiter(map(vocabulary.__getitem__, ws), np.uint64, len(ws))
                key, at = _pairs(ids)
                slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[slot] == key
                slot, at = slot[hit], at[hit]
                for k in _candidates(t, slot).tolist():
                    item_id, item = t["items"][k]
                    own[t["slots"][k]] = True
                    mine = np.unique(at[own[slot]])
                    own[t["slots"][k]] = False
                    best = None
                    # an alignment of that score and an excerpt are shorter than two items
                    for lo, hi in _windows(mine, int(t["least"][k]), 2 * len(item), len(ids)):
                        s, end = align(ids[lo:hi], item)
                        if (best is None or s > best[0]) and (s >= min_score * MATCH * len(item) or align(ids[lo:hi], item, -2 * MATCH, -2 * MATCH)[0] >= EXCERPT * MATCH):
                            _, back = align(ids[lo:lo + end][::-1], item[::-1])
                            best = s, lo + end - back, lo + end, int(((mine >= lo) & (mine < hi)).sum())
                    if best:
                        rows.append((i, item_id, best[0] / (MATCH * len(item)), *best[1:]))
            if rows:
                o = b.iloc[[r[0] for r in rows]][keys].reset_index(drop=True)
                for j, c in enumerate(columns, 1):
                    o[c] = [r[j] for r in rows]
                yield o
    return docs.select(*keys, F.col(text).alias("_text")).mapInPandas(scored, f"{kinds}, " + ", ".join(f"{c} {kind}" for c, kind in columns.items()))

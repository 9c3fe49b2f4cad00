"""Periodic runs of words by scale-tiled distribution. For every octave of periods the stretches of a document that can hold a run of such
a period are exploded into overlapping tiles; tiles are solved independently of each other by Z-functions at boundaries; the interval fragments meet by
document and period and are stitched where they overlap.

A run is a stretch with smallest period q and a length of at least max(LEAST, POWER x q) that no neighbouring word extends. All of it is exact: the
search for stretches leaves out only what can't touch such a run (see `_stretches`), and tiles overlap by 8 periods."""
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import written

#: a run has at least so many words and so many periods
LEAST, POWER = 6, 4
#: words of a tile without its overlap: so many times the octave, and no fewer than that
STRIDE, MIN_STRIDE = 16, 4_096
#: overlap of tiles, in octaves: four of the longest periods
OVERLAP = 8
#: words of the grams whose distances show where a run may be
GRAM = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _distances(x: np.ndarray, g: int, below: int | None = None) -> np.ndarray:
    """For each position: how far back the same gram of g words was last seen; 0 if never, or not nearer than `below`."""
    m = len(x) - g + 1
    if m < 2:
        return np.zeros(max(m, 0), np.int64)
    out = np.zeros(m, np.int64)
    if below is not None:
        for k in range(below - 1, 0, -1):
            same = x[k:] == x[:-k]
            for j in range(1, g):
                same = same[:-1] & (x[k + j:] == x[j:-k])
            out[k:][same] = k
        return out
    code = x[:m].astype(np.uint64)
    for k in range(1, g):
        code = (code * _MIX) ^ (code >> np.uint64(29)) ^ x[k:m + k].astype(np.uint64)
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(code[1:] == code[:-1])
    out[order[at + 1]] = order[at + 1] - order[at]
    return out


def _islands(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(octave, start, end): stretches of words that hold every run with a period from octave to 2 x octave - 1.

    In such a run [s, e) of period q each gram of g words from s + q to e - g was seen q words before, or later. So a run shows as a row of grams with
    distances below 2 x octave, at least max(LEAST, POWER x octave) - octave - g + 1 of them. Where the distance is one and the same q0 below the
    octave for long, the words have the period q0 there; two periods can't hold together for q0 + q words, so a run of this
    octave reaches no more than 2 x octave - 1 - g grams into the beginning of that part and q0 - g into its end: the rest is cut out.
    Grams are compared by hashes; equal hashes of different ones only make distances smaller."""
    n, h = len(x), 1
    while max(LEAST, POWER * h) <= n:
        g = min(h, GRAM)
        if h <= GRAM:  # the distances of the longest grams serve all octaves from there
            d = _distances(x, g, 2 * h if h < GRAM else None)
            seen = np.flatnonzero(d)
            # islands of grams that were seen before
            cut = np.flatnonzero(np.diff(seen) > 1)
            longest = int(np.diff(np.concatenate(([-1], cut, [len(seen) - 1]))).max()) if len(seen) else 0
        need = max(LEAST, POWER * h) - h - g + 1
        if longest < need:
            if g == GRAM:
                return  # longer octaves need more
            h *= 2
            continue
        if h <= GRAM:
            cut = np.flatnonzero(np.diff(d)) + 1
            at = np.concatenate(([0], cut))
            to, q0 = np.concatenate((cut, [len(d)])), d[at]
        near = (d > 0) & (d < 2 * h)
        for k in np.flatnonzero((q0 > 0) & (q0 < h) & (to - at >= 2 * h - g)).tolist():
            lo, hi = int(at[k]) + max(0, 2 * h - 1 - g), int(to[k]) - max(0, int(q0[k]) - g)
            if lo < hi:
                near[lo:hi] = False
        a, b = _islands(near)
        wide = b - a >= need
        start, end = -1, -1
        for lo, hi in zip((a[wide] - 2 * h).tolist(), (b[wide] + g).tolist(), strict=True):
            lo, hi = max(0, lo), min(n, hi)
            if start >= 0 and lo <= end:
                end = max(end, hi)
                continue
            if start >= 0:
                yield h, start, end
            start, end = lo, hi
        if start >= 0:
            yield h, start, end
        h *= 2


def tiles(x: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(octave, offset, words) of all tiles of a document; x numbers equal words equally (int32)."""
    out = []
    for h, lo, hi in _stretches(x):
        stride = max(STRIDE * h, MIN_STRIDE)
        for t in range(max(0, lo // stride - 1), hi // stride + 1):
            a, b = max(lo, t * stride), min(hi, (t + 1) * stride + OVERLAP * h)
            if b - a >= max(LEAST, POWER * h):
                out.append((h, a, x[a:b].tobytes()))
    return out


def z_function(x: list[int], start: int, k: int) -> list[int]:
    """z[j], j < k: length of the longest common prefix of x[start:] and x[start + j:] (z[0] is left at 0)."""
    n = len(x) - start
    z, left, right = [0] * k, 0, 0
    for j in range(1, min(k, n)):
        v = min(right - j, z[j - left]) if j < right else 0
        if j + v >= right:
            while j + v < n and x[start + v] == x[start + j + v]:
                v += 1
            left, right = j, j + v
        z[j] = v
    return z


@lru_cache(4_096)
def _shorter(p: int) -> tuple[int, ...]:
    """p divided by each of its prime factors: a stretch of period p has a smaller one that divides p only if it has one of these."""
    out, rest, r = [], p, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            out.append(p // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return tuple(out)


def solve(x: list[int], h: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the maximal stretches of a tile with a smallest period from h to 2 h - 1 and a length of at least max(LEAST, POWER x period).

    The words that equal those a period later are 3 periods or more in a row, so a boundary at every 2 h meets them. At a boundary the Z-function gives, for all
    periods at once, how far the equality goes on; the Z-function of the reversed words before it how far it goes back. The leftmost boundary
    reports a stretch; boundaries deep inside a stretch that is known are passed over, as no other can hold there."""
    n, out, known, step = len(x), [], [], 2 * h
    for c in range(0, n, step):
        if any(c >= s + step and e - c >= 2 * step for s, e in known):
            continue
        z = z_function(x, c, min(step, n - c))
        some = [p for p in range(h, len(z)) if z[p] >= max(LEAST, POWER * p) - p - step + 1]
        if not some:
            continue
        # reversed: the words before the boundary, a mark that no word equals, the words before boundary + period
        low, top = max(0, c - step), min(c + step - 1, n)
        y = x[low:c][::-1]
        back = z_function([*y, -1, *x[low:top][::-1]], 0, len(y) + 1 + max(0, top - c - h) + 1)
        for p in some:
            at = len(y) + 1 + top - c - p
            b = back[at] if y else 0
            if b >= step:
                continue  # an earlier boundary has it
            s, e = c - b, c + z[p] + p
            if e - s >= max(LEAST, POWER * p) and not any(x[s:s + p] == x[s + r:s + r + p] for r in _shorter(p)):
                out.append((p, s, e))
                known = [k for k in known if k[1] > c] + [(s, e)]
    return out


def _tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n, joined, found = [], [], []
        for text in b["_text"]:
            words = text.encode("utf-8", "surrogatepass").split()
            ids: dict[bytes, int] = {}
            x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
            n.append(len(words))
            joined.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            found.append([{"octave": h, "offset": a, "ids": w} for h, a, w in tiles(x)])
        yield pd.DataFrame({"_row": b["_row"], "n_words": n, "_words": joined, "_tiles": found})


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(row, p, offset + s, offset + e) for row, h, offset, ids in zip(b["_row"], b["octave"], b["offset"], b["ids"], strict=True)
               for p, s, e in solve(np.frombuffer(ids, np.int32).tolist(), h)]
        yield pd.DataFrame(out, columns=["_row", "period", "start", "end"])


@F.pandas_udf(StringType())
def _collapsed(words: pd.Series, runs: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(words, runs, strict=True):
        ws = text.split(" ")
        keep = np.ones(len(ws), bool)
        for r in found:
            keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
        out.append(" ".join(w for w, k in zip(ws, keep.tolist(), strict=True) if k))
    return pd.Series(out)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_words, runs (array of start, length, period by start, then period, in words from 0) and collapsed: the words joined
    by one space, without those that a run contains after its first period.

    Words are runs of anything but space and the controls 9 to 13. Null and empty texts have no words; texts of any length are tiled alike;
    null keys and repeated rows are rows of their own; other columns are ignored, whatever their names. An empty table gives an
    empty result. Texts are written once to the shared folder, so that tiles, stitching and the last pass read the same rows.
    """
    d = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_id"))
    kind = docs.schema[key].dataType
    # the key rides in the row's name, as JSON of its type, past Python
    d = d.select(F.to_json(F.struct("_id", "_key")).alias("_row"), "_text")
    base = written(d.mapInPandas(_tiled, "_row string, n_words bigint, _words string, _tiles array<struct<octave:int,offset:bigint,ids:binary>>"), "runs")
    named = F.from_json("_row", f"_id bigint, _key {kind.simpleString()}")["_key"].alias(key)
    t = base.where(F.size("_tiles") > 0).select("_row", F.explode("_tiles").alias("t")).select("_row", "t.*")
    pieces = t.repartition("_row", "octave", "offset").mapInPandas(_solved, "_row string, period bigint, start bigint, end bigint")
    # fragments of one run overlap by at least a period, different runs of one period by less
    order = Window.partitionBy("_row", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= F.col("_before") - F.col("period"), 0).otherwise(1)
    stitched = (pieces.withColumn("_before", before).withColumn("_run", F.sum(opens).over(order))
                .groupBy("_row", "period", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    runs = stitched.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period"))).alias("runs"))
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    plain = base.where(F.size("_tiles") == 0).select(named, "n_words", none.alias("runs"), F.col("_words").alias("collapsed"))
    some = base.where(F.size("_tiles") > 0).select("_row", "n_words", "_words").join(runs, "_row", "left").withColumn("runs", F.coalesce("runs", none))
    return plain.unionByName(some.select(named, "n_words", "runs", _collapsed("_words", "runs").alias("collapsed")))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, a tenth of the documents with a periodic end: with h the crc32 of the key, g = h / 10 and n words, if h is divisible by 10, each word i from
    a = g % n is the word a + (i - a) % p of the original, p = 1 + (n - a) / (3 + g % 8). Null keys change nothing."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (F.pmod(h, F.lit(10)) == 0).alias("_on"), F.floor(h / 10).alias("_g"))
    d = d.withColumn("_words", F.when(F.col("_on"), F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    n = F.size("_words")
    d = d.withColumn("_a", F.when(n > 0, F.pmod("_g", n)))
    d = d.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.pmod("_g", F.lit(8)))))
    changed = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", (F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int"))))
    return d.select(F.col("_key").alias(key), F.when(n > 0, F.array_join(changed, " ")).otherwise(F.col("_text")).alias(text))

"""Toxic passages: every token has a log-odds under Dirichlet priors, a linear scan finds all segments of maximal score, and the
extreme-value law of such scores in clean texts says how surprising the best segments of a document of its length are, taken together."""
import math
import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches, written

#: tokens are hashed to so many classes: the model has this size at any input
CLASSES = 1 << 18
#: bound of the training sample (labelled documents)
TRAIN_DOCS = 20_000
#: weight of the prior, in documents; its shape is the share of toxic documents in the sample
PRIOR = 2.0
#: log-odds count only for tokens whose share of toxic documents stands out so much, upwards or downwards (signed root of the likelihood ratio, about
#: standard errors), that of all tokens in three documents and more about this number would by chance
CHANCE_TOKENS = 1.0
#: the odds are taken at the bound nearer to zero of an interval of so many standard errors, so that rare tokens count less
CAUTION = 1.64
#: no token counts more than this, upwards or downwards
MAX_ODDS = 6.0
#: all tokens are shifted by this and, if it is positive, by the mean weight of tokens in clean documents, so that the expected score of clean text is
#: negative and segments stay local
STEP_DOWN = -0.05
#: tokens of a run whose minwise values tell copies of a document from others
RUN = 3
#: minwise values: documents that share a majority of them are taken for copies
MARKS = 5
#: the law of clean scores and its calibration come from scores under weights that were learnt on the other folds
FOLDS = 3
#: weights of documents are counted in whole parts of this size, so that sums don't depend on their order
WEIGHT_UNIT = 1 << 20
#: segments with a p-value up to this are reported
MAX_P = 1e-3

_SPLIT = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits (and all that is not ASCII)."""
    return text.lower().encode("utf-8", "replace").translate(_SPLIT).split()


class _Classes(dict):
    """Token -> class; emptied when it has grown large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[w] = c = zlib.crc32(w) & (CLASSES - 1)
        return c


def _classes(text: str, memo: _Classes) -> np.ndarray:
    ws = words(text)
    return np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))


def _marks(at: np.ndarray) -> list[int]:
    """Minwise values of the runs of RUN tokens (shorter texts: of the tokens)."""
    if not len(at):
        return [0] * MARKS
    runs = np.lib.stride_tricks.sliding_window_view(at, RUN) if len(at) >= RUN else at[:, None]
    h = pd.util.hash_array(np.unique((runs.astype(np.uint64) * (CLASSES + 1) ** np.arange(runs.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)))
    # odd multipliers, then the upper half: another order of the same hashes for each mark
    return [int((h * np.uint64(2 * zlib.crc32(b"%d" % k) + 1) >> np.uint64(32)).min()) for k in range(MARKS)]


def _training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(_y, _t, _fold, _w) of at most `rows` documents, one for each key (of a key with several texts, one with the smallest checksum). Copies are not
    independent: the weight of a document is one over the number of documents of the sample that it shares most of its minwise values
    with, the median over these, and its fold goes by the first of them."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    sample = bounded_sample(known, key, rows)
    d = (docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(sample), key)
         .groupBy(F.col(key).alias("_id"), "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), F.col("_t"))).alias("_t")))

    @F.pandas_udf("array<bigint>")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Classes()
        for texts in batches:
            yield pd.Series([_marks(_classes(t, memo)) for t in texts])
    d = written(d.repartition(max(1, min(64, rows // 1000)), "_id").withColumn("_m", marked("_t")), "toxic-sample")
    one = d.select("_id", F.posexplode("_m").alias("_k", "_v"))
    sizes = one.join(one.groupBy("_k", "_v").agg(F.count("*").alias("_n")), ["_k", "_v"]).groupBy("_id").agg(F.sort_array(F.collect_list("_n"))[MARKS // 2].alias("_n"))
    return written(d.join(sizes, "_id").select("_y", "_t", F.pmod(F.xxhash64(F.col("_m")[0]), F.lit(FOLDS)).cast("int").alias("_fold"), (1 / F.col("_n")).alias("_w")), "toxic-train")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_DOCS) -> dict:
    """Token scores, the extreme-value law and its calibration from at most `rows` labelled documents (label 0 or 1; others are ignored; a key with
    both labels counts as 1). Key and label meet here only; neither is an input of a score."""
    small_batches(docs.sparkSession)
    d = _training_rows(docs, labels, key, text, label, rows)
    model = _fitted(d)
    if model["fit"][0] > 0:
        return model
    # a sample of a few texts and their copies: as groups nothing stands out in them, as documents it may
    return _fitted(d.withColumn("_w", F.lit(1.0)))


def _fitted(d: DataFrame) -> dict:
    """The model of training rows; without slope where their labels can't be told apart."""
    cells = [f"n{k}" for k in range(2 * FOLDS)]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, memo = np.zeros((2 * FOLDS, CLASSES + 1), np.int64), _Classes()  # the last cell counts documents
        for b in batches:
            for y, t, fold, weight in zip(b["_y"], b["_t"], b["_fold"], b["_w"], strict=True):
                # a token counts once in a document, and a group of copies as one: long texts, repeated lines and texts don't outweigh others
                n[2 * fold + y, np.append(np.unique(_classes(t, memo)), CLASSES)] += round(weight * WEIGHT_UNIT)
        at = np.flatnonzero(n.sum(0))
        yield pd.DataFrame({"c": at} | {c: n[k, at] for k, c in enumerate(cells)})
    counts = (d.mapInPandas(counted, "c bigint, " + ", ".join(f"{c} bigint" for c in cells)).groupBy("c").agg(*[F.sum(c).alias(c) for c in cells])).toArrow()  # CLASSES rows at most
    by_fold = np.zeros((FOLDS, 2, CLASSES + 1))
    for k, c in enumerate(cells):
        by_fold[k // 2, k % 2, counts["c"].to_numpy()] = counts[c].to_numpy() / WEIGHT_UNIT
    n = by_fold.sum(0)
    model = {"weights": _log_odds(n), "law": (0.0, 1.0), "fit": (0.0, 0.0)}
    if not n[0].any() or not n[1].any():
        share = 1.0 if n[1].any() else 0.0
        return model | {"fit": (0.0, _logit(share))}
    others = [_log_odds(n - by_fold[k]) for k in range(FOLDS)]

    w = model["weights"]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Classes()
        for b in batches:
            at = [(_classes(t, memo), k) for t, k in zip(b["_t"], b["_fold"], strict=True)]
            yield pd.DataFrame({"y": b["_y"], "s": [segment_scores(others[k][c]) for c, k in at], "own": [segment_scores(w[c]) for c, _ in at], "n": [len(c) for c, _ in at]})
    s = d.mapInPandas(scored, "y int, s array<double>, own array<double>, n bigint").toArrow().to_pandas()  # as many rows as the sample
    y, n = s["y"].to_numpy(float), s["n"].to_numpy(float)
    for column in ("s", "own"):
        score = np.array([max(x, default=0.0) for x in s[column]], float)
        # a sample of few different texts can leave folds without any toxic one: then the scores under all weights serve
        if (score[y == 1] > 0).any():
            law = extreme_value(score[y == 0], n[y == 0])
            fit = _calibrate(np.array([together(np.asarray(x, float), k, law)[0] for x, k in zip(s[column], n, strict=True)]), y)
            if fit[0] > 0:
                return model | {"law": law, "fit": fit}
    return model | {"fit": (0.0, _logit(float(y.mean())))}


def _logit(p: float) -> float:
    p = min(max(p, 0.01), 0.99)
    return math.log(p / (1 - p))


def _log_odds(n: np.ndarray) -> np.ndarray:
    """Log-odds ratio of each class of tokens between toxic and clean documents under a Dirichlet prior, of both signs. n are counts of documents with the
    class; the last cell counts all. Classes that don't stand out have none: the likelihood ratio against the common share of toxic documents holds
    for counts of a few as well as for many. All are shifted so that clean documents drift downwards."""
    docs, n = n[:, -1], n[:, :-1]
    total, share = n.sum(0), docs / max(1.0, docs.sum())
    g = sum(np.where(n[y] > 0, n[y] * np.log(np.maximum(n[y], 1e-12) / np.maximum(total * share[y], 1e-12)), 0.0) for y in (0, 1))
    z = np.sign(n[1] - total * share[1]) * np.sqrt(2 * np.maximum(g, 0.0))
    prior = np.maximum(PRIOR * share, 1e-6)
    odds = [np.log((n[y] + prior[y]) / (docs[y] + PRIOR)) for y in (0, 1)]
    ratio = odds[1] - odds[0]
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - CAUTION * np.sqrt(1 / (n[1] + prior[1]) + 1 / (n[0] + prior[0])), 0.0)
    tested = max(2, int((total >= 3).sum()))
    least = NormalDist().inv_cdf(1 - min(0.4, CHANCE_TOKENS / tested))
    w = np.where((np.abs(z) >= least) & (z * ratio > 0), np.clip(ratio, -MAX_ODDS, MAX_ODDS), 0.0)
    clean = float((w * n[0]).sum() / max(1.0, n[0].sum()))
    return (w + STEP_DOWN - max(0.0, clean)).astype(np.float32)


def best_score(w: np.ndarray) -> tuple[float, int]:
    """Largest sum of a segment (0 if none is positive), in one pass over running sums, and the number of tokens."""
    if not len(w):
        return 0.0, 0
    run = np.cumsum(w, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate(([0.0], run[:-1])))
    return float(max(0.0, (run - low).max())), len(w)


def maximal_segments(w: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time: each candidate remembers the running sum before and with it; a new one
    either joins back over those it can improve, or stands alone."""
    out: list[list[float]] = []  # start, end, sum before, sum with
    sums = np.concatenate(([0.0], np.cumsum(w, dtype=np.float64)))
    for i in np.flatnonzero(w > 0).tolist():
        new = [i, i + 1, float(sums[i]), float(sums[i + 1])]
        while True:
            # nearest earlier candidate whose sum before is lower; those passed over can't be extended by this or later ones
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = int(out[j][4])
            if j < 0 or out[j][3] >= new[3]:
                out.append([*new, j])
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(int(s), int(e), b - a) for s, e, a, b, _ in out]


def segment_scores(w: np.ndarray) -> list[float]:
    """Scores of all maximal segments, the best first."""
    return sorted((v for *_, v in maximal_segments(w)), reverse=True)


def extreme_value(score: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(location, scale) of the Gumbel law of best scores of clean texts, less the log of their length; by quantiles, which mislabelled texts don't move."""
    if not len(score):
        return 0.0, 1.0
    low, high = np.quantile(score, (0.5, 0.9))
    scale = max(0.25, float(high - low) / (math.log(-math.log(0.5)) - math.log(-math.log(0.9))))
    return float(np.median(score - scale * np.log(np.maximum(n, 1.0)))) + math.log(-math.log(0.5)) * scale, scale


def surprise(score: np.ndarray, n: np.ndarray, law: tuple[float, float]) -> np.ndarray:
    """Minus log of the chance that a clean text of this length has so good a segment; 0 for texts without tokens."""
    at, scale = law
    t = (score - at) / scale - np.log(np.maximum(n, 1.0))
    e = np.exp(-np.clip(t, -30, 700))
    return np.where(n > 0, -np.log(np.maximum(-np.expm1(-e), 1e-300)), 0.0)


def together(scores: np.ndarray, n: float, law: tuple[float, float]) -> tuple[float, int]:
    """Surprise of all segments of a text together, and how many of the best ones it rests on. In clean texts the number of segments with a score is
    Poisson, of the mean that the extreme-value law has; so for each r there is a chance of r segments as good as the r-th. The least of them counts, under
    weights 2 / (r (r + 1)), so that a single segment keeps its chance. scores: the best first."""
    if not len(scores):
        return float(surprise(np.zeros(1), np.array([n]), law)[0]), 0
    r = np.arange(1, len(scores) + 1)
    t = np.clip((scores - law[0]) / law[1] - math.log(max(n, 1.0)), -30, 700)
    mean = np.exp(-t)
    # the first term of the tail, and a bound of the ratio of the others to it
    x = np.where(mean < r, t * r + mean + np.cumsum(np.log(r)) + np.log1p(-np.minimum(mean / (r + 1), 0.999)), 0.0) - np.log(r * (r + 1) / 2)
    x[0] = surprise(scores[:1], np.array([n]), law)[0]
    k = int(x.argmax())
    return max(0.0, float(x[k])), k + 1


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from surprise to label: Newton's steps with a small ridge, until they stand still."""
    a, b = 0.0, _logit(float(y.mean()))
    f = np.minimum(x, 60.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -50, 50)))
        g = np.array([((y - p) * f).sum() - 1e-3 * a, (y - p).sum() - 1e-3 * b])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * f * f).sum() + 1e-3, (v * f).sum()], [(v * f).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        if size > 2:
            step *= 2 / size
        a, b = a + step[0], b + step[1]
        if size < 1e-8:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: dict, text: str = "text", passages: bool = False) -> DataFrame:
    """Adds score (0 to 1), n_tokens, best_segment, p_value (of all segments together), n_passages (segments in the text, if p_value is up to MAX_P: those that
    it rests on and those that alone reach MAX_P) and, if asked, passages: these segments, as (start, end, score) in tokens.
    Whole texts count; null is read as empty, and empty texts have the score of surprise 0. Repeated rows are scored each; extra columns stay, but those
    with these names are replaced."""
    small_batches(docs.sparkSession)
    names = ["score", "n_tokens", "best_segment", "p_value", "n_passages", "passages"]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CLASSES numbers and four more
    kind = "struct<score:double,n_tokens:bigint,best_segment:double,p_value:double,n_passages:bigint" + (",passages:array<struct<start:int,end:int,score:double>>" if passages else "") + ">"

    @F.pandas_udf(kind)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, memo = shared.value, _Classes()
        w, law, (a, b) = m["weights"], m["law"], m["fit"]
        for texts in batches:
            best, n, x, found = [], [], [], []
            for t in texts:
                values = w[_classes(t or "", memo)]
                segments, k = maximal_segments(values), len(values)
                scores = np.array(sorted((v for *_, v in segments), reverse=True), float)
                how, r = together(scores, k, law)
                best.append(scores[0] if r else 0.0)
                n.append(k)
                x.append(how)
                # the score that a segment alone needs in a text of this length
                least = law[0] + law[1] * (math.log(max(k, 1)) - math.log(-math.log1p(-MAX_P)))
                if r and how >= -math.log(MAX_P):
                    least = min(least, scores[r - 1])
                found.append([{"start": lo, "end": hi, "score": v} for lo, hi, v in segments if v >= max(least, 1e-9)])
            best, n, x = np.array(best, float), np.array(n, float), np.array(x, float)
            p = 1 / (1 + np.exp(-np.clip(a * np.minimum(x, 60.0) + b, -50, 50)))
            out = {"score": p, "n_tokens": n.astype(np.int64), "best_segment": best, "p_value": np.exp(-x), "n_passages": [len(f) for f in found]}
            yield pd.DataFrame(out | ({"passages": found} if passages else {}))
    d = docs.select(*kept, judged(F.col(text)).alias("_j"))
    return d.select(*kept, *[F.col(f"_j.{c}").alias(c) for c in (names if passages else names[:5])])

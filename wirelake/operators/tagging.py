"""Sequence model for sentence tags: counts with add-k smoothing, and decoding.

Sentences are rows with arrays words and tags. The model is three long tables:
start(tag, lp), step(prev, tag, lp), emit(tag, word, lp)."""
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.wording import word_shape
from ..session import cut
from ..vocabulary import TAGS
from .components import spread_join

C = F.col
SHAPES = ["<NUM>", "<UNK>"]


@dataclass
class Model:
    start: DataFrame
    step: DataFrame
    emit: DataFrame

    def save(self, path: str) -> None:
        for name in ("start", "step", "emit"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def stored(path: str, train) -> "Model":
        """The model under path; where there is none, train() makes one, which is stored first. A model counts as stored once its last table is."""
        spark = SparkSession.active()
        try:
            return Model.load(spark, path)
        except AnalysisException:  # a table is missing
            train().save(path)
            return Model.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Model":
        return Model(*[spark.read.parquet(f"{path}/{n}") for n in ("start", "step", "emit")])


def bigrams(sentences: DataFrame) -> DataFrame:
    """Counts of adjacent tag pairs; the pairs are formed inside each sentence, without a shuffle."""
    pairs = F.zip_with(F.slice("tags", 1, F.greatest(F.size("tags") - 1, F.lit(0))), F.slice("tags", 2, F.greatest(F.size("tags") - 1, F.lit(1))),
                       lambda a, b: F.struct(a.alias("prev"), b.alias("tag")))
    return sentences.filter(F.size("tags") > 1).select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.tag").agg(F.count("*").alias("n"))


def word_counts(sentences: DataFrame) -> DataFrame:
    """Counts per (lower-case word, shape of the original, tag); all later steps work on this small table."""
    d = sentences.select(F.explode(F.arrays_zip("words", "tags")).alias("t"))
    return d.groupBy(F.lower("t.words").alias("word"), word_shape(C("t.words")).alias("shape"), C("t.tags").alias("tag")).agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """Words seen more than once, and the shape classes."""
    seen = counts.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").select("word")
    shapes = counts.sparkSession.createDataFrame([(s,) for s in SHAPES], "word string")
    return seen.unionByName(shapes).distinct()


def _dropped(sentences: DataFrame, share: float, seed: int) -> DataFrame:
    """Replace a hashed share of the words by a word no vocabulary holds, so that they train their shape."""
    if share <= 0:
        return sentences
    h = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    mask = F.transform("words", lambda w, i: F.when(h(i) < share, F.lit(True)).otherwise(False))
    return sentences.withColumn("mask", mask)


def fit(sentences: DataFrame, k: float = 0.1, dropout: float = 0.0, seed: int = 0) -> Model:
    """sentences(id, words, tags). Row-normalised log probabilities with k added to every cell."""
    spark = sentences.sparkSession
    # tokens are cut out once for all counts
    sentences = cut(sentences.select(*[c for c in ("id", "words", "tags") if c in sentences.columns]))
    tags = F.array(*map(F.lit, TAGS))
    counts = cut(word_counts(sentences))
    vocab = cut(vocabulary(counts))
    if dropout > 0:
        d = _dropped(sentences, dropout, seed).select(F.explode(F.arrays_zip("words", "tags", "mask")).alias("t"))
        d = d.select(F.lower("t.words").alias("w"), word_shape(C("t.words")).alias("shape"), C("t.tags").alias("tag"), C("t.mask").alias("mask"))
        counts = d.groupBy(F.when(C("mask"), C("shape")).otherwise(C("w")).alias("word"), "shape", "tag").agg(F.count("*").alias("n"))
    known = counts.join(vocab.withColumn("known", F.lit(True)), "word", "left")
    cells = known.groupBy("tag", F.when(C("known"), C("word")).otherwise(C("shape")).alias("word")).agg(F.sum("n").alias("n"))
    n_words = vocab.count()
    grid = vocab.select("word", F.explode(tags).alias("tag")).join(cells, ["word", "tag"], "left").fillna(0, ["n"])
    per_tag = cells.groupBy("tag").agg(F.sum("n").alias("total"))
    emit = grid.join(per_tag, "tag", "left").select("tag", "word", F.log((C("n") + k) / (F.coalesce("total", F.lit(0)) + k * n_words)).alias("lp"))
    # the tag set is fixed, so start and step have 11 and 121 cells whatever the corpus
    first = sentences.filter(F.size("tags") > 0).groupBy(F.get("tags", F.lit(0)).alias("tag")).agg(F.count("*").alias("n"))
    base = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    total = sum(r["n"] for r in first.collect())
    start = base.join(first, "tag", "left").select("tag", F.log((F.coalesce("n", F.lit(0)) + k) / (total + k * len(TAGS))).alias("lp"))
    pairs = bigrams(sentences)
    out = pairs.groupBy("prev").agg(F.sum("n").alias("total"))
    full = spark.createDataFrame([(a, b) for a in TAGS for b in TAGS], "prev string, tag string")
    step = full.join(pairs, ["prev", "tag"], "left").join(out, "prev", "left").select(
        "prev", "tag", F.log((F.coalesce("n", F.lit(0)) + k) / (F.coalesce("total", F.lit(0)) + k * len(TAGS))).alias("lp"))
    return Model(start, step, emit)


def _best_paths(obs: list[np.ndarray], start: np.ndarray, step: np.ndarray, budget: int = 200_000) -> list[list[str]]:
    """Best tags of each row of scores (tokens x tags): rows of similar length advance together, position by position."""
    result: list = [[] for _ in obs]
    todo = sorted((i for i in range(len(obs)) if len(obs[i])), key=lambda i: len(obs[i]))
    while todo:
        n = len(obs[todo[-1]])
        take = max(1, budget // n)
        part, todo = todo[-take:], todo[:-take]
        part = part[::-1]                                   # longest first
        size = np.array([len(obs[i]) for i in part])
        cur = start + np.stack([obs[i][0] for i in part])
        back = np.zeros((n, len(part), len(TAGS)), dtype=np.int8)
        for t in range(1, n):
            live = int(np.searchsorted(-size, -t, side="left"))   # rows longer than t
            cand = cur[:live, :, None] + step
            back[t, :live] = cand.argmax(1)
            cur[:live] = cand.max(1) + np.stack([obs[i][t] for i in part[:live]])
        for j, i in enumerate(part):
            k = int(cur[j].argmax())
            path = [k]
            for t in range(size[j] - 1, 0, -1):
                k = int(back[t, j, k])
                path.append(k)
            result[i] = [TAGS[k] for k in reversed(path)]
    return result


#: a vocabulary goes along with the tasks up to this size (words, characters in them): 18 MB of scores and the words
CARRIED = (200_000, 4_000_000)


def tag(sentences: DataFrame, model: Model) -> DataFrame:
    """Adds `tags` to sentences(id, words, ...).

    The scores of a vocabulary of up to CARRIED travel as one matrix: words are looked up where the sentences are, and nothing is shuffled. Those
    of a larger one are joined to the distinct words of each sentence's tokens, frequent words split over tasks."""
    at = {t: i for i, t in enumerate(TAGS)}
    start, step = np.zeros(len(TAGS)), np.zeros((len(TAGS), len(TAGS)))
    for r in model.start.collect():
        start[at[r["tag"]]] = r["lp"]
    for r in model.step.collect():
        step[at[r["prev"]], at[r["tag"]]] = r["lp"]
    order = F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, TAGS)), C("tag")).alias("i"), "lp")))
    vec = cut(model.emit.groupBy("word").agg(F.transform(order, lambda x: x["lp"]).alias("vec")))
    n, chars = vec.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    words, number = F.transform("words", F.lower), F.transform("words", lambda w: word_shape(w) == SHAPES[0])
    if n <= CARRIED[0] and chars <= CARRIED[1]:
        rows = vec.collect()
        shared = sentences.sparkSession.sparkContext.broadcast(({r["word"]: i for i, r in enumerate(rows)}, np.array([r["vec"] for r in rows])))

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def carried(words: pd.Series, number: pd.Series) -> pd.Series:
            row, matrix = shared.value
            shapes = [row[s] for s in SHAPES]
            found = [[row.get(w, shapes[0 if k else 1]) for w, k in zip(ws, ks, strict=True)] if ws is not None else [] for ws, ks in zip(words, number, strict=True)]
            return pd.Series(_best_paths([matrix[f] if f else np.zeros((0, len(TAGS))) for f in found], start, step))
        return sentences.drop("tags").withColumn("tags", carried(words, number))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scored(scores: pd.Series) -> pd.Series:
        return pd.Series(_best_paths([np.asarray(s, dtype=float).reshape(-1, len(TAGS)) for s in scores], start, step))
    shape = {r["word"]: r["vec"] for r in vec.filter(C("word").isin(*SHAPES)).collect()}
    lit = lambda name: F.array(*map(F.lit, shape[name]))
    tok = sentences.select("id", F.posexplode("words").alias("pos", "w")).select("id", "pos", "w", F.lower("w").alias("word"))
    seen = tok.groupBy("word").agg(F.count("*").alias("_rows"))
    tok = spread_join(tok, vec.join(seen, "word"), ["word"], ["id", "pos"], "left")
    tok = tok.select("id", "pos", F.coalesce("vec", F.when(word_shape(C("w")) == SHAPES[0], lit(SHAPES[0])).otherwise(lit(SHAPES[1]))).alias("vec"))
    obs = tok.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda x: x["vec"])).alias("obs"))
    got = obs.select("id", scored("obs").alias("tags"))
    return sentences.drop("tags").join(got, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def token_pairs(sentences: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return sentences.select("id", F.posexplode(F.arrays_zip(C(gold).alias("gold"), C(pred).alias("pred"))).alias("pos", "t")).select("id", "pos", "t.gold", "t.pred")


def tag_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 per tag from counts of (gold, pred)."""
    cells = pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    hit = C("gold") == C("pred")
    sides = F.array_distinct(F.array("gold", "pred"))
    per = cells.select(F.explode(sides).alias("tag"), "gold", "pred", "n").groupBy("tag").agg(
        F.sum(F.when(hit, C("n")).otherwise(0)).alias("tp"), F.sum(F.when(~hit & (C("pred") == C("tag")), C("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & (C("gold") == C("tag")), C("n")).otherwise(0)).alias("fn"))
    p = F.coalesce(F.try_divide(C("tp"), C("tp") + C("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(C("tp"), C("tp") + C("fn")), F.lit(0.0))
    d = per.withColumns({"precision": p, "recall": r})
    return d.withColumn("f1", F.coalesce(F.try_divide(2 * C("precision") * C("recall"), C("precision") + C("recall")), F.lit(0.0)))


def component_counts(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset overlap per sentence of (keys) rows: tp, fp, fn."""
    count = lambda d, n: d.groupBy("id", *keys).agg(F.count("*").alias(n))
    d = count(gold, "g").join(count(pred, "p"), ["id", *keys], "full_outer").fillna(0, ["g", "p"])
    return d.groupBy("id").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(C("p") - C("g"), F.lit(0))).alias("fp"),
                               F.sum(F.greatest(C("g") - C("p"), F.lit(0))).alias("fn"))


def error_type(error: Column, tokens_ok: Column, tag_errors: Column, tree_ok: Column, components_ok: Column) -> Column:
    """First reason in this order that explains a wrong circuit."""
    return (F.when(error.isNotNull(), "exception").when(~tokens_ok, "tokenization").when(F.size(tag_errors) > 0, "tagging")
            .when(tree_ok, "source").when(~components_ok, "components/values").otherwise("structure"))

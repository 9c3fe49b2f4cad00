"""Approximate nearest neighbours by an inverted multi-index. Each half of a vector is quantised on its own; a cell is a pair of
centroids; a query visits cells in the order of summed distance, found with a heap, until it has seen enough entries; these are
reranked on the original vectors."""
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, written

#: bound of the sample that the centroids are fitted on, and of the queries that the visiting depth is measured on
FIT_ROWS, PROBE_ROWS = 20_000, 256
#: entries that every query is compared with first, for a bound of its k-th score
BOUND_ROWS = 4_096
#: entries of a cell on average; the number of centroids of a half is chosen for it, up to MAX_CENTROIDS
CELL_ROWS, MAX_CENTROIDS = 150, 512
#: recall that the visiting depth is set for, on the measured queries
RECALL = 0.95
#: a task compares at most so many entries of a cell with so many queries
ENTRY_BLOCK, QUERY_BLOCK = 2_048, 2_048


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """_id and _v (array<double>): vectors that are null, empty, zero or hold a null or a non-finite component take no part, nor do null keys."""
    v = F.col(vector).cast("array<double>")
    fine = (F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0)
            & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0))
    return vectors.select(F.col(key).cast("bigint").alias("_id"), v.alias("_v")).where(fine)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def fit(v: DataFrame, rows: int, seed: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Centroids of both halves from at most FIT_ROWS vectors; their number grows with the square root of rows / CELL_ROWS. Also BOUND_ROWS of the vectors."""
    x = np.array([r["_v"] for r in bounded_sample(v, "_id", FIT_ROWS, seed).select("_v").limit(FIT_ROWS).collect()])
    k = max(1, min(MAX_CENTROIDS, round((rows / CELL_ROWS) ** 0.5), len(x) // 4))
    half = max(1, x.shape[1] // 2)
    return [_kmeans(x[:, :half], k, seed), _kmeans(x[:, half:], k, seed + 1) if x.shape[1] > 1 else np.zeros((1, 0))], x[:BOUND_ROWS]


def _halves(x: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = centroids[0].shape[1]
    return x[:, :half], x[:, half:]


def cells_of(x: np.ndarray, centroids: list[np.ndarray]) -> np.ndarray:
    near = [((c * c).sum(1) - 2 * h @ c.T).argmin(1) for h, c in zip(_halves(x, centroids), centroids, strict=True)]
    return near[0] * len(centroids[1]) + near[1]


def traverse(distances: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of centroids in the order of summed distance. The heap holds the border of the pairs seen so far in both sorted lists."""
    order = [np.argsort(d, kind="stable") for d in distances]
    a, b = distances[0][order[0]], distances[1][order[1]]
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(order[0][i]), int(order[1][j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[p] + b[q], p, q))


def visits(query: np.ndarray, centroids: list[np.ndarray], counts: np.ndarray, depth: int) -> list[int]:
    """Cells that a query visits: until `depth` entries are seen. Nearness is the inner product, which adds up over the halves."""
    q = _halves(query[None, :], centroids)
    out, seen = [], 0
    for i, j in traverse((-(centroids[0] @ q[0][0]), -(centroids[1] @ q[1][0]))):
        cell = i * len(centroids[1]) + j
        if counts[cell]:
            out.append(cell)
            seen += int(counts[cell])
            if seen >= depth:
                break
    return out


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k nearest rows found of each query (all, if there are fewer): largest inner product of the original
    vectors in double precision first, ties to the smaller id; a query's own id is no candidate.

    Every valid row of vectors is indexed (see valid()). Rows with one id count once, by the smallest vector. Vectors have one length; others than the most
    frequent length take no part. Equal vectors are one entry of the index with its k + 1 smallest ids, which is all that any answer can name of them, so
    a crowd of copies costs one comparison. The depth of the visits is set on PROBE_ROWS queries against all rows, so that they find `recall` of
    their true neighbours; k entries at least. Empty tables give an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    out_schema = "query_id bigint, rank int, vec_id bigint, score double"
    v = valid(vectors, key, vector)
    sizes = v.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    v = v.where(F.size("_v") == sizes["n"]).groupBy("_id").agg(F.min("_v").alias("_v"))
    # equal vectors become one entry: two steps, the first within shares of a crowd, keep any task small
    share = v.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(64))).withColumn("_i", F.row_number().over(Window.partitionBy("_v", "_s").orderBy("_id"))).where(F.col("_i") <= k + 1)
    first = share.withColumn("_i", F.row_number().over(Window.partitionBy("_v").orderBy("_id"))).where(F.col("_i") <= k + 1)
    e = first.groupBy("_v").agg(F.min("_id").alias("_id"), F.sort_array(F.collect_list("_id")).alias("_ids"))
    e = written(e, "entries")
    rows = e.count()
    centroids, few = fit(e, rows)
    n_cells = len(centroids[0]) * len(centroids[1])
    shared = spark.sparkContext.broadcast(centroids)

    def placed(batches):
        for b in batches:
            b["_cell"] = cells_of(_matrix(b["_v"]), shared.value) if len(b) else []
            yield b
    e = written(e.mapInPandas(placed, "_v array<double>, _id bigint, _ids array<bigint>, _cell bigint"), "cells")
    counts = np.zeros(n_cells, np.int64)
    for r in e.groupBy("_cell").count().collect():  # MAX_CENTROIDS squared at most
        counts[r["_cell"]] = r["count"]
    q = valid(queries, key, vector).where(F.size("_v") == sizes["n"]).groupBy("_id").agg(F.min("_v").alias("_v"))
    q = written(q, "queries")
    depth = _depth(e, q, centroids, counts, k, recall)
    # a path is cut in two: the more entries its first cells hold, the more rows they give and the tighter is the bound for the rest
    near = max(4 * (k + 1), round((depth * CELL_ROWS) ** 0.5))
    plan = spark.sparkContext.broadcast((centroids, counts, depth, near, few))

    def visited(batches):
        c, n, d, first, some = plan.value
        some_cells = cells_of(some, c)
        for b in batches:
            paths = [visits(x, c, n, d) for x in _matrix(b["_v"])] if len(b) else []
            # besides the query's own vector, k entries of its cells at least reach the (k + 1)-th score of those of the sample that lie in them
            least = []
            for x, p in zip(_matrix(b["_v"]) if len(b) else [], paths, strict=True):
                mine = some[np.isin(some_cells, p)] @ x
                least.append(float(np.partition(mine, len(mine) - k - 1)[len(mine) - k - 1]) if len(mine) > k else -np.inf)
            b["_least"] = least
            # the first cells of a path, which give a bound, and the rest
            cut = [int(np.searchsorted(np.cumsum(n[p]), first)) + 1 for p in paths]
            b["_near"], b["_rest"] = [p[:m] for p, m in zip(paths, cut, strict=True)], [p[m:] for p, m in zip(paths, cut, strict=True)]
            yield b
    probes = written(q.mapInPandas(visited, "_id bigint, _v array<double>, _least double, _near array<bigint>, _rest array<bigint>"), "probes")
    first = written(_compared(e, probes.select(F.col("_id").alias("q"), F.col("_v").alias("qv"), F.col("_least").alias("bound"), F.explode("_near").alias("_cell")), k), "pairs")
    # the k-th score of the first cells, or of the sample: an entry further on counts only if it reaches it
    bound = _exact(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("bound"))
    rest = probes.where(F.size("_rest") > 0).join(bound, "_id", "left").select(
        F.col("_id").alias("q"), F.col("_v").alias("qv"), F.greatest("bound", "_least").alias("bound"), F.explode("_rest").alias("_cell"))
    return _exact(first.unionByName(_compared(e, rest, k)), k)


def _compared(e: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the entries of each probed cell that can be among the k nearest: the best of the cell, and none below the query's bound.
    Cells and their queries are dealt in blocks: neither a crowded cell nor a popular one is a single task."""
    probes = written(probes, "asked")
    asked = probes.groupBy("_cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("_nq"))
    filled = e.groupBy("_cell").agg(F.ceil(F.count("*") / ENTRY_BLOCK).alias("_ne"))
    blocks = F.broadcast(asked.join(filled, "_cell"))  # one row for each cell: MAX_CENTROIDS squared at most
    left = (e.join(blocks, "_cell").withColumn("_eb", F.pmod(F.xxhash64("_id"), F.col("_ne")))
            .withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nq") - 1))).select("_cell", "_eb", "_qb", "_ids", "_v"))
    right = (probes.join(blocks, "_cell").withColumn("_qb", F.pmod(F.xxhash64("q"), F.col("_nq")))
             .withColumn("_eb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ne") - 1))).select("_cell", "_eb", "_qb", "q", "qv", "bound"))

    def compared(entries: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = entries["_ids"].tolist()
        rough = _matrix(asking["qv"]) @ _matrix(entries["_v"]).T
        # an entry gives one id at least besides the query's own, or none: k + 1 entries hold the k nearest ids. The margin covers rounding
        keep = min(k + 1, len(ids))
        least = np.maximum(np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep], asking["bound"].to_numpy(float))
        least -= 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0.0)))
        out = [(own, d, float(rough[i, j])) for i, own in enumerate(asking["q"].tolist()) for j in np.flatnonzero(rough[i] >= least[i]).tolist() for d in ids[j] if d != own]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return left.groupBy("_cell", "_eb", "_qb").cogroup(right.groupBy("_cell", "_eb", "_qb")).applyInPandas(compared, "query_id bigint, vec_id bigint, score double")


def _exact(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _depth(e: DataFrame, q: DataFrame, centroids, counts, k: int, recall: float) -> int:
    """Entries to visit, from the true neighbours of a bounded number of queries."""
    sample = [(r["_id"], np.array(r["_v"])) for r in bounded_sample(q, "_id", PROBE_ROWS, 17).collect()]
    if not sample:
        return k
    y = np.array([x for _, x in sample])
    shared = e.sparkSession.sparkContext.broadcast(y)

    def nearest(batches):
        best: list[list[tuple[float, int]]] = [[] for _ in shared.value]
        for b in batches:
            if len(b):
                s = shared.value @ _matrix(b["_v"]).T
                cells = b["_cell"].to_numpy()
                for i, row in enumerate(s):
                    top = np.argpartition(-row, min(k, len(row) - 1))[:k + 1]
                    best[i] = heapq.nlargest(k + 1, best[i] + [(float(row[j]), int(cells[j])) for j in top])
        yield pd.DataFrame([(i, s, c) for i, x in enumerate(best) for s, c in x], columns=["i", "s", "c"])
    found = e.select("_v", "_cell").mapInPandas(nearest, "i int, s double, c bigint")
    rank = Window.partitionBy("i").orderBy(F.desc("s"))
    true = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1).collect()  # PROBE_ROWS x (k + 1)
    needs = []
    for i, (_, x) in enumerate(sample):
        path = visits(x, centroids, counts, int(counts.sum()) + 1)
        upto = dict(zip(path, np.cumsum(counts[path]).tolist(), strict=True))
        needs += [upto[r["c"]] for r in true if r["i"] == i]
    needs.sort()
    return max(k + 1, needs[min(len(needs) - 1, int(recall * len(needs)))])

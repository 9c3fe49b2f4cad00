"""Mixing sources to target weights by weighted fair queueing: every shuffled document gets a virtual finish time,
the tokens of its source up to and with it divided by the source's target; all documents are served in the order of
these times until the total budget is spent."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

#: no source is repeated more often
MAX_REPEATS = 3
#: rows a bucket of the shuffled order holds on average; buckets are what one task sorts
BUCKET_ROWS = 20_000
#: further rounds that fill what the cut leaves open, with documents that still fit
FILL_ROUNDS = 3


def targets(sizes: list[tuple[object, float, int]], budget: float, repeats: int = MAX_REPEATS) -> dict:
    """Target of each source (name, weight, size): shares of the budget by weight, no more than repeats x size, the
    excess shared again by weight until none is above."""
    out, free, left = {}, list(sizes), float(budget)
    while free:
        total = sum(w for _, w, _ in free)
        over = [(n, s) for n, w, s in free if left * w / total > repeats * s]
        if not over:
            return out | {n: left * w / total for n, w, _ in free}
        for n, s in over:
            out[n] = float(repeats * s)
        left -= sum(repeats * s for _, s in over)
        names = {n for n, _ in over}
        free = [x for x in free if x[0] not in names]
    return out


def cycle_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> list[tuple[object, float, int]]:
    """Sources by code point, null last, with the weights in turn. One row for each source reaches the driver."""
    rows = sizes.orderBy(F.col("source").isNull(), "source").collect()
    return [(r["source"], float(weights[i % len(weights)]), r["source_size"]) for i, r in enumerate(rows)]


def _running(d: DataFrame, by: list[str]) -> DataFrame:
    """Adds _end: the running total of size inside a source, in shuffled order, both ends included. Two levels: totals of the
    buckets before, then the rows of the bucket, so that no task sorts a whole source."""
    per = d.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select(F.col("source").alias("_source"), F.col("_b").alias("_bucket"), F.coalesce(before, F.lit(0)).alias("_offset"))
    run = F.sum("size").over(Window.partitionBy("source", "_b").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return (d.withColumn("_run", run)
            .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_bucket")))
            .withColumn("_end", F.col("_run") + F.col("_offset")).drop("_source", "_bucket", "_run", "_offset"))


def _per_source(spark, values: dict, name: str) -> DataFrame:
    """One row for each source: as many as the driver has listed before."""
    return F.broadcast(spark.createDataFrame(list(values.items()), f"_source string, {name} double"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3),
        budget: float | None = None, seed: int = 11) -> DataFrame:
    """One row for each row of docs: key, source, size, source_size, target (its source's), copies, taken (size x copies).

    Sizes are words (null and empty texts 0). The budget is the sum of all sizes unless given. A source whose target is
    above its size is gone through up to three times, each time whole but the last; no document is taken more than three
    times. Where the cut falls inside a document it is served if its middle lies before the cut; what a source is then short
    of is filled in further rounds with documents that fit. Null sources are one source, the last by order. Repeated rows
    count as rows of their own; extra columns are ignored; an empty table gives an empty result.
    The order is a hash of key, text checksum and seed, so reruns agree.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = written(d.select("_key", "source", n_words(F.col("_t")).alias("size"), F.monotonically_increasing_id().alias("_row"),
                         F.xxhash64(F.lit(seed), "_key", F.crc32(F.col("_t").cast("binary"))).alias("_h")), "mix")
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = cycle_weights(sums.select("source", "source_size"), weights)
    rows = d.count()
    total = float(sum(s for _, _, s in plan) if budget is None else budget)
    goal = targets(plan, total)
    pieces = max(1, -(-rows // BUCKET_ROWS))
    d = (d.withColumn("_b", F.pmod(F.shiftright("_h", 8), F.lit(pieces)))
         .join(_per_source(spark, goal, "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
         .join(_per_source(spark, {n: float(s) for n, _, s in plan}, "_size"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))
    shuffled = ["_h", "_key", "_row"]
    d = _running(d, shuffled)
    # a copy for each time the source may be gone through, with its virtual finish time
    times = F.least(F.lit(MAX_REPEATS), F.ceil(F.col("target") / F.col("_size")) + 1)
    copies = (d.where((F.col("size") > 0) & (F.col("target") > 0))
              .withColumn("_p", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
              .withColumn("_vt", ((F.col("_p") - 1) * F.col("_size") + F.col("_end")) / F.col("target")))
    # global order: ranges of virtual time hold about as many tokens each; their totals, then the rows of the range
    # a source has had its target at virtual time 1; a copy that this falls in is served if its middle comes before
    copies = copies.where(F.col("_vt") - F.col("size") / 2 / F.col("target") <= 1)
    copies = copies.select("_row", "size", "_vt", "_h", "_p", F.floor(F.col("_vt") * pieces).alias("_range"))
    spans = copies.groupBy("_range").agg(F.sum("size").alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("_range", ahead.alias("_ahead"))
    order = Window.partitionBy("_range").orderBy("_vt", "_h", "_row", "_p").rowsBetween(Window.unboundedPreceding, 0)
    served = (copies.withColumn("_pos", F.sum("size").over(order)).join(spans, "_range")
              .where(F.col("_ahead") + F.col("_pos") - F.col("size") / 2 <= F.lit(min(total, sum(goal.values()))))
              .groupBy("_row").agg(F.count("*").alias("copies")))
    d = d.drop("_end").join(served, "_row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    for k in range(FILL_ROUNDS):
        d = written(d, f"mix{k}")
        got = {r["source"]: r["w"] for r in d.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("w")).collect()}
        short = {n: t - got.get(n, 0) for n, t in goal.items()}
        d = d.join(_per_source(spark, short, "_short"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        fit = (F.col("size") > 0) & (F.col("size") <= F.col("_short")) & (F.col("copies") < MAX_REPEATS)
        add = (_running(d.where(fit), ["copies", *shuffled]).where(F.col("_end") <= F.col("_short")).select("_row", F.lit(1).alias("_more")))
        d = (d.drop("_short").join(add, "_row", "left")
             .withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0))).drop("_more"))
    return d.select(F.col("_key").alias(key), "source", "size", F.col("_size").cast("bigint").alias("source_size"), "target",
                    F.col("copies").cast("bigint").alias("copies"), (F.col("size") * F.col("copies")).alias("taken"))

"""Positions and running totals that do not send a whole key to one task."""
from pyspark.sql import Column, DataFrame, Window, functions as F

C = F.col
SPAN = 4096


def report_positions(df: DataFrame, *order: str) -> DataFrame:
    """1-based position of the rows of a report. Reports are aggregated tables: one row per
    label, group or split, so their size does not follow the data."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def numbered(df: DataFrame, keys: list[str], order: list, out: str, piece: Column | None = None) -> DataFrame:
    """row_number over (keys, order) in two levels: positions inside pieces of a key, plus the counts of
    its earlier pieces. `piece` must rise with the order; by default it is a span of the first order column."""
    d = df.withColumn("_span", F.floor(C(order[0]) / SPAN) if piece is None else piece)
    inner = Window.partitionBy(*keys, "_span").orderBy(*order)
    d = d.withColumn(out, F.row_number().over(inner).cast("long"))
    per = d.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_base > 0").drop("_n")
    return d.join(base, [*keys, "_span"], "left").withColumn(out, C(out) + F.coalesce("_base", F.lit(0))).drop("_span", "_base")


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums along `order` for every key. `bucket` rises with the order and cuts a key into
    pieces: sums run inside a piece and the totals of the earlier pieces are added."""
    d = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tot = d.groupBy(*keys, "_b").agg(*[F.sum(v).alias("_t_" + o) for o, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = tot.select(*keys, "_b", *[F.coalesce(F.sum("_t_" + o).over(before), F.lit(0)).alias("_p_" + o) for o in sums])
    d = d.withColumns({o: F.sum(v).over(inner) for o, v in sums.items()}).join(base, [*keys, "_b"])
    return d.withColumns({o: C(o) + C("_p_" + o) for o in sums}).drop(*["_p_" + o for o in sums])


def later_max(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Maximum of value at this or any later row, over the pieces `_b` made by running()."""
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    top = df.groupBy(*keys, "_b").agg(F.max(value).alias("_m"))
    after = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    rest = top.select(*keys, "_b", F.max("_m").over(after).alias("_later"))
    return df.withColumn(out, F.max(value).over(inner)).join(rest, [*keys, "_b"]) \
             .withColumn(out, F.greatest(out, "_later")).drop("_later")


def medians(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact median of value for each key (nulls don't count; a key without values has no row), by selection: equal values are counted, counts are added up by whole
    numbers, and only the bucket or two that the middle ranks fall in are put in order. No state grows with the rows of a key."""
    vals = df.filter(C(value).isNotNull()).groupBy(key, C(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", F.floor("_v"))
    per = vals.groupBy(key, "_b").agg(F.sum("_n").alias("_n"))
    up = Window.partitionBy(key).orderBy("_b")
    per = per.withColumns({"_to": F.sum("_n").over(up), "_all": F.sum("_n").over(Window.partitionBy(key))}).withColumn("_from", C("_to") - C("_n"))
    low, high = F.floor((C("_all") - 1) / 2), F.floor(C("_all") / 2)  # ranks from 0
    mid = per.filter((C("_to") > low) & (C("_from") <= high)).select(key, "_b", "_from", "_all")
    d = vals.join(mid, [key, "_b"])
    d = d.withColumn("_to", C("_from") + F.sum("_n").over(Window.partitionBy(key, "_b").orderBy("_v"))).withColumn("_from", C("_to") - C("_n"))
    hit = lambda r: F.max(F.when((C("_from") <= r) & (r < C("_to")), C("_v")))
    return d.groupBy(key).agg(hit(low).alias("_x"), hit(high).alias("_y")).select(key, ((C("_x") + C("_y")) / 2).alias(out))

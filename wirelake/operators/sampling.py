"""Seeded, stratified sampling."""
from pyspark.sql import Column, DataFrame, Window, functions as F

C = F.col


def stratified_sample(images: DataFrame, n: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """n rows of images(image_id, split, classes ARRAY<STRING>, priority BOOLEAN): priority rows up to n // 4, two per split, every class (rare first) up
    to n // classes, then any row; no row twice. Rows of a stratum come by `order` (a hash of the key and the seed unless given), then image_id.

    Strata are ranked in one pass: a rank limit, which Spark applies in every task before it shuffles, leaves the first 2n rows of each, more than can be
    chosen. These few rows make one array for each stratum, and a fold over the strata in the order of the rules settles the quotas; nothing reaches the driver."""
    d = images.withColumn("h", F.xxhash64("image_id", F.lit(seed)) if order is None else order)
    at = lambda tier, name: F.struct(F.lit(tier).alias("tier"), name.alias("name"))
    none = F.array().cast("array<struct<tier:int,name:string>>")
    strata = F.concat(F.array(at(3, F.lit(""))), F.when(C("priority"), F.array(at(0, F.lit("")))).otherwise(none),
                      F.array(at(1, C("split"))), F.transform(F.array_distinct("classes"), lambda c: at(2, c)))
    long = d.select("image_id", "split", "classes", "h", F.explode(strata).alias("stratum"))
    size = long.groupBy("stratum").agg(F.count("*").alias("size"))
    first = long.withColumn("rn", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "image_id"))).filter(C("rn") <= 2 * n)
    row = F.struct("rn", "image_id", "split", "classes")
    by = first.groupBy("stratum").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(size, "stratum")
    # tier, size (for classes only) and name are the order of the rules
    rank = F.struct(C("stratum.tier").alias("tier"), F.when(C("stratum.tier") == 2, C("size")).otherwise(0).alias("size"), C("stratum.name").alias("name"), "rows")
    all_ = by.agg(F.array_sort(F.collect_list(rank)).alias("strata"), F.count_if(C("stratum.tier") == 2).alias("n_classes"))
    per_class = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest("n_classes", F.lit(1))))

    def take(chosen, s):
        mine = lambda r: F.when(s["tier"] == 1, r["split"] == s["name"]).when(s["tier"] == 2, F.array_contains(r["classes"], s["name"])).otherwise(F.lit(False))
        have = F.size(F.filter(chosen, mine))
        quota = F.when(s["tier"] == 0, F.lit(n // 4)).when(s["tier"] == 1, 2 - have).when(s["tier"] == 2, per_class - have).otherwise(n - F.size(chosen))
        free = F.filter(s["rows"], lambda r: ~F.exists(chosen, lambda c: c["image_id"] == r["image_id"]))
        return F.concat(chosen, F.slice(free, 1, F.greatest(F.lit(0), quota).cast("int")))
    kind = dict(by.dtypes)["rows"]
    picked = all_.select(F.explode(F.slice(F.aggregate("strata", F.array().cast(kind), take), 1, n)).alias("r")).select("r.image_id")
    return images.join(picked, "image_id", "left_semi")

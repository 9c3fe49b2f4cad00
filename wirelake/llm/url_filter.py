"""URL rules by expression hashes: every URL is expanded into host suffixes x path prefixes, the expressions
meet the rules on a short hash prefix, full digests confirm, and the longest fitting rule decides."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: hex digits of the digest that the equi-join compares
PREFIX = 8
#: rules up to this number are broadcast (some 100 bytes each); more are shuffled
BROADCAST_RULES = 100_000
#: copies of a rule in the shuffled join, so that a frequent expression such as "com/" is spread over so many tasks
SALTS = 16


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there
    up to "?", "#" or the end. Null or no "://": both empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    return urls.withColumns({
        "host": F.translate(F.regexp_extract(text, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "path": F.regexp_extract(text, _URL, 2)})


def compile_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, action) -> digest, short, rule, length, host_length, action. A rule's host holds for itself and all
    subdomains, its path (beginning with "/") for every path that starts with it. Rows with a null are left out;
    of several actions for one rule, block wins."""
    r = (rules.dropna(subset=["host", "path", "action"])
         .select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path", "action")
         .groupBy("host", "path").agg(F.max("action").alias("action")))
    text = F.concat("host", "path")
    digest = F.sha2(F.concat_ws(" ", "host", "path"), 256)
    return r.select(digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("short"), text.alias("rule"),
                    F.length(text).alias("length"), F.length("host").alias("host_length"), "action")


def judge(urls: DataFrame, rules: DataFrame, key: str, default: str = "allow", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict for every row of urls.

    The longest fitting rule (host and path together; among equals the longer host) gives the verdict; without one it is
    `default`. Host suffixes end at label boundaries. Path prefixes are taken at those lengths, host suffixes of those label counts that occur
    among the rules, so any rule is met exactly and a long host costs no more than a short one. An empty host fits no rule. Repeated rows are judged each on its own; extra
    columns are ignored; empty tables give an empty result or the default everywhere.
    """
    spark = urls.sparkSession
    compiled = compile_rules(rules)
    # distinct lengths of rule paths and label counts of rule hosts: no more of them than the longest rule has characters
    shapes = compiled.select((F.col("length") - F.col("host_length")).alias("n"), F.size(F.split(F.substring("rule", F.lit(1), F.col("host_length")), r"\.")).alias("k")).distinct().collect()
    lengths, counts = sorted({r["n"] for r in shapes}) or [0], sorted({r["k"] for r in shapes}) or [1]
    small = compiled.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    u = parts(urls.select(F.col(key).alias("_key"), F.col(url).alias("_url")), "_url")
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.filter(F.array(*[F.lit(n) for n in counts]), lambda n: n <= F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), ".")))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
                           lambda n: F.col("path").substr(F.lit(1), n))
    digests = F.array_distinct(F.flatten(F.transform("_suffixes", lambda h: F.transform("_prefixes", lambda p: F.sha2(F.concat_ws(" ", h, p), 256)))))
    x = (u.withColumns({"_suffixes": suffixes, "_prefixes": prefixes, "_row": F.monotonically_increasing_id()})
         .select("_row", "_key", "host", "path", F.explode_outer(digests).alias("digest"))
         .withColumn("short", F.substring("digest", 1, PREFIX)))
    r = compiled.withColumnRenamed("digest", "_digest")
    if small:
        met = x.join(F.broadcast(r), "short", "left")
    else:
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
        met = (x.withColumn("salt", F.pmod(F.xxhash64("_row", "digest"), F.lit(SALTS)))
               .join(r.withColumn("salt", F.explode(salts)), ["short", "salt"], "left"))
    # the expressions of a row lie side by side, so that partial aggregation makes one of them before the shuffle
    best = F.max(F.when(F.col("digest") == F.col("_digest"), F.struct("length", "host_length", "rule", "action"))).alias("best")
    return (met.groupBy("_row", "_key", "host", "path").agg(best)
            .select(F.col("_key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.action", F.lit(default)).alias("verdict")))


def rules_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")

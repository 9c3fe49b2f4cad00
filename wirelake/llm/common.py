"""Helpers shared by the operators of this package."""
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A word is a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, name: str = "llm") -> DataFrame:
    """df as a table in the shared folder: later steps reread it instead of computing it again,
    and lost executors cost no more than the task that ran."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(docs: DataFrame, key: str, rows: int, seed: int = 7) -> DataFrame:
    """The `rows` rows of docs (non-null key) whose key has the smallest hashes. `rows` is the documented
    bound of a training sample; only the keys are sorted, the texts of the chosen rows come by a semi join
    with a broadcast of at most `rows` keys."""
    # n smallest hashes, so the same rows come again in every run
    keys = (docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
            .orderBy(F.xxhash64(F.lit(seed), F.col("_k")), "_k").limit(rows).distinct())
    return docs.join(F.broadcast(keys), F.col(key) == F.col("_k"), "left_semi")


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array<bigint> column, in two levels (blocks, then entries), so that
    long arrays cost no quadratic copying. `lengths` has to be a plain column, not an expression."""
    empty = F.array().cast("array<bigint>")

    def state(pos, out):
        return F.struct(pos.cast("bigint").alias("pos"), out.alias("out"))

    def scan(values, start):
        return F.aggregate(values, state(start, empty),
                           lambda s, x: state(s["pos"] + x, F.concat(s["out"], F.array(s["pos"]))), lambda s: s["out"])

    def part(b):
        return F.slice(lengths, (b * block + 1).cast("int"), block)

    blocks = F.sequence(F.lit(0), F.ceil(F.size(lengths) / block).cast("int") - 1)
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("bigint"), lambda s, x: s + x))
    return F.when(F.size(lengths) > 0,
                  F.flatten(F.transform(scan(sums, F.lit(0)), lambda start, b: scan(part(b), start)))).otherwise(empty)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Batches of texts that go to Python: 1,000 rows instead of Spark's 10,000, so that a worker holds a few MB of texts. A setting made by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)

"""Streams over arriving annotation files: running counts and drift against an approved snapshot.

There is no event time, so there are no watermarks. Each batch reads what has arrived since the last one and nothing else: what earlier batches
held is in the state store. What a batch returns is written under its number and counts once the manifest names it, so a reader sees
whole results of one batch, also while the next is being written and after a crash at any point."""
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.audit import clipped
from ..session import scratch_path, spread
from ..sources.annotations import objects, parse

C = F.col


def _listed(spark: SparkSession, out: str) -> list[int]:
    """Batches that the manifest names: one small row each."""
    try:
        return sorted(r.epoch for r in spark.read.schema("epoch long").parquet(f"{out}/manifest").collect())
    except AnalysisException:  # nothing has been written yet
        return []


def _published(batch: DataFrame, epoch: int, out: str) -> None:
    """Write a batch, then name it. A batch that runs again after a crash replaces what the manifest doesn't name yet, and leaves
    alone what it names."""
    spark = batch.sparkSession
    if epoch in _listed(spark, out):
        return
    batch.write.mode("overwrite").parquet(f"{out}/batches/epoch={epoch}")
    _named(spark, epoch, out)


def _named(spark: SparkSession, epoch: int, out: str) -> None:
    spark.range(epoch, epoch + 1).select(C("id").alias("epoch")).coalesce(1).write.mode("append").parquet(f"{out}/manifest")


def _drain(stream: DataFrame, mode: str, out: str, checkpoint: str) -> list[dict]:
    """Run one pass over what has arrived; files seen before are skipped by the checkpoint. Returns the progress of its batches."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, epoch: _published(b, epoch, out)).trigger(availableNow=True).start())
    q.awaitTermination()
    return q.recentProgress


def incremental_counts(objects: DataFrame, images: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Stream of object rows -> counts per split of classes kept and box problems. State is one counter for each split and item; every batch writes
    all counters. counts() reads the newest whole ones."""
    d = clipped(objects).join(images, "image_id")
    items = F.array_compact(F.array(F.when(C("box").isNotNull(), C("cls")), C("box_problem")))
    counts = d.select("split", F.explode(items).alias("item")).groupBy("split", "item").agg(F.count("*").alias("n"))
    return _drain(counts, "complete", out, checkpoint)


def counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts after the newest batch that the manifest names."""
    epochs = _listed(spark, out)
    if not epochs:
        return spark.createDataFrame([], "split string, item string, n long")
    return spark.read.parquet(f"{out}/batches/epoch={epochs[-1]}")


def drift_guard(rows: DataFrame, approved: DataFrame, key: str, out: str, checkpoint: str) -> list[dict]:
    """Stream of label rows, held against the approved rows of their keys.

    The approved rows are put beside the output at the first call and enter the stream once, as minus one each; arriving rows are plus one. The state store
    holds the signed count of each row of each key, spread by both, so a key with very many rows is no hot spot; a batch updates
    the counts of its own rows and writes those. A row that comes twice counts twice. A guard belongs to one snapshot: another one
    needs its own output and checkpoint."""
    spark, columns = rows.sparkSession, approved.columns
    approved.write.mode("ignore").parquet(f"{out}/approved")
    old = spark.readStream.schema(approved.schema).parquet(f"{out}/approved").select(*columns, F.lit(-1).alias("_sign"))
    both = old.unionByName(rows.select(*columns, F.lit(1).alias("_sign")))
    state = both.groupBy(*columns).agg(F.sum("_sign").alias("extra"), F.max(C("_sign") > 0).alias("arrived"))
    return _drain(state, "update", out, checkpoint)


def drift(spark: SparkSession, key: str, out: str) -> DataFrame:
    """Signed differences of every key of which any row has arrived: rows with extra, the number by which one side has more of them, and side."""
    epochs = _listed(spark, out)
    # the approved rows are there from the first call on, so is their schema
    columns = spark.read.parquet(f"{out}/approved").schema
    names = columns.fieldNames()
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", extra long, arrived boolean, epoch long"
    d = spark.read.schema(shape).option("basePath", f"{out}/batches").parquet(*[f"{out}/batches/epoch={e}" for e in epochs])
    last = d.groupBy(*names).agg(F.max_by(F.struct("extra", "arrived"), "epoch").alias("s")).select(*names, "s.*")
    seen = last.filter("arrived").select(key).distinct()
    side = F.when(C("extra") > 0, "new").otherwise("approved")
    return last.filter("extra <> 0").join(seen, key, "left_semi").select(*names, F.abs("extra").alias("extra"), side.alias("side"))


def annotation_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation texts (image_id, xml) of a folder as a stream of object rows, parsed as they arrive; unreadable texts give none."""
    docs = spark.readStream.schema("image_id long, xml string").parquet(folder)
    return objects(parse(spread(docs, "image_id")), ["image_id"])


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's files of one table as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def fresh(spark: SparkSession) -> tuple[str, str]:
    return scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")

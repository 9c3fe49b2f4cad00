"""JSON artefacts, label lines, sentences and netlist texts; and the sinks that write them."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..vocabulary import NOT_AVAILABLE

SENTENCE = "id BIGINT, text STRING, tokens ARRAY<STRING>, tags ARRAY<STRING>, source STRING, tree STRING"


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENTENCE).json(path)


def read_netlists(spark: SparkSession, path: str) -> DataFrame:
    """Files group/stem.cir -> (group, stem, text)."""
    return _netlists(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("text")))


def _netlists(docs: DataFrame) -> DataFrame:
    return docs.select(F.element_at(F.split("p", "/"), -2).alias("grp"), F.regexp_extract("p", r"([^/]+)\.cir$", 1).alias("stem"), "text")


def pack(docs: DataFrame, folder: str) -> None:
    """docs(path, text): documents with their paths, many to a file. A document of 100 bytes as a file of its own takes a block of the disk (4 KB)
    and an entry of every listing; keyed_files.write() is for readers that need such files."""
    docs.select("path", F.coalesce("text", F.lit("")).alias("text")).write.parquet(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of pack(): (p, text)."""
    return spark.read.schema("path string, text string").parquet(folder).withColumnRenamed("path", "p")


def read_packed_netlists(spark: SparkSession, folder: str) -> DataFrame:
    """Packed documents group/stem.cir -> (group, stem, text)."""
    return _netlists(read_packed(spark, folder))


def text_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Document rows -> one row per line, numbered from 1."""
    body = F.regexp_replace(F.col(text), r"\R\z", "")
    return docs.select(*keys, F.posexplode(F.split(body, r"\R")).alias("pos", "line")) \
               .select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def line_documents(lines: DataFrame, key: str, order: str = "line_no") -> DataFrame:
    """Line rows -> one text per key. A netlist or report is one document by format."""
    rows = F.array_sort(F.collect_list(F.struct(order, "line")))
    return lines.groupBy(key).agg(F.concat(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def label_boxes(lines: DataFrame, w: Column, h: Column) -> DataFrame:
    """Normalised label lines 'class cx cy w h' -> corner boxes in pixels."""
    p = F.split(F.trim("line"), r"\s+")
    num = lambda k: F.get(p, F.lit(k)).try_cast("double")
    cx, cy, bw, bh = num(1) * w, num(2) * h, num(3) * w, num(4) * h
    return lines.filter(F.length(F.trim("line")) > 0).withColumns({
        "cls_id": F.get(p, F.lit(0)).try_cast("int"), "x1": cx - bw / 2, "y1": cy - bh / 2, "x2": cx + bw / 2, "y2": cy + bh / 2})


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files split/stem.txt, one for each photo -> (split, stem, line_no, line)."""
    return label_lines_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("text")))


def label_lines_of(docs: DataFrame) -> DataFrame:
    """(p: .../split/stem.txt, text) -> (split, stem, line_no, line)."""
    return text_lines(docs.select(F.element_at(F.split("p", "/"), -2).alias("split"), F.regexp_extract("p", r"([^/]+)\.txt$", 1).alias("stem"), "text"), ["split", "stem"])


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """Metric files as text, one row per file; unreadable content turns into NULL fields later."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("name"), F.col("value").alias("json"))


def tolerant(expected: DataFrame, artefacts: DataFrame, key: str, schema: str) -> DataFrame:
    """Every expected artefact with its parsed content, NULL where missing or unreadable."""
    d = artefacts.withColumn("m", F.from_json("json", schema, {"mode": "PERMISSIVE"})).drop("json")
    return expected.join(d, key, "left")


def shown(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull(), NOT_AVAILABLE).otherwise(F.format_string(f"%.{digits}f", value))


def write_lines(lines: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """Line rows as text files below by=value folders. The rows of one document are range-
    partitioned by their order, so a very long document becomes several ordered part files."""
    body = F.coalesce("line", F.lit("")).alias("value")
    (lines.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
     .select(*by, body).write.mode("overwrite").partitionBy(*by).text(path))


def write_ragged_csv(frames: list[DataFrame], path: str, drop: str) -> None:
    """Rows of several shapes under one header, the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.drop(drop).write.mode("overwrite").option("header", True).csv(path)

"""Annotation documents (one XML text per photo) as object rows."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import symbols as S

_BOX = "xmin STRING, ymin STRING, xmax STRING, ymax STRING, rotation STRING, mirror STRING, mirrored STRING"
ANNOTATION = (f"size STRUCT<width: STRING, height: STRING>, object ARRAY<STRUCT<name: STRING, text: STRING, rotation: STRING, "
              f"mirror: STRING, mirrored: STRING, bndbox: STRUCT<{_BOX}>>>, _corrupt_record STRING")
FIELDS = "object ARRAY<MAP<STRING, STRING>>"
BOX_FIELDS = "object ARRAY<STRUCT<bndbox: MAP<STRING, STRING>>>"
OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Files drafter/annotations/stem.xml -> (drafter, stem, xml)."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("xml"))
    return d.select(F.element_at(F.split("p", "/"), -3).alias("drafter"),
                    F.regexp_extract("p", r"([^/]+)\.xml$", 1).alias("stem"), "xml")


def parse(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds the parsed document as `doc`; a malformed text, or one with an object without four corners in numbers, keeps its row with `parse_error` set."""
    d = docs.withColumn("doc", F.from_xml(F.col(xml), ANNOTATION, OPTIONS)).drop(xml)
    lame = lambda o: F.greatest(*[o["bndbox"][k].try_cast("double").isNull() for k in ("xmin", "ymin", "xmax", "ymax")])
    bad = F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull() | F.coalesce(F.exists("doc.object", lame), F.lit(False))
    return d.withColumn("parse_error", bad)


def either_level(tag: str):
    """The box element wins over the object element."""
    return F.coalesce(F.col(f"o.bndbox.{tag}"), F.col(f"o.{tag}"))


def objects(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per annotated object of every readable document; a document without objects keeps one empty row."""
    size = lambda k: F.coalesce(F.col(f"doc.size.{k}").try_cast("double").cast("int"), F.lit(0))
    d = parsed.filter(~F.col("parse_error")).select(*keys, size("width").alias("w"), size("height").alias("h"),
                                                    F.posexplode_outer("doc.object").alias("pos", "o"))
    corner = lambda k: F.col(f"o.bndbox.{k}").try_cast("double")
    return d.select(*keys, (F.col("pos") + 1).cast("long").alias("obj_idx"), F.col("o.name").alias("label"),
                    corner("xmin").alias("x1"), corner("ymin").alias("y1"), corner("xmax").alias("x2"), corner("ymax").alias("y2"),
                    either_level("rotation").alias("rotation"),
                    F.coalesce(either_level("mirror"), either_level("mirrored")).alias("mirror"),
                    F.col("o.text").alias("txt"), "w", "h")


def detections(objs: DataFrame) -> DataFrame:
    """Detection rows: whole-pixel corners, confidence 1, quarter-turn rotation, unmapped labels kept as 'other'."""
    cut = lambda k: F.col(k).cast("int").alias(k)
    return objs.select("image_id", F.col("obj_idx").alias("det_idx"), S.scoped_class(F.col("label"), keep_other=True).alias("cls"),
                       *map(cut, ("x1", "y1", "x2", "y2")), F.lit(1.0).alias("conf"), "txt",
                       S.rotation_bin(F.col("label"), F.col("rotation")).alias("rotation"), S.mirrored(F.col("mirror")).alias("mirrored"))


def field_counts(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """How often each field occurs inside an object and inside its box element."""
    def count(schema, fields, level):
        d = docs.select(F.explode(F.from_xml(F.col(xml), schema, OPTIONS)["object"]).alias("o"))
        return d.select(F.explode(F.map_keys(fields)).alias("field")).groupBy("field").agg(F.count("*").alias("n")) \
                .select(F.lit(level).alias("level"), "field", "n")
    return count(FIELDS, F.col("o"), "object").unionByName(count(BOX_FIELDS, F.col("o.bndbox"), "bndbox"))


def documents(objs: DataFrame) -> DataFrame:
    """Annotation texts of an object table, one per photo as the format asks.
    Every second object carries rotation and mirror beside its box instead of inside."""
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>")), F.lit(""))
    odd = F.col("obj_idx") % 2 == 1
    inner = F.when(odd, F.concat(tag("rotation", F.col("rotation")), tag("mirror", F.col("mirror")))).otherwise("")
    outer = F.when(odd, F.when(F.col("rotation").isNotNull(), "<rotation>999</rotation>").otherwise("")) \
             .otherwise(F.concat(tag("rotation", F.col("rotation")), tag("mirrored", F.col("mirror"))))
    one = F.concat(F.lit("<object>"), tag("name", F.col("label")), F.lit("<bndbox>"), tag("xmin", F.col("x1")), tag("ymin", F.col("y1")),
                   tag("xmax", F.col("x2")), tag("ymax", F.col("y2")), inner, F.lit("</bndbox>"), tag("text", F.col("txt")), outer,
                   F.lit("</object>"))
    rows = F.array_sort(F.collect_list(F.struct("obj_idx", one.alias("t"))))
    return objs.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"), rows.alias("r")).select(
        "image_id", F.concat(F.lit("<annotation><size>"), tag("width", F.col("w")), tag("height", F.col("h")), F.lit("</size>"),
                             F.array_join(F.transform("r", lambda x: x["t"]), ""), F.lit("</annotation>")).alias("xml"))

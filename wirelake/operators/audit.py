"""Audit and conversion of annotated photo sets."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boxes as B, symbols as S
from ..vocabulary import CLASSES, POLARISED

C = F.col


def clipped(objs: DataFrame) -> DataFrame:
    """In-scope objects with class, clipped box and what happened to the box."""
    d = objs.withColumn("cls", S.canonical_class(C("label"))).filter("cls IS NOT NULL") \
            .withColumn("box", B.clip(*B.corners(), C("w"), C("h")))
    same = (C("box.x1") == C("x1")) & (C("box.y1") == C("y1")) & (C("box.x2") == C("x2")) & (C("box.y2") == C("y2"))
    return d.withColumn("box_problem", F.when(C("box").isNull(), "boxes_dropped").when(~same, "boxes_clipped"))


def label_lines(objs: DataFrame, images: DataFrame) -> DataFrame:
    """Label lines of every image; an image with nothing in scope keeps one empty line."""
    d = clipped(objs).filter("box IS NOT NULL").select(
        "image_id", "obj_idx", B.label_line(S.class_id(C("cls")), C("box"), C("w"), C("h")).alias("line"))
    return images.join(d, "image_id", "left")


def split_counts(objs: DataFrame, images: DataFrame) -> DataFrame:
    """Images, objects and objects per class for every split, after clipping."""
    wide = clipped(objs).filter("box IS NOT NULL").groupBy("image_id").agg(
        F.count("*").alias("objects"), *[F.count_if(C("cls") == c).alias(c) for c in CLASSES])
    return images.join(wide, "image_id", "left").groupBy("split").agg(
        F.count("*").alias("images"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES])


def counted(flags: DataFrame, *problems: Column) -> DataFrame:
    """Rows x nullable problem names -> counts; a problem that never occurs has no row."""
    return flags.select(F.explode(F.array_compact(F.array(*problems))).alias("problem")) \
                .groupBy("problem").agg(F.count("*").alias("n"))


def pairing(photos: DataFrame) -> DataFrame:
    """(drafter, stem) present as image and/or annotation -> pairing state."""
    xml = photos.filter("has_xml").select("drafter", "stem", F.lit(True).alias("xml"))
    img = photos.filter("has_image").select("drafter", "stem", F.lit(True).alias("img"))
    d = xml.join(img, ["drafter", "stem"], "full_outer")
    state = F.when(C("img").isNull(), "xml_without_image").when(C("xml").isNull(), "image_without_xml").otherwise("paired")
    return d.select("drafter", "stem", state.alias("state"))


def inventory(pairs: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(C("state").isin(*s))
    return pairs.groupBy("drafter").agg(
        n("paired", "xml_without_image").alias("xml"), n("paired", "image_without_xml").alias("images"), n("paired").alias("paired"),
        n("xml_without_image").alias("xml_without_image"), n("image_without_xml").alias("images_without_xml"))


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def nested(df: DataFrame, key: str, inner: str, n: str = "n") -> DataFrame:
    """Counts per (key, inner) -> one map per key, in key order of the inner value."""
    entries = F.array_sort(F.collect_list(F.struct(inner, n)))
    return df.groupBy(key).agg(F.map_from_entries(entries).alias("counts"))


def first_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group. The k-limit is applied before the shuffle as well as after it."""
    from pyspark.sql import Window
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(C("rn") <= k)


def missing_rotation(objs: DataFrame) -> DataFrame:
    """Polarised labels with fewer rotations than objects."""
    d = objs.filter(F.lower(F.ltrim("label")).rlike("^(diode|voltage)"))
    return d.groupBy("label").agg((F.count("*") - F.count("rotation")).alias("missing")).filter("missing > 0")


def crop_counts(objs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable crops per class and rotation, and the reasons others were skipped."""
    d = objs.select(S.canonical_class(C("label")).alias("cls"), S.rotation_bin(C("label"), C("rotation")).alias("rotation"),
                    S.mirrored(C("mirror")).alias("mirrored")).filter(C("cls").isin(*POLARISED))
    reason = F.when(C("rotation").isNull(), "no_rotation").when(F.coalesce("mirrored", F.lit(False)), "mirrored")
    d = d.withColumn("skip", reason)
    return histogram(d.filter("skip IS NULL"), "cls", "rotation"), counted(d, C("skip"))


def signed_diff(new: DataFrame, approved: DataFrame) -> DataFrame:
    """Multiset difference in both directions in one pass: rows whose copies differ."""
    cols = approved.columns
    both = new.select(*cols, F.lit(1).alias("s")).unionByName(approved.select(*cols, F.lit(-1).alias("s")))
    d = both.groupBy(*cols).agg(F.sum("s").alias("extra")).filter("extra <> 0")
    return d.withColumn("side", F.when(C("extra") > 0, "new").otherwise("approved")).withColumn("extra", F.abs("extra"))


def rotation_groups(objs: DataFrame) -> DataFrame:
    """Polarised source labels with the text form of their rotation bin ('none', mirror suffix) and its sort key."""
    b = F.coalesce(S.quarter_turn(C("rotation").try_cast("double")).cast("string"), F.lit("none"))
    bin_ = F.concat(b, F.coalesce(F.concat(F.lit(" mirror="), "mirror"), F.lit("")))
    d = objs.filter(F.lower("label").rlike("^(diode|voltage)")).withColumn("bin", bin_)
    return d.withColumn("bin_order", F.struct(C("bin").startswith("none").alias("none"),
                                              F.coalesce(F.split("bin", " ")[0].try_cast("int"), F.lit(0)).alias("deg"), C("bin").alias("bin")))


def size_check(readable: Column, w: Column, h: Column, raw_w: Column, raw_h: Column, shown_w: Column, shown_h: Column) -> Column:
    """How the size in an annotation stands to the size of its image as stored and as displayed."""
    return (F.when(~readable, "unreadable_image").when((w == shown_w) & (h == shown_h), "xml_matches_displayed")
            .when((w == raw_w) & (h == raw_h), "xml_matches_raw_only(EXIF rotated)").otherwise("xml_size_mismatch"))


def approval(objs: DataFrame) -> DataFrame:
    """One row for objs(image_id, obj_idx, label): how many, a checksum that any change of a key or label changes, and the time."""
    label = F.conv(F.substring(F.md5("label"), 1, 7), 16, 10).cast("bigint")
    mixed = (C("image_id") * 48271 + C("obj_idx") * 16807 + label * 69621) % 2147483647
    return objs.agg(F.count("*").alias("objects"), F.sum(mixed).alias("checksum")).withColumn("approved_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))

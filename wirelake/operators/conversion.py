"""What becomes of each annotated photo on its way into the training set. One outcome for each photo decides in all
reports whether its boxes count."""
from pyspark.sql import DataFrame, functions as F

from ..functions import symbols as S

C = F.col
#: the boxes of these photos are clipped and counted as problems; only converted ones enter the set
REACHED = ("converted", "unreadable_image")


def outcomes(photos: DataFrame, parsed: DataFrame, headers: DataFrame) -> DataFrame:
    """photos(image_id, drafter, stem, has_image, has_xml), parsed annotations (annotations.parse) and image headers (image_id, raw_w, raw_h, exif,
    readable) -> outcome of every photo with an annotation. In this order: no image, unreadable annotation, no size, unreadable image, converted."""
    size = lambda k: F.coalesce(C(f"doc.size.{k}").try_cast("double").cast("int"), F.lit(0)).alias(k[0])
    docs = parsed.select("image_id", "parse_error", size("width"), size("height"))
    d = photos.filter("has_xml").join(docs, "image_id", "left").join(headers, "image_id", "left")
    outcome = (F.when(~C("has_image"), "missing_image").when(F.coalesce("parse_error", F.lit(True)), "xml_parse_error")
               .when((C("w") <= 0) | (C("h") <= 0), "missing_size").when((C("exif") != 1) & ~C("readable"), "unreadable_image").otherwise("converted"))
    frame = F.when(outcome.isin(*REACHED) & (C("exif") != 1), S.frame_class(*[C(k) for k in ("raw_w", "raw_h", "exif", "readable", "w", "h")]))
    return d.select("image_id", "drafter", "stem", outcome.alias("outcome"), frame.alias("frame"), "w", "h")


def failures(out: DataFrame) -> DataFrame:
    """One line for each failure of any kind; the table is whole, a display limit is the caller's."""
    name = F.concat("drafter", F.lit("/"), "stem")
    why = (F.when(C("outcome") == "missing_image", ".xml: no image").when(C("outcome") == "xml_parse_error", ".xml: parse error")
           .when(C("outcome") == "missing_size", F.concat(F.lit(".xml: size "), C("w").cast("string"), F.lit("x"), C("h").cast("string")))
           .when(C("frame").isin("ambiguous", "mismatch"), F.concat(F.lit(": EXIF frame "), "frame")))
    return out.select(F.concat(name, why).alias("failure")).filter("failure IS NOT NULL")

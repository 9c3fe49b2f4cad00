"""Labels, rotation, polarity and photo names as column expressions."""
from pyspark.sql import Column, functions as F

from ..vocabulary import (CLASSES, LABEL_TO_CLASS, MIRROR_TRUE, OTHER, POLARISED, SIDES, STEM)


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def canonical_class(label: Column) -> Column:
    """One of the canonical classes, or NULL when the label is out of scope."""
    return F.try_element_at(literal_map(LABEL_TO_CLASS), F.lower(F.trim(label)))


def scoped_class(label: Column, raw: bool = False, keep_other: bool = False) -> Column:
    if raw:
        return label
    mapped = canonical_class(label)
    return F.coalesce(mapped, F.lit(OTHER)) if keep_other else mapped


def class_id(cls: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, CLASSES)), cls) - 1).cast("int")


def split_of(group: Column, val: list[str], test: list[str]) -> Column:
    return F.when(group.isin(*val), "val").when(group.isin(*test), "test").otherwise("train")


def quarter_turn(degrees: Column) -> Column:
    """Nearest of 0/90/180/270; halves go to the even quarter."""
    return F.pmod(F.bround(degrees / 90).cast("long") * 90, F.lit(360)).cast("int")


def source_rotation(label: Column, rotation: Column) -> Column:
    """Annotated degrees with the extra 270 that one source label needs; NULL if not a number."""
    deg = rotation.try_cast("double")
    return F.when(label == "voltage.dc", F.pmod(deg + 270, F.lit(360.0))).otherwise(deg)


def rotation_bin(label: Column, rotation: Column, clockwise: bool = False) -> Column:
    r = quarter_turn(source_rotation(label, rotation))
    return F.pmod(-r, F.lit(360)).cast("int") if clockwise else r


def raw_rotation_facts(rotation: Column) -> dict[str, Column]:
    """Audit view of a rotation text: bin, signed offset from it, offset bucket."""
    deg = F.pmod(rotation.try_cast("double"), F.lit(360.0))
    b = quarter_turn(deg)
    off = F.pmod(deg - b + 180, F.lit(360.0)) - 180
    bucket = (F.when(rotation.isNull(), None).when(deg.isNull(), "unparsable")
              .when(F.abs(off) <= 5, "<=5").when(F.abs(off) <= 15, "<=15").otherwise(">15"))
    return {"bin": b, "offset": off, "offset_bucket": bucket}


def mirrored(value: Column) -> Column:
    return F.when(value.isNull(), None).otherwise(F.lower(F.trim(value)).isin(*MIRROR_TRUE))


def positive_side(cls: Column, rotation: Column, plus_at_0: str = "left") -> Column:
    base = SIDES.index(plus_at_0)
    idx = F.pmod(F.lit(base) + F.floor(rotation / 90), F.lit(4)).cast("int")
    return F.when(cls.isin(*POLARISED) & rotation.isNotNull(),
                  F.get(F.array(*map(F.lit, SIDES)), idx))


def scorable(cls: Column, rotation: Column, mirror: Column) -> Column:
    return cls.isin(*POLARISED) & rotation.isNotNull() & ~F.coalesce(mirror, F.lit(False))


def drafter_number(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"-?\d+", 0), F.lit("")).cast("long"), F.lit(10 ** 6))


def circuit_of(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, STEM, 1), F.lit(""))


def drawing_of(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, STEM, 2), F.lit(""))


def displayed_size(raw_w, raw_h, exif) -> tuple[Column, Column]:
    swap = exif.isin(5, 6, 7, 8)
    return F.when(swap, raw_h).otherwise(raw_w), F.when(swap, raw_w).otherwise(raw_h)


def frame_class(raw_w, raw_h, exif, readable, w, h) -> Column:
    """Which pixel frame the annotated size refers to."""
    sw, sh = displayed_size(raw_w, raw_h, exif)
    shown, raw = (sw == w) & (sh == h), (raw_w == w) & (raw_h == h)
    return (F.when(~readable, "unreadable").when(exif == 1, "upright").when(shown & raw, "ambiguous")
            .when(raw, "raw").when(shown, "displayed").otherwise("mismatch"))


def size_check(raw_w, raw_h, exif, readable, w, h) -> Column:
    sw, sh = displayed_size(raw_w, raw_h, exif)
    return (F.when(~readable, "unreadable_image").when((sw == w) & (sh == h), "xml_matches_displayed")
            .when((raw_w == w) & (raw_h == h), "xml_matches_raw_only(EXIF rotated)")
            .otherwise("xml_size_mismatch"))


def repaired_size(raw_w, raw_h, exif, readable, w, h) -> Column:
    """Annotated size, or the displayed size when it fits neither frame."""
    sw, sh = displayed_size(raw_w, raw_h, exif)
    fits = ((sw == w) & (sh == h)) | ((raw_w == w) & (raw_h == h))
    keep = ~readable | raw_w.isNull() | fits
    return F.struct(F.when(keep, w).otherwise(sw).alias("w"), F.when(keep, h).otherwise(sh).alias("h"),
                    (~keep).alias("placeholder"))

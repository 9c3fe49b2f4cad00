"""Box arithmetic as column expressions. A box is four columns x1, y1, x2, y2."""
from pyspark.sql import Column, functions as F

EPS = 1e-9


def corners(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + k) for k in ("x1", "y1", "x2", "y2"))


def clip(x1, y1, x2, y2, w, h) -> Column:
    """Corners put in order and cut to the image; NULL when a side is shorter than 1."""
    lo_x = F.greatest(F.lit(0.0), F.least(x1, x2))
    lo_y = F.greatest(F.lit(0.0), F.least(y1, y2))
    hi_x = F.least(w.cast("double"), F.greatest(x1, x2))
    hi_y = F.least(h.cast("double"), F.greatest(y1, y2))
    return F.when((hi_x - lo_x >= 1) & (hi_y - lo_y >= 1),
                  F.struct(lo_x.alias("x1"), lo_y.alias("y1"), hi_x.alias("x2"), hi_y.alias("y2")))


def iou(a, b, eps: float = EPS) -> Column:
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    inter = (F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
             * F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1)))
    return inter / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter + F.lit(eps))


def centre(x1, y1, x2, y2) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def longer_side(x1, y1, x2, y2) -> Column:
    return F.greatest(x2 - x1, y2 - y1)


def shape_class(x1, y1, x2, y2, factor: float = 1.2) -> Column:
    w, h = x2 - x1, y2 - y1
    return F.when(w > factor * h, "wide").when(h > factor * w, "tall").otherwise("square")


def quality(x1, y1, x2, y2, w, h) -> dict[str, Column]:
    """Box checks of the audit; bounds are ignored where the image size is 0."""
    parsed = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return {
        "unparsable": ~parsed,
        "inverted_or_empty": parsed & ((x2 <= x1) | (y2 <= y1)),
        "out_of_bounds": parsed & ((x1 < 0) | (y1 < 0) | ((w != 0) & (x2 > w)) | ((h != 0) & (y2 > h))),
    }


def label_line(class_id, box, w, h) -> Column:
    """'id cx cy w h' with the centre and size as shares of the image."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id,
                           (box["x1"] + box["x2"]) / 2 / w, (box["y1"] + box["y2"]) / 2 / h,
                           (box["x2"] - box["x1"]) / w, (box["y2"] - box["y1"]) / h)


def terminal_points(cx, cy, size, vertical) -> Column:
    """Two end points of a part, left or top first."""
    half = size / 2
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when(vertical, F.array(point(cx, cy - half), point(cx, cy + half))) \
            .otherwise(F.array(point(cx - half, cy), point(cx + half, cy)))


def part_box(cx, cy, long_side, short_side, vertical, scale) -> Column:
    w = F.when(vertical, short_side).otherwise(long_side)
    h = F.when(vertical, long_side).otherwise(short_side)
    cut = lambda c: (c * scale).cast("int")
    return F.struct(cut(cx - w / 2).alias("x1"), cut(cy - h / 2).alias("y1"),
                    cut(cx + w / 2).alias("x2"), cut(cy + h / 2).alias("y2"))


def jitter(key: Column, share: float, seed: int, x1, y1, x2, y2) -> Column:
    """Shift and resize by at most `share` of the size; the noise is a hash of the key."""
    def noise(slot):
        h = F.conv(F.substring(F.md5(F.concat_ws("/", key, F.lit(seed), F.lit(slot))), 1, 8), 16, 10).cast("long") % 1_000_000
        return (h / 1_000_000.0 * 2 - 1) * share
    w, h = x2 - x1, y2 - y1
    cx, cy = (x1 + x2) / 2 + noise(0) * w, (y1 + y2) / 2 + noise(1) * h
    nw, nh = w * (1 + noise(2)), h * (1 + noise(3))
    return F.struct((cx - nw / 2).alias("x1"), (cy - nh / 2).alias("y1"),
                    (cx + nw / 2).alias("x2"), (cy + nh / 2).alias("y2"))

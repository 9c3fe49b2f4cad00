"""Box joins and one-to-one matching.

Boxes meet through grid cells: the join key is (image, cell), so a photo with very many boxes is
spread over its cells and no image is compared all against all."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import boxes as B
from ..functions.values import drawn_value
from ..session import cut
from ..vocabulary import ELEMENT_PREFIX

C = F.col
BOX = ("x1", "y1", "x2", "y2")


def _cells(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def _level(side: Column) -> Column:
    return F.ceil(F.log(4.0, F.greatest(side, F.lit(1.0)))).cast("int")


def _cell_size(level: Column) -> Column:
    return F.pow(F.lit(4.0), level + 1)


def _renamed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[C(c).alias(prefix + c) for c in df.columns if c not in keep])


#: groups of up to so many right boxes meet all left ones of the group; the others meet by cells
FEW_BOXES = 64


def close_pairs(left: DataFrame, right: DataFrame, group: list[str], min_iou: float = 0.5) -> DataFrame:
    """Pairs with IoU >= min_iou for min_iou >= 0.5, columns prefixed l_ and r_. Lower thresholds go through overlapping_pairs.

    A left box is compared with all of up to FEW_BOXES right boxes of its group; only those of larger groups are spread over cells."""
    if min_iou < 0.5:
        return overlapping_pairs(left, right, group, min_iou)
    sound = (C("x2") > C("x1")) & (C("y2") > C("y1"))
    a, b = left.filter(sound), right.filter(sound)
    many = cut(b.groupBy(*group).agg(F.count("*").alias("_n")).filter(C("_n") > FEW_BOXES).select(*group))
    some = None if many.isEmpty() else _pairs_by_cells(a.join(many, group, "left_semi"), b.join(many, group, "left_semi"), group)
    if some is not None:
        b = b.join(many, group, "left_anti")
    d = _renamed(a, "l_", group).join(_renamed(b, "r_", group), group)
    d = d if some is None else d.unionByName(some)
    return d.withColumn("iou", B.iou(B.corners("l_"), B.corners("r_"))).filter(C("iou") >= min_iou)


def _pairs_by_cells(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Candidates for an IoU of 0.5: at such an overlap the centre of one box lies in the other and their longer sides differ by at
    most a factor 2. So a left box needs one cell (its centre, at its size level) and a right box
    the few cells it covers at the one or two levels a partner can have."""
    side = B.longer_side(*B.corners())
    cx, cy = B.centre(*B.corners())
    a = left.withColumn("_lv", _level(side)).withColumns(
        {"_gx": F.floor(cx / _cell_size(C("_lv"))), "_gy": F.floor(cy / _cell_size(C("_lv")))})
    b = right.withColumn("_lv", F.explode(F.sequence(_level(side / 2), _level(side * 2))))
    b = b.withColumn("_gx", F.explode(_cells(C("x1"), C("x2"), _cell_size(C("_lv"))))) \
         .withColumn("_gy", F.explode(_cells(C("y1"), C("y2"), _cell_size(C("_lv")))))
    keys = [*group, "_lv", "_gx", "_gy"]
    return _renamed(a, "l_", keys).join(_renamed(b, "r_", keys), keys).drop("_lv", "_gx", "_gy")


def _known_levels(*dfs: DataFrame) -> list[int]:
    """Size levels that occur: a few tens at most, one for each factor of four in size."""
    d = dfs[0]
    for o in dfs[1:]:
        d = d.unionByName(o)
    return sorted(r[0] for r in d.distinct().filter("_lv IS NOT NULL").collect())


def overlapping_pairs(left: DataFrame, right: DataFrame, group: list[str], min_iou: float) -> DataFrame:
    """All pairs with an IoU above 0 and of at least min_iou, columns prefixed l_ and r_.

    Boxes meet at the size level of the larger one: every box is spread over the cells it covers (four at most) at its own
    level and at the higher levels that occur. A pair counts only in the cell that holds the low corner of its intersection,
    so it appears once. A min_iou of 0 asks for every pair that touches, which in a dense photo grows with the square of its boxes."""
    sound = (C("x2") > C("x1")) & (C("y2") > C("y1"))
    side = B.longer_side(*B.corners())
    a, b = (d.filter(sound).withColumn("_own", _level(side)) for d in (left, right))
    levels = _known_levels(a.select(C("_own").alias("_lv")), b.select(C("_own").alias("_lv")))
    all_levels = F.array(*[F.lit(n) for n in levels]).cast("array<int>")

    def spread(df):
        d = df.withColumn("_lv", F.explode(F.filter(all_levels, lambda n: n >= C("_own"))))
        return d.withColumn("_gx", F.explode(_cells(C("x1"), C("x2"), _cell_size(C("_lv"))))) \
                .withColumn("_gy", F.explode(_cells(C("y1"), C("y2"), _cell_size(C("_lv")))))
    keys = [*group, "_lv", "_gx", "_gy"]
    d = _renamed(spread(a), "l_", keys).join(_renamed(spread(b), "r_", keys), keys)
    d = d.filter(C("_lv") == F.greatest("l__own", "r__own"))
    size = _cell_size(C("_lv"))
    home = (F.floor(F.greatest("l_x1", "r_x1") / size) == C("_gx")) & (F.floor(F.greatest("l_y1", "r_y1") / size) == C("_gy"))
    d = d.filter(home).drop("_lv", "_gx", "_gy", "l__own", "r__own").withColumn("iou", B.iou(B.corners("l_"), B.corners("r_")))
    return d.filter((C("iou") > 0) & (C("iou") >= min_iou))


def alone_and_contested(edges: DataFrame, group: list[str], left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Edges that stand alone at both of their ends, and the others, from one written table."""
    alone = lambda end: F.count("*").over(Window.partitionBy(*group, end)) == 1
    e = cut(edges.withColumn("_alone", alone(left) & alone(right)))
    return e.filter("_alone").drop("_alone"), e.filter("NOT _alone").drop("_alone")


def greedy_one_to_one(edges: DataFrame, group: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """Edges a sequential greedy pass in `order` would accept, each end used once; edges are distinct and `order` free of ties.

    Edges that stand alone at both ends are accepted before the first round. See settle() for the rest."""
    e = edges.withColumn("_o", F.struct(*order)).select(*group, left, right, "_o")
    taken, e = alone_and_contested(e, group, left, right)
    return taken.select(*group, left, right).unionByName(settle(e, group, left, right))


def settle(edges: DataFrame, group: list[str], left: str, right: str) -> DataFrame:
    """Accepted ones among contested edges (group, left, right, _o: their order).

    An edge is accepted if none of the earlier edges at its ends is. So one without undecided earlier edges is accepted, and its neighbours go;
    and one with a single undecided earlier edge is what that one is not. Such edges point to the earlier one and jump from pointer to pointer,
    counting turns: a chain of n edges that wait for each other is settled in about log2(n) rounds. A round is two passes of windows (by left
    end, by right end), one join of the pointers and one written table; an end with very many edges is one window partition."""
    key = [*group, left, right]
    at = lambda end: Window.partitionBy(*group, end)
    # state: true accepted, null open; a rejected edge is dropped. _pl, _pr: the edge it points to; _odd: it is what that one is not
    e = edges.select(*key, "_o", F.lit(None).cast("boolean").alias("_state"), *[C(x).alias(y) for x, y in ((left, "_pl"), (right, "_pr"))], F.lit(None).cast("boolean").alias("_odd"))
    while True:
        # accepted edges stay as targets of pointers; they take no part in the ranks of the others
        done = C("_state").isNotNull()
        e = e.withColumn("_hit", F.max(done).over(at(left)) | F.max(done).over(at(right))).filter(done | ~C("_hit")).withColumn("_done", done)
        for end, other, name in ((right, left, "r"), (left, right, "l")):
            w = Window.partitionBy(*group, end, "_done").orderBy("_o")
            e = e.withColumns({"_n" + name: F.row_number().over(w), "_b" + name: F.lag(other).over(w)})
        first = (C("_nl") == 1) & (C("_nr") == 1)
        single = ~C("_done") & (C("_nl") + C("_nr") == 3) & C("_odd").isNull()
        e = cut(e.select(*key, "_o", "_done", (C("_done") | F.when(first, True)).alias("_state"),
                         F.when(single, F.when(C("_nl") == 2, C(left)).otherwise(C("_br"))).otherwise(C("_pl")).alias("_pl"),
                         F.when(single, F.when(C("_nl") == 2, C("_bl")).otherwise(C(right))).otherwise(C("_pr")).alias("_pr"),
                         F.when(single, True).otherwise(C("_odd")).alias("_odd")))
        e = e.withColumn("_state", F.when(C("_state"), True))
        if e.filter("_state IS NULL").isEmpty():
            return e.select(*key)
        # a target that is not there any more was rejected
        to = e.select(*group, C(left).alias("_pl"), C(right).alias("_pr"), C("_state").alias("_ts"), C("_pl").alias("_tl"), C("_pr").alias("_tr"), C("_odd").alias("_todd"), F.lit(True).alias("_there"))
        j = e.join(to, [*group, "_pl", "_pr"], "left")
        waits = C("_state").isNull() & C("_odd").isNotNull()
        state = F.when(waits & C("_there").isNull(), C("_odd")).when(waits & C("_ts"), ~C("_odd")).otherwise(C("_state"))
        hop = waits & C("_there") & C("_ts").isNull() & C("_todd").isNotNull()
        e = j.select(*key, "_o", state.alias("_state"), F.when(hop, C("_tl")).otherwise(C("_pl")).alias("_pl"), F.when(hop, C("_tr")).otherwise(C("_pr")).alias("_pr"),
                     F.when(hop, C("_odd") != C("_todd")).otherwise(C("_odd")).alias("_odd")).filter("_state IS NULL OR _state")


def _gt_pairs(preds: DataFrame, gts: DataFrame, thr: float) -> DataFrame:
    p = preds.select("image_id", "pred_idx", "cls", "conf", *BOX)
    g = gts.select("image_id", "gt_idx", "cls", *BOX)
    return close_pairs(p, g, ["image_id"], thr).select(
        "image_id", C("l_pred_idx").alias("pred_idx"), C("r_gt_idx").alias("gt_idx"), C("l_cls").alias("cls"),
        C("r_cls").alias("gt_cls"), C("l_conf").alias("conf"), "iou")


def match_order() -> list[Column]:
    return [(-C("conf")).alias("a"), C("pred_idx").alias("b"), (-C("iou")).alias("c"), C("gt_idx").alias("d")]


def match_predictions(preds: DataFrame, gts: DataFrame, thr: float = 0.5) -> DataFrame:
    """Every prediction with its outcome: tp and the object it took, or fp and the class of the best
    object of another class it covers. Order: confidence, then pred_idx; then IoU, then gt_idx."""
    pairs = cut(_gt_pairs(preds, gts, thr))
    tp = greedy_one_to_one(pairs.filter("cls = gt_cls"), ["image_id"], "pred_idx", "gt_idx", match_order())
    other = pairs.filter("cls <> gt_cls").groupBy("image_id", "pred_idx").agg(
        F.max_by("gt_cls", F.struct("iou", -C("gt_idx"))).alias("other_cls"))
    keys = ["image_id", "pred_idx"]
    d = preds.select(*keys, "cls", "conf").join(tp, keys, "left").join(other, keys, "left")
    return d.select(*keys, "cls", "conf", F.when(C("gt_idx").isNotNull(), "tp").otherwise("fp").alias("kind"), "gt_idx",
                    F.when(C("gt_idx").isNull(), C("other_cls")).alias("confused_with"))


def missed(gts: DataFrame, outcomes: DataFrame) -> DataFrame:
    tp = outcomes.filter("kind = 'tp'").select("image_id", "gt_idx")
    return gts.join(tp, ["image_id", "gt_idx"], "left_anti")


def best_match(gts: DataFrame, preds: DataFrame) -> DataFrame:
    """For every ground truth the single prediction of highest IoU, whatever its class; a prediction
    may serve several. ok = IoU >= 0.5, same class, same rotation. Below 0.5 the answer is no anyway,
    so only close pairs are joined."""
    g = gts.select("image_id", "gt_idx", "cls", "rotation", *BOX)
    p = preds.select("image_id", "pred_idx", "cls", "rotation", *BOX)
    best = close_pairs(g, p, ["image_id"]).groupBy("image_id", C("l_gt_idx").alias("gt_idx")).agg(
        F.max_by(F.struct("r_cls", "r_rotation"), F.struct("iou", -C("r_pred_idx"))).alias("m"))
    d = gts.select("image_id", "gt_idx", "cls", "rotation").join(best, ["image_id", "gt_idx"], "left")
    ok = F.coalesce((C("m.r_cls") == C("cls")) & (C("m.r_rotation") == C("rotation")), F.lit(False))
    return d.select("image_id", "gt_idx", "cls", "rotation", ok.alias("ok"))


def double_labels(parts: DataFrame, idx: str, min_iou: float = 0.7) -> DataFrame:
    """Pairs of parts with different classes on the same symbol, each pair once."""
    d = close_pairs(parts, parts, ["image_id"], min_iou)
    return d.filter((C(f"l_{idx}") < C(f"r_{idx}")) & (C("l_cls") != C("r_cls")) & (C("iou") > min_iou))


def contained(items: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """Items that lie wholly inside one box of their image. A box is spread over its cells at its own size level, four at most; the low corner
    of an item has one cell at every level that occurs."""
    b = boxes.filter("x2 >= x1 AND y2 >= y1").withColumn("_lv", _level(B.longer_side(*B.corners())))
    levels = F.array(*[F.lit(n) for n in _known_levels(b.select("_lv"))]).cast("array<int>")
    size = _cell_size(C("_lv"))
    a = items.withColumn("_lv", F.explode(levels)).withColumns({"_gx": F.floor(C("x1") / size), "_gy": F.floor(C("y1") / size)})
    b = b.select("image_id", "_lv", *[C(k).alias("b" + k) for k in BOX]) \
         .withColumn("_gx", F.explode(_cells(C("bx1"), C("bx2"), size))).withColumn("_gy", F.explode(_cells(C("by1"), C("by2"), size)))
    inside = (C("bx1") <= C("x1")) & (C("by1") <= C("y1")) & (C("x2") <= C("bx2")) & (C("y2") <= C("by2"))
    return a.join(b, ["image_id", "_lv", "_gx", "_gy"]).filter(inside).select("image_id", *key).distinct()


def wire_fragments(frags: DataFrame, symbols: DataFrame, key: list[str], reach: float, min_area: float) -> DataFrame:
    """Fragments large enough to be wires that leave the neighbourhood of every symbol."""
    grown = symbols.select("image_id", (C("x1") - reach).alias("x1"), (C("y1") - reach).alias("y1"),
                           (C("x2") + reach).alias("x2"), (C("y2") + reach).alias("y2"))
    big = frags.filter(C("area") >= min_area)
    return big.join(contained(big, grown, key), ["image_id", *key], "left_anti")


# ---- value labels ----
BASE_LIMIT = 150.0


def label_candidates(elements: DataFrame, labels: DataFrame, max_dist: float | None = None) -> DataFrame:
    """(element, value label) pairs within reach whose units agree. Elements spread over the cells of
    their reach at a size level; labels have one cell per level."""
    v = drawn_value(C("txt"))
    lab = labels.withColumn("v", v).filter("v.value IS NOT NULL").select(
        "image_id", C("idx").alias("label_idx"), *[e.alias(n) for e, n in zip(B.centre(*B.corners()), ("tx", "ty"))],
        C("v.value").alias("value"), C("v.cls").alias("unit_cls"))
    size = F.pow(F.lit(4.0), C("_lv")) * (2 * BASE_LIMIT)
    limit = F.lit(float(max_dist)) if max_dist else F.greatest(F.lit(BASE_LIMIT), 1.5 * B.longer_side(*B.corners()))
    cx, cy = B.centre(*B.corners())
    el = elements.select("image_id", C("idx").alias("element_idx"), "cls", cx.alias("cx"), cy.alias("cy"), limit.alias("reach"))
    el = el.filter("cx IS NOT NULL AND cy IS NOT NULL AND reach IS NOT NULL").withColumn("_lv", F.ceil(F.log(4.0, F.greatest(C("reach") / BASE_LIMIT, F.lit(1.0)))).cast("int"))
    levels = F.array(*[F.lit(n) for n in _known_levels(el.select("_lv"))]).cast("array<int>")
    lab = lab.withColumn("_lv", F.explode(levels)).withColumns({"_gx": F.floor(C("tx") / size), "_gy": F.floor(C("ty") / size)})
    el = el.withColumn("_gx", F.explode(_cells(C("cx") - C("reach"), C("cx") + C("reach"), size))) \
           .withColumn("_gy", F.explode(_cells(C("cy") - C("reach"), C("cy") + C("reach"), size)))
    d = el.join(lab, ["image_id", "_lv", "_gx", "_gy"])
    dx, dy = C("cx") - C("tx"), C("cy") - C("ty")
    d = d.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    return d.filter((C("dist") <= C("reach")) & (C("unit_cls").isNull() | (C("unit_cls") == C("cls")))) \
            .select("image_id", "element_idx", "label_idx", "dist", "value")


def attach_values(objects: DataFrame, max_dist: float | None = None) -> DataFrame:
    """Value of each element: closest pairs first, every element and label used once. objects has
    image_id, idx, cls, txt and a box; ties go to the lower element, then the lower label."""
    elements = objects.filter(C("cls").isin(*ELEMENT_PREFIX))
    pairs = cut(label_candidates(elements, objects.filter("cls = 'text' AND txt IS NOT NULL"), max_dist))
    won = greedy_one_to_one(pairs, ["image_id"], "element_idx", "label_idx", [C("dist"), C("element_idx").alias("e"), C("label_idx").alias("l")])
    return won.join(pairs.select("image_id", "element_idx", "label_idx", "value"), ["image_id", "element_idx", "label_idx"])


# ---- crowding ----
#: side of the smallest cell; a level has cells four times as wide as the one below
FINEST = 16.0


def nearest_distances(spots: DataFrame) -> DataFrame:
    """spots(image_id, cx, cy: distinct) -> distance d of each to the nearest other spot of its image (none: no row).

    A pyramid of cells: every spot is counted in its cell of every level, in one aggregate. Cells nest, so a spot is alone in its cell up to some
    level; in the cell above it another one lies within 1.5 cell sides. The 3 x 3 cells of the next level then hold the nearest one, and one join finds it.
    Spots that look at one level are each alone in a cell 16 times as narrow, so few of them meet any other spot; those within the finest cell
    are compared directly."""
    box = spots.groupBy("image_id").agg(F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("_extent"), F.count("*").alias("_k")).filter("_k > 1")
    # at the top level all spots of an image lie in 3 x 3 cells
    top = F.ceil(F.log(4.0, F.greatest(C("_extent") / FINEST, F.lit(1.0)))).cast("int")
    s = spots.join(box.select("image_id", top.alias("_top")), "image_id").select("image_id", "cx", "cy", "_top")
    size = F.lit(FINEST) * F.pow(F.lit(4.0), C("_lv"))
    cell = lambda d: d.withColumns({"_gx": F.floor(C("cx") / size), "_gy": F.floor(C("cy") / size)})
    levels = cell(s.withColumn("_lv", F.explode(F.sequence(F.lit(0), C("_top")))))
    alone = (levels.filter("_lv < _top").groupBy("image_id", "_lv", "_gx", "_gy")
             .agg(F.count("*").alias("_k"), F.min("cx").alias("cx"), F.min("cy").alias("cy")).filter("_k = 1"))
    up = alone.groupBy("image_id", "cx", "cy").agg(F.max("_lv").alias("_alone"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    q = s.join(up, ["image_id", "cx", "cy"], "left").withColumn("_lv", F.least(C("_top"), F.coalesce("_alone", F.lit(-1)) + 2))
    q = cell(q).withColumn("_gx", F.explode(F.transform(near, lambda k: C("_gx") + k))).withColumn("_gy", F.explode(F.transform(near, lambda k: C("_gy") + k)))
    o = levels.select("image_id", C("cx").alias("ox"), C("cy").alias("oy"), "_lv", "_gx", "_gy")
    dx, dy = C("cx") - C("ox"), C("cy") - C("oy")
    return (q.join(o, ["image_id", "_lv", "_gx", "_gy"]).filter("cx <> ox OR cy <> oy")
            .groupBy("image_id", "cx", "cy").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("d")))


#: images of up to so many spots are compared spot by spot where they are; the others go through the pyramid
FEW_SPOTS = 64


def crowding(boxes: DataFrame) -> DataFrame:
    """Per image the mean of longer side / distance to the nearest other centre; 0 below two boxes. Boxes without four finite corners
    don't count, but their image has a row. The spots of an image of up to FEW_SPOTS travel as one array beside each of them, in one shuffle."""
    cx, cy = B.centre(*B.corners())
    pts = boxes.select("image_id", cx.alias("cx"), cy.alias("cy"), B.longer_side(*B.corners()).alias("side"))
    finite = lambda c: C(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = finite("cx") & finite("cy") & finite("side")
    pts = pts.withColumns({c: F.when(ok, C(c)) for c in ("cx", "cy", "side")})
    # boxes with one centre are one spot; those that don't count are one row of their image
    spots = pts.groupBy("image_id", "cx", "cy").agg(F.count("side").alias("n"), F.sum("side").alias("side"))
    image = Window.partitionBy("image_id")
    spots = spots.withColumn("_few", F.count_if(C("n") > 0).over(image) <= FEW_SPOTS)
    spots = spots.withColumn("_all", F.collect_list(F.when(C("_few") & (C("n") > 0), F.struct("cx", "cy"))).over(image))
    dist = lambda o: F.sqrt((C("cx") - o["cx"]) * (C("cx") - o["cx"]) + (C("cy") - o["cy"]) * (C("cy") - o["cy"]))
    d = F.array_min(F.transform(F.filter("_all", lambda o: (o["cx"] != C("cx")) | (o["cy"] != C("cy"))), dist))
    spots = cut(spots.withColumn("d", d).drop("_all"))
    many = spots.filter("NOT _few AND n > 0").drop("d")
    if not many.isEmpty():
        spots = spots.filter("_few OR n = 0").unionByName(many.join(nearest_distances(many.select("image_id", "cx", "cy")), ["image_id", "cx", "cy"], "left"))
    # of several boxes on one spot each has another at distance 0
    share = C("side") / (F.when(C("n") > 1, 0.0).otherwise(C("d")) + 1e-9)
    return spots.groupBy("image_id").agg(F.coalesce(F.try_divide(F.sum(share), F.sum("n")), F.lit(0.0)).alias("crowding"))

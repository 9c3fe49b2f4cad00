"""Boxes, matching, crowding, value labels."""
import itertools
import math
import random

from pyspark.sql import functions as F

from wirelake.functions import boxes as B
from wirelake.operators import matching as M, metrics as E

BOX = "image_id long, {} long, cls string, x1 double, y1 double, x2 double, y2 double"


def frame(spark, rows, idx):
    return spark.createDataFrame([(1, i, c, *map(float, b)) for i, (c, b) in enumerate(rows)], BOX.format(idx))


def test_clip_box(spark):
    rows = [((10, 10, 50, 30), (10, 10, 50, 30)), ((180, 60, 230, 90), (180, 60, 200, 90)), ((50, 50, 50, 70), None), ((50, 30, 10, 10), (10, 10, 50, 30))]
    d = spark.createDataFrame([tuple(map(float, b)) for b, _ in rows], "x1 double, y1 double, x2 double, y2 double")
    got = [r[0] and tuple(r[0]) for r in d.select(B.clip(*B.corners(), F.lit(200), F.lit(100))).collect()]
    assert got == [w and tuple(map(float, w)) for _, w in rows]


def preds(spark, rows):
    return spark.createDataFrame([(1, i, c, *map(float, b), float(p)) for i, (c, b, p) in enumerate(rows)], BOX.format("pred_idx") + ", conf double")


def test_outcomes_in_a_row_of_tiles(spark):
    """Tiles of 24 x 12 in a row: one found exactly, one found shifted, one read as another class, one not found, and a prediction beside them all."""
    tile = lambda k, dx=0: (7 + 30 * k + dx, 3, 31 + 30 * k + dx, 15)
    gt = frame(spark, [("inductor", tile(0)), ("gnd", tile(1)), ("diode", tile(2)), ("lamp", tile(3))], "gt_idx")
    pr = preds(spark, [("gnd", tile(1, 5), .31), ("inductor", tile(0), .22), ("junction", tile(2, -3), .64), ("lamp", tile(9), .97)])
    out = M.match_predictions(pr, gt)
    got = {r.pred_idx: (r.kind, r.gt_idx, r.confused_with) for r in out.collect()}
    assert got == {0: ("tp", 1, None), 1: ("tp", 0, None), 2: ("fp", None, "diode"), 3: ("fp", None, None)}
    assert sorted(r.gt_idx for r in M.missed(gt, out).collect()) == [2, 3]


def test_the_surer_of_three_predictions_takes_the_object(spark):
    gt = frame(spark, [("gnd", (100, 40, 140, 60))], "gt_idx")
    pr = preds(spark, [("gnd", (102, 40, 142, 60), .5), ("gnd", (100, 41, 140, 61), .7), ("gnd", (100, 40, 140, 60), .6)])
    assert {r.pred_idx: r.kind for r in M.match_predictions(pr, gt).collect()} == {0: "fp", 1: "tp", 2: "fp"}


def random_boxes(n, seed, spread):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        x, y, w, h = rnd.uniform(-50, spread), rnd.uniform(-50, spread), rnd.uniform(1, 300) ** rnd.random(), rnd.uniform(1, 300) ** rnd.random()
        out.append(("resistor", (x, y, x + w, y + h)))
    return out


def py_iou(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w + 1e-9)


def test_cell_joins_find_every_pair_once(spark):
    """Against all pairs, in one crowded image."""
    a, b = random_boxes(150, 1, 150), random_boxes(150, 2, 150)
    want = {(i, j): py_iou(p, q) for (i, (_, p)), (j, (_, q)) in itertools.product(enumerate(a), enumerate(b))}
    fa, fb = frame(spark, a, "i"), frame(spark, b, "j")
    near = [(r.l_i, r.r_j) for r in M.close_pairs(fa, fb, ["image_id"]).collect()]
    assert sorted(near) == sorted(k for k, v in want.items() if v >= 0.5) and near
    touch = [(r.l_i, r.r_j) for r in M.overlapping_pairs(fa, fb, ["image_id"], 0.0).collect()]
    assert sorted(touch) == sorted(k for k, v in want.items() if v > 0)


def test_greedy_rounds_equal_the_sequential_pass(spark):
    rnd = random.Random(3)
    edges = [(1, l, r, rnd.randrange(20)) for l, r in itertools.product(range(25), range(25)) if rnd.random() < 0.4]
    used_l, used_r, want = set(), set(), set()
    for _, l, r, _w in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if l not in used_l and r not in used_r:
            used_l.add(l), used_r.add(r), want.add((l, r))
    d = spark.createDataFrame(edges, "image_id long, l long, r long, w long")
    got = M.greedy_one_to_one(d, ["image_id"], "l", "r", [F.col("w"), F.col("l").alias("a"), F.col("r").alias("b")])
    assert {(x.l, x.r) for x in got.collect()} == want


def sequential(edges):
    """(group, l, r, w) in the order of w, l, r."""
    used, won = set(), set()
    for g, l, r, _ in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if (g, "l", l) not in used and (g, "r", r) not in used:
            used |= {(g, "l", l), (g, "r", r)}
            won.add((g, l, r))
    return won


def test_greedy_on_sparse_and_dense_graphs(spark):
    """Chains with branches, where pointers and ranks take turns."""
    rnd = random.Random(11)
    edges = [(g, l, r, rnd.randrange(1000)) for g in range(40) for l, r in itertools.product(range(14), range(14)) if rnd.random() < (0.04, 0.1, 0.15, 0.3)[g % 4]]
    edges += [(99, k // 2, (k + 1) // 2, k if k % 7 else 1) for k in range(200)]
    d = spark.createDataFrame(edges, "image_id long, l long, r long, w long")
    got = M.greedy_one_to_one(d, ["image_id"], "l", "r", [F.col("w"), F.col("l").alias("a"), F.col("r").alias("b")])
    assert {(x.image_id, x.l, x.r) for x in got.collect()} == sequential(edges)


def direct_crowding(rows):
    c = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for _, b in rows]
    near = [min(math.dist(p, q) for j, q in enumerate(c) if j != i) for i, p in enumerate(c)]
    return sum(max(b[2] - b[0], b[3] - b[1]) / (m + 1e-9) for (_, b), m in zip(rows, near)) / len(rows)


def test_crowding_grid_equals_direct(spark):
    rows = random_boxes(120, 5, 2000) + [("resistor", (0, 0, 4, 4))] * 2
    got, want = M.crowding(frame(spark, rows, "idx")).collect()[0].crowding, direct_crowding(rows)
    assert abs(got - want) / want < 1e-9


def test_crowding_of_clusters_and_far_boxes(spark):
    """Dense clusters across the axes, lone boxes near and very far: the pyramid has many levels."""
    rnd = random.Random(6)
    box = lambda x, y, s: ("lamp", (x - s, y - s, x + s, y + s))
    rows = [box(rnd.gauss(0, 3), rnd.gauss(0, 3), rnd.uniform(1, 4)) for _ in range(80)] + [box(5000 + rnd.gauss(0, 0.01), -900 + rnd.gauss(0, 0.01), 2) for _ in range(40)]
    rows += [box(x, y, 5) for x, y in ((40, 0), (-170, 60), (4900, -900), (1e9, 3), (-3e8, 1e7), (4990, -880))]
    got, want = M.crowding(frame(spark, rows, "idx")).collect()[0].crowding, direct_crowding(rows)
    assert abs(got - want) / want < 1e-9


def test_crowding_without_corners(spark):
    """Boxes without corners don't count, in small images as in large ones."""
    rows = [(1, k, float(10 * k), 0.0, float(10 * k + 5), 5.0) for k in range(70)] + [(1, 70, None, None, None, None), (2, 0, 0.0, 0.0, 5.0, 5.0), (2, 1, 10.0, 0.0, 15.0, 5.0), (2, 2, None, 0.0, 1.0, 1.0),
            (3, 0, None, None, None, None), (4, 0, 0.0, 0.0, 1.0, 1.0), (5, 0, float("nan"), 0.0, 1.0, 1.0)]
    got = {r.image_id: round(r.crowding, 6) for r in M.crowding(spark.createDataFrame(rows, "image_id long, idx long, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.0}


def test_low_threshold_and_far_sizes(spark):
    a, b = random_boxes(60, 8, 150) + [("resistor", (-1e7, -1e7, 1e7, 1e7))], random_boxes(60, 9, 150) + [("resistor", (0, 0, 1e6, 1e6))]
    want = {(i, j) for (i, (_, p)), (j, (_, q)) in itertools.product(enumerate(a), enumerate(b)) if py_iou(p, q) >= 0.3}
    got = [(r.l_i, r.r_j) for r in M.close_pairs(frame(spark, a, "i"), frame(spark, b, "j"), ["image_id"], 0.3).collect()]
    assert sorted(got) == sorted(want)


def test_chain_of_contested_edges(spark, monkeypatch):
    """Each of 1,000 edges waits for the one before it: rounds as the logarithm of their number."""
    tables = []
    monkeypatch.setattr(M, "cut", lambda d, f=M.cut: (tables.append(1), f(d))[1])
    d = spark.createDataFrame([(1, k // 2, (k + 1) // 2, k) for k in range(1000)], "image_id long, l long, r long, w long")
    got = {(x.l, x.r) for x in M.greedy_one_to_one(d, ["image_id"], "l", "r", [F.col("w")]).collect()}
    assert got == {(k // 2, (k + 1) // 2) for k in range(0, 1000, 2)} and len(tables) <= 14


def test_confusion_cells_add_up(spark):
    gt = frame(spark, [("resistor", (0, 0, 10, 10)), ("capacitor", (20, 0, 30, 10)), ("text", (40, 0, 50, 10))], "gt_idx")
    pr = preds(spark, [("diode", (0, 0, 10, 10), .9), ("capacitor", (20, 0, 30, 10), .8), ("diode", (20, 0, 30, 11), .99), ("text", (80, 0, 90, 10), .7)])
    rows = {r.predicted: r.asDict() for r in E.confusion_matrix(gt, pr).collect()}
    cells = {(p, t): n for p, r in rows.items() for t, n in r.items() if t != "predicted" and n}
    assert cells == {("diode", "resistor"): 1, ("capacitor", "capacitor"): 1, ("diode", "background"): 1, ("text", "background"): 1, ("background", "text"): 1}


def test_value_labels(spark):
    rows = [(1, 0, "resistor", 0., 0., 40., 20., None), (1, 1, "capacitor", 200., 0., 240., 20., None), (1, 2, "text", 0., 30., 40., 40., "10uF"),
            (1, 3, "text", 0., 60., 40., 70., "4k7"), (1, 4, "text", 0., 90., 40., 95., "R1"), (1, 5, "inductor", 9000., 0., 9040., 20., None)]
    d = spark.createDataFrame(rows, "image_id long, idx long, cls string, x1 double, y1 double, x2 double, y2 double, txt string")
    assert {(r.element_idx, r.value) for r in M.attach_values(d, 250).collect()} == {(0, "4.7k"), (1, "10u")}
    assert {(r.element_idx, r.value) for r in M.attach_values(d).collect()} == {(0, "4.7k")}


def test_perfect_predictions_have_full_precision(spark):
    gt = frame(spark, [("resistor", (0, 0, 10, 10)), ("diode", (50, 0, 60, 10))], "gt_idx")
    pr = preds(spark, [("resistor", (0, 0, 10, 10), .9), ("diode", (50, 0, 60, 10), .8)])
    got = E.average_precision(E.threshold_matches(pr, gt, [0.5, 0.75]), gt).collect()
    assert {(r.cls, round(r.ap50, 6), round(r.ap50_95, 6), r.recall) for r in got} == {("resistor", 1.0, 1.0, 1.0), ("diode", 1.0, 1.0, 1.0)}


def test_small_and_large_images_agree(spark, monkeypatch):
    """Crowding and close pairs by cells and by images; coincident centres, a box without corners, and an image of one box among them."""
    rows = [(k % 7, i, "gnd", x1, y1, x2, y2) for k in range(40) for i, (_, (x1, y1, x2, y2)) in enumerate(random_boxes(k % 9, k, 300), 100 * k)]
    rows += [(1, 9001, "gnd", 10.0, 10.0, 30.0, 20.0), (1, 9002, "gnd", 5.0, 5.0, 35.0, 25.0), (2, 9003, "gnd", None, 1.0, 2.0, 3.0), (9, 9004, "gnd", 1.0, 1.0, 2.0, 2.0)]
    d = spark.createDataFrame(rows, "image_id long, idx long, cls string, x1 double, y1 double, x2 double, y2 double")
    moved = d.withColumns({"x1": F.col("x1") + 1, "x2": F.col("x2") + 1})

    def both():
        c = {r.image_id: r.crowding for r in M.crowding(d).collect()}
        return c, sorted((r.image_id, r.l_idx, r.r_idx) for r in M.close_pairs(d, moved, ["image_id"]).collect())
    crowd, pairs = both()
    monkeypatch.setattr(M, "FEW_SPOTS", 3)
    monkeypatch.setattr(M, "FEW_BOXES", 3)
    crowd2, pairs2 = both()
    assert pairs == pairs2 and len(pairs) > 100 and crowd[9] == 0 and crowd[1] > 1e6
    assert crowd.keys() == crowd2.keys() and all(math.isclose(crowd[k], crowd2[k], rel_tol=1e-9) for k in crowd)


def test_small_images_take_no_pyramid(spark, monkeypatch):
    monkeypatch.setattr(M, "nearest_distances", None)
    monkeypatch.setattr(M, "_pairs_by_cells", None)
    d = frame(spark, random_boxes(30, 3, 200), "idx")
    assert M.crowding(d).collect()[0].crowding > 0 and M.close_pairs(d, d, ["image_id"]).count() >= 30


def test_crowding_queries_read_the_boxes_as_they_are():
    from wirelake.plans import catalogue
    from wirelake.plans.fixtures import VIEWS
    assert "fx_apart" not in VIEWS
    assert all("fx_gt a LEFT JOIN fx_gt b" in catalogue.ORACLES[n] for n in ("j7_crowding", "a16_image_scores", "win5_failure_examples"))

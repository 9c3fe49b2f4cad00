"""Annotation documents, conversion counts, sources."""
from pyspark.sql import functions as F

from wirelake.operators import audit as A
from wirelake.operators.sampling import stratified_sample
from wirelake.sources import annotations as X, artefacts as J, inventory as I


def symbol(label, corners, **more):
    names = dict(zip(("xmin", "ymin", "xmax", "ymax"), corners, strict=True))
    inside = "".join(f"<{k}>{v}</{k}>" for k, v in (names | {k: v for k, v in more.items() if k == "rotation"}).items())
    return f"<object><name>{label}</name><bndbox>{inside}</bndbox>" + (f"<text>{more['text']}</text>" if "text" in more else "") + "</object>"


SYMBOLS = [symbol("inductor", (30, 20, 90, 50)), symbol("voltage.battery", (5, 60, 45, 115)), symbol("diode.zener", (210, 30, 260, 55), rotation=184), symbol("lamp", (120, 70, 150, 100)),
           symbol("text", (95, 10, 130, 24), text="68n"), symbol("capacitor.polarized", (-12, 120, 40, 140)), symbol("resistor", (70, 80, 70, 95)), symbol("gnd", (160, 130, 190, 170))]
XML = "<annotation><size><width>300</width><height>150</height></size>" + "".join(SYMBOLS) + "</annotation>"


def corpus(spark):
    rows = [(10 * d + k, f"drafter_{d}", XML) for d in (1, 11, 12) for k in range(2)] + [(99, "drafter_1", XML[:-30])]
    return spark.createDataFrame(rows, "image_id long, drafter string, xml string")


def test_parse_and_counts(spark):
    parsed = X.parse(corpus(spark))
    assert parsed.filter("parse_error").count() == 1
    d = X.objects(parsed, ["image_id"])
    det = {r.cls: r for r in X.detections(d).filter("image_id = 10").collect()}
    assert det["diode"].rotation == 180 and det["text"].txt == "68n" and det["other"].x1 == 120 and det["inductor"].rotation is None
    problems = {r.problem: r.n for r in A.counted(A.clipped(d), F.col("box_problem")).collect()}
    assert problems == {"boxes_clipped": 12, "boxes_dropped": 6}
    images = corpus(spark).filter("image_id <> 99").select("image_id", F.when(F.col("drafter") == "drafter_12", "test").otherwise("train").alias("split"))
    counts = {r.split: r for r in A.split_counts(d, images).collect()}
    assert counts["test"].images == 2 and counts["train"].images == 4 and counts["test"].objects == 12 and counts["train"].diode == 4
    line = A.label_lines(d, images).filter("image_id = 120 AND obj_idx = 1").collect()[0].line
    assert line == "2 0.200000 0.233333 0.200000 0.200000"


def test_label_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1, "0 0.150000 0.200000 0.200000 0.200000"), ("test", 1, None)], "split string, obj_idx long, line string")
    J.write_lines(rows, str(tmp_path / "labels"), ["split"], ["obj_idx"])
    back = spark.read.text(str(tmp_path / "labels" / "split=train"))
    box = J.label_boxes(back.withColumnRenamed("value", "line"), F.lit(200), F.lit(100)).collect()[0]
    assert [round(v, 6) for v in (box.x1, box.y1, box.x2, box.y2)] == [10, 10, 50, 30]


def test_file_sources(spark, tmp_path):
    for sub in ("drafter_1/annotations", "drafter_1/images"):
        (tmp_path / sub).mkdir(parents=True)
    (tmp_path / "drafter_1/annotations/C1_D1_P1.xml").write_text(XML)
    (tmp_path / "drafter_1/images/C1_D1_P1.png").write_bytes(b"x")
    d = X.read_annotations(spark, str(tmp_path / "drafter_1/annotations")).collect()[0]
    assert (d.drafter, d.stem) == ("drafter_1", "C1_D1_P1") and d.xml == XML
    assert I.list_files(spark, str(tmp_path)).count() == 2
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.cir").write_text("* a\nR1 1 0 1k\n.end\n")
    net = J.read_netlists(spark, str(tmp_path / "c"))
    assert [r.line for r in J.text_lines(net, ["stem"]).orderBy("line_no").collect()] == ["* a", "R1 1 0 1k", ".end"]
    (tmp_path / "m.json").write_text("{broken")
    got = J.tolerant(spark.createDataFrame([("m",), ("gone",)], "name string"), J.read_artefacts(spark, str(tmp_path / "m.json")), "name", "x DOUBLE")
    assert {r.v for r in got.select(J.shown(F.col("m.x")).alias("v")).collect()} == {"NOT AVAILABLE"}


def test_sample_covers_splits_classes_and_priority(spark):
    rows = [(i, "train", ["resistor", "capacitor"], i == 3) for i in range(40)] + [(100 + i, "val", ["resistor"], i == 2) for i in range(5)] \
        + [(200 + i, "test", ["capacitor"], False) for i in range(5)] + [(300, "train", ["crossover"], False)]
    got = stratified_sample(spark.createDataFrame(rows, "image_id long, split string, classes array<string>, priority boolean"), 12).collect()
    ids = {r.image_id for r in got}
    assert len(got) == len(ids) == 12 and {3, 102, 300} <= ids
    assert all(sum(r.split == s for r in got) >= 2 for s in ("train", "val", "test"))


def test_drift(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, label string")
    new = spark.createDataFrame([(1, "a"), (2, "c")], "id long, label string")
    assert {tuple(r) for r in A.signed_diff(new, old).select("id", "label", "extra", "side").collect()} == {(1, "a", 1, "approved"), (2, "b", 1, "approved"), (2, "c", 1, "new")}
    assert A.signed_diff(old, old).isEmpty()


def test_one_file_for_each_key(spark, tmp_path):
    """Written whole or not at all: nothing is left of a failed write, a second write adds and replaces."""
    import os

    import pytest

    from wirelake.sources import artefacts as J, inventory as I, keyed_files as K
    root = str(tmp_path / "out")
    files = lambda: sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    d = spark.range(200).selectExpr("concat('train/', id, '.txt') AS path", "concat('1 0.5 0.5 0.1 0.', id, '\\n2 0 0 0 0\\n') AS text").repartition(7)
    K.write(d, root)
    assert files() == sorted(["_SUCCESS", *(f"train/{k}.txt" for k in range(200))])
    K.write(spark.createDataFrame([("val/x y.txt", None), ("train/3.txt", "new\n")], "path string, text string"), root)
    assert {(r.split, r.stem): r.n for r in J.read_label_lines(spark, f"{root}/*").groupBy("split", "stem").count().withColumnRenamed("count", "n").collect()}[("train", "3")] == 1
    listed = I.below(I.list_files(spark, root), root)
    assert "val/x y.txt" in files() and listed.count() == 200 and listed.filter("path = 'train/7.txt'").count() == 1  # Spark lists no empty files
    with pytest.raises(Exception):
        K.write(spark.createDataFrame([("a/b.txt", "x"), ("a/../b.txt", "x")], "path string, text string").coalesce(1), root)
    assert not any(f.startswith(("a/", "_staging")) for f in files())
    K.write(d.limit(0), root)
    assert len(files()) == 202


def test_listings_are_made_in_tasks(spark, tmp_path, monkeypatch):
    """The driver keeps no status of a listed file: what it reads is the written listing."""
    from wirelake.sources import inventory as I
    monkeypatch.setattr(I, "_BATCH", 3)
    want = {"top.png": 1, **{f"drafter_{k}/images/a b{i}.jpg": i for k in range(3) for i in range(5)}, "drafter_1/x/y/z/deep.xml": 4}
    for name, n in {**want, "_SUCCESS": 1, ".hidden": 1, "_staging/a.jpg": 1, "drafter_1/images/_b.jpg": 1}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * n)
    (tmp_path / "drafter_9").mkdir()
    root = str(tmp_path)
    for start in (root, root + "/", "file://" + root):
        d = I.list_files(spark, start, empty=True)
        assert sorted(tuple(r) for r in I.below(d, start).collect()) == sorted(want.items())
        assert not any(f.removeprefix("file://").startswith(root) for f in d.inputFiles())
    assert sorted(r.path for r in I.below(I.list_files(spark, root), root).collect()) == sorted(p for p, n in want.items() if n)
    assert I.photos(I.below(I.list_files(spark, root, empty=True), root)).filter("stem = 'a b0'").count() == 3
    assert I.list_files(spark, str(tmp_path / "drafter_9")).isEmpty()


def test_medians_by_selection(spark):
    import random
    import statistics

    from wirelake.operators.ranking import medians
    rnd = random.Random(2)
    rows = [(k, rnd.choice([float(rnd.randrange(6)), rnd.uniform(-5, 5), rnd.uniform(0, 1)])) for k in range(25) for _ in range(rnd.randrange(1, 40))]
    rows += [(90, 3.25)] * 4 + [(91, 1.0), (91, 1e6)]
    got = {r.k: r.m for r in medians(spark.createDataFrame(rows + [(92, None)], "k long, v double"), "k", "v", "m").collect()}
    assert got == {k: statistics.median([v for i, v in rows if i == k]) for k in {i for i, _ in rows}}


def test_any_change_shows_in_the_approval(spark):
    rows = [(i, k, label) for i in range(5) for k, label in enumerate(["resistor", "diode", "gnd"])]
    sums = [A.approval(spark.createDataFrame(r, "image_id long, obj_idx long, label string")).first().checksum
            for r in (rows, rows[::-1], [*rows[1:], (0, 0, "inductor")], [*rows[1:], (0, 7, "resistor")])]
    assert sums[0] == sums[1] and len(set(sums)) == 3


def test_size_check(spark):
    rows = [(True, 4, 3, 4, 3, 4, 3), (True, 4, 3, 4, 3, 3, 4), (True, 3, 4, 4, 3, 3, 4), (True, 9, 9, 4, 3, 4, 3), (False, 4, 3, 4, 3, 4, 3)]
    d = spark.createDataFrame(rows, "r boolean, w int, h int, rw int, rh int, sw int, sh int")
    assert [x.c for x in d.select(A.size_check(*map(F.col, ("r", "w", "h", "rw", "rh", "sw", "sh"))).alias("c")).collect()] == [
        "xml_matches_displayed", "xml_matches_raw_only(EXIF rotated)", "xml_matches_displayed", "xml_size_mismatch", "unreadable_image"]


def test_packed_documents_are_few_files(spark, tmp_path):
    from wirelake.sources import artefacts as J
    docs = spark.range(2000).selectExpr("concat('group', id % 10, '/', id, '.cir') AS path", "CASE WHEN id % 7 > 0 THEN concat('* ', id, char(10), '.end', char(10)) END AS text")
    J.pack(docs, str(tmp_path / "packed"))
    files = [f for f in (tmp_path / "packed").rglob("*") if f.is_file()]
    assert len(files) < 50 and sum(-(-f.stat().st_size // 4096) * 4096 for f in files) < 2000 * 4096 / 4
    got = {r.stem: (r.grp, r.text) for r in J.read_packed_netlists(spark, str(tmp_path / "packed")).collect()}
    assert len(got) == 2000 and got["12"] == ("group2", "* 12\n.end\n") and got["14"] == ("group4", "")

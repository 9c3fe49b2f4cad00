"""Streams: a second arrival goes on from the first, and images split over batches."""
from wirelake.session import scratch_path
from wirelake.streaming import incremental as R

XML = "<annotation><size><width>100</width><height>100</height></size>{}</annotation>"
ONE = "<object><name>{}</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>{}</xmax><ymax>50</ymax></bndbox></object>"


def test_counts_go_on(spark):
    folder, (out, state) = scratch_path(spark, "in"), R.fresh(spark)
    images = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "image_id long, split string")

    def arrive(*docs):
        spark.createDataFrame(docs, "image_id long, xml string").write.mode("append").parquet(folder)
        R.incremental_counts(R.annotation_stream(spark, folder), images, out, state)
        return {(r.split, r["item"]): r.n for r in R.counts(spark, out).collect()}
    assert arrive((1, XML.format(ONE.format("resistor", 40) + ONE.format("gnd", 140))), (2, "<annotation><broken")) == {("train", "resistor"): 1, ("train", "gnd"): 1, ("train", "boxes_clipped"): 1}
    assert arrive((3, XML.format(ONE.format("resistor", 60))), (2, XML.format(ONE.format("lamp", 30)))) == {("train", "resistor"): 2, ("train", "gnd"): 1, ("train", "boxes_clipped"): 1}


def test_an_image_in_two_batches_is_no_drift(spark):
    folder, (out, state) = scratch_path(spark, "in"), R.fresh(spark)
    approved = spark.createDataFrame([(1, "a", "resistor"), (1, "b", "diode"), (2, "a", "gnd")], "image_id long, k string, label string")

    def arrive(*rows):
        spark.createDataFrame(rows, approved.schema).write.mode("append").parquet(folder)
        R.drift_guard(spark.readStream.schema(approved.schema).parquet(folder), approved, "image_id", out, state)
        return sorted((r.image_id, r.k, r.label, r.side) for r in R.drift(spark, "image_id", out).collect())
    assert arrive((1, "a", "resistor"), (2, "a", "lamp")) == [(1, "b", "diode", "approved"), (2, "a", "gnd", "approved"), (2, "a", "lamp", "new")]
    assert arrive((1, "b", "diode")) == [(2, "a", "gnd", "approved"), (2, "a", "lamp", "new")]


def test_later_batches_read_only_themselves(spark):
    """The fifth arrival reads its own rows, and rows that are split over arrivals or come twice are judged right."""
    folder, (out, state) = scratch_path(spark, "in"), R.fresh(spark)
    approved = spark.createDataFrame([(i, f"k{j}", "gnd") for i in range(5) for j in range(3)] + [(99, "k0", "gnd")], "image_id long, k string, label string")
    for i in range(5):
        rows = [(i, "k0", "gnd"), ((i + 1) % 5, "k1", "gnd"), ((i + 2) % 5, "k2", "lamp" if i == 3 else "gnd")] + ([(4, "k0", "gnd")] if i == 4 else [])
        spark.createDataFrame(rows, approved.schema).coalesce(1).write.mode("append").parquet(folder)
        progress = R.drift_guard(spark.readStream.schema(approved.schema).parquet(folder), approved, "image_id", out, state)
        assert sum(p["numInputRows"] for p in progress) == len(rows) + (16 if i == 0 else 0)
    got = sorted((r.image_id, r.k, r.label, r.extra, r.side) for r in R.drift(spark, "image_id", out).collect())
    assert got == [(0, "k2", "gnd", 1, "approved"), (0, "k2", "lamp", 1, "new"), (4, "k0", "gnd", 1, "new")]


def test_a_crash_between_the_two_writes_leaves_the_old_counts(spark, monkeypatch):
    import pytest
    folder, (out, state) = scratch_path(spark, "in"), R.fresh(spark)
    images = spark.createDataFrame([(1, "train"), (2, "test")], "image_id long, split string")

    def arrive(i):
        spark.createDataFrame([(i, XML.format(ONE.format("resistor", 40)))], "image_id long, xml string").write.mode("append").parquet(folder)
        R.incremental_counts(R.annotation_stream(spark, folder), images, out, state)
    seen = lambda: {(r.split, r["item"]): r.n for r in R.counts(spark, out).collect()}
    assert seen() == {}
    arrive(1)
    before = seen()

    def killed(*_):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(R, "_named", killed)
        with pytest.raises(Exception):
            arrive(2)
        assert seen() == before == {("train", "resistor"): 1}
    R.incremental_counts(R.annotation_stream(spark, folder), images, out, state)
    assert seen() == {("train", "resistor"): 1, ("test", "resistor"): 1}


def test_accuracy_of_separable_features(spark):
    from wirelake.operators.learning import orientation_accuracy
    # each quarter turn moves the mark by one block of four numbers
    rows = [("diode", [1.0 if k // 4 == (4 - y) % 4 else 0.02 * ((i * 7 + k) % 5) for k in range(16)], y, i % 4 == 0) for i in range(60) for y in range(4)]
    d = spark.createDataFrame(rows, "cls string, features array<double>, label int, is_test boolean")
    r = orientation_accuracy(d, ["diode"], block=4).first()
    assert r.plain_accuracy == 1.0 and r.turned_accuracy == 1.0 and r.plain_n == 60

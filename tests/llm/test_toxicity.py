"""Segments against brute force, held-out accuracy, edge cases."""
import zlib

import numpy as np
from pyspark.sql import functions as F

from wirelake.llm import queries, toxicity as tx

SF = "/root/testdata/sf0.1"


def brute_segments(w):
    """Maximal segments by the definition: the best segment (the shortest of equals, then the first), then the same left and right of it."""
    best = None
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            s = sum(w[i:j])
            if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return brute_segments(w[:i]) + [(i, j, s)] + [(a + j, b + j, v) for a, b, v in brute_segments(w[j:])]


def test_segments_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        w = rng.normal(-0.2, 1, rng.integers(0, 25))
        got, want = tx.maximal_segments(w), brute_segments(list(w))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])
        assert np.isclose(tx.best_score(w)[0], max([x[2] for x in want], default=0.0))


def test_held_out_accuracy(spark):
    rows = queries.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("doc_id", "score", "predicted", "toxic").collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    tp = sum(r["predicted"] == r["toxic"] == 1 for r in rows)
    assert tp / max(1, sum(r["toxic"] for r in rows)) >= 0.85 and tp / max(1, sum(r["predicted"] for r in rows)) >= 0.9


def test_edges(spark):
    docs = [(i, "you awful vile thing " * 3 if i % 4 == 0 else "a calm day in may " * 3, "s") for i in range(200)] + [(None, "x", "s"), (900, None, "s"), (901, "", "s"), (5, "a calm day", "s")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    m = tx.train(d, labels)
    probe = spark.createDataFrame([(1, "awful vile thing " * 3), (2, "calm day"), (3, None), (4, ""), (4, ""), (5, "calm day in may " * 20_000 + "awful vile awful vile " * 4)], "doc_id int, text string")
    rows = tx.score(probe, m, passages=True).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and got[1]["score"] > 0.5 > got[2]["score"] and got[3]["score"] == got[4]["score"] and got[3]["n_tokens"] == 0
    assert 0 <= min(r["score"] for r in rows) and max(r["score"] for r in rows) <= 1
    (p,) = got[5]["passages"][-1:]
    assert p["start"] >= 79_000 and p["end"] == 80_016
    assert tx.score(d, m).columns.count("score") == 1


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    m = tx.train(d, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert 0 <= tx.score(d, m).first()["score"] <= 0.3
    assert tx.score(d.limit(0), m).count() == 0
    assert tx.train(d, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))["fit"][1] > 0


def test_separate_moderate_passages_add_up(spark):
    weights = np.full(tx.CLASSES, tx.STEP_DOWN, np.float32)
    weights[zlib.crc32(b"awful") & (tx.CLASSES - 1)] = 3.0
    # one such passage is expected in every second clean text of this length
    m = {"weights": weights, "law": (-0.18, 0.3), "fit": (1.0, -5.0)}
    calm = "calm " * 999
    texts = [(1, (calm + "awful ") * 20), (2, calm * 19 + "awful " + calm)]
    got = {r["doc_id"]: r for r in tx.score(spark.createDataFrame(texts, "doc_id int, text string"), m, passages=True).collect()}
    assert got[1]["score"] > 0.9 and got[1]["n_passages"] == len(got[1]["passages"]) == 20
    assert got[2]["score"] < 0.1 and got[2]["n_passages"] == 0 and abs(got[1]["best_segment"] - got[2]["best_segment"]) < 1e-6


def test_copies_count_as_one(spark):
    """200 toxic copies of an ordinary text must not make its words toxic."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(x) for x in rng.choice(list("abcdefgh"), (400, 5))]

    def text():
        return " ".join(rng.choice(vocabulary, 60))
    copied = " ".join(f"copied{i}" for i in range(60))
    docs = [(i, text() + (" awful vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs += [(1000 + i, copied + f" own{i} awful vile", 1) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, toxic int")
    rows = tx._training_rows(d, d.select("doc_id", "toxic"), "doc_id", "text", "toxic", 1000).toPandas()
    of_copies = rows["_t"].str.startswith("copied0")
    assert len(rows) == 600 and rows["_w"][of_copies].sum() < 5 and (rows["_w"][~of_copies] == 1).all()
    m = tx.train(d, d.select("doc_id", "toxic"))
    probe = spark.createDataFrame([(1, copied), (2, text() + " awful vile"), (3, text())], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in tx.score(probe, m).collect()}
    assert got[1] < 0.3 and got[2] > 0.5 and got[3] < 0.3


def test_shared_keys_keep_the_bound(spark):
    d = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(2, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id bigint, toxic int")
    assert tx._training_rows(d, labels, "doc_id", "text", "toxic", 50).count() == 50


def test_odds_have_both_signs():
    n = np.zeros((2, tx.CLASSES + 1))
    n[:, -1] = 900, 100
    n[:, 0], n[:, 1], n[:, 2] = (2, 60), (600, 2), (90, 10)
    w = tx._log_odds(n)
    assert w[0] > 1 and w[1] < -1 and -0.06 < w[2] <= tx.STEP_DOWN

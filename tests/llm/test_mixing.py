"""Targets, shares and limits of the mix."""
import pytest
from pyspark.sql import functions as F

from wirelake.llm import mixing, queries


def test_targets_share_the_excess_again():
    assert mixing.targets([("a", 1, 100), ("b", 2, 100), ("c", 3, 100)], 300) == {"a": 50, "b": 100, "c": 150}
    got = mixing.targets([("a", 1, 10), ("b", 2, 1000), ("c", 3, 20)], 1030)
    assert got == {"a": 30, "b": 940, "c": 60}
    assert mixing.targets([("a", 1, 0), ("b", 1, 5)], 5) == {"a": 0, "b": 5}
    assert mixing.targets([], 0) == {}


def docs(spark):
    rows = [(i, "w " * (1 + i % 40), ("big" if i % 3 == 0 else f"s{i % 5}")) for i in range(3000)] + [(i, "n " * 7, None) for i in range(9000, 9100)]
    rows += [(10_000, None, "s1"), (10_001, "", "s2"), (10_002, " \n\t", "s3"), (None, "w w", "s1"), (5, "w " * 6, "s0"), (5, "w " * 6, "s0"), (20_000, "x", "tiny"), (20_001, "x " * 30_000, "one"), (20_002, None, "void")]
    return spark.createDataFrame([(*r, 4) for r in rows], "doc_id bigint, text string, source string, size int")


def test_sources_come_near_their_targets(spark):
    d = mixing.mix(docs(spark)).cache()
    assert d.count() == docs(spark).count()
    rows = d.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("given"), F.max("target").alias("target"), F.min("target").alias("low"),
                                   F.sum("taken").alias("taken"), F.max("size").alias("longest")).collect()
    names = sorted((r["source"] for r in rows if r["source"] is not None)) + [None]
    sizes = {r["source"]: r["size"] for r in rows}
    goal = mixing.targets([(n, 1 + i % 3, sizes[n]) for i, n in enumerate(names)], sum(sizes.values()))
    for r in rows:
        assert r["given"] == r["size"] and r["target"] == r["low"] == pytest.approx(goal[r["source"]])
        assert abs(r["taken"] - r["target"]) <= max(0.01 * r["target"], min(r["longest"] / 2, 30_000)) + 1, r
    assert d.where("taken > 3 * size or taken % greatest(size, 1) <> 0").count() == 0


def test_reruns_agree(spark):
    a, b = ({(r["doc_id"], r["size"], r["source"], r["taken"]) for r in mixing.mix(docs(spark).repartition(n)).where("doc_id is not null and doc_id <> 5").collect()} for n in (3, 5))
    assert a == b


def test_small_buckets_give_the_same(spark, monkeypatch):
    one = {r["source"]: r["t"] for r in mixing.mix(docs(spark)).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    two = {r["source"]: r["t"] for r in mixing.mix(docs(spark)).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert set(one) == set(two) and all(abs(one[k] - two[k]) <= 60_000 for k in one)


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")).collect()] == [0, 0]


def test_query_sizes(spark):
    import re
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op10_mixing(spark, sf).collect()
    assert len(rows) == len(texts) and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in rows)

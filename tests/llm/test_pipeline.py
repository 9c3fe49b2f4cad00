"""Each stage of the pipeline on what the one before it kept."""
import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from wirelake.llm import decontamination, mixing, near_dedup, toxicity
from wirelake.llm.pii import base_spans

from .test_near_dedup import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cp.written(stage(spark, out[-1], SF), name))
        if stage is not cp.STAGES[-1][1]:
            assert out[-1].schema == docs.schema
    return out


def test_toxic_documents_go_and_clean_ones_stay(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = kept[1].join(labels, "doc_id").groupBy("toxic").count().collect()
    before = {r[0]: r[1] for r in kept[0].join(labels, "doc_id").groupBy("toxic").count().collect()}
    after = {r[0]: r[1] for r in left}
    assert after.get(0, 0) >= before[0] - max(4, 0.03 * before[0]) and after.get(1, 0) <= 0.5 * before[1]


def test_one_of_each_group_stays(kept):
    before = [(r["doc_id"], shingle_set(r["text"], 5)) for r in kept[1].collect()]
    after = {r["doc_id"] for r in kept[2].collect()}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) > 0
    stay = [x for x in before if x[0] in after]
    for i, (_, a) in enumerate(stay):
        assert not any(alike(a, b) for _, b in stay[:i])
    for d, a in before:
        assert d in after or any(alike(a, b) for e, b in before if e < d)


def test_benchmark_copies_go(spark, kept):
    norm = lambda t: b" " + b" ".join(decontamination.words(t)) + b" "
    items = [norm(r[0]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert not any(i in norm(r["text"]) for r in kept[3].collect() for i in items)
    gone = {r["doc_id"] for r in kept[2].collect()} - {r["doc_id"] for r in kept[3].collect()}
    assert len(gone) <= 1 + sum(any(i in norm(r["text"]) for i in items) for r in kept[2].collect()) * 1.3


def test_personal_data_is_gone(kept):
    before, after = ({r["doc_id"]: r for r in k.collect()} for k in kept[3:5])
    assert set(before) == set(after)
    for d, r in after.items():
        assert not base_spans(r["text"]) and r["n_chars"] == (len(r["text"]) if r["text"] != before[d]["text"] else before[d]["n_chars"])


def test_mix_and_run(spark, kept):
    assert kept[5].count() == kept[4].count() and kept[5].where("taken > 3 * size").count() == 0
    assert sorted(map(tuple, cp.run(spark, SF).collect()), key=str) == sorted(map(tuple, kept[5].collect()), key=str)


def test_odd_rows(spark):
    rows = [(None, "plain words of a nameless text here", "en", None, 5), (1, None, None, "a", None), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 27),
            (4, "One two three four five six", "en", "b", 27), (3, "one two three four five six", "en", "a", 27), (None, "one two three four five six", "en", "a", 27)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [docs]
    for name, stage in cp.STAGES:
        got.append(cp.written(stage(spark, got[-1], SF), name))
    left = sorted((r["doc_id"] for r in got[2].collect()), key=str)
    assert left == sorted([None, 1, 2, 3], key=str) or left == sorted([None, 1, 1, 2, 3], key=str)
    assert got[5].count() == got[4].count() == got[3].count()
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    more = docs.selectExpr("*", "'mine' AS score", "7 AS spans", "'b' AS base", "1 AS size", "2 AS target", "'t' AS tokens", "0 AS item_id")
    for name, stage in cp.STAGES[:-1]:
        d = stage(spark, more, SF)
        assert d.columns == more.columns and {tuple(r) for r in d.select("score", "spans", "base", "size", "target", "tokens", "item_id").collect()} == {("mine", 7, "b", 1, 2, "t", 0)}
    assert cp.STAGES[-1][1](spark, more, SF).count() == docs.count()
    assert [s[1].__module__ for s in cp.STAGES] == ["corpus_pipeline"] * 5 and all((mixing, near_dedup, toxicity, F))


def test_one_survivor_whatever_the_ids(spark):
    """Near copies without an id, with one id for all, and with some ids; repeated rows that differ in another column."""
    words = [f"w{k}" for k in range(60)]
    copy = lambda tag, i: " ".join([*(f"{tag}{w}" for w in words), f"end{i}"])
    rows = [(None, copy("a", i), "x", "s") for i in range(6)] + [(7, copy("b", i), "x", "s") for i in range(6)] + [(i or None, copy("c", i), "x", "s") for i in (0, 31, 22, 0)]
    rows += [(50, copy("d", 0), lang, "s") for lang in ("q", "p", None, "p")] + [(None, "", "x", "s"), (51, None, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _key string")
    runs = [sorted(map(tuple, cp.drop_near_copies(spark, d, SF).collect()), key=str) for d in (docs.repartition(3), docs.repartition(5, "text"))]
    assert runs[0] == runs[1] and cp.drop_near_copies(spark, docs, SF).columns == docs.columns
    assert [r[0] for r in runs[0]].count(None) == 2 and {r[0] for r in runs[0]} == {None, 7, 22, 50, 51} and len(runs[0]) == 6
    (d,) = [r for r in runs[0] if r[0] == 50]
    assert d[2] is None

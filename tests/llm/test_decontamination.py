"""Alignment against the textbook recurrence, planted copies, edge cases."""
import random

import numpy as np

from wirelake.llm import decontamination as dc, queries

SF = "/root/testdata/sf0.01"


def brute_score(a, b):
    h = np.zeros((len(b) + 1, len(a) + 1))
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dc.MATCH if a[j - 1] == b[i - 1] else dc.MISMATCH), h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return h.max()


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(0, 30)), rng.integers(0, 4, rng.integers(0, 15))
        assert dc.align(a, b)[0] == brute_score(a, b)


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(50)) for _ in range(n)]


def planted():
    rng = random.Random(5)
    items = [words(rng, 30) for _ in range(8)]
    fill = lambda n: words(rng, n)
    edited = list(items[1])
    for k in (4, 12, 20, 27):
        edited[k] = "changed"
    del edited[16]
    edited.insert(9, "inserted")
    docs = [(1, " ".join(fill(50) + items[0] + fill(50))), (2, " ".join(fill(10) + edited + fill(400))), (3, " ".join(fill(200))),
            (4, " ".join(fill(5) + items[2][:10] + fill(60))), (5, None), (6, ""), (7, " ".join(items[3]).upper() + "!"), (7, " ".join(items[3]).upper() + "!"),
            (None, " ".join(fill(3) + items[4])), (8, " ".join(fill(20_000) + items[5] + fill(20_000) + items[5])), (9, "one two"), (10, " ".join(items[6][:24]))]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, ""), (52, "too short"), (0, " ".join(items[0]))]
    want = [(None, 4), (1, 0), (2, 1), (7, 3), (8, 5), (10, 6)]
    return docs, bench, want


def tables(spark):
    docs, bench, want = planted()
    return (spark.createDataFrame([(*d, 1.0, 3) for d in docs], "doc_id bigint, text string, score double, number int"),
            spark.createDataFrame([(*b, "x") for b in bench], "item_id bigint, text string, doc_id string"), want)


def found(d):
    return sorted(((r["doc_id"], r["item_id"]) for r in d.collect()), key=str)


def test_planted_copies(spark):
    docs, bench, want = tables(spark)
    d = dc.find(docs, bench, ["doc_id"]).cache()
    assert found(d) == sorted(want, key=str)
    rows = {(r["doc_id"], r["item_id"]): r for r in d.collect()}
    assert rows[1, 0]["score"] == 1 and (rows[1, 0]["first_word"], rows[1, 0]["last_word"]) == (50, 80)
    assert (rows[8, 5]["first_word"], rows[8, 5]["last_word"]) == (20_000, 20_030) and 0.6 < rows[2, 1]["score"] < 1


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 300)
    docs, bench, want = tables(spark)
    assert found(dc.find(docs, bench, ["doc_id"])) == sorted(want, key=str)


def test_empty_tables(spark):
    docs, bench, _ = tables(spark)
    assert dc.find(docs.limit(0), bench, ["doc_id"]).count() == 0
    d = dc.find(docs, bench.limit(0), ["doc_id"])
    assert d.count() == 0 and d.columns == ["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"]


def test_query_finds_all_whole_items(spark):
    norm = lambda t: b" " + b" ".join(dc.words(t)) + b" "
    items = [(r[0], norm(r[1])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(r[0], norm(r[1])) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, SF).collect()}
    assert want and want <= got and len(got) <= 1.2 * len(want) + 2


def test_edits_every_few_words_and_changed_ends(spark):
    rng = random.Random(9)
    items = [words(rng, n) for n in (6, 12, 21, 37, 59, 200)]
    kinds, docs, want = {}, [], []
    for i, x in enumerate(items):
        for step in (4, 5, 6, 7):
            for start in range(step):
                kinds["every", i, step, start] = [w if k % step != start else "changed" for k, w in enumerate(x)]
        kinds["inserted", i] = [w for k, y in enumerate(x) for w in ([y, "new"] if k % 2 else [y])]
        kinds["ends", i] = ["changed"] * 3 + [w if k % 6 else "changed" for k, w in enumerate(x)][3:-3] + ["changed"] * 3
        kinds["deleted", i] = [w for k, w in enumerate(x) if k % 5]
    for n, ((_, i, *_), x) in enumerate(kinds.items()):
        docs.append((n, " ".join(words(rng, 40) + x + words(rng, 40))))
        if brute_score(np.array(docs[-1][1].split()), np.array(items[i])) >= dc.MIN_SCORE * dc.MATCH * len(items[i]):
            want.append((n, i))
    # a verbatim copy elsewhere has the n-grams that the edits broke
    docs += [(10_000 + i, " ".join(x)) for i, x in enumerate(items)]
    want += [(10_000 + i, i) for i in range(len(items))]
    d = dc.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"), ["doc_id"])
    assert len(want) > 100 and found(d) == sorted(want, key=str)


def test_all_pairs_of_small_vocabularies(spark):
    rng = random.Random(3)
    items = [[rng.choice("abcdefgh") for _ in range(rng.randrange(4, 30))] for _ in range(40)]
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))] for _ in range(100)]
    want = [(n, i) for n, x in enumerate(docs) for i, y in enumerate(items) if brute_score(np.array(x), np.array(y)) >= dc.MIN_SCORE * dc.MATCH * len(y)]
    d = dc.find(spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(docs)], "doc_id bigint, text string"),
                spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"), ["doc_id"])
    assert want and found(d) == sorted(want, key=str)


def test_long_excerpts(spark):
    rng = random.Random(12)
    items = [words(rng, n) for n in (200, 59, 200)]
    edited = [w if k % 8 else "changed" for k, w in enumerate(items[0][20:80])]
    parts = [(1, items[0][50:150]), (2, items[1][10:40]), (3, items[2][:20]), (4, edited), (5, items[2][:18]), (6, [w if k % 2 else "changed" for k, w in enumerate(items[0][:60])])]
    docs = [(n, " ".join(words(rng, 300) + x + words(rng, 300))) for n, x in parts]
    d = dc.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"), ["doc_id"])
    assert found(d) == [(1, 0), (2, 1), (3, 2), (4, 0)]

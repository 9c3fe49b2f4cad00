"""Groups of near copies against brute force over all pairs, at several node sizes."""
import random

import pytest

from wirelake.llm import graph, near_dedup as nd, queries


def shingle_set(text, size):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return frozenset()
    n = min(size, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(rows, size, percent=80):
    """doc -> (n_shingles, component, kept) by comparing all pairs."""
    sets = [shingle_set(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)), d is not None and d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1, groups=12, base_words=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, base_words))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t))
    # a chain: each links with the next, the ends do not
    chain = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(10):
        rows.append(" ".join(chain))
        chain = chain[4:] + [rng.choice(vocabulary) for _ in range(4)]
    rows += [rows[0], rows[0].upper(), "", None, "   \n\t", "single", "single", "two words", "Two  words", "a\u00a0b", "a b"]
    rng.shuffle(rows)
    out = list(enumerate(rows))
    out += [(None, rows[3]), (None, "only nameless"), (5, rows[5]), (5, "another text of the same id")]
    return out


def result(spark, rows, **kw):
    d = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id bigint, text string, n_shingles string, node int")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.groups(d, **kw).collect()), key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(spark, size):
    rows = corpus()
    assert result(spark, rows, size=size) == brute(rows, size)


def test_small_nodes_branch_and_deal_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "NODE", 6)
    rows = corpus(seed=2, groups=8)
    assert result(spark, rows, size=2) == brute(rows, 2)


def test_groups_of_any_size_give_the_same(spark, monkeypatch):
    rows = corpus(seed=4)
    monkeypatch.setattr(nd, "GROUP_DOCS", 3)
    assert result(spark, rows, size=2) == brute(rows, 2)
    monkeypatch.setattr(nd, "NODE", 6)
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    assert result(spark, rows, size=2) == brute(rows, 2)


def test_crowd_around_one_text(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(200)}" for _ in range(50)]
    rows = []
    for i in range(250):  # neighbours of the base, many of them not of each other
        t = list(base)
        for _ in range(3):
            t[rng.randrange(50)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    assert result(spark, rows, size=2) == brute(rows, 2)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "w1 w2")]
    assert result(spark, rows, size=2) == brute(rows, 2)
    assert result(spark, []) == []


def test_components_of_long_paths(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (2000, 2000)] + [(5000, 5000 + i) for i in range(1, 40)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000} | {5000 + i: 5000 for i in range(40)}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op7_near_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows, 2)

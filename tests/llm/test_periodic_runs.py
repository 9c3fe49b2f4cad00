"""Runs against brute force over random and periodic texts, tiles of any size, stitching in Spark, edge cases."""
import numpy as np
import pytest

from wirelake.llm import periodic_runs as pr


def brute(x):
    """Every maximal stretch of every period, then those whose period is the smallest."""
    out = []
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i < len(x) - p:
            j = i
            while j < len(x) - p and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p) and not any(p % q == 0 and all(x[k] == x[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out)


def texts(seed):
    rng = np.random.default_rng(seed)
    for it in range(300):
        if it % 4 == 0:
            yield rng.integers(0, 2, rng.integers(0, 60)).tolist()
        elif it % 4 == 1:
            x = []
            while len(x) < rng.integers(20, 300):
                w = rng.integers(0, rng.integers(2, 9), rng.integers(1, 25)).tolist()
                x += (w * int(rng.integers(1, 9)))[:len(w) * 6 - int(rng.integers(0, len(w) + 1))]
            yield x
        elif it % 4 == 2:
            block = [0] * int(rng.integers(1, 12)) + [1] + [0] * int(rng.integers(0, 5))
            yield (block * int(rng.integers(1, 9)) + [0] * int(rng.integers(0, 40))) * int(rng.integers(1, 6))
        else:
            yield rng.integers(0, 3, 40).tolist()[:int(rng.integers(1, 40))] * int(rng.integers(1, 12)) + rng.integers(0, 2, 10).tolist()


def stitched(x):
    pieces = sorted((p, a + s, a + e) for h, a, w in pr.tiles(np.array(x, np.int32)) for p, s, e in pr.solve(np.frombuffer(w, np.int32).tolist(), h))
    out = []
    for p, s, e in pieces:
        if out and out[-1][2] == p and s <= out[-1][0] + out[-1][1] - p:
            out[-1] = (out[-1][0], max(e - out[-1][0], out[-1][1]), p)
        else:
            out.append((s, e - s, p))
    return sorted(out)


@pytest.mark.parametrize("stride", [1, 7, 4_096])
def test_runs_equal_brute_force(monkeypatch, stride):
    monkeypatch.setattr(pr, "MIN_STRIDE", stride)
    for x in texts(stride):
        assert stitched(x) == brute(x), x


def test_z_function():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 2, rng.integers(1, 30)).tolist()
        c = int(rng.integers(0, len(x)))
        want = [next((k for k in range(len(x) - c - j) if x[c + k] != x[c + j + k]), len(x) - c - j) for j in range(1, len(x) - c)]
        assert pr.z_function(x, c, len(x) - c)[1:] == want
    assert [pr._shorter(p) for p in (1, 2, 12, 35, 49)] == [(), (1,), (6, 4), (7, 5), (7,)]


def test_table_against_brute_force(spark):
    rows = [(i, " ".join(f"w{v}" for v in x)) for i, x in enumerate(list(texts(9))[:120])]
    got = {r["doc_id"]: r for r in pr.find(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    for i, t in rows:
        x = t.split()
        runs = brute(x)
        assert [tuple(r) for r in got[i]["runs"]] == runs and got[i]["n_words"] == len(x)
        assert got[i]["collapsed"] == " ".join(w for k, w in enumerate(x) if not any(s + p <= k < s + n for s, n, p in runs))


def test_long_text_and_edges(spark):
    block = " ".join(f"word{k}" for k in range(30_000))
    rows = [("a", "x y " * 7 + "end"), ("b", None), ("c", ""), ("c", ""), (None, " \n a\tb a b\x0ba b\r"), ("d", block + " " + "\n".join([block] * 4)), ("e", "no " * 200_000)]
    d = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id string, text string, runs int, _row int, n_words int")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], len(r["collapsed"])) for r in pr.find(d).collect()]
    assert sorted(got, key=repr) == sorted([("a", 8, [(0, 7, 1)], 7), ("b", 0, [], 0), ("c", 0, [], 0), ("c", 0, [], 0), (None, 6, [], 11),
                                           ("d", 150_000, [(0, 150_000, 30_000)], len(block)), ("e", 200_000, [(0, 200_000, 1)], 2)], key=repr)
    assert pr.find(d.limit(0)).count() == 0

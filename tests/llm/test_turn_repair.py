"""Repair against an exhaustive search, damage, giant conversations in small batches, edge cases."""
import hashlib
import heapq
import re

import numpy as np

from wirelake.llm import turn_repair as tr


def brute(rows):
    """rows: (role, text) in order. Best first search over all edits; of equal costs the least audit."""
    faults, seen = [], set()
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    ok = re.compile(r"(s?(ua)+)?")
    start = re.compile(r"s?(ua)*u?")
    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if (i, roles[:1] == "s", roles[-1:]) in done:
            continue
        # the least audit of a cost comes first only among whole ways, so states close when their end is reached
        if i == len(rows) and ok.fullmatch(roles):
            return cost, audit, hashlib.sha256(out[1:].encode()).hexdigest(), faults
        def add(price, letter, role, text, step):
            if start.fullmatch(roles + role[:1]) and role[:1]:
                heapq.heappush(heap, (cost + price, audit + letter, i + step, roles + role[:1], out + "\n" + role + ":" + text))
        if cost > 40:
            continue
        for role in ("user", "assistant"):
            add(2, "I", role, "", 0)
        if i < len(rows):
            (role, text), more = rows[i], faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, out))
            if faults[i] not in ("blank", "duplicate"):
                add(more, "K", role, text, 1)
                for new in ("user", "assistant"):
                    add(2 + more, "R", new, text, 1)


def cases(n, seed):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", " "], ["a.", "b?", "c", "", " \n", "d! ", "e.\t"]
    for _ in range(n):
        yield [(roles[int(rng.choice(5, p=[0.4, 0.4, 0.1, 0.05, 0.05]))], texts[rng.integers(0, 7)] if rng.random() < 0.4 else f"t{rng.integers(0, 99)}.") for _ in range(rng.integers(0, 6))]


def test_repairs_equal_exhaustive_search(spark):
    todo = list(cases(150, 1))
    rows = [(i, k, role, text) for i, c in enumerate(todo) for k, (role, text) in enumerate(c)]
    got = {r["conv_id"]: r for r in tr.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)).collect()}
    for i, c in enumerate(todo):
        if c:
            cost, audit, digest, faults = brute(c)
            initials = [role[:1] for role, _ in c]
            assert (got[i]["cost"], got[i]["audit"], got[i]["repaired_sha256"]) == (cost, audit, digest), c
            assert [got[i][k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
            assert got[i]["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) and got[i]["gaps"] == 0


def test_giant_conversation_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = [(5, k, "user" if k % 2 == 0 else "assistant", f"text {k}.") for k in range(30_000) if k % 1_000 != 500] + [(6, 0, "user", "x.")]
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(8)
    try:
        spark.conf.set(key, 97)
        got = {r["conv_id"]: r for r in tr.repair(d).collect()}
    finally:
        spark.conf.set(key, before)
    # each missing user turn costs an inserted one
    assert got[5]["cost"] == 60 and got[5]["gaps"] == 30 and got[5]["audit"].count("I") == 30 and len(got[5]["audit"]) == 30_000
    want = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:" + ("" if k % 1_000 == 500 else f"text {k}.") for k in range(30_000))
    assert got[5]["repaired_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[6]["audit"] == "KI"


def test_edges(spark):
    rows = [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (1, None, None, None), (1, 3, "user", "q?"), (1, 9, "assistant", "r."), (2, 1, "user", "same."), (2, 1, "user", "same."),
            (3, 4, "", "x."), (4, None, "user", "u."), (4, None, "assistant", "v.")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, _c string, cost int")
    got = {r["conv_id"]: r for r in tr.repair(d).collect()}
    assert set(got) == {None, 1, 2, 3, 4}
    assert got[None]["audit"] == "KK" and got[1]["audit"] == "DKK" and got[1]["blank"] == 1 and got[1]["gaps"] == 5 and got[1]["illegal"] == 1
    assert got[2]["audit"] == "IKD" or got[2]["audit"] == "KDI" or got[2]["cost"] == 5
    assert got[3]["audit"] == "D" and got[4]["gaps"] == 0 and got[4]["audit"] == "IKK" or got[4]["cost"] > 0
    assert tr.repair(d.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(8)] + [(None, None, None, None), (77, None, None, "x")]
    d = tr.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    import zlib
    kinds = {(c, t): zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows}
    assert {0, 1, 2, 3, 4} <= set(kinds.values())
    for (c, t), k in kinds.items():
        mine = [r for r in d if (r["conv"], r["turn"]) == (c, t)]
        assert len(mine) == (2 if k == 3 else 1) and all(r["gone"] == (k == 0) for r in mine)
        if c is not None and c < 30:
            assert mine[0]["text"] == {1: "", 2: "One Two Three"}.get(k, "One. Two! Three?") and mine[0]["role"] == ("user" if k == 4 else "assistant")
    alone = tr.repair(spark.createDataFrame([(1, 0, "user", "a.", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean"), gone="gone").first()
    assert tuple(alone) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

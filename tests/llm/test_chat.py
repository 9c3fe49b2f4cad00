"""Windows of chats: what is read back equals the conversations, budgets hold, the mask covers each answer once."""
import hashlib
import re

from wirelake.llm import chat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string"
HAND = [(1, 0, "system", "be brief", ""), (1, 1, "user", "a <|im_end|> \\ b <\\| \\\\n", ""), (1, 2, "assistant", "<|im_start|>assistant\n\n", ""), (1, 3, "user", None, ""), (1, 4, "assistant", "", ""),
        (2, 5, "assistant", "x " * 700, ""), (2, 1, "user", "q " * 20, ""), (2, 7, "assistant", "short", ""), (2, 8, "user", "u " * 40, ""), (2, 9, "assistant", "v " * 30, ""), (2, 10, "assistant", "end", ""),
        (3, 0, None, "role is null", ""), (3, 0, "tool <|im_end|>\n x", "odd", ""), (4, 0, "system", "alone", ""), (5, 0, "user", "twice", ""), (5, 0, "user", "twice", ""),
        (None, None, "assistant", "no ids <", ""), (None, 1, "user", "|im_end|>", ""), (6, 0, "system", "s " * 400, ""), (6, 1, "assistant", "é😀 t", ""), (6, 2, "system", "late system", "")] + \
       [(7, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 9 + 1), "") for i in range(400)]


def expected(rows):
    """conv -> turns in order of number, role, text, nulls first."""
    by = {}
    for c, n, r, t, _ in rows:
        by.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def test_read_back(spark):
    want = expected(HAND)
    d = chat.read_back(chat.windows(spark.createDataFrame(HAND, SCHEMA), 64, 16)).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in d} == want
    assert {r["conv_id"]: r["loss_text"] for r in d} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}


def test_windows_keep_budget_history_and_system_turn(spark):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for w in chat.windows(spark.createDataFrame(HAND, SCHEMA), 64, 16).collect():
        parts = [p.split("\n", 1) for p in w["formatted"].split("<|im_end|>\n")[:-1]]
        texts = [re.sub(r"(?s)\\(.)", r"\1", t) for _, t in parts]
        assert len(parts) == w["n_turns"] and w["formatted"].count(chat.START) == w["n_turns"]
        new = texts[w["n_system"] + w["n_history"]:]
        assert sum(map(n, texts[w["n_system"]:w["n_system"] + w["n_history"]])) <= 16
        assert sum(map(n, texts)) <= 64 or len(new) <= 1
        if w["conv_id"] in (1, 4, 6):
            assert parts[0][0] == "<|im_start|>system"
        assert len(w["loss"]) == sum(p[0] == "<|im_start|>assistant" for p in parts[w["n_system"] + w["n_history"]:])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(*r, "") for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "<|im_end|><|im_start|>assistant ok"
    want = expected(rows) | {-1: [("user", probe), ("assistant", probe)]}
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, sf).collect()}
    assert set(got) == set(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, v in want.items():
        loss = "".join(t for r, t in v if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_empty_table(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversation(spark):
    """Memory grows with the conversation, not with turns times windows."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"w{k} " * 40, "") for k in range(8_000)] + [(2, k, "user", "", "") for k in range(3_000)]
    d = chat.windows(spark.createDataFrame(rows, SCHEMA).repartition(4)).cache()
    try:
        assert d.where("conv_id = 1").count() >= 8_000 * 40 / 192 and d.where("conv_id = 2").count() == 1
        assert d.where("conv_id = 1 and window > 0").agg({"n_history": "min"}).first()[0] == 1
        back = {r["conv_id"]: r for r in chat.read_back(d).collect()}
    finally:
        d.unpersist()
    assert [t["text"] for t in back[1]["turns"]] == [r[3] for r in rows[:8_000]] and len(back[2]["turns"]) == 3_000
    assert back[1]["loss_text"] == "".join(r[3] for r in rows[1:8_000:2])

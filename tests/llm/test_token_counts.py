"""Token counts after edits equal counts of the edited text."""
import random

import pytest

from wirelake.llm import queries, token_counts as tc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return tc.Encoder()


def some_text(rng, n):
    return "".join(rng.choice(["the ", "Anon ", "  ", "\n", "don't", "'ll ", "été ", "12345 ", "a", " b", "...", "\t\n ", "ß", "😀 ", "word word word "]) for _ in range(n))


def test_leaves_add_up(encoder, monkeypatch):
    monkeypatch.setattr(tc, "LEAF", 20)
    rng = random.Random(3)
    for _ in range(200):
        t = some_text(rng, rng.randrange(0, 120))
        tree = tc.build(t, encoder)
        assert tc.total(tree) == encoder.count(t) and sum(tree["lengths"]) == len(t)


def test_edits_equal_a_full_count(encoder, monkeypatch):
    monkeypatch.setattr(tc, "LEAF", 20)
    rng = random.Random(4)
    for _ in range(400):
        t = some_text(rng, rng.randrange(0, 150))
        cuts = sorted(rng.randrange(0, len(t) + 1) for _ in range(2 * rng.randrange(1, 5)))
        edits = [(a, b, some_text(rng, rng.randrange(0, 12))) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        tree, n = tc.apply(tc.build(t, encoder), t, edits, encoder)
        want = tc.edited(t, edits)
        assert tc.total(tree) == encoder.count(want) == sum(tree["counts"]), (t, edits)
        assert sum(tree["lengths"]) == len(want)
        assert tree["sums"] == tc._sums(tree["counts"])


def test_only_touched_leaves_are_encoded(encoder):
    t = "one two three four " * 20_000
    tree, n = tc.apply(tc.build(t, encoder), t, [(200_000, 200_010, "else")], encoder)
    assert n < 3 * tc.LEAF and tc.total(tree) == encoder.count(tc.edited(t, [(200_000, 200_010, "else")]))


def test_rows(spark, encoder):
    rows = [(1, None, []), (2, "", [(0, 0, "new words")]), (3, "same", None), (4, "cut me out", [(0, 4, ""), (2, 5, "overlap"), (90, 91, "out")]), (4, "cut me out", []), (5, "x" * 300_000, [(5, 6, "y")])]
    d = spark.createDataFrame([(i, t, e, 7) for i, t, e in rows], "doc_id int, text string, edits array<struct<start:int,end:int,replacement:string>>, n_encoded int")
    got = sorted((r["doc_id"], r["n_tokens"], r["n_tokens_after"]) for r in tc.update(tc.index(d), "edits").collect())
    c = encoder.count
    assert got == sorted([(1, 0, 0), (2, 0, c("new words")), (3, c("same"), c("same")), (4, c("cut me out"), c("me out")), (4, c("cut me out"), c("cut me out")),
                          (5, c("x" * 300_000), c("x" * 5 + "y" + "x" * 299_994))])
    assert tc.update(tc.index(d.limit(0)), "edits").count() == 0


def test_query_equals_a_full_count(spark, encoder):
    import re
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op3_token_counts(spark, SF).collect():
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == encoder.count(t)
        assert r["n_tokens_after"] == encoder.count(re.sub("[0-9]{5,}", "#", t))
        assert r["n_edits"] == len(re.findall("[0-9]{5,}", t))


SCRIPTS = {"cyrillic": "\u0441\u043b\u043e\u0432\u043e \u0438 \u0434\u0435\u043b\u043e ", "chinese": "\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u3002", "numbers": "17 4 2026\n8 15 16\n",
           "lines": "x=1\r\n\r\n\ty_2\n\n\n", "marks": "it's  -- 'tis \u00b2\u00bd\u3000\u2028 don't\u3001'sun\u3002\x1c\x1f ' s  "}


def test_every_script_is_cut_and_edits_stay_local():
    encoder = tc.Encoder()
    rng = random.Random(8)
    for name, piece in SCRIPTS.items():
        text = piece * (60_000 // len(piece))
        leaves = tc.cut(text)
        assert "".join(leaves) == text and len(leaves) >= 20, name
        assert sum(map(encoder.count, leaves)) == encoder.count(text), name
        tree = tc.build(text, encoder)
        for _ in range(25):
            s = rng.randrange(len(text) - 8)
            edit = (s, s + rng.choice([0, 1, 2, 7]), rng.choice(["", " ", "\n", "'s", "\u4eca", "7", "\u3002", " a"]))
            new, encoded = tc.apply(tree, text, [edit], encoder)
            assert tc.total(new) == encoder.count(tc.edited(text, [edit])) and encoded < 12_000, (name, edit)


def test_cuts_of_random_texts():
    encoder = tc.Encoder()
    rng = random.Random(9)
    signs = "ab'st _1\u00b2 \n\t\r\x0b\x1c\x85\u00a0\u3000\u3001\u3002\u4eca\u0301\u0441.-\uff0c"
    old = tc.LEAF
    try:
        tc.LEAF = 3
        for _ in range(3000):
            text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
            assert sum(map(encoder.count, tc.cut(text))) == encoder.count(text), repr(text)
            s = rng.randrange(len(text) + 1)
            edit = (s, rng.randrange(s, len(text) + 1), "".join(rng.choice(signs) for _ in range(rng.randrange(4))))
            assert tc.total(tc.apply(tc.build(text, encoder), text, [edit], encoder)[0]) == encoder.count(tc.edited(text, [edit])), (text, edit)
    finally:
        tc.LEAF = old

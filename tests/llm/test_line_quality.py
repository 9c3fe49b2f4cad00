"""Counts, decoding and likelihood against brute force, held-out accuracy, edge cases."""
import itertools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wirelake.llm import line_quality as lq
from wirelake.llm import queries

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def brute_counts(text):
    words = re.findall(WORD, text)
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_counts_of_every_document(spark):
    rows = queries.op11_line_quality(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        n, chars, symbols, dup, repeated = brute_counts(r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and not (r["base_failed"] and r["kept"])


def test_counts_of_odd_texts():
    rng = np.random.default_rng(3)
    texts = ["", "\n", "a", "\n\na\n", "é ü # ", "x " * 9, "\x1c \x85 a\x0bb\rc"] + ["".join(rng.choice(list("ab é|\n\t#!"), rng.integers(0, 60))) for _ in range(300)]
    x = lq.Lines([t.encode() for t in texts])
    got = list(zip(x.words.tolist(), x.word_chars.tolist(), x.symbols.tolist(), x.dup_lines.tolist(), x.repeat_words.tolist(), strict=True))
    assert got == [brute_counts(t) for t in texts]
    lined = [(i, k) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if re.search(WORD, line)]
    assert lined == list(zip(x.doc.tolist(), x.number.tolist(), strict=True))


def total(score, move, labels):
    return sum(s for s, k in zip(score, labels, strict=True) if k) + sum(move[a][b] for a, b in itertools.pairwise(labels))


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(200):
        score, move = rng.normal(0, 2, rng.integers(1, 8)), rng.normal(0, 1.5, (2, 2))
        best = max(total(score, move, y) for y in itertools.product((0, 1), repeat=len(score)))
        assert np.isclose(total(score, move, lq.viterbi(score, move).tolist()), best)
    assert lq.viterbi(np.zeros(4), np.zeros((2, 2))).tolist() == [0, 0, 0, 0]


def test_likelihood_and_gradient():
    rng = np.random.default_rng(5)
    codes = np.stack([rng.integers(lq._AT[k], lq._AT[k + 1], (3, 4)) for k in range(len(lq.FEATURES))], 2)
    real, y = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool), np.array([1, 0, 1])
    p = rng.normal(0, 1, lq.WEIGHTS + 4)
    value, grad = lq._likelihood(p, codes, real, y)
    move, want = p[lq.WEIGHTS:].reshape(2, 2), 0.0
    for c, r, k in zip(codes, real, y, strict=True):
        score = p[:lq.WEIGHTS][c[r]].sum(1)
        want -= total(score, move, [k] * len(score)) - np.log(sum(np.exp(total(score, move, l)) for l in itertools.product((0, 1), repeat=len(score))))
    assert np.isclose(value, want)
    for i in [*rng.integers(0, lq.WEIGHTS, 8), *range(lq.WEIGHTS, lq.WEIGHTS + 4)]:
        step = np.zeros_like(p)
        step[i] = 1e-5
        assert np.isclose((lq._likelihood(p + step, codes, real, y)[0] - lq._likelihood(p - step, codes, real, y)[0]) / 2e-5, grad[i], atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = queries.held_out("doc_id")
    model = lq.train(docs, labels.where(~held))
    rows = lq.judge(docs.join(labels.where(held), "doc_id"), model).where("not base_failed").select("doc_id", "quality", "kept").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows) and sum(r["quality"] == 0 for r in rows) > 30
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows) >= 0.98


def lines(rng, n, good):
    """n lines of ten words, none of which comes twice."""
    words = [["".join(rng.choice(list("abcdeéilmnorst"), rng.integers(2, 9))) for _ in range(10)] for _ in range(n)]
    return "\n".join((" ".join(w).capitalize() + "." if good else " ".join(f"{x.upper()}!!" for x in w)) for w in words)


def test_mixed_text_and_edges(spark):
    rng = np.random.default_rng(8)
    docs = [(i, lines(rng, 6, i % 2), "z") for i in range(80)]
    d = spark.createDataFrame([*docs, (None, docs[1][1], "z"), (900, None, "z"), (901, "", "z"), (3, docs[3][1], "z")], "doc_id bigint, text string, kept string")
    model = lq.train(d, spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (5, None)], "doc_id bigint, quality int"))
    got = lq.judge(d, model).collect()
    assert len(got) == 84 and all(r["kept"] == (r["doc_id"] is None or r["doc_id"] < 80 and r["doc_id"] % 2 == 1) for r in got)
    assert all(r["base_failed"] and r["n_words"] == 0 for r in got if r["doc_id"] in (900, 901)) and d.columns[0] in got[0]
    mixed = lines(rng, 2, False) + "\n\n" + lines(rng, 5, True)
    probe = spark.createDataFrame([(1, mixed), (2, lines(rng, 20_000, True)), (3, "\n".join([docs[1][1]] * 3_000))], "doc_id int, text string")
    one, two, three = sorted(lq.judge(probe, model).collect(), key=lambda r: r["doc_id"])
    assert [tuple(x) for x in one["boilerplate"]] == [(0, 2)] and one["kept"] and one["content_words"] == 50
    assert two["n_words"] == 200_000 and two["kept"] and two["content_words"] == 200_000
    assert three["n_repeat_words"] == three["n_words"] == 180_000 and three["base_failed"] and three["n_dup_lines"] == 6 * 2_999
    assert lq.judge(d.limit(0), model).count() == 0


def test_bounds_hold_for_rows_and_labels_may_be_missing(spark):
    d = spark.range(2_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("some words here "), F.col("id") % 50).alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id bigint, quality int")
    m = lq.train(d, labels, docs_bound=20, pieces_bound=10)
    assert (m["weights"] < 0).all() and (lq.train(d.limit(0), labels)["weights"] < 0).all()
    assert (lq.train(d, spark.createDataFrame([(7, 0)], "doc_id bigint, quality int"))["weights"] > 0).all()

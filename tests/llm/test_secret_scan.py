"""Secrets: fixed patterns against plain regular expressions, the character model on held-out strings, edge cases."""
import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from wirelake.llm import queries, secret_scan

SF = "/root/testdata/sf0.001"
PATTERNS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(spans)]


HAND = ["", None, "nothing here", "password=abc", "PassWord : 'hunter2hunter' then secret=token=abcdefgh", "api_key=token: abcdef12 api_key=ab token:xyzxyz",
        "ü" * 50 + " AKIA" + "A1" * 8 + " é AKIAAKIA" + "B2" * 7, "f" * 23 + " " + "0" * 24 + "g" + "a" * 30, "token = \"" + "9f" * 20 + "\" " + "😀" * 5 + " passwd=\"x.y/z+1-_\"",
        "secret" * 3 + "=abcdef", ("word " * 3000) + "apikey=" + "Z9" * 10 + " " + "tail " * 2000]


def test_fixed_patterns_equal_plain_ones(spark):
    rows = [(i, t, "x") for i, t in enumerate(HAND)] + [(0, HAND[0], "x"), (4, HAND[4], "y")]
    d = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, base string"), [0.0] * 128 * 128)
    assert d.columns == ["doc_id", "text", "base", "spans"]
    got = d.select("doc_id", secret_scan.digest_text(F.col("base"))).collect()
    assert len(got) == len(rows)
    for i, s in got:
        assert s == ",".join(brute(HAND[i])), HAND[i]


def test_query_over_a_table(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op1_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}


def test_model_tells_random_strings_from_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = secret_scan.train(secret_scan.labelled_tokens(docs, "doc_id"))
    rng = random.Random(1)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(60)]
    names = ["_".join(rng.sample(["the", "inthing", "ation", "hand", "there", "wither", "shore"], 5)) for _ in range(60)]
    d = secret_scan.scan(spark.createDataFrame([(i, f"so {t} it") for i, t in enumerate(keys + names)], "doc_id bigint, text string"), model)
    hit = {r[0] for r in d.where(F.size("spans") > 0).select("doc_id").collect()}
    assert len([i for i in hit if i < 60]) >= 57 and len([i for i in hit if i >= 60]) <= 3


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    model = secret_scan.train(secret_scan.labelled_tokens(d, "doc_id"))
    assert set(model) == {0.0} and secret_scan.scan(d, model).count() == 0

"""Personal data: fixed patterns against plain regular expressions, redaction, edge cases."""
import hashlib
import re

from pyspark.sql import functions as F

from wirelake.llm import pii, queries

SF = "/root/testdata/sf0.001"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out, text = [], text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", m))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


HAND = ["", None, "plain words", "a@b", "x.y+z@mail.example.com, q@q.q@r.s and @no.com a@b.c@d.e", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.2.3.0255 1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 49927398716 4111111111111111111111", "+1 (456) 555-2186 and +49.30.123456 + 1 +12345678 +1234567890123456",
        "é" * 30 + " +1 (456) 555-2186 😀 me@home.example.org " + "ü" * 5, "+1+2+3(((( +4 555 555 555 5)", "0" * 4000 + ".1.2.3", "call 456 555 2186 or me at home dot com", "." * 40 + "@" * 40]


def test_fixed_patterns_equal_plain_ones(spark):
    rows = [(i, t, 1) for i, t in enumerate(HAND)] + [(4, HAND[4], 2)]
    d = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string, spans int"), ([], [2.0] * 4))
    got = d.select("doc_id", pii.digest_text(F.col("base"))).collect()
    assert len(got) == len(rows)
    for i, s in got:
        assert s == ",".join(brute(HAND[i])), HAND[i]


def test_query_over_a_table(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op2_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(b.startswith(k) for b in base) for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}


def test_trees_accept_what_looks_like_the_fixed_kinds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    trees, thresholds = pii.train(docs, "doc_id")
    assert trees and len(thresholds) == 4
    n = pii.find(docs, (trees, thresholds)).agg(F.sum(F.size("base")), F.sum(F.size("spans"))).first()
    assert n[0] <= n[1] <= 1.3 * n[0]


def test_redaction(spark):
    rows = [(1, "mail a@b.com now"), (2, None), (3, "none"), (4, "x +1 (456) 555-2186 y 4111 1111 1111 1111")]
    d = pii.redact(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"), ([], [2.0] * 4)))
    assert {r["doc_id"]: r["text"] for r in d.collect()} == {1: "mail [EMAIL] now", 2: None, 3: "none", 4: "x [PHONE] y [CARD]"}


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    model = pii.train(d, "doc_id")
    assert model[0] == [] and pii.find(d, model).count() == 0


def test_local_phones_and_obfuscated_addresses_are_redacted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").limit(4000)
    planted = ["(456) 555-2186", "456-555-2186", "456 555 2186", "jane.77 at mail3 dot example dot com", "jane.77(at)mail3.example.com", "10[.]20[.]30[.]40", "4111/1111/1111/1111"]
    ordinary = ["2024-01-15", "12 345 678", "98079157628044901"]
    rows = [(i, f"thst oner whe er {x} rethsh on the") for i, x in enumerate(planted + ordinary)]
    d = pii.redact(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"), pii.train(docs, "doc_id")))
    got = {r["doc_id"]: r["text"] for r in d.collect()}
    missed = [x for i, x in enumerate(planted) if x in got[i]]
    assert not missed and all(got[len(planted) + i] == rows[len(planted) + i][1] for i in range(len(ordinary)))


def test_very_many_spans_in_one_text():
    import itertools
    import random
    import time
    rnd = random.Random(1)
    text = " ".join(rnd.choice((f"u{k}@mail{k}.org", f"10.0.{k % 256}.{k % 99}", f"+49 30 {k:07}", "1.1.1.1.1.1.1", f"at home {k}")) for k in range(100_000))
    assert len(text) > 1_400_000
    began = time.time()
    assert len(pii.propose(text)) > 70_000 and len(pii.examples(text, 3)) > 70_000
    assert time.time() - began < 120
    spans = [(0, s, s + rnd.randrange(1, 9)) for s in sorted(rnd.sample(range(60), 12))]
    held = pii._Spans(spans)
    for x, y in itertools.combinations(range(70), 2):
        assert held.hold(x, y) == any(s <= x and y <= e for _, s, e in spans) and held.touch(x, y) == any(s < y and x < e for _, s, e in spans)


def test_trees_learn_from_all_candidates(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    n = 21_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to u"), (F.col("id") % 50).cast("string"), F.lit("@mail.example.com for more")).alias("text"))
    per = {k: len(pii.examples(f"write to u{k}@mail.example.com for more", 5)) for k in range(50)}
    seen = []

    def fit(self, data):
        seen.append(data.agg(F.sum("n") if "n" in data.columns else F.count("*")).first()[0])
        raise StopIteration
    monkeypatch.setattr(GBTClassifier, "fit", fit)
    try:
        pii.train(docs, "doc_id")
    except StopIteration:
        pass
    total = sum(per[i % 50] for i in range(n))
    assert total > 40_000 and abs(seen[0] / total - 0.75) < 0.02


def test_bins_and_cuts(spark):
    rows = [([float(i % 3)] + [float(i)] + [0.0] * (pii.N_FEATURES - 2), 1.0) for i in range(640)]
    cuts = pii._cuts(spark.createDataFrame(rows, "f array<double>, n double"))
    assert cuts[0] == [0.5, 1.5] and cuts[1] == [20 * i - 0.5 for i in range(1, 32)] and cuts[2:] == [[]] * (pii.N_FEATURES - 2)

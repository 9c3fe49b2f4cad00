"""Values, tokens, tags, structures."""
import pytest
from pyspark.sql import functions as F

from wirelake.functions import values as V, wording as T
from wirelake.operators import sentences as P, tagging as G
from wirelake.plans.fixtures import view
from wirelake.plans.texts import trained


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


def test_values(spark):
    for text, cls, want in [("6.8nF", "capacitor", "6.8n"), ("3M", "resistor", "3meg"), ("18volt", "voltage_source", "DC 18"), ("8k2", "resistor", "8.2k"), ("5R6", "resistor", "5.6"),
                            ("470R", "resistor", "470"), ("470R", "inductor", None), ("choke", "inductor", None), ("22kz", "resistor", None)]:
        assert one(spark, V.sentence_value(F.lit(text), F.lit(cls))) == want, text
    for text, want in [("33uH", "inductor"), ("68k", "resistor"), ("47", None), ("6p8", "capacitor"), ("24V", "voltage_source")]:
        assert one(spark, V.unit_class(F.lit(text))) == want, text
    for text, want in [("82k", ("82k", None)), ("6,8nF", ("6.8n", "capacitor")), ("150R", ("150", "resistor")), ("Q7", (None, None)), ("+12V", ("12", "voltage_source")), ("5R6", ("5.6", None))]:
        assert tuple(one(spark, V.drawn_value(F.lit(text)))) == want, text
    for text, want in [("8.2k", (8200.0, None)), ("DC 24", (24.0, None)), ("3meg", (3e6, None)), ("DX1", (None, "DX1")), (None, (None, None))]:
        assert tuple(one(spark, V.netlist_number(F.lit(text).cast("string")))) == want, text


def test_tokens(spark):
    tok = lambda s: one(spark, T.tokens(F.lit(s)))
    assert tok("one 5R6 coil, 8.2 kilohm or 3 megohms (1N5817)") == ["one", "5R6", "coil", ",", "8.2k", "ohm", "or", "3M", "ohm", "(", "1N5817", ")"]
    assert tok("470Ω 5R6. 8k2.") == ["470", "ohm", "5R6", "8k", "2"] and one(spark, T.label_text(F.lit("68 kΩ"))) == "68k"


TAGS = {"battery": "SRC", "supply": "SRC", "source": "SRC", "resistor": "RES", "resistors": "RES", "res": "RES", "capacitor": "CAP", "cap": "CAP", "inductor": "IND", "inductors": "IND", "coil": "IND",
        "choke": "IND", "diode": "DIO", "LED": "DIO", "ohm": "UNIT", "V": "UNIT", "volt": "UNIT", "k": "UNIT", "series": "SER", "followed": "SER", "parallel": "PAR", ",": "SEP", "and": "SEP"}
CASES = [
    ("a 3V battery driving a 47k resistor in series with a 15k resistor", "DC 3", "S(resistor:47k,resistor:15k)"),
    ("an LED in series with a 680 ohm resistor powered by a 6 V battery", "DC 6", "S(diode:-,resistor:680)"),
    ("a 33k resistor , a 22nF capacitor and a 8.2 k resistor in parallel", None, "P(capacitor:22n,resistor:33k,resistor:8.2k)"),
    ("a 7mH coil in parallel with a 3k resistor which is in series with a 22uF cap connected across a 18 volt supply", "DC 18", "P(S(resistor:3k,capacitor:22u),inductor:7m)"),
    ("two inductors of 2mH and 3mH in series across a 15 volt source", "DC 15", "S(inductor:2m,inductor:3m)"),
    ("a 12k resistor in parallel with a 4uF cap, then in series with a 9k resistor", None, "S(P(capacitor:4u,resistor:12k),resistor:9k)"),
    ("three 5mH inductors in parallel", None, "P(inductor:5m,inductor:5m,inductor:5m)"),
    ("a pair of 39k resistors in series", None, "S(resistor:39k,resistor:39k)"),
    ("a 2mH coil in series with a 7k resistor, all in parallel with a 18k resistor across a 4V supply", "DC 4", "P(S(inductor:2m,resistor:7k),resistor:18k)"),
    ("(a 82 ohm resistor in parallel with a 3nF cap) in series with a 75 ohm resistor", None, "S(P(capacitor:3n,resistor:82),resistor:75)"),
    ("a 11k resistor in series with (a 13k resistor in parallel with a 6mH inductor) powered by a 48V battery", "DC 48", "S(resistor:11k,P(inductor:6m,resistor:13k))"),
    ("(a 91k resistor in series with a 62k resistor", None, "S(resistor:91k,resistor:62k)"),
    ("((a 20k resistor in parallel with a 9uF cap) in series with a 30k resistor) in parallel with a 51k resistor", None,
     "P(S(P(capacitor:9u,resistor:20k),resistor:30k),resistor:51k)"),
    ("a 6k8 res in parallel with a 4mH choke", None, "P(inductor:4m,resistor:6.8k)"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, text string").withColumn("words", T.tokens(F.col("text")))
    pairs = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    tag = lambda w: F.coalesce(F.try_element_at(pairs, w), F.when(w.rlike("^[0-9]"), "VAL").otherwise("O"))
    d = P.structured(P.chunked(d.withColumn("tags", F.transform("words", tag))))
    return {r.id: r for r in P.netlist(d, F.lit("t")).withColumn("notes", P.notes()).collect()}


def test_structures(parsed):
    for i, (text, src, tree) in enumerate(CASES):
        r = parsed[i]
        assert (r.tree_text, r.source and r.source.value) == (tree, src), text


def test_nested_netlist_nodes(parsed):
    body = lambda i: parsed[i].netlist.split("\n")[1:-3]
    assert body(0) == ["V1 1 0 DC 3", "R1 1 2 47k", "R2 2 0 15k"]
    assert sorted(body(3)) == ["C1 2 0 22u", "L1 1 0 7m", "R1 1 2 3k", "V1 1 0 DC 18"]
    assert sorted(body(5)) == ["C1 1 2 4u", "R1 1 2 12k", "R2 2 0 9k", "V1 1 0 DC 5"]
    assert ".model DMOD D" in parsed[1].netlist and any("No voltage source" in n for n in parsed[2].notes) and parsed[0].notes == []


SF = "/root/testdata/sf0.001"


def test_training_and_decoding(spark):
    from wirelake.plans.texts import gold
    model = trained(spark, SF)
    gold_rows = gold(spark, SF)
    got = G.tag(gold_rows.withColumnRenamed("tags", "gold"), model).select(
        F.explode(F.arrays_zip("gold", "tags")).alias("t")).agg(F.avg((F.col("t.gold") == F.col("t.tags")).cast("int")).alias("a")).collect()[0].a
    assert got > 0.99
    assert G.tag(spark.createDataFrame([(1, [])], "id long, words array<string>"), model).collect()[0].tags == []


def test_large_vocabularies_are_joined(spark, monkeypatch):
    """The same tags where the scores are too many to go along, frequent words split."""
    from wirelake.operators import components as K
    model = trained(spark, SF)
    d = spark.createDataFrame([(i, "A 5V battery driving Unheard 3k resistors in 1x2 series".split()[:i % 11]) for i in range(60)] + [(99, None)], "id long, words array<string>")
    want = {r.id: r.tags for r in G.tag(d, model).collect()}
    monkeypatch.setattr(G, "CARRIED", (0, 0))
    monkeypatch.setattr(K, "SPAN", 10)
    assert {r.id: r.tags for r in G.tag(d, model).collect()} == want and len(want[10]) == 10 and want[99] == []


def test_a_model_is_trained_once(spark, tmp_path):
    made = []

    def train():
        made.append(1)
        return trained(spark, SF)
    for _ in range(2):
        assert G.Model.stored(str(tmp_path / "m"), train).step.count() == 121
    assert len(made) == 1


def test_reports(spark):
    d = spark.createDataFrame([(1, " "), (2, "a and a")], "id long, text string").unionByName(view(spark, SF, "fx_sent").limit(1).select(F.lit(3).cast("long").alias("id"), "text"))
    got = {r.id: r.report for r in P.report(P.described(d, trained(spark, SF))).collect()}
    assert got[1] == "Type a circuit description." and got[2].startswith("No circuit components were found") and got[3] == "Validation: OK"


def test_each_text_is_taken_apart_once_and_in_many_tasks(spark):
    """Sentences of one row group, most of them the same text; null texts keep their rows."""
    from pyspark.sql import functions as F
    from wirelake.operators import sentences as P
    d = spark.range(300, numPartitions=1).select("id", F.when(F.col("id") % 50 > 0, F.concat(F.lit("a "), F.col("id") % 20, F.lit("k resistor"))).alias("text"))
    seen = []

    def work(texts):
        seen.append((texts.count(), texts.rdd.getNumPartitions()))
        return texts.withColumn("n", F.length("text"))
    got = P.per_text(d, work)
    assert got.columns == ["id", "text", "n"] and seen[0][0] == 21 and seen[0][1] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = {r.id: (r.text, r.n) for r in got.collect()}
    assert len(rows) == 300 and rows[50] == (None, None) and rows[21] == ("a 1k resistor", 13)

"""Netlist checks, nets and equivalence."""
import random

from pyspark.sql import functions as F

from wirelake.operators import components as K, equivalence as Q, netlists as N, nets as W
from wirelake.sources.artefacts import text_lines

GOOD = "* low pass\nV7 3 0 DC 9\nR4 3 8 47k\nC2 8 0 22n\n.op\n.end\n"
CASES = {
    "good": (GOOD, None), "plain source": ("* x\nV2 4 0 18\nL1 4 0 7\n.end\n", None),
    "short line": (GOOD.replace("R4 3 8 47k", "R4 8 47k"), "syntax error at line 3 near '47k'"),
    "no end": ("* x\nL3 6 0 2m\n", "syntax error at line end near '<eof>'"), "no title": ("L3 6 0 2m\n.end\n", "syntax error at line 1 near 'L3'"),
    "after end": ("* x\n.end\nC5 2 0 3n\n", "syntax error at line 3 near 'C5'"), "too long": ("* x\nC5 2 0 3n tail\n.end\n", "syntax error at line 2 near 'tail'"),
    "too short": ("* x\nC5 2 0\n.end\n", "syntax error at line 2 near '\\n'"), "title alone": ("* x\n", "syntax error at line end near '<eof>'"),
    "no ground": ("* x\nL3 6 7 2m\nC5 6 7 3n\n.end\n", "no ground node (0)"), "floating": (GOOD.replace("C2 8 0", "C2 5 0"), "node 8 is floating (1 connection)"),
    "model": ("* x\nV2 4 0 18\nD9 4 0 DX1\n.end\n", "D9 uses undefined model DX1"), "shorted": ("* x\nV2 4 0 18\nL1 4 0 7\nC5 4 4 3n\n.end\n", "C5 is shorted (both terminals on node 4)"),
    "duplicate": ("* x\nV2 4 0 18\nL1 4 0 7\nL1 4 0 9\n.end\n", "duplicate reference L1"),
}


def line_rows(spark, texts):
    return text_lines(spark.createDataFrame(list(texts.items()), "circuit_id string, text string"), ["circuit_id"])


def test_validation(spark):
    got = {r.circuit_id: r.first_error for r in N.validation(line_rows(spark, {k: v[0] for k, v in CASES.items()})).collect()}
    assert got == {k: v[1] for k, v in CASES.items()}


REF = "* bridge\nV3 5 0 DC 24\nL2 5 6 3m\nC8 6 0 68n\n.op\n.end\n"
TEXTS = {"ref": REF, "renamed": "* other names\nC1 2 11 68n\nV5 40 11 24\nL9 40 2 3m\n.end\n", "value": REF.replace("C8 6 0 68n", "C8 6 0 33n"),
         "wiring": REF.replace("C8 6 0", "C8 5 0"), "polarity": REF.replace("V3 5 0", "V3 0 5")}


def classes(spark, texts, values):
    el = N.elements(line_rows(spark, texts))
    return {r.circuit_id: r.class_id for r in Q.classes(el, el.select("circuit_id").distinct(), values).collect()}


def test_equivalence_cases(spark):
    c, t = classes(spark, TEXTS, True), classes(spark, TEXTS, False)
    assert c["ref"] == c["renamed"] and len({c[k] for k in ("ref", "value", "wiring", "polarity")}) == 4
    assert t["ref"] == t["renamed"] == t["value"] and t["wiring"] != t["ref"]


def ring(nodes):
    return [f"R{i} {a} {b} 1k" for i, (a, b) in enumerate(zip(nodes, nodes[1:] + nodes[:1], strict=True))]


def shuffled(lines, seed):
    rnd = random.Random(seed)
    nodes = sorted({n for x in lines for n in x.split()[1:3]})
    new = dict(zip(nodes, rnd.sample([str(100 + k) for k in range(len(nodes))], len(nodes)), strict=True))
    out = [(p[0], *rnd.sample([new[p[1]], new[p[2]]], 2), p[3]) for p in map(str.split, lines)]
    return [" ".join(p) for p in rnd.sample(out, len(out))]


def test_rings_need_the_exact_check(spark):
    """One ring and two rings of half the size look alike to colour refinement."""
    texts, want = {}, {}
    for n in (6, 14, 20, 40):
        one, two = ring([str(k) for k in range(n)]), ring([str(k) for k in range(n // 2)]) + ring([str(k) for k in range(n // 2, n)])
        for kind, lines in (("one", one), ("two", two)):
            for seed in range(3):
                texts[f"{kind}{n}/{seed}"] = "\n".join(shuffled(lines, seed))
                want[f"{kind}{n}/{seed}"] = (kind, n)
    c = classes(spark, texts, False)
    assert all((c[a] == c[b]) == (want[a] == want[b]) for a in texts for b in texts)


def test_random_graphs_equal_brute_force(spark):
    import itertools
    rnd = random.Random(7)
    graphs = [[f"{rnd.choice('RC')}{k} {rnd.randrange(5)} {rnd.randrange(5)} 1k" for k in range(rnd.randrange(3, 7))] for _ in range(25)]
    graphs += [shuffled(g, 1) for g in graphs]

    def form(lines):
        nodes = sorted({n for x in lines for n in x.split()[1:3]})
        best = None
        for perm in itertools.permutations(range(len(nodes))):
            at = dict(zip(nodes, perm, strict=True))
            key = sorted((p[0][0], *sorted((at[p[1]], at[p[2]]))) for p in map(str.split, lines))
            best = key if best is None or key < best else best
        return str(best)
    c = classes(spark, {str(i): "\n".join(g) for i, g in enumerate(graphs)}, False)
    forms = [form(g) for g in graphs]
    assert all((c[str(i)] == c[str(j)]) == (forms[i] == forms[j]) for i in range(len(graphs)) for j in range(i))


def test_voltages_against_several_references(spark):
    volts = spark.createDataFrame([(1, "R1k", [1.0, 2.0]), (2, "R1k", [1.0, 2.0000001]), (3, "R1k", [1.0, 3.0]), (4, "R1k", [1.0])], "circuit_id long, label string, volts array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 1)], "circuit_id long, ref_id long")
    assert {(r.ref_id, r.op_match) for r in N.voltages_match(pairs, volts).collect()} == {(1, True), (2, True), (3, False), (4, False)}


def test_elements_keep_long_lines(spark):
    line = "R1 1 0 " + " ".join(f"w{k}" for k in range(5000))
    assert N.elements(line_rows(spark, {"a": line})).first()["rest"].count(" ") == 4999


def test_components_on_long_chains(spark):
    edges = [(1, i, i + 1) for i in range(60) if i != 30] + [(2, 5, 7)]
    d = spark.createDataFrame(edges, "image_id long, u long, v long")
    nodes = d.select("image_id", F.explode(F.array("u", "v")).alias("node")).distinct()
    got = {(r.image_id, r.node): r.root for r in K.connected(nodes, d).collect()}
    assert all(v == (0 if n <= 30 else 31) for (i, n), v in got.items() if i == 1) and got[(2, 7)] == 5


def test_large_images_and_hubs(spark, monkeypatch):
    """With small bounds: the same components by rounds of joins, and no join key with more than about SPAN rows."""
    rnd = random.Random(4)
    edges = [(1, 0, k) for k in range(1, 300)] + [(1, k, k + 1) for k in range(2000, 2006)] + [(2, rnd.randrange(30), rnd.randrange(30)) for _ in range(25)] + [(3, 8, 9), (3, 9, 9)]
    d = spark.createDataFrame(edges, "image_id long, u long, v long").repartition(8)
    nodes = d.select("image_id", F.explode(F.array("u", "v")).alias("node")).distinct()
    got = lambda: {(r.image_id, r.node): r.root for r in K.connected(nodes, d).collect()}
    want = got()
    assert want[(1, 299)] == 0 and want[(1, 2006)] == 2000 and want[(3, 9)] == 8
    monkeypatch.setattr(K, "LARGE", 20)
    monkeypatch.setattr(K, "SPAN", 50)
    assert got() == want
    rows = spark.range(1000).selectExpr("id % 2 * (id % 7) AS k", "id AS n")
    t = rows.groupBy("k").agg(F.count("*").alias("_rows")).withColumn("x", F.col("k") * 10)
    j = K.spread_join(rows, t, ["k"], ["n"])
    assert j.count() == 1000 and j.filter("x <> k * 10").count() == 0
    counted = K.spread_join(rows, t.withColumn("part", F.monotonically_increasing_id()), ["k"], ["n"])
    assert counted.columns == ["k", "n", "x", "part"]


def test_ground_rules(spark):
    rows = [(1, 1, "resistor", [1, 2]), (1, 2, "gnd", [2]), (2, 1, "voltage_source", [1, 2, 3]), (2, 2, "voltage_source", [3, 1]), (3, 1, "resistor", [1, 2]), (3, 2, "diode", [2, 3]), (4, 1, "other", [1])]
    t = spark.createDataFrame(rows, "image_id long, det_idx long, cls string, nets array<bigint>")
    rules, zero = W.ground_rule(t)
    assert {r.image_id: r.rule for r in rules.collect()} == {1: W.RULES["symbol"], 2: W.RULES["source"], 3: W.RULES["degree"], 4: "none"}
    assert {(r.image_id, r.net) for r in zero.collect()} == {(1, 2), (2, 1), (3, 2)}
    comps = {(r.image_id, r.ref): r.nets for r in W.components(t).collect()}
    assert comps[(1, "R1")] == [1, 0] and comps[(2, "V1")] == [0, 2, 3] and comps[(3, "D1")] == [0, 3]


def test_same_partition(spark):
    rows = [(1, 5, 1), (1, 6, 2), (1, 5, 1), (2, 5, 1), (2, 5, 2), (3, 5, 1), (3, 6, 1)]
    d = spark.createDataFrame(rows, "k long, pred long, true long")
    assert {r.k: r.same for r in W.same_partition(d, ["k"]).collect()} == {1: True, 2: False, 3: False}


def grid(w, h, wrap):
    cell = lambda x, y: str(x % w + w * (y % h))
    return [f"R{k} {a} {b} 1k" for k, (a, b) in enumerate((cell(x, y), cell(x + dx, y + dy)) for x in range(w) for y in range(h) for dx, dy in ((1, 0), (0, 1))
            if wrap or (x + dx < w and y + dy < h))]


def test_symmetric_graphs(spark):
    """Stars, complete graphs, bundles of equal chains, tori and many equal parts: thousands of automorphisms."""
    star = [f"R{k} 0 {k} 1k" for k in range(1, 60)]
    full = [f"C{a}x{b} {a} {b} 1u" for a in range(9) for b in range(a)]
    bundle = [f"R{k}{x} {a} {b} 1k" for k in range(12) for x, (a, b) in enumerate((("0", f"{k}1"), (f"{k}1", f"{k}2"), (f"{k}2", "9")))]
    parts = [x for k in range(25) for x in ring([f"{k}00{j}" for j in range(4)])]
    graphs = {"star": star, "full": full, "bundle": bundle, "torus": grid(5, 5, True), "torus64": grid(6, 4, True), "torus83": grid(8, 3, True), "grid": grid(5, 5, False), "parts": parts,
              "parts8": [x for k in range(12) for x in ring([f"{k}00{j}" for j in range(8)])] + ring(["1", "2", "3", "4"]), "rest": bundle + ["L1 0 9 1m"], "turned": star[:-1] + ["R99 1 2 1k"]}
    texts = {f"{k}/{s}": "\n".join(shuffled(g, s)) for k, g in graphs.items() for s in range(3)}
    c = classes(spark, texts, False)
    assert all((c[a] == c[b]) == (a.split("/")[0] == b.split("/")[0]) for a in texts for b in texts)


def test_large_circuits_are_refined_by_spark(spark, monkeypatch):
    """With a small bound: the same partition by colours, fingerprints and canonical forms of what stays tied."""
    chain = [f"{'RCL'[k % 3]}{k} {k} {k + 1} {k}k" for k in range(12)]
    graphs = {"ring": ring([str(k) for k in range(12)]), "two": ring([str(k) for k in range(6)]) + ring([str(k) for k in range(6, 12)]), "chain": chain, "turned": chain[:-1] + ["V1 11 12 5"], "small": ["R1 0 1 1k"]}
    texts = {f"{k}/{s}": "\n".join(shuffled(g, s) if k != "turned" else g) for k, g in graphs.items() for s in range(2)}
    want = classes(spark, texts, False)
    monkeypatch.setattr(Q, "LARGE", 8)
    c = classes(spark, texts, False)
    assert all((c[a] == c[b]) == (want[a] == want[b]) == (a.split("/")[0] == b.split("/")[0]) for a in texts for b in texts)


def test_syntax_errors_shuffle_the_lines_once(spark):
    """Lines that are not a written table are not made a second time for the frame of their circuit."""
    rows = {1: ["* a", "R1 1 0 1k", ".end"], 2: ["R1 1 0 1k", ".end"], 3: ["* a", "R1 1 0 1k"], 4: ["* a", ".end", "C1 1 0 1u"], 5: ["* a", "R1 1 x 1k", "L1 1 0", ".end"], 6: ["", " "]}
    lines = line_rows(spark, {str(k): "\n".join(v) for k, v in rows.items()})
    d = N.syntax_errors(lines, lines.select("circuit_id").distinct())
    assert {int(r.circuit_id): r.message for r in d.collect()} == {
        2: "syntax error at line 1 near 'R1'", 3: "syntax error at line end near '<eof>'", 4: "syntax error at line 3 near 'C1'", 5: "syntax error at line 2 near 'x'", 6: "syntax error at line end near '<eof>'"}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_tables_of_lines_are_dealt_over_all_tasks(spark):
    from wirelake.plans.fixtures import view
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert view(spark, "/root/testdata/sf0.001", "fx_obj").rdd.getNumPartitions() == n


def test_terminals_write_hits_and_detections_once(spark, monkeypatch):
    from wirelake.plans import circuits
    made = []
    monkeypatch.setattr(circuits, "cut", lambda d: made.append(d.columns) or d)
    circuits.term_table(spark, "/root/testdata/sf0.001")
    assert len(made) == 2


def test_symbols_are_detections_with_their_hits(spark):
    from wirelake.plans.fixtures import view
    sf = "/root/testdata/sf0.001"
    sym, det, hit = (view(spark, sf, n) for n in ("fx_sym", "fx_det", "fx_hit"))
    cols = ["image_id", "det_idx", "cls", "rotation", "x1", "y1", "x2", "y2"]
    same = lambda a, b: a.count() == b.count() > 1000 and a.dtypes == b.dtypes and a.exceptAll(b).isEmpty()
    assert same(sym.select(cols), det.select(cols))
    assert same(sym.select("image_id", "det_idx", F.explode("hits").alias("h")).select("image_id", "det_idx", "h.side", "h.frag").distinct(), hit.distinct())


def random_symbols(spark):
    """Images of 1 to 12 symbols, symbols of 0 to 5 hits; some without class, hits, fragment or image, crossovers in chains."""
    rnd, rows = random.Random(5), []
    classes = ["resistor", "capacitor", "voltage_source", "voltage_source", "diode", "gnd", "crossover", "crossover", "text", "junction", "other", None]
    for image in [*range(120), None]:
        kinds = rnd.sample(classes, rnd.choice((2, 5, len(classes))))
        for k in range(1, rnd.randint(1, 12) + 1):
            hits = [(rnd.choice(W.SIDES), rnd.choice((None, *range(1, 2 + image % 13 if image else 9)))) for _ in range(rnd.randint(0, 5))]
            w, h = rnd.choice(((10.0, 5.0), (5.0, 10.0), (5.0, 5.0), (None, 5.0)))
            rows.append((image, k, rnd.choice(kinds), rnd.choice((None, 0, 90, 180, 270)), 0.0, 0.0, w, h, hits if hits or k % 2 else None))
    return spark.createDataFrame(rows, "image_id long, det_idx long, cls string, rotation int, x1 double, y1 double, x2 double, y2 double, hits array<struct<side: string, frag: bigint>>")


def test_images_as_arrays_equal_joins(spark, monkeypatch):
    d = random_symbols(spark).repartition("image_id").cache()
    by_rows = lambda f: sorted(map(repr, f(d).collect()))
    grounds = lambda s: W.symbol_grounds(s).withColumn("zero", F.array_sort("zero"))
    found = {}
    for limit in (64, 0, 5):
        monkeypatch.setattr(W, "FEW_SYMBOLS", limit)
        found[limit] = by_rows(W.symbol_components), by_rows(grounds)
    assert found[64] == found[0] == found[5]
    assert len(found[64][0]) > 150 and all(sum(rule in r for r in found[64][1]) > 3 for rule in W.RULES.values())
    hits = d.filter("image_id IS NOT NULL").select("image_id", "det_idx", F.explode("hits").alias("h")).select("image_id", "det_idx", "h.side", "h.frag").filter("frag IS NOT NULL")
    det = d.filter("image_id IS NOT NULL AND cls IS NOT NULL").drop("hits")
    terms = W.image_terminals(d.filter("image_id IS NOT NULL")).select("image_id", F.inline("terms"))
    want = W.terminals(hits, det, W.net_table(hits, det)).select(terms.columns)
    assert sorted(map(repr, terms.collect())) == sorted(map(repr, want.collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_two_terminal_share_shuffles_the_lines_once(spark):
    from wirelake.plans import circuits
    d = circuits.a34(spark, "/root/testdata/sf0.001")
    assert shuffles(d) == 1 and "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()


def test_ground_rules_shuffle_the_lines_once(spark):
    from wirelake.plans import circuits
    d = circuits.win2(spark, "/root/testdata/sf0.001")
    assert shuffles(d) == 1 and d.dtypes == [("image_id", "bigint"), ("rule", "string"), ("zero_nets", "string")]


def test_reference_numbers_shuffle_the_lines_once(spark):
    from wirelake.plans import circuits
    d = circuits.win1(spark, "/root/testdata/sf0.001")
    assert shuffles(d) == 1 and d.columns == ["image_id", "det_idx", "ref", "cls", "nets", "rule"]


def test_circuits_that_are_the_same_as_they_stand_are_settled_once(spark, monkeypatch):
    sent, forms = [], Q._forms

    def counted(edges, *args, **kw):
        sent.append(edges.select("circuit_id").distinct().count())
        return forms(edges, *args, **kw)
    monkeypatch.setattr(Q, "_forms", counted)
    one = [("R", "1", "2", 1.0), ("C", "2", "0", 2.0), ("D", "0", "1", None)]
    turned = [("C", "0", "2", 2.0), ("D", "0", "1", None), ("R", "2", "1", 1.0)]
    renamed = [("R", "a", "b", 1.0), ("C", "b", "c", 2.0), ("D", "c", "a", None)]
    other = [("R", "1", "2", 1.0), ("C", "2", "0", 2.0), ("D", "1", "0", None)]
    missing = [("R", None, "2", 1.0)], [("R", "2", "2", 1.0)]
    circuits = [one] * 20 + [turned] * 20 + [renamed] * 20 + [other] * 20 + [*missing]
    rows = [(i, p, a, b, x, None) for i, c in enumerate(circuits) for p, a, b, x in c]
    el = spark.createDataFrame(rows, "circuit_id bigint, prefix string, n1 string, n2 string, num double, txt string")
    ids = {r["circuit_id"]: (r["topology"], r["exact"]) for r in Q.class_ids(el, el.select("circuit_id").distinct(), ["topology", "exact"]).collect()}
    assert len(ids) == 82 and len({ids[k] for k in range(60)}) == 1 and len({ids[k] for k in range(60, 80)}) == 1 and len(set(ids.values())) == 4
    assert sent == [5]


def test_records_match_by_labels_and_voltages(spark):
    volts = spark.createDataFrame([(1, "R", [1.0, 2.0]), (1, "C", [3.0]), (2, "C", [3.0001]), (2, "R", [1.0, 2.0]), (3, "R", [1.0, 2.0]), (4, "C", [3.0]), (4, "R", [1.0])],
                                  "circuit_id bigint, label string, volts array<double>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 9), (9, 9), (2, 1)], "circuit_id bigint, ref_id bigint")
    got = {(r[0], r[1]): r[2] for r in N.voltages_match(pairs, volts).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): False, (1, 4): False, (1, 9): False, (9, 9): False, (2, 1): True}

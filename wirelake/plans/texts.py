"""Sentences: tokens, tags, entities, structures, netlists, scores."""
from pyspark.sql import functions as F

from ..functions import wording as T
from ..operators import sentences as P, tagging as G
from ..session import cut, scratch_path, spread
from ..vocabulary import TAGS
from .fixtures import table, view
from .registry import query

C = F.col

# The template of the sentence view written out: tokens with gold tags, and the expected circuit.
TOK = """tok AS (SELECT id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT id, string_split(replace(text, ',', ' ,'), ' ') AS w FROM fx_sent)),
gold AS (SELECT *, CASE WHEN regexp_matches(word, '^[0-9]') THEN 'VAL' WHEN word = 'battery' THEN 'SRC' WHEN word IN ('resistor','resistors') THEN 'RES' WHEN word = 'cap' THEN 'CAP' WHEN word = 'series' THEN 'SER'
 WHEN word = 'parallel' THEN 'PAR' WHEN word IN (',','and') THEN 'SEP' ELSE 'O' END AS gold FROM tok),
pred AS (SELECT *, CASE WHEN (id * 7 + pos) % 13 = 0 THEN 'O' WHEN (id + pos) % 29 = 0 THEN 'UNIT' ELSE gold END AS pred FROM gold)"""
CIRC = """circ AS (SELECT id, concat('DC ', volts) AS source, r, c, two, conn, CASE WHEN conn = 1 AND two THEN concat('S(', r, ',P(', c, ',', r, '))') WHEN conn = 1 THEN concat('P(', c, ',', r, ')')
 WHEN two THEN concat('S(', r, ',', r, ',', c, ')') ELSE concat('S(', r, ',', c, ')') END AS tree FROM (SELECT id, volts, concat('resistor:', kohm, 'k') AS r, concat('capacitor:', uf, 'u') AS c, art = 0 AS two, conn FROM fx_gold))"""


def gold_tag(w):
    return (F.when(w.rlike("^[0-9]"), "VAL").when(w == "battery", "SRC").when(w.isin("resistor", "resistors"), "RES").when(w == "cap", "CAP")
            .when(w == "series", "SER").when(w == "parallel", "PAR").when(w.isin(",", "and"), "SEP").otherwise("O"))


def with_gold(sentences):
    return sentences.withColumn("words", T.tokens(C("text"))).withColumn("tags", F.transform("words", gold_tag))


def gold(spark, sf):
    return with_gold(spread(view(spark, sf, "fx_sent"), "id"))


def perturbed(spark, sf):
    """Gold tags and tags with regular mistakes, to score."""
    d = gold(spark, sf).withColumnRenamed("tags", "gold")
    wrong = lambda g, i: F.when((C("id") * 7 + i) % 13 == 0, "O").when((C("id") + i) % 29 == 0, "UNIT").otherwise(g)
    return d.withColumn("pred", F.transform("gold", wrong))


def chunks(spark, sf):
    return P.per_text(view(spark, sf, "fx_sent"), lambda d: P.chunked(with_gold(d)))


def trees(spark, sf):
    return P.per_text(view(spark, sf, "fx_sent"), lambda d: P.structured(P.chunked(with_gold(d))))


@query("str1_tokens", f"WITH {TOK} SELECT id, pos, word FROM tok")
def str1(spark, sf):
    return view(spark, sf, "fx_sent").select("id", F.posexplode(T.tokens(C("text"))).alias("pos", "word"))


@query("str1_document_tokens")
def str1b(spark, sf):
    """Free text in several languages, whole documents."""
    d = table(spark, sf, "documents").select("lang", F.explode(T.tokens(C("text"))).alias("t"))
    return d.groupBy("lang", T.word_shape(C("t")).alias("shape")).agg(F.count("*").alias("tokens"))


@query("str2_word_shape", f"WITH {TOK} SELECT id, pos, CASE WHEN regexp_matches(word, '^(\\d+(\\.\\d+)?[a-zA-Z]*|\\d+[pnumkKMGR]\\d+)$') THEN '<NUM>' ELSE '<UNK>' END AS shape FROM tok")
def str2(spark, sf):
    d = view(spark, sf, "fx_sent").select("id", F.posexplode(T.tokens(C("text"))).alias("pos", "word"))
    return d.select("id", "pos", T.word_shape(C("word")).alias("shape"))


@query("str16_value_spans", f"WITH {TOK} SELECT id, pos, pos + 1 AS end_pos, word AS text FROM gold WHERE gold = 'VAL'")
def str16(spark, sf):
    d = gold(spark, sf).select("id", F.explode(P.value_spans()).alias("v"))
    return d.select("id", C("v.s").alias("pos"), C("v.e").alias("end_pos"), "v.text")


@query("j15_noun_values", f"WITH {TOK} SELECT g.id, g.pos, g.gold AS tag, max(v.pos) AS value_pos, arg_max(v.word, v.pos) AS value FROM gold g JOIN gold v ON v.id = g.id AND v.gold = 'VAL' AND v.pos < g.pos WHERE g.gold IN ('SRC','RES','CAP') GROUP BY 1, 2, 3")
def j15(spark, sf):
    d = chunks(spark, sf).select("id", F.explode("picks").alias("p"))
    return d.select("id", C("p.n").alias("pos"), "p.tag", C("p.pick.s").alias("value_pos"), C("p.pick.text").alias("value"))


@query("str17_counted_copies", f"SELECT id, CASE WHEN art = 0 THEN 2 ELSE 1 END AS copies FROM fx_gold")
def str17(spark, sf):
    d = chunks(spark, sf).select("id", F.explode("items").alias("x")).filter("x.kind = 'ENT' AND x.cls = 'resistor'")
    return d.groupBy("id").agg(F.count("*").cast("int").alias("copies"))


@query("seq3_entities", f"WITH {TOK}, {CIRC}, base AS (SELECT c.*, (SELECT min(pos) FROM gold g WHERE g.id = c.id AND gold = 'SRC') AS sp, (SELECT min(pos) FROM gold g WHERE g.id = c.id AND gold = 'RES') AS rp, (SELECT min(pos) FROM gold g WHERE g.id = c.id AND gold = 'CAP') AS cp FROM circ c)"
       " SELECT id, CAST(sp AS DOUBLE) AS pos, 'voltage_source' AS cls, source AS value FROM base UNION ALL SELECT id, rp, 'resistor', replace(r, 'resistor:', '') FROM base UNION ALL SELECT id, rp + 0.1, 'resistor', replace(r, 'resistor:', '') FROM base WHERE two"
       " UNION ALL SELECT id, cp, 'capacitor', replace(c, 'capacitor:', '') FROM base")
def seq3(spark, sf):
    return P.entities(chunks(spark, sf))


@query("seq4_clause_structure", f"WITH {CIRC} SELECT id, tree FROM circ WHERE conn < 3")
def seq4(spark, sf):
    """Sentences of a single clause."""
    d = P.staged(trees(spark, sf), "clauses", P.clauses())
    return d.filter(F.size("clauses") == 1).select("id", C("tree_text").alias("tree"))


@query("seq5_clause_fold", f"WITH {CIRC} SELECT id, source, tree FROM circ")
def seq5(spark, sf):
    return trees(spark, sf).select("id", C("source.value").alias("source"), C("tree_text").alias("tree"))


NETLIST = """net AS (SELECT id, unnest(CASE WHEN conn = 1 AND two THEN [concat('R1 1 2 ', rv), concat('R2 2 0 ', rv), concat('C1 2 0 ', cv)] WHEN conn = 1 THEN [concat('R1 1 0 ', rv), concat('C1 1 0 ', cv)]
 WHEN two THEN [concat('R1 1 2 ', rv), concat('R2 2 3 ', rv), concat('C1 3 0 ', cv)] ELSE [concat('R1 1 2 ', rv), concat('C1 2 0 ', cv)] END) AS line FROM (SELECT *, replace(r, 'resistor:', '') AS rv, replace(c, 'capacitor:', '') AS cv FROM circ)
 UNION ALL SELECT id, unnest([concat('V1 1 0 ', source), '.op', '.end']) FROM circ UNION ALL SELECT id, concat('* ', left(text, 60)) FROM fx_sent)"""


@query("seq6_netlist_rows", f"WITH {CIRC}, {NETLIST} SELECT id, line FROM net")
def seq6(spark, sf):
    d = P.netlist(trees(spark, sf), F.substring("text", 1, 60))
    return d.select("id", F.explode(F.split(F.regexp_replace("netlist", "\n$", ""), "\n")).alias("line"))


@query("str18_assumptions", f"SELECT id, 'No voltage source was described; a default DC 5 V source was placed across the circuit.' AS note FROM fx_sent UNION ALL SELECT id, concat('1 capacitor had no value; the default 1u was used.') FROM fx_sent"
       " UNION ALL SELECT id, concat(CASE WHEN art = 0 THEN '1 resistor' ELSE '1 resistor' END, ' had no value; the default 1k was used.') FROM fx_gold UNION ALL SELECT id, '''resistors'' is plural but no number of parts was given; only one was built.' FROM fx_gold WHERE art = 0")
def str18(spark, sf):
    """The same sentences with all numbers, count words and the source taken out."""
    d = view(spark, sf, "fx_sent").withColumn("text", F.regexp_replace("text", r"\d+(V battery driving|k|uF) ?|\btwo ", ""))
    return P.per_text(d, lambda d: P.structured(P.chunked(with_gold(d)))).select("id", F.explode(P.notes()).alias("note"))


def trained(spark, sf):
    return G.fit(gold(spark, sf))


MODEL_SQL = f"""{TOK}, n AS (SELECT lower(word) AS w, gold AS tag, count(*) AS n, any_value(CASE WHEN regexp_matches(word, '^\\d+(\\.\\d+)?[a-zA-Z]*$') THEN '<NUM>' ELSE '<UNK>' END) AS shape FROM gold GROUP BY 1, 2),
vocab AS (SELECT w FROM n GROUP BY w HAVING sum(n) > 1 UNION SELECT '<NUM>' UNION SELECT '<UNK>'), tags AS (SELECT unnest([{', '.join(f"'{t}'" for t in TAGS)}]) AS tag),
cells AS (SELECT tag, CASE WHEN v.w IS NULL THEN shape ELSE n.w END AS word, sum(n) AS n FROM n LEFT JOIN vocab v ON v.w = n.w GROUP BY 1, 2),
emit AS (SELECT t.tag, v.w AS word, ln((coalesce(c.n, 0) + 0.1) / (coalesce(s.total, 0) + 0.1 * (SELECT count(*) FROM vocab))) AS lp FROM tags t CROSS JOIN vocab v LEFT JOIN cells c ON c.tag = t.tag AND c.word = v.w LEFT JOIN (SELECT tag, sum(n) AS total FROM cells GROUP BY 1) s ON s.tag = t.tag),
bi AS (SELECT prev, gold AS tag, count(*) AS n FROM (SELECT *, lag(gold) OVER (PARTITION BY id ORDER BY pos) AS prev FROM gold) WHERE prev IS NOT NULL GROUP BY 1, 2),
step AS (SELECT a.tag AS prev, b.tag, ln((coalesce(n, 0) + 0.1) / (coalesce(total, 0) + 1.1)) AS lp FROM tags a CROSS JOIN tags b LEFT JOIN bi ON bi.prev = a.tag AND bi.tag = b.tag LEFT JOIN (SELECT prev, sum(n) AS total FROM bi GROUP BY 1) s ON s.prev = a.tag),
start AS (SELECT tag, ln((count(g.id) + 0.1) / ((SELECT count(*) FROM fx_sent) + 1.1)) AS lp FROM tags LEFT JOIN (SELECT * FROM gold WHERE pos = 0) g ON g.gold = tag GROUP BY tag)"""


MODEL_TABLES = f"WITH {MODEL_SQL} SELECT 'start' AS part, '' AS prev, tag, '' AS word, round(lp, 6) AS lp FROM start UNION ALL SELECT 'step', prev, tag, '', round(lp, 6) FROM step UNION ALL SELECT 'emit', '', tag, word, round(lp, 6) FROM emit"


@query("a33_sequence_model", MODEL_TABLES)
def a33(spark, sf):
    return model_tables(trained(spark, sf))


def model_tables(m):
    e = F.lit("")
    cols = lambda part, prev, word: [F.lit(part).alias("part"), prev.alias("prev"), C("tag"), word.alias("word"), F.round("lp", 6).alias("lp")]
    return m.start.select(*cols("start", e, e)).unionByName(m.step.select(*cols("step", C("prev"), e))).unionByName(m.emit.select(*cols("emit", e, C("word"))))


@query("src17_model_round_trip", MODEL_TABLES)
def src17(spark, sf):
    """Trained and stored at the first call, as there is no model yet; the second one finds it. All three tables are read back."""
    path = scratch_path(spark, "model")
    G.Model.stored(path, lambda: trained(spark, sf))

    def again():
        raise RuntimeError("there is a model already")
    return model_tables(G.Model.stored(path, again))


@query("win6_tag_bigrams", f"WITH {MODEL_SQL} SELECT prev, tag, n FROM bi")
def win6(spark, sf):
    return G.bigrams(gold(spark, sf))


@query("set3_vocabulary", f"WITH {MODEL_SQL} SELECT w AS word FROM vocab")
def set3(spark, sf):
    return G.vocabulary(G.word_counts(gold(spark, sf)))


@query("seq2_word_lookup", f"WITH {MODEL_SQL} SELECT g.id, g.pos, coalesce(v.w, CASE WHEN regexp_matches(word, '^\\d+(\\.\\d+)?[a-zA-Z]*$') THEN '<NUM>' ELSE '<UNK>' END) AS key FROM gold g LEFT JOIN vocab v ON v.w = lower(word)")
def seq2(spark, sf):
    d = gold(spark, sf)
    vocab = G.vocabulary(G.word_counts(d)).withColumn("known", F.lit(True))
    tok = d.select("id", F.posexplode("words").alias("pos", "w")).withColumn("word", F.lower("w")).join(vocab, "word", "left")
    return tok.select("id", "pos", F.when(C("known"), C("word")).otherwise(T.word_shape(C("w"))).alias("key"))


@query("seq1_best_tags", f"WITH {TOK} SELECT id, string_agg(gold, ' ' ORDER BY pos) AS tags FROM gold GROUP BY id")
def seq1(spark, sf):
    """The corpus is unambiguous, so decoding must give the gold tags back."""
    d = G.tag(view(spark, sf, "fx_sent").withColumn("words", T.tokens(C("text"))), trained(spark, sf))
    return d.select("id", F.array_join("tags", " ").alias("tags"))


@query("seq1_conversation_tags")
def seq1b(spark, sf):
    """Free text: tag counts over whole conversation turns."""
    d = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), T.tokens(C("text")).alias("words"))
    t = G.tag(d, trained(spark, sf)).select(F.explode("tags").alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n"))


@query("j16_gold_prediction_pairs", f"WITH {TOK} SELECT id, pos, gold, pred FROM pred")
def j16(spark, sf):
    return G.token_pairs(perturbed(spark, sf))


SCORE_SQL = f"""{TOK}, cnt AS (SELECT t AS tag, count(*) FILTER (gold = t AND pred = t) AS tp, count(*) FILTER (gold <> t AND pred = t) AS fp, count(*) FILTER (gold = t AND pred <> t) AS fn FROM pred, (SELECT unnest([{', '.join(f"'{t}'" for t in TAGS)}]) AS t) GROUP BY 1),
per AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cnt WHERE tp + fp + fn > 0))"""


@query("a24_tag_scores", f"WITH {SCORE_SQL} SELECT tag, tp, fp, fn, CAST(round(p, 6) AS DOUBLE) AS precision, CAST(round(r, 6) AS DOUBLE) AS recall, CAST(round(f1, 6) AS DOUBLE) AS f1 FROM per")
def a24(spark, sf):
    d = G.tag_scores(G.token_pairs(perturbed(spark, sf)))
    return d.select("tag", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a25_summary_rates", f"WITH {SCORE_SQL} SELECT (SELECT round(avg(CAST(gold = pred AS INTEGER)), 6) FROM pred) AS token_accuracy, (SELECT round(avg(f1), 6) FROM per) AS macro_f1, (SELECT round(avg(CAST(ok AS INTEGER)), 6) FROM (SELECT id, bool_and(gold = pred) AS ok FROM pred GROUP BY 1)) AS exact_rate, (SELECT round(avg(CAST(id % 5 <> 0 AND id % 7 <> 0 AS INTEGER)), 6) FROM fx_sent) AS circuit_exact_match, (SELECT round(avg(CAST(id % 9 <> 0 AND id % 10 <> 0 AS INTEGER)), 6) FROM fx_sent) AS netlist_valid")
def a25(spark, sf):
    d = cut(perturbed(spark, sf))
    scores = G.tag_scores(G.token_pairs(d)).agg(F.avg("f1").alias("m"), (F.sum(F.when(C("tag").isNotNull(), C("tp"))) / F.sum(C("tp") + C("fn"))).alias("a"))
    exact = d.agg(F.avg((C("gold") == C("pred")).cast("int")).alias("e"))
    g = cut(gold_trees(spark, sf))
    p = wrong_trees(g).select("id", C("tree").alias("pt"), C("source").alias("ps"))
    same = (C("tree") == C("pt")) & C("source").eqNullSafe(C("ps"))
    circuits = g.join(p, "id").agg(F.avg(same.cast("int")).alias("c"))
    valid = odd_sentences(spark, sf).agg(F.avg((C("netlist").isNotNull() & (F.size("errors") == 0)).cast("int")).alias("v"))
    one = lambda x: x.withColumn("k", F.lit(1))
    d = one(scores).join(one(exact), "k").join(one(circuits), "k").join(one(valid), "k")
    return d.select(*[F.round(a, 6).alias(b) for a, b in (("a", "token_accuracy"), ("m", "macro_f1"), ("e", "exact_rate"), ("c", "circuit_exact_match"), ("v", "netlist_valid"))])


LEAVES = f"""{CIRC}, g AS (SELECT id, 'voltage_source' AS cls, source AS value FROM circ UNION ALL SELECT id, 'resistor', replace(r, 'resistor:', '') FROM circ UNION ALL SELECT id, 'resistor', replace(r, 'resistor:', '') FROM circ WHERE two UNION ALL SELECT id, 'capacitor', replace(c, 'capacitor:', '') FROM circ)"""
PLEAVES = LEAVES + """, p AS (SELECT id, cls, CASE WHEN id % 5 = 0 AND cls = 'resistor' THEN '99k' ELSE value END AS value FROM g WHERE NOT (id % 7 = 0 AND cls = 'voltage_source')),
cmp AS (SELECT id, sum(least(gn, pn)) AS tp, sum(greatest(pn - gn, 0)) AS fp, sum(greatest(gn - pn, 0)) AS fn FROM (SELECT id, cls, value, count(*) FILTER (s = 'g') AS gn, count(*) FILTER (s = 'p') AS pn FROM (SELECT 'g' AS s, * FROM g UNION ALL SELECT 'p', * FROM p) GROUP BY 2, 3, 4) GROUP BY 1)""".replace("GROUP BY 2, 3, 4", "GROUP BY id, cls, value")


def gold_trees(spark, sf):
    d = trees(spark, sf)
    return d.select("id", "text", "words", "tags", C("source.value").alias("source"), C("tree_text").alias("tree"))


def wrong_trees(d):
    return d.withColumn("tree", F.when(C("id") % 5 == 0, F.regexp_replace("tree", r"resistor:\d+k", "resistor:99k")).otherwise(C("tree"))) \
            .withColumn("source", F.when(C("id") % 7 != 0, C("source")))


@query("str14_tree_leaves", f"WITH {LEAVES} SELECT id, cls, value FROM g")
def str14(spark, sf):
    return P.tree_leaves(gold_trees(spark, sf))


def overlap(g):
    return G.component_counts(P.tree_leaves(g), P.tree_leaves(wrong_trees(g)), ["cls", "value"])


@query("a26_component_scores", f"WITH {PLEAVES} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / sum(tp + fp), 6) AS precision, round(sum(tp) / sum(tp + fn), 6) AS recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS f1 FROM cmp")
def a26(spark, sf):
    d = overlap(cut(gold_trees(spark, sf))).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return d.select("tp", "fp", "fn", F.round(F.try_divide(C("tp"), C("tp") + C("fp")), 6).alias("precision"), F.round(F.try_divide(C("tp"), C("tp") + C("fn")), 6).alias("recall"),
                    F.round(F.try_divide(2 * C("tp"), 2 * C("tp") + C("fp") + C("fn")), 6).alias("f1"))


@query("set1_multiset_operations", f"WITH {PLEAVES} SELECT 'both' AS side, id, cls, value FROM (SELECT * FROM g INTERSECT ALL SELECT * FROM p) UNION ALL SELECT 'gold_only', id, cls, value FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM p) UNION ALL SELECT 'pred_only', id, cls, value FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM g)")
def set1(spark, sf):
    t = cut(gold_trees(spark, sf))
    g, p = P.tree_leaves(t), P.tree_leaves(wrong_trees(t))
    side = lambda d, s: d.select(F.lit(s).alias("side"), "id", "cls", "value")
    return side(g.intersectAll(p), "both").unionByName(side(g.exceptAll(p), "gold_only")).unionByName(side(p.exceptAll(g), "pred_only"))


@query("a27_error_types", f"""WITH {PLEAVES} SELECT error_type, count(*) AS n FROM (SELECT CASE WHEN c.id % 11 = 0 THEN 'exception' WHEN c.id % 13 = 0 THEN 'tokenization' WHEN c.id % 3 = 1 AND c.id % 5 = 0 THEN 'tagging' WHEN c.id % 5 <> 0 THEN 'source' WHEN fp + fn > 0 THEN 'components/values' ELSE 'structure' END AS error_type
FROM circ c JOIN cmp ON cmp.id = c.id WHERE c.id % 5 = 0 OR c.id % 7 = 0) GROUP BY 1""")
def a27(spark, sf):
    g = cut(gold_trees(spark, sf))
    p = wrong_trees(g).select("id", C("tree").alias("pt"), C("source").alias("ps"))
    n = overlap(g)
    pred = F.when((C("id") % 3 == 1) & (C("id") % 5 == 0), F.transform("tags", lambda t: F.lit("O"))).otherwise(C("tags"))
    errors = P.tag_mismatches(C("words"), C("tags"), pred)
    d = g.join(p, "id").join(n, "id").filter(~((C("tree") == C("pt")) & C("source").eqNullSafe(C("ps"))))
    # some runs ended with an error, some texts were cut into other tokens
    error = F.when(C("id") % 11 == 0, F.lit("ValueError: no value"))
    tokens = T.tokens(F.when(C("id") % 13 == 0, F.concat("text", F.lit(" x"))).otherwise(C("text")))
    kind = G.error_type(error, tokens == P.kept_tokens(C("words")), errors, C("tree") == C("pt"), (C("fp") + C("fn")) == 0)
    return d.groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))


@query("str20_tag_mismatches", f"WITH {TOK} SELECT id, string_agg(concat(word, ':', gold, '->', pred), ' ' ORDER BY pos) AS mismatches FROM pred WHERE gold <> pred GROUP BY id")
def str20(spark, sf):
    d = perturbed(spark, sf).withColumn("m", P.tag_mismatches(C("words"), C("gold"), C("pred"))).filter(F.size("m") > 0)
    return d.select("id", F.array_join("m", " ").alias("mismatches"))


def described(spark, sf):
    return P.described(view(spark, sf, "fx_sent"), trained(spark, sf))


ERR = """err AS (SELECT c.id, CAST(NULL AS VARCHAR) AS errors FROM circ c)"""


@query("seq9_sentence_to_netlist", f"WITH {TOK}, {CIRC}, {NETLIST} SELECT c.id, c.tree, c.source, CAST(0 AS INTEGER) AS n_errors, CAST(0 AS INTEGER) AS n_notes, CAST((SELECT count(*) FROM net n WHERE n.id = c.id) AS INTEGER) AS n_lines, CAST((SELECT count(*) FROM tok t WHERE t.id = c.id) AS INTEGER) AS n_tokens, (SELECT md5(string_agg(line, chr(10) ORDER BY line)) FROM net n WHERE n.id = c.id) AS netlist_lines FROM circ c")
def seq9(spark, sf):
    d = described(spark, sf)
    return d.select("id", C("tree_text").alias("tree"), C("source.value").alias("source"), F.size("errors").alias("n_errors"), F.size("notes").alias("n_notes"),
                    (F.size(F.split("netlist", "\n")) - 1).alias("n_lines"), F.size("tags").alias("n_tokens"),
                    F.md5(F.array_join(F.array_sort(F.split(F.regexp_replace("netlist", "\n$", ""), "\n")), "\n")).alias("netlist_lines"))


@query("str22_sentence_report", "SELECT id, CASE WHEN id % 9 = 0 THEN 'Type a circuit description.' WHEN id % 10 = 0 THEN 'No circuit components were found in that description. Name at least one part.' ELSE 'Validation: OK' END AS report FROM fx_sent")
def str22(spark, sf):
    return P.report(odd_sentences(spark, sf))


def odd_sentences(spark, sf):
    """Sentences as they may be typed: some are blank, some name no part."""
    s = view(spark, sf, "fx_sent")
    odd = s.withColumn("text", F.when(C("id") % 9 == 0, " ").when(C("id") % 10 == 0, "a and a").otherwise(C("text")))
    return P.described(odd, trained(spark, sf))

"""Netlist text as rows: tokens, elements, line shapes, semantic checks.

Input: lines(circuit_id, line_no, line)."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values as V
from ..session import cut
from ..vocabulary import ELEMENT_PREFIX

C = F.col
U = "(?U)"
NAME = {p: rf"(?iU)^{p}\w+$" for p in "rclvd"}
NODE = U + r"^\d+$"
VALUE = r"(?iU)^\d+(\.\d+)?(meg|[fpnumkg])?\w*$"
IDENT = r"(?iU)^[a-z_]\w*$"
ELEMENT = r"(?i)^[rclvd]"


def _stripped() -> Column:
    return F.regexp_replace("line", U + r"^\s+|\s+$", "")


def with_tokens(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their tokens; a comment is one token."""
    t = _stripped()
    d = lines.withColumn("t", t).filter(F.length("t") > 0)
    return d.withColumn("toks", F.when(C("t").startswith("*"), F.array("t")).otherwise(F.split("t", U + r"\s+"))).drop("t")


def tokens(lines: DataFrame, end: str = "\n") -> DataFrame:
    d = with_tokens(lines).withColumn("toks", F.concat("toks", F.array(F.lit(end))))
    return d.select("circuit_id", "line_no", F.posexplode("toks").alias("pos", "token"))


def elements(lines: DataFrame) -> DataFrame:
    """Element lines: reference, prefix, two nodes, the rest, and the value as number or text."""
    p = F.split(_stripped(), U + r"\s+")
    at = lambda k: F.get("p", F.lit(k))
    d = lines.withColumn("p", p).filter(at(0).rlike(ELEMENT) & (F.size("p") >= 3))
    rest = F.slice("p", F.lit(4), F.size("p"))
    d = d.select("circuit_id", "line_no", F.upper(at(0)).alias("ref"), F.upper(F.substring(at(0), 1, 1)).alias("prefix"),
                 at(1).alias("n1"), at(2).alias("n2"), F.when(F.size(rest) > 0, F.array_join(rest, " ")).alias("rest"))
    v = V.netlist_number(C("rest"))
    return d.withColumns({"num": v["num"], "txt": v["txt"]})


def _first_bad(toks: Column) -> Column:
    """Index of the first token no statement shape can accept, -1 when the line is complete.
    Index = number of tokens means that the line ends too early."""
    t = lambda k: F.coalesce(F.get(toks, F.lit(k)), F.lit(""))
    n = F.size(toks)

    def shape(*tests):
        bad = F.when(n > len(tests), len(tests)).when(n < len(tests), n).otherwise(-1)
        for k in reversed(range(len(tests))):
            bad = F.when((n > k) & ~tests[k], k).otherwise(bad)
        return bad
    node1, node2 = t(1).rlike(NODE), t(2).rlike(NODE)
    yes = F.lit(True)
    rcl = t(0).rlike(NAME["r"]) | t(0).rlike(NAME["c"]) | t(0).rlike(NAME["l"])
    dc = F.lower(t(3)) == "dc"
    return (F.when(t(0).startswith("*"), shape(yes))
            .when(rcl, shape(yes, node1, node2, t(3).rlike(VALUE)))
            .when(t(0).rlike(NAME["v"]) & dc, shape(yes, node1, node2, yes, t(4).rlike(VALUE)))
            .when(t(0).rlike(NAME["v"]), shape(yes, node1, node2, t(3).rlike(VALUE)))
            .when(t(0).rlike(NAME["d"]), shape(yes, node1, node2, t(3).rlike(IDENT)))
            .when(F.lower(t(0)) == ".model", shape(yes, t(1).rlike(IDENT), t(2).rlike(IDENT)))
            .when(F.lower(t(0)).isin(".op", ".end"), shape(yes)).otherwise(0))


def _quoted(token: Column) -> Column:
    t = F.replace(token, F.lit("\\"), F.lit("\\\\"))
    q = F.when(F.instr(t, "'") > 0, '"').otherwise("'")
    return F.concat(q, t, q)


def syntax_errors(lines: DataFrame, circuits: DataFrame) -> DataFrame:
    """At most one message per circuit: line 1 is a comment, `.end` closes the text, every line between
    has a statement shape. The grammar is regular over lines, so no chart is needed."""
    d = with_tokens(lines).withColumns({"bad": _first_bad(C("toks")), "head": F.get("toks", F.lit(0))})
    is_end = (F.lower("head") == ".end") & (C("bad") == -1)
    circuit = Window.partitionBy("circuit_id")
    d = d.withColumns({"first_no": F.min("line_no").over(circuit), "end_no": F.min(F.when(is_end, C("line_no"))).over(circuit)})
    title, after = C("line_no") == C("first_no"), C("line_no") > C("end_no")
    at = (F.when(title & ~C("head").startswith("*"), 0).when(title, -1).when(after, 0).otherwise(C("bad")))
    d = d.withColumn("at", at).withColumn("tok", F.when(C("at") >= 0, F.coalesce(_quoted(F.get("toks", C("at"))), F.lit("'\\n'"))))
    first = d.groupBy("circuit_id").agg(F.min("end_no").alias("end_no"), F.min_by(F.struct("line_no", "tok"), F.when(C("at") >= 0, C("line_no"))).alias("e"))
    out = circuits.join(first, "circuit_id", "left")
    msg = (F.when(C("e").isNotNull(), F.concat(F.lit("syntax error at line "), C("e.line_no").cast("string"), F.lit(" near "), "e.tok"))
           .when(C("end_no").isNull(), "syntax error at line end near '<eof>'"))
    return out.select("circuit_id", msg.alias("message")).filter("message IS NOT NULL")


def semantic_errors(lines: DataFrame, circuits: DataFrame) -> DataFrame:
    """Rows (circuit_id, kind, ord, message) in report order: duplicates, ground, floating, shorted, models."""
    el = cut(elements(lines))
    row = lambda d, kind, ord_, msg: d.select("circuit_id", F.lit(kind).alias("kind"), ord_.cast("long").alias("ord"), msg.alias("message"))
    dup = el.groupBy("circuit_id", "ref").agg(F.count("*").alias("n"), F.min("line_no").alias("o")).filter("n > 1")
    ends = el.select("circuit_id", F.explode(F.array(F.struct((C("line_no") * 2).alias("o"), C("n1").alias("node")),
                                                     F.struct((C("line_no") * 2 + 1).alias("o"), C("n2").alias("node")))).alias("e"))
    deg = ends.groupBy("circuit_id", C("e.node").alias("node")).agg(F.count("*").alias("n"), F.min("e.o").alias("o"))
    deg = cut(deg)
    grounded = deg.filter("node = '0'").select("circuit_id")
    models = lines.filter(F.lower("line").startswith(".model")).select(
        "circuit_id", F.upper(F.get(F.split(F.trim("line"), U + r"\s+"), F.lit(1))).alias("model")).filter("model IS NOT NULL").distinct()
    word = F.get(F.split("rest", " "), F.lit(0))
    undef = el.filter((C("prefix") == "D") & C("rest").isNotNull()).withColumn("word", word).withColumn("model", F.upper("word")) \
              .join(models, ["circuit_id", "model"], "left_anti")
    parts = [
        row(dup, 1, C("o"), F.concat(F.lit("duplicate reference "), "ref")),
        row(circuits.join(grounded, "circuit_id", "left_anti"), 2, F.lit(0), F.lit("no ground node (0)")),
        row(deg.filter("n < 2"), 3, C("o"), F.concat(F.lit("node "), "node", F.lit(" is floating (1 connection)"))),
        row(el.filter("n1 = n2"), 4, C("line_no"), F.concat("ref", F.lit(" is shorted (both terminals on node "), "n1", F.lit(")"))),
        row(undef, 5, C("line_no"), F.concat("ref", F.lit(" uses undefined model "), "word"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def errors(lines: DataFrame) -> DataFrame:
    """All messages; a syntax error hides the semantic ones."""
    return _errors(cut(lines))


def _errors(lines: DataFrame) -> DataFrame:
    """errors() of lines that are a written table."""
    circuits = lines.select("circuit_id").distinct()
    syn = cut(syntax_errors(lines, circuits))
    sem = semantic_errors(lines, circuits).join(syn.select("circuit_id"), "circuit_id", "left_anti")
    return syn.select("circuit_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), "message").unionByName(sem)


def validation(lines: DataFrame) -> DataFrame:
    """(circuit_id, valid, first_error, n_errors) for every circuit."""
    lines = cut(lines)
    e = _errors(lines).groupBy("circuit_id").agg(F.min_by("message", F.struct("kind", "ord")).alias("first_error"), F.count("*").alias("n_errors"))
    d = lines.select("circuit_id").distinct().join(e, "circuit_id", "left")
    return d.select("circuit_id", C("n_errors").isNull().alias("valid"), "first_error", F.coalesce("n_errors", F.lit(0)).alias("n_errors"))


REDUCED_ALLOWED = r"^(node \S+ is floating \(1 connection\)|no ground node \(0\))$"


def reference_rules(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Rules for reference texts: name pattern, title line, and no errors beyond those an omitted part explains."""
    lines = cut(lines)
    meta = lines.groupBy("circuit_id").agg(F.min_by("line", "line_no").alias("title"), F.max(C("line").startswith("* omitted:")).alias("reduced"))
    e = _errors(lines).join(meta.select("circuit_id", "reduced"), "circuit_id")
    left = e.filter(~(C("reduced") & C("message").rlike(REDUCED_ALLOWED))).groupBy("circuit_id").agg(F.count("*").alias("n"))
    d = names.join(meta, "circuit_id").join(left, "circuit_id", "left")
    return d.select("circuit_id", C("name").rlike(r"^C\d+_D\d+\.cir$").alias("name_ok"),
                    (C("title") == F.concat(F.lit("* "), F.regexp_replace("name", r"\.cir$", ""))).alias("title_ok"),
                    F.coalesce("n", F.lit(0)).alias("remaining_errors"))


def signature(elements_: DataFrame, key: str) -> DataFrame:
    """Class counts and number of distinct nets over two-terminal elements: (key, prefix counts, nets)."""
    per = elements_.groupBy(key).agg(*[F.count_if(C("prefix") == p).alias("n_" + p) for p in ELEMENT_PREFIX.values()])
    nets = elements_.select(key, F.explode(F.array("n1", "n2")).alias("net")).distinct().groupBy(key).agg(F.count("*").alias("nets"))
    return per.join(nets, key)


def element_voltages(elements_: DataFrame, op: DataFrame) -> DataFrame:
    """(circuit_id, label, volts[]) with sorted voltages; a circuit with any unknown node has no rows."""
    lab = V.value_label(C("prefix"), C("num"), C("txt"))
    e = elements_.select("circuit_id", lab.alias("label"), "prefix", F.lower("n1").alias("n1"), F.lower("n2").alias("n2"))
    for k in ("1", "2"):
        e = e.join(op.select("circuit_id", C("node").alias("n" + k), C("volts").alias("o" + k)), ["circuit_id", "n" + k], "left")
        e = e.withColumn("v" + k, F.when(C("n" + k) == "0", 0.0).otherwise(C("o" + k)))
    diff = C("v1") - C("v2")
    v = F.when(C("prefix").isin("D", "V"), diff).otherwise(F.abs(diff))
    e = e.groupBy("circuit_id", "label").agg(F.sort_array(F.collect_list(v)).alias("volts"), F.bool_or(v.isNull()).alias("_lost"))
    e = e.withColumn("_lost", F.max("_lost").over(Window.partitionBy("circuit_id")))
    return e.filter("NOT _lost").drop("_lost")


def by_circuit(volts: DataFrame) -> DataFrame:
    """(circuit_id, labels): the voltages of a circuit as an array of (label, volts), in order of the labels."""
    return volts.groupBy("circuit_id").agg(F.sort_array(F.collect_list(F.struct("label", "volts"))).alias("labels"))


def same_voltages(a: Column, b: Column, rel: float = 1e-3, tol: float = 1e-6) -> Column:
    """Whether two arrays of by_circuit() have equal labels with equally many values, all within tolerance; false where one is missing."""
    near = lambda v, w: F.forall(F.zip_with(v, w, lambda x, y: F.abs(x - y) <= tol + rel * F.greatest(F.abs(x), F.abs(y))), lambda x: x)
    one = lambda x, y: x["label"].eqNullSafe(y["label"]) & (F.size(x["volts"]) == F.size(y["volts"])) & near(x["volts"], y["volts"])
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(one(x, y), F.lit(False))), lambda x: x), F.lit(False))


def voltages_match(pairs: DataFrame, volts: DataFrame, rel: float = 1e-3, tol: float = 1e-6) -> DataFrame:
    """pairs(circuit_id, ref_id) -> op_match: equal labels, equally many values, all within tolerance. A circuit may have several references."""
    per = cut(by_circuit(volts))
    d = pairs.join(per.withColumnRenamed("labels", "_a"), "circuit_id", "left").join(per.select(C("circuit_id").alias("ref_id"), C("labels").alias("_b")), "ref_id", "left")
    return d.select("circuit_id", "ref_id", same_voltages(C("_a"), C("_b"), rel, tol).alias("op_match"))
